"""How far the sources of a region differ in their words: exact term counts by sorted word pointers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wayfold.llm.common import shuffle_width, text_bytes
from wayfold.runtime import spool

SLICE_BYTES = 1 << 23
CELLS = 1 << 18
SHARE = 1_000_000_000

# bytes of terms: A-Z and a-z (lower-cased) and all of characters beyond ASCII; 0 ends a term
_LOW = np.zeros(256, dtype=np.uint8)
_LOW[0x80:] = np.arange(0x80, 0x100)
_LOW[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOW[0x41:0x5B] = np.arange(0x61, 0x7B)
#: leaves the first n of 8 bytes of a big-endian number
_FIRST = np.array([0] + [(1 << 64) - (1 << 64 - 8 * n) for n in range(1, 9)], dtype=np.uint64)


def word_pointers(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every term in a buffer of texts; a term never runs from one text into the next."""
    n = len(low)
    inside = low != 0
    start, end = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    start[:n] = inside
    start[1:n] &= ~inside[:-1]
    end[1:] = inside
    end[1:n] &= ~inside[1:]
    at = offsets[:-1][np.diff(offsets) > 0]
    start[at[inside[at]]] = True
    at = at[at > 0]
    end[at[inside[at - 1]]] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def sort_words(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms' bytes, and the run of equal terms that each belongs to.

    Multikey quicksort with 8 bytes as one character: pointers are sorted by the character at the depth reached; slices that are equal and
    go on are sorted by the next one, all open slices of a depth in one pass.
    """
    padded = np.concatenate([low, np.zeros(8, dtype=np.uint8)])
    loads = np.ndarray(len(low) + 1, dtype=">u8", buffer=padded, strides=(1,))

    def character(which, depth):
        left = np.clip(end[which] - start[which] - depth, 0, 8)
        return loads[np.minimum(start[which] + depth, len(low))].astype(np.uint64) & _FIRST[left]

    m = len(start)
    keys = character(slice(None), 0)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(m, dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    full = np.flatnonzero(keys & np.uint64(0xFF))
    depth = 8
    while len(full):
        slices = np.cumsum(new)[full]
        some = order[full]
        keys = character(some, depth)
        again = np.lexsort((keys, slices))
        order[full] = some[again]
        keys = keys[again]
        new[full[1:]] |= (keys[1:] != keys[:-1])
        full = full[(keys & np.uint64(0xFF)) != 0]
        depth += 8
    return order, np.cumsum(new) - 1


def slice_counts(low: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """(term bytes, their offsets, run, group, occurrences, texts) of a slice of texts, from the equal runs of its sorted pointers."""
    start, end = word_pointers(low, offsets)
    order, run = sort_words(low, start, end)
    docs = len(group)
    by_group = np.argsort(group, kind="stable")
    rank = np.empty(docs, dtype=np.int64)
    rank[by_group] = np.arange(docs)
    doc = np.searchsorted(offsets, start, side="right") - 1
    # run and text as one number: equal numbers are one term's occurrences in one text
    both = run * docs + rank[doc][order]
    both.sort()
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.r_[first, len(both)])
    run_of, group_of = both[first] // docs if docs else first, group[by_group[both[first] % docs]] if docs else first
    head = np.flatnonzero(np.r_[True, (run_of[1:] != run_of[:-1]) | (group_of[1:] != group_of[:-1])]) if len(first) else first
    lead = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])] if len(run) else order
    size = end[lead] - start[lead]
    ends = np.cumsum(size)
    text = low[np.repeat(start[lead] - (ends - size), size) + np.arange(int(size.sum()))]
    n = np.add.reduceat(times, head) if len(head) else times
    return text, np.r_[0, ends], run_of[head], group_of[head], n, np.diff(np.r_[head, len(first)])


def _terms(batches):
    """(region and group numbers, term, occurrences, texts) of bounded slices of texts."""
    for b in batches:
        texts = b.column(0)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        region, group = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        lo = 0
        while lo < len(texts):
            # whole texts up to the bound, a longer one alone
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
            low = _LOW[data[offsets[lo]:offsets[hi]]]
            text, ends, run, part, n, docs = slice_counts(low, offsets[lo:hi + 1] - offsets[lo], group[lo:hi])
            of = np.zeros(int(group[lo:hi].max()) + 1, dtype=np.int32)
            of[group[lo:hi]] = region[lo:hi]
            terms = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([
                pa.array(of[part], pa.int32()), pa.array(part.astype(np.int32)), terms.take(pa.array(run)), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64)),
            ], names=["region", "grp", "term", "n", "docs"])
            lo = hi


def share(count: np.ndarray, total) -> np.ndarray:
    """floor(SHARE * count / total), exact for totals below 9e15 (long division, three digits at a time)."""
    rest, out = np.asarray(count, dtype=np.int64), 0
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out


def _divergence(p, q):
    return (p - q) * (p - q) // q


def _compare(groups: dict[int, tuple], totals: dict[int, tuple]):
    """Sums of divergences to other sources over terms, as differences from terms without occurrences, and terms' own values.

    ``groups``: region -> (numbers of its groups, their denominators); ``totals``: region -> denominator.
    """
    def pairs(sums):
        rows = [(r, i, j) for r, s in sums.items() for i, j in zip(*np.nonzero(s))]
        names = [np.asarray([groups[r][0][x] for r, *ij in rows for x in (ij[k],)], dtype=np.int32) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([
            pa.array(names[0], pa.int32()), pa.array(names[1], pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array([int(sums[r][i, j]) for r, i, j in rows], pa.int64()),
        ], names=["grp", "other", "term", "value"])

    def run(batches):
        sums = {}
        for b in batches:
            regions = b.column(0).to_numpy(zero_copy_only=False)
            lists, counts = b.column(2), b.column(3)
            first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            member, count = lists.flatten().to_numpy(), counts.flatten().to_numpy()
            for r in np.unique(regions).tolist():
                names, under = groups[r]
                place = np.zeros(int(names.max()) + 1, dtype=np.int64)
                place[names] = np.arange(len(names))
                zero = 1 + share(np.ones(len(names), dtype=np.int64), under)
                base = _divergence(zero[:, None], zero[None, :])
                total = sums.setdefault(r, np.zeros((len(names), len(names)), dtype=np.int64))
                all_rows = np.flatnonzero(regions == r)
                step = max(1, CELLS // len(names))
                for lo in range(0, len(all_rows), step):
                    rows = all_rows[lo:lo + step]
                    size = first[rows + 1] - first[rows]
                    at = np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    table = np.zeros((len(rows), len(names)), dtype=np.int64)
                    table[np.repeat(np.arange(len(rows)), size), place[member[at]]] = count[at]
                    p = 1 + share(table + 1, under)
                    whole = table.sum(axis=1)
                    q = 1 + share(whole + 1, totals[r])
                    for i in range(len(names)):
                        here = np.flatnonzero(table[:, i])
                        own = p[here, i]
                        total[i] += _divergence(own[:, None], p[here]).sum(axis=0) - len(here) * base[i]
                        # other sources without the term, against this one that has it
                        gap = _divergence(zero[None, :], own[:, None]) - base[None, :, i]
                        total[:, i] += np.where(table[here] == 0, gap, 0).sum(axis=0)
                        more = own > q[here]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(int(more.sum()), names[i]), pa.int32()), pa.nulls(int(more.sum()), pa.int32()),
                            b.column(1).take(pa.array(rows[here[more]])), pa.array(_divergence(own, q[here])[more]),
                        ], names=["grp", "other", "term", "value"])
            if sum(s.size for s in sums.values()) > 4 * CELLS:
                yield pairs(sums)
                sums = {}
        yield pairs(sums)

    return run


def audit_divergence(
    pois: DataFrame, text: str = "address", region: str = "province", source: str = "dataset_id", *, least_docs: int = 3, top: int = 200,
) -> DataFrame:
    """How the datasets (sources) of each province differ in the words of their points.

    Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII.  A region keeps the V terms that are in at least ``least_docs`` of its texts.  A group (region, source), and a
    region as a whole, gives each kept term with ``count`` occurrences there the share p = 1 + floor(1e9 (count + 1) / (N + V)), N being the sum of its counts
    of kept terms; the divergence of p from q is floor((p - q)^2 / q), in whole numbers throughout.

    Returns region, source, part, item, value, rank.  Part ``pair``: for each other source of the region the
    divergence from it, summed over all kept terms (0 if none are kept).  Part ``term``: the ``top`` terms of the group with
    the largest divergence from the whole region, of those that occur and have a larger share than there.  Rank: value descending, then item
    ascending as UTF-8 bytes.

    Null text, region and source count as ''; each text is one document, also of repeated rows; an empty table gives no rows; other columns are not read.
    Every task takes the list of groups (two of a region's groups are a row of the report, so these are datasets, not points).
    """
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (region, source)]
    named = sorted(tuple(r) for r in pois.select(*place).distinct().collect())
    regions = {r: i for i, r in enumerate(sorted({r for r, _ in named}))}
    spark = pois.sparkSession
    numbered = spark.createDataFrame([(r, s, regions[r], i) for i, (r, s) in enumerate(named)], f"`{region}` string, `{source}` string, _r int, _g int")
    rows = pois.select(text_bytes(text).alias("_t"), *place).join(F.broadcast(numbered), [region, source]).select("_t", "_r", "_g")
    # a slice has one row for each term and group; a key has at most as many rows as there are slices times groups
    counts = rows.mapInArrow(_terms, "region int, grp int, term binary, n bigint, docs bigint").repartition(shuffle_width(pois), "region", "term")
    counts = counts.groupBy("region", "grp", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = spool(counts.groupBy("region", "term").agg(
        F.collect_list("grp").alias("groups"), F.collect_list("n").alias("counts"), F.sum("docs").alias("docs"),
    ).filter(F.col("docs") >= least_docs).select("region", "term", "groups", "counts"))

    terms = {r["region"]: r["v"] for r in kept.groupBy("region").agg(F.count(F.lit(1)).alias("v")).collect()}
    single = kept.select(F.explode(F.arrays_zip("groups", "counts")).alias("x")).select("x.groups", "x.counts")
    sizes = {r[0]: r[1] for r in single.groupBy("groups").agg(F.sum("counts")).collect()}
    groups, totals = {}, {}
    for r, name in enumerate(regions):
        own = [i for i, x in enumerate(named) if x[0] == name]
        v = terms.get(r, 0)
        # without kept terms nothing is compared
        groups[r] = np.array(own, dtype=np.int64), np.array([max(1, sizes.get(i, 0) + v) for i in own], dtype=np.int64)
        totals[r] = max(1, sum(sizes.get(i, 0) for i in own) + v)
    found = spool(kept.mapInArrow(_compare(groups, totals), "grp int, other int, term binary, value bigint"))

    zeros = [(i, r, terms.get(r, 0), int(1 + share(1, d))) for r, (own, under) in groups.items() for i, d in zip(own.tolist(), under.tolist())]
    zero = spark.createDataFrame(zeros, "g int, r int, v long, p long")
    a, b = zero.alias("a"), zero.alias("b")
    gap = F.col("a.p") - F.col("b.p")
    table = a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.g") != F.col("b.g"))).select(
        F.col("a.g").alias("grp"), F.col("b.g").alias("other"), (F.col("a.v") * F.call_function("div", gap * gap, F.col("b.p"))).alias("base"))
    sums = found.filter("term is null").groupBy("grp", "other").agg(F.sum("value").alias("more"))
    names = numbered.select(F.col("_g").alias("grp"), region, source)
    pair = table.join(sums, ["grp", "other"], "left").join(
        F.broadcast(numbered.select(F.col("_g").alias("other"), F.col(source).alias("item"))), "other",
    ).select("grp", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))
    term = found.filter("term is not null").select("grp", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("grp").orderBy(F.col("value").desc(), "item")
    ranked = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).unionByName(pair.withColumn("rank", F.row_number().over(order)))
    return ranked.join(F.broadcast(names), "grp").select(region, source, "part", "item", "value", F.col("rank").cast("int").alias("rank"))
