"""Exact similarity join on word shingles with token-combination prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayfold.llm.common import WordHashes, golomb_pack, golomb_unpack, shuffle_width, text_bytes, words
from wayfold.operators.network import weak_components
from wayfold.runtime import spool

SHINGLE, PERCENT = 5, 80
BLOCK_TOKENS = 1 << 22
RARE = 24
MAX_FREQUENT = 1 << 22
BROADCAST_ROWS = 1 << 20
LONG_LIST, FAMILY_BLOCK, COLUMNS = 32, 1024, 2048
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_WIDE = np.uint64((1 << 48) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted 48-bit hashes of the distinct shingles; a shorter text is one shingle, an empty one has none."""
    w = hashes.of(words(text))
    if len(w) == 0:
        return w
    if len(w) < SHINGLE:
        h = _mix((w * _FACTORS[:len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    else:
        m = len(w) - SHINGLE + 1
        h = w[:m] * _FACTORS[0]
        for i in range(1, SHINGLE):
            h += w[i:m + i] * _FACTORS[i]
        h = _mix(h)
    return np.unique(h & _WIDE)


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _classes(bits: int, owners: int):
    """Size and class of equal sets of each text; and, for the first text of a class in a partition,
    sorted bucket numbers of its shingles, Golomb-coded, cut by owner."""
    def run(batches):
        hashes, seen, held, n_held = WordHashes(), set(), [], 0

        def rows(keys, n, cls, own, codes):
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(own, pa.int32()), pa.array(codes, pa.binary())],
                names=["key", "n", "class", "owner", "codes"])

        def counts():
            v = np.sort(np.concatenate(held) >> np.uint64(48 - bits))
            edges = np.searchsorted(v, np.array([(i << bits) // owners for i in range(1, owners)], dtype=np.uint64))
            parts = [(o, golomb_pack(x)) for o, x in enumerate(np.split(v, edges)) if len(x)]
            none = [None] * len(parts)
            return rows(pa.array(none, kind), none, none, [o for o, _ in parts], [c for _, c in parts])

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            n, cls = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, hashes)
                n.append(len(s))
                cls.append(class_of(s))
                if len(s) and cls[-1] not in seen:
                    _remember(seen, cls[-1])
                    held.append(s)
                    n_held += len(s)
                    if n_held >= BLOCK_TOKENS:
                        yield counts()
                        held, n_held = [], 0
            none = [None] * len(n)
            yield rows(b.column(0), n, cls, none, none)
        if n_held:
            yield counts()

    return run


def class_of(s: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _remember(seen: set, c: int) -> None:
    if len(seen) > 1 << 21:
        seen.clear()
    seen.add(c)


def _bodies(batches):
    """Class and shingles of texts; the first of a class in a partition."""
    hashes, seen = WordHashes(), set()
    for b in batches:
        cls, blobs = [], []
        for t in b.column(0).to_pylist():
            s = shingle_set(t, hashes)
            c = class_of(s)
            if c is not None and c not in seen:
                _remember(seen, c)
                cls.append(c), blobs.append(_packed(s))
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(blobs, pa.binary())], names=["class", "shingles"])


def _often(table: pa.Table) -> pa.Table:
    v, c = np.unique(np.concatenate([golomb_unpack(x) for x in table.column("codes").to_pylist()]), return_counts=True)
    keep = c >= RARE
    return pa.table({"bucket": pa.array(v[keep].astype(np.int64)), "n": pa.array(c[keep].astype(np.int64))})


def frequent_buckets(codes: DataFrame) -> np.ndarray:
    """Sorted buckets (leading bits of shingle hashes) that at least RARE sets hold.

    At most MAX_FREQUENT are told apart: where there would be more, the limit
    rises to the count that leaves so many.  Any split gives whole results, as it
    only fixes the order in which shingles enter a prefix.
    """
    often = spool(codes.groupBy("owner").applyInArrow(_often, "bucket bigint, n bigint"))
    limit = 0
    if often.count() > MAX_FREQUENT:
        by = often.groupBy(F.ceil(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()
        total = 0
        for r in by:
            total += r["n"]
            if total > MAX_FREQUENT:
                limit = (1 << int(r["b"])) + 1
                break
    got = often.filter(F.col("n") >= limit).select("bucket").toPandas()["bucket"].to_numpy()
    return np.sort(got.astype(np.uint64))


def prefix_keys(s: np.ndarray, frequent: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Index keys of a set, rare shingles of its prefix and pairs of neighbouring frequent ones; and how many keys it asks a partner to share.

    Order: rare shingles by hash, then frequent ones.  Of a linked pair's at least
    a = ceil(0.8 n) common shingles the k-th is among the first n - a + k of both, so
    prefixes extended by k - 1 share k of them; each set takes k as a twentieth of its
    size.  A set whose extended prefix is all rare asks for k keys, any other
    for one.  Where no rare shingle is common, all c >= 0.8 u common ones (u: size
    of the union) are frequent, and the D = u - c others cut them into at most D + 1
    runs; neighbours in a run are neighbours in both sets, so at least
    c - D - 1 >= 0.6 n - 1 combinations of two are shared, and a prefix of the
    combinations (by their hash) holds one.
    """
    n = len(s)
    need = -(-PERCENT * n // 100)
    k = 1 + n // 20
    bucket = s >> np.uint64(48 - bits)
    at = np.searchsorted(frequent, bucket)
    often = np.zeros(n, dtype=bool)
    ok = at < len(frequent)
    often[ok] = frequent[at[ok]] == bucket[ok]
    rare, many = s[~often], s[often]
    keys = rare[:n - need + k]
    asks = k if len(rare) >= n - need + k else 1
    if len(many) >= max(need, 2):
        pairs = np.unique(_mix(many[:-1] * _FACTORS[0] + many[1:] * _FACTORS[1]) >> np.uint64(8))
        shared = max(1, -(-(2 * PERCENT - 100) * n // 100) - 1)
        keys = np.concatenate([keys, pairs[:max(0, len(pairs) - shared + 1)] | np.uint64(1 << 60)])
    return keys, asks


def _postings(shared, bits: int, owners: int):
    """Keys of a partition's sets by owner: sorted keys; class, size and shared keys asked for at each."""
    def run(batches):
        frequent, hashes, seen = shared.value, WordHashes(), set()
        def out(held):
            counts = [len(h[0]) for h in held]
            keys = np.concatenate([h[0] for h in held])
            which = np.repeat(np.arange(len(held), dtype=np.uint16), counts)
            own = (_mix(keys) % np.uint64(owners)).astype(np.int32)
            order = np.lexsort((keys, own))
            keys, which, own = keys[order], which[order], own[order]
            edges = np.searchsorted(own, np.arange(owners + 1))
            sets = np.array([h[1:] for h in held], dtype="<i8").tobytes()
            rows = [(o, golomb_pack(keys[a:b]), which[a:b].tobytes(), sets) for o, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)),
            ], names=["owner", "codes", "which", "sets"])
        held, total = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingle_set(t, hashes)
                c = class_of(s)
                if c is None or c in seen:
                    continue
                _remember(seen, c)
                k, asks = prefix_keys(s, frequent, bits)
                held.append((k, c, len(s), asks))
                total += len(k)
                if total >= BLOCK_TOKENS >> 1 or len(held) == 0xFFFF:
                    yield out(held)
                    held, total = [], 0
        if total:
            yield out(held)
    return run


def _lists(table: pa.Table) -> pa.Table:
    """Distinct lists of classes that share a key, ordered by size and class, and the number of such keys."""
    keys = np.concatenate([golomb_unpack(x) for x in table.column("codes").to_pylist()])
    sets = np.concatenate([
        np.frombuffer(t, "<i8").reshape(-1, 3)[np.frombuffer(w, np.uint16)]
        for w, t in zip(table.column("which").to_pylist(), table.column("sets").to_pylist())])
    # keys met once name nobody
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    keys, sets = keys[many], sets[order[many]]
    order = np.lexsort((sets[:, 0], sets[:, 1], keys))
    keys, sets = keys[order], sets[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sets[1:, 0] != sets[:-1, 0])
    keys, sets = keys[new], sets[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    seen: dict[bytes, list] = {}
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a > 1:
            seen.setdefault(sets[a:b, 0].tobytes(), [a, b, 0])[2] += 1
    found = list(seen.values())
    lists = lambda i, kind: pa.array([sets[a:b, i] for a, b, _ in found], pa.list_(kind))
    return pa.table({
        "ids": lists(0, pa.int64()), "sizes": lists(1, pa.int64()), "asks": lists(2, pa.int64()), "keys": pa.array([x[2] for x in found], pa.int64())})


def _verify(batches):
    for b in batches:
        a, c, x, y = (b.column(i).to_pylist() for i in range(4))
        cache: dict[int, np.ndarray] = {}
        u, v = [], []
        for p, q, s, t in zip(a, c, x, y):
            if p not in cache:
                cache = {p: _unpacked(s)}
            s, t = cache[p], _unpacked(t)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= PERCENT * (len(s) + len(t) - both):
                u.append(p), v.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def linked_pairs(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Those pairs (u, v) of classes whose sets reach the limit."""
    left = pairs.join(bodies.select(F.col("class").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(bodies.select(F.col("class").alias("v"), F.col("shingles").alias("b")), "v")
    return spool(both.select("u", "v", "a", "b").mapInArrow(_verify, "u bigint, v bigint"))


def _possible(rows: DataFrame) -> DataFrame:
    """Pairs whose sizes are within reach and whose lists hold as many keys as both ask for: u, v, keys."""
    near = rows.filter(F.col("n1") * 100 >= F.col("n2") * PERCENT)
    return near.groupBy("u", "v").agg(F.sum("keys").alias("keys"), F.min(F.least("k1", "k2")).alias("k")).filter("keys >= k").select("u", "v", "keys")


def _members(lists: DataFrame) -> DataFrame:
    at = lambda c: F.col(c)[F.col("i")]
    return lists.select("list", "keys", F.posexplode("ids").alias("i", "class"), "sizes", "asks").select(
        "list", "keys", "i", "class", at("sizes").alias("n"), at("asks").alias("k"))


def _cross_pairs(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """Possible pairs of lists' members that the links so far leave apart.

    Lists that lie in one component, as those inside a group of copies do, make none.
    """
    named = _members(lists).join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    open_lists = named.groupBy("list").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("list")
    m = spool(named.join(open_lists, "list", "left_semi"))
    a = m.select("list", "keys", F.col("i").alias("i1"), F.col("class").alias("u"), F.col("n").alias("n1"), F.col("k").alias("k1"), F.col("part").alias("p1"))
    b = m.select("list", F.col("i").alias("i2"), F.col("class").alias("v"), F.col("n").alias("n2"), F.col("k").alias("k2"), F.col("part").alias("p2"))
    return _possible(a.join(b, "list").filter("i1 < i2 AND p1 <> p2"))


def _compare(table: pa.Table) -> pa.Table:
    """Links between the sets of two blocks of a family, as one edge from each set to the least one it is joined with.

    Common shingles are counted for all pairs at once, as products of 0/1 matrices.
    """
    cls, blk = table.column("class").to_numpy(), table.column("blk").to_numpy()
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    order = np.argsort(cls)
    cls, blk = cls[order], blk[order]
    bodies = table.column("shingles").to_pylist()
    sets = [_unpacked(bodies[i]) for i in order]
    n = np.array([len(x) for x in sets], dtype=np.float32)
    tokens, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    often = np.bincount(col) > 1
    keep = often[col]
    row, col = row[keep], (np.cumsum(often) - 1)[col[keep]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    a, b = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    for first in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(col, [first, first + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        m[row[i:j], col[i:j] - first] = 1
        common += m[a] @ m[b].T
    linked = 100 * common >= PERCENT * (n[a][:, None] + n[b][None, :] - common)
    label = np.arange(len(sets))
    while True:
        far = len(sets)
        down = np.minimum(label[a], np.where(linked, label[b][None, :], far).min(axis=1, initial=far))
        new = label.copy()
        new[a] = down
        new[b] = np.minimum(new[b], np.where(linked, down[:, None], far).min(axis=0, initial=far))
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return pa.table({"u": pa.array(cls[label[moved]]), "v": pa.array(cls[moved])})


def _family_links(lists: DataFrame, parts: DataFrame, bodies: DataFrame) -> DataFrame:
    """Joins inside families: classes that long lists chain together.

    A family is dealt to blocks of bounded size, and every two blocks are compared
    in one task; no row stands for a pair that does not link.
    """
    named = _members(lists).join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    open_lists = named.groupBy("list").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("list")
    chains = named.filter("i > 0").join(open_lists, "list", "left_semi").join(lists.select("list", F.col("ids")[0].alias("u")), "list")
    family = spool(weak_components(chains.select("u", F.col("class").alias("v")).distinct()).select(F.col("node").alias("class"), F.col("component").alias("family")))
    sizes = spool(family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).cast("int").alias("blocks")))
    dealt = family.join(sizes, "family").withColumn("blk", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = dealt.withColumn("o", other).select("family", "class", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))
    return spool(tasks.join(bodies, "class").groupBy("family", "lo", "hi").applyInArrow(_compare, "u bigint, v bigint"))


def near_groups(pois: DataFrame, key: str = "poi_id", text: str = "address") -> DataFrame:
    """Groups of records whose texts share at least 80 % of their five-word shingles (Jaccard).

    Equal sets form one class.  Shingles that many sets hold are counted exactly
    by hash bucket; each class is indexed by the rare shingles of its prefix and
    by combinations of neighbouring frequent ones (:func:`prefix_keys`).  Each
    class is compared with one other that shares most keys; then, wherever
    the links found leave a list of sharers in several components, its possible pairs
    between components are compared too, so no link between components is lost
    and a group of copies of any size costs one comparison for each member.  Long lists
    that stay apart are compared by blocks instead (:func:`_family_links`).  All
    comparisons are on the whole sets of 48-bit shingle hashes.

    Returns one row for each input row: key, n_shingles, component_id (smallest
    key reachable, itself included).  Null or empty texts and texts without words
    have no shingles and link with nothing; rows without a key keep a null
    component unless a linked record has one.  Repeated rows are in one component.
    """
    kind = pois.schema[key].dataType.simpleString()
    texts = pois.select(text_bytes(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one shingle for every six bytes; twice as many buckets or more
    bits = min(46, max(20, (int(size) // 3).bit_length()))
    owners = shuffle_width(pois)
    sets = spool(pois.select(F.col(key).alias("key"), text_bytes(text).alias("text")).mapInArrow(
        _classes(bits, owners), f"key {kind}, n bigint, class bigint, owner int, codes binary"))
    frequent = pois.sparkSession.sparkContext.broadcast(frequent_buckets(sets.filter("owner IS NOT NULL").select("owner", "codes")))
    sets = sets.filter("owner IS NULL").select("key", "n", "class")
    posted = texts.mapInArrow(_postings(frequent, bits, owners), "owner int, codes binary, which binary, sets binary")
    found = spool(posted.groupBy("owner").applyInArrow(_lists, "ids array<bigint>, sizes array<bigint>, asks array<bigint>, keys bigint"))
    lists = spool(found.groupBy("ids").agg(F.first("sizes").alias("sizes"), F.first("asks").alias("asks"), F.sum("keys").alias("keys")).withColumn(
        "list", F.monotonically_increasing_id()))
    wanted = spool(lists.select(F.explode("ids").alias("class")).distinct())
    few = wanted.count() <= BROADCAST_ROWS
    bodies = texts.mapInArrow(_bodies, "class bigint, shingles binary").join(F.broadcast(wanted) if few else wanted, "class", "left_semi")
    # equal sets of several partitions: one of each is enough
    bodies = spool(bodies.groupBy("class").agg(F.first("shingles").alias("shingles")))
    # each class with the first member of lists that it shares most keys with: joins most groups of copies
    stars = _possible(_members(lists).filter("i > 0").select("list", F.col("class").alias("v"), F.col("n").alias("n2"), F.col("k").alias("k2"), "keys").join(
        lists.select("list", F.col("ids")[0].alias("u"), F.col("sizes")[0].alias("n1"), F.col("asks")[0].alias("k1")), "list"))
    firsts = spool(stars.groupBy("v").agg(F.max_by("u", F.struct("keys", -F.col("u"))).alias("u")).select("u", "v"))
    first = linked_pairs(firsts, bodies)
    parts = spool(weak_components(first).select(F.col("node").alias("class"), F.col("component").alias("part")))
    short, long = lists.filter(F.size("ids") <= LONG_LIST), lists.filter(F.size("ids") > LONG_LIST)
    rest = spool(_cross_pairs(short, parts).select("u", "v").join(firsts, ["u", "v"], "left_anti"))
    links = first if rest.isEmpty() else first.unionByName(linked_pairs(rest, bodies))
    if not long.isEmpty():
        links = links.unionByName(_family_links(long, parts, bodies))
    whole = spool(weak_components(links).select(F.col("node").alias("class"), F.col("component").alias("part")))
    rows = sets.select("key", "n", "class").join(whole, "class", "left").withColumn("part", F.coalesce("part", "class"))
    rows = spool(rows)
    low = rows.filter("part IS NOT NULL").groupBy("part").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(spool(low), "part", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("low", "key").alias("component_id"))


def without_copies(records: DataFrame, groups: DataFrame, key: str = "poi_id") -> DataFrame:
    """One record of each group of :func:`near_groups`, the one with the smallest key; all columns stay.

    Rows that share a key, or have none, stay or go together.
    """
    marks = groups.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_gone")).agg(
        F.max(F.col("component_id") == F.col(key)).alias("_stays")).filter("NOT _stays").select("_gone")
    return records.join(spool(marks), F.col(key) == F.col("_gone"), "left_anti")
