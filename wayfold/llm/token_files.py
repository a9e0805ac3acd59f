"""Token ids in canonical Huffman coded block files."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType

from wayfold.llm.common import keep_table, shuffle_width
from wayfold.llm.tokens import word_ids

BLOCK_IDS = 1 << 16
CHECK_IDS = 64
STEP_IDS = 1 << 18
MAX_BITS = 16


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, levels = leaves, []
    for _ in range(limit - 1):
        levels.append(np.ones(len(row), dtype=bool) if not levels else flags)
        packs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packs])
        at = np.argsort(both, kind="stable")
        row, flags = both[at], at < len(leaves)
    levels.append(flags if limit > 1 else np.ones(len(row), dtype=bool))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.uint8)
    for flags in reversed(levels):
        n = int(flags[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes counted up by (length, id)."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def encode_ids(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bit stream of several texts (each starts at a byte), their byte offsets, bit offsets of every CHECK_IDS-th id."""
    first = np.concatenate([[0], np.cumsum(n)])
    ends = np.concatenate([[0], np.cumsum(lengths[ids], dtype=np.int64)])
    size = (ends[first[1:]] - ends[first[:-1]] + 7) // 8
    at = np.concatenate([[0], np.cumsum(size)])
    pos = ends[:-1] + np.repeat(at[:-1] * 8 - ends[first[:-1]], n)
    word = pos >> 5
    value = (codes << (64 - lengths.astype(np.int64)).astype(np.uint64))[ids] >> (pos & 31).astype(np.uint64)
    out = np.zeros(int(at[-1]) // 4 + 3, dtype=np.uint64)
    if len(ids):
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        # codes never share a bit, so sums are unions
        np.add.at(out, word[start], np.add.reduceat(value >> np.uint64(32), start))
        np.add.at(out, word[start] + 1, np.add.reduceat(value & np.uint64(0xFFFFFFFF), start))
    stretches = -(-n // CHECK_IDS)
    nth = np.arange(int(stretches.sum())) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    checks = pos[np.repeat(first[:-1], stretches) + CHECK_IDS * nth] - np.repeat(at[:-1] * 8, stretches)
    return out.astype(">u4").tobytes()[: int(at[-1])], at, checks


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, bits) for every string of ``width`` bits."""
    width = int(lengths.max()) if len(lengths) else 1
    ids = np.lexsort((np.arange(len(lengths)), lengths))
    ids = ids[lengths[ids] > 0]
    spans = 1 << (width - lengths[ids].astype(np.int64))
    table, bits = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.uint8)
    total = int(spans.sum())
    table[:total], bits[:total] = np.repeat(ids, spans), np.repeat(lengths[ids], spans)
    return table, bits, width


def decode_ids(payload: bytes, start_bits: np.ndarray, n: np.ndarray, table: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Ids of independent stretches (at most CHECK_IDS each), all stretches in step."""
    raw = np.frombuffer(payload + b"\0" * 4, dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-n, kind="stable")
    pos, left = start_bits[order].copy(), n[order]
    out = np.zeros((len(n), CHECK_IDS), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))
        p = pos[:live]
        key = (window[p >> 3] >> (32 - width - (p & 7)).astype(np.uint32)) & mask
        out[:live, step] = table[key]
        pos[:live] += bits[key]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back][np.arange(CHECK_IDS) < n[:, None]]


def _tokens(path: str, end_id: int, key: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        ids = word_ids(path)
        for b in batches:
            got = [np.frombuffer(x + end, dtype="<u4") for x in ids.encode([t or "" for t in b.column(1).to_pylist()])]
            wide = ids.tokenizer.get_vocab_size() > 1 << 16 or end_id > 0xFFFF
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([wide] * len(got)),
                pa.array([x.astype("<u4" if wide else "<u2").tobytes() for x in got], pa.binary()),
            ], names=[key, "n_tokens", "wide", "ids"])

    return run


def _read(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4" if w else "<u2") for w, x in zip(b.column("wide").to_pylist(), b.column("ids").to_pylist())]


def _slices(b: pa.RecordBatch):
    """(from, to, ids of each text) of a batch, about STEP_IDS at a time: bounds the arrays in work."""
    ids = _read(b)
    lo = total = 0
    for hi, x in enumerate(ids):
        total += len(x)
        if total >= STEP_IDS:
            yield lo, hi + 1, ids[lo:hi + 1]
            lo, total = hi + 1, 0
    if lo < len(ids):
        yield lo, len(ids), ids[lo:]


def _counts(batches):
    total = np.zeros(0, dtype=np.int64)
    for b in batches:
        for _, _, ids in _slices(b):
            c = np.bincount(np.concatenate(ids))
            total, c = (c, total) if len(c) > len(total) else (total, c)
            total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])


def _encode(lengths, codes, key: str):
    def run(batches):
        for b in batches:
            for lo, hi, ids in _slices(b):
                n = np.array([len(x) for x in ids], dtype=np.int64)
                stream, at, checks = encode_ids(np.concatenate(ids), n, lengths, codes)
                ends = np.cumsum(-(-n // CHECK_IDS))
                marks = [np.diff(x).astype("<u2").tobytes() for x in np.split(checks, ends[:-1])]
                at = at.tolist()
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array([stream[i:j] for i, j in zip(at, at[1:])], pa.binary()), pa.array(marks, pa.binary()),
                ], names=[key, "n_tokens", "payload", "checks"])

    return run


def _blocks(key: str, kind: pa.DataType):
    """Texts of a shard in order, gathered to blocks of about BLOCK_IDS ids that never cut a text."""
    def run(batches):
        held, ids, state = [], 0, {}

        def out():
            nonlocal held, ids
            shard = held[0][0]
            block, start = state.get(shard, (0, 0))
            state.clear()
            state[shard] = (block + 1, start + ids)
            row = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([ids], pa.int64()),
                pa.array([[r[1] for r in held]], pa.list_(kind)), pa.array([[r[2] for r in held]], pa.list_(pa.int64())),
                pa.array([[len(r[3]) for r in held]], pa.list_(pa.int64())), pa.array([b"".join(r[4] for r in held)], pa.binary()),
                pa.array([b"".join(r[3] for r in held)], pa.binary()),
            ], names=["shard", "block", "start", "ids", "keys", "n_tokens", "bytes", "checks", "payload"])
            held, ids = [], 0
            return row

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("shard", key, "n_tokens", "payload", "checks"))):
                if held and (r[0] != held[0][0] or ids + r[2] > BLOCK_IDS):
                    yield out()
                held.append(r)
                ids += r[2]
        if held:
            yield out()

    return run


def _cut_keys(rows: DataFrame, key: str, shards: int) -> list | None:
    """Keys that cut the table into about equal shards: quantiles of numbers, or those of about 100 keys a shard drawn by hash."""
    if isinstance(rows.schema[key].dataType, NumericType):
        return rows.agg(F.percentile_approx(key, [i / shards for i in range(1, shards)], 100 * shards)).first()[0]
    share = min(1.0, 100 * shards / max(1, rows.count())) * (1 << 20)
    # about 100 keys a shard
    drawn = sorted(r[0] for r in rows.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share)).select(key).distinct().collect())
    return [drawn[i * len(drawn) // shards] for i in range(1, shards)] if drawn else None


def write_token_files(
    pois: DataFrame, path: str, tokenizer: str, key: str = "poi_id", text: str = "address", end_id: int = 2,
) -> None:
    """Ids of whole texts (null: empty), each followed by ``end_id``, as Huffman coded files under ``path``.

    ``path/codes`` holds the canonical code lengths made from the ids' counts over
    all texts; ``path/blocks`` holds shards in ascending key order (null first,
    repeated keys by n_tokens, then by their bits).  A row of it is a block that can be
    decoded alone: its place among the ids, keys and sizes of its texts, the bit
    stream (a text starts at a byte) and bit offsets of every 64th id, as
    differences.  Spark commits the files, so a lost executor leaves no half block.
    """
    kind = pois.schema[key].dataType
    name = kind.simpleString()
    rows = keep_table(pois.select(key, text).mapInArrow(_tokens(tokenizer, end_id, key), f"`{key}` {name}, n_tokens bigint, wide boolean, ids binary"))
    got = rows.select("wide", "ids").mapInArrow(_counts, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in got], default=0) + 1, dtype=np.int64)
    for r in got:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark = pois.sparkSession
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    shards = shuffle_width(pois)
    cuts = _cut_keys(rows, key, shards) if shards > 1 else None
    # place among the cuts: how many of them are not above the key
    shard = F.lit(0) if not cuts else F.coalesce(F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col(key))), F.lit(0))
    coded = rows.mapInArrow(_encode(lengths, canonical_codes(lengths), key), f"`{key}` {name}, n_tokens bigint, payload binary, checks binary")
    dealt = coded.withColumn("shard", F.greatest(shard, F.lit(0)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", key, "n_tokens", "payload")
    from pyspark.sql.pandas.types import to_arrow_type

    dealt.mapInArrow(
        _blocks(key, to_arrow_type(kind)),
        f"shard int, block bigint, start bigint, ids bigint, keys array<{name}>, n_tokens array<bigint>, bytes array<bigint>, checks binary, payload binary",
    ).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, key: str = "poi_id") -> DataFrame:
    """Texts of token files: key, start (ids of all texts before it), n_tokens, ids_crc32 (little-endian unsigned 32-bit ids)."""
    lengths_of = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codes").collect()}
    lengths = np.zeros(max(lengths_of, default=0) + 1, dtype=np.uint8)
    for i, n in lengths_of.items():
        lengths[i] = n
    table, bits, width = decode_table(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum("ids").alias("ids"))
    before = sizes.select("shard", F.coalesce(
        F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            keys, start, count, crc = [], [], [], []
            cols = ("start", "before", "keys", "n_tokens", "bytes", "checks", "payload")
            for at, shift, ks, n, size, checks, payload in zip(*(b.column(c).to_pylist() for c in cols)):
                n = np.array(n, dtype=np.int64)
                stretches = -(-n // CHECK_IDS)
                gaps = np.frombuffer(checks, "<u2").astype(np.int64)
                first = np.concatenate([[0], np.cumsum(stretches)])[:-1]
                step = np.zeros(int(stretches.sum()), dtype=np.int64)
                inner = np.ones(len(step), dtype=bool)
                inner[first] = False
                step[inner] = gaps
                run_bits = np.cumsum(step)
                base = np.concatenate([[0], np.cumsum(size)])[:-1] * 8
                pos = run_bits + np.repeat(base - run_bits[first], stretches)
                nth = np.arange(len(step)) - np.repeat(first, stretches)
                left = np.minimum(CHECK_IDS, np.repeat(n, stretches) - CHECK_IDS * nth)
                raw = decode_ids(payload, pos, left, table, bits, width).astype("<u4").tobytes()
                ends = np.concatenate([[0], np.cumsum(n)])
                keys += ks
                count += n.tolist()
                start += (ends[:-1] + at + shift).tolist()
                crc += [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.column("keys").type.value_type), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(before), "shard").select("start", "before", "keys", "n_tokens", "bytes", "checks", "payload").mapInArrow(
        run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
