"""Sum-of-squares packing of token pieces into training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayfold.llm.tokens import word_ids
from wayfold.runtime import spool

SHARD_PIECES = 8192
FULL_SHARE = 0.99


def pieces(pois: DataFrame, tokenizer: str, key: str = "poi_id", text: str = "address", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Token pieces of whole texts: key, piece, start, length, ids_crc32.

    Ids of the text (null: empty) and ``end_id``; only longer ones are cut, into
    pieces of ``capacity``.
    """
    kind = pois.schema[key].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        ids = word_ids(tokenizer)
        for b in batches:
            out = ([], [], [], [], [])
            for i, blob in enumerate(ids.encode([t or "" for t in b.column(1).to_pylist()])):
                blob += end
                for j, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at:at + 4 * capacity]
                    for o, v in zip(out, (i, j, at // 4, len(part) // 4, zlib.crc32(part))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(o, pa.int64()) for o in out[2:])],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return pois.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed in the given order.

    ``open_bins[g]`` counts open bins with residual gap g.  Every piece goes where
    the sum of the squared counts becomes smallest; ties prefer the tightest
    gap, then an open bin over a new one.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    stack: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    new = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:capacity])
        best = None
        if len(gaps):
            # moving a bin from gap g to g - s: (c_g - 1)^2 - c_g^2 + (c_{g-s} + 1)^2 - c_{g-s}^2, gap 0 counts nothing
            after = 2 * count[gaps] + 1
            after[gaps == 0] = 0
            change = after - 2 * count[gaps + s] + 1
            j = int(np.argmin(change))
            best, g = int(change[j]), int(gaps[j]) + s
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if best is not None and best <= fresh:
            b = stack[g].pop()
            count[g] -= 1
        else:
            b, g, new = new, capacity, new + 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            stack[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def _pack(capacity: int, level: int, carry: bool):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("tie").to_numpy(), -length))
        table, length = table.take(pa.array(order)), length[order]
        bins, offsets = sum_of_squares(length, capacity)
        fill = np.bincount(bins, weights=length)
        seq = bins + (shard << 24) + (level << 56)
        again = (fill[bins] < FULL_SHARE * capacity) & carry
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq, pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64())).append_column("again", pa.array(again))

    return run


def pack_pieces(parts: DataFrame, key: str = "poi_id", capacity: int = 2048) -> DataFrame:
    """Sequences of at most ``capacity`` tokens for the rows of :func:`pieces`.

    Pieces are spread by hash over shards of bounded size, each packed by the
    sum-of-squares rule, longest first.  Pieces of sequences that stay
    noticeably unfilled go, all together, into a next round with fewer shards;
    the last round keeps everything.  No shard depends on a key's frequency.

    Returns the given columns, sequence_id and offset (gapless from 0).  Repeated
    rows are packed as often as they occur; an empty table gives no rows.
    """
    rest = spool(parts.select("*", F.xxhash64(F.col(key).cast("string"), "piece", "ids_crc32").alias("tie")))
    names, level, done = parts.columns, 0, None
    n = rest.count()
    while True:
        shards = max(1, -(-n // SHARD_PIECES))
        carry = shards > 1 and level < 6
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("tie", F.lit(level), F.monotonically_increasing_id()), F.lit(shards)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id bigint, offset bigint, again boolean"
        packed = spool(dealt.groupBy("shard").applyInArrow(_pack(capacity, level, carry), schema))
        placed = packed.filter("not again").select(*names, "sequence_id", "offset")
        done = placed if done is None else done.unionByName(placed)
        if not carry:
            return done
        rest = packed.filter("again").drop("again", "sequence_id", "offset")
        n = rest.count()
        if n == 0:
            return done
        level += 1


def pack_sequences(
    pois: DataFrame, tokenizer: str, key: str = "poi_id", text: str = "address", end_id: int = 0, capacity: int = 2048,
) -> DataFrame:
    """Whole texts of points, tokenized and packed into training sequences.

    Returns, for each piece: key, piece, start, length, ids_crc32, sequence_id,
    offset.  Null and empty texts give one piece with the end id alone; other
    columns are not read.  See :func:`pieces` and :func:`pack_pieces`.
    """
    return pack_pieces(pieces(pois, tokenizer, key, text, end_id, capacity), key, capacity)
