"""Groups of equal texts by an exchange of compressed fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wayfold.llm.common import golomb_pack, golomb_unpack, shuffle_width, text_bytes
from wayfold.runtime import spool

BLOCK_ROWS = 1 << 20
_SIGN = np.uint64(1 << 63)


def _fingerprints(batches):
    for b in batches:
        low = [t.lower() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in low], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in low], pa.string()),
        ], names=["key", "fp", "text_sha256"])


def _lowered(batches):
    for b in batches:
        low = [t.lower() for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in low], pa.int64()), pa.array(low, pa.binary()),
        ], names=["fp", "body"])


def _send(owners: int):
    """Blocks of a partition's sorted distinct fingerprints, cut by owner; bits mark those met twice inside the block."""
    from pyspark import TaskContext

    def cut(fps: np.ndarray, block: int):
        values, counts = np.unique(fps, return_counts=True)
        edges = np.searchsorted(values, np.array([(i << 64) // owners for i in range(1, owners)], dtype=np.uint64))
        for o, (v, c) in enumerate(zip(np.split(values, edges), np.split(counts, edges))):
            if len(v):
                yield block, o, golomb_pack(v), np.packbits(c > 1).tobytes()

    def run(batches):
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        def out():
            rows = list(cut(np.concatenate(held), (part << 24) | seq))
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary()),
            ], names=["block", "owner", "codes", "twice"])
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield out()
                held, n, seq = [], 0, seq + 1
        if n:
            yield out()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """An owner's duplicate bitmaps, one for each block it heard from."""
    blocks = table.column("block").to_pylist()
    lists = [golomb_unpack(c) for c in table.column("codes").to_pylist()]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    many = values[counts > 1]
    bits = []
    for v in lists:
        at = np.searchsorted(many, v)
        hit = np.zeros(len(v), dtype=bool)
        inside = at < len(many)
        hit[inside] = many[at[inside]] == v[inside]
        bits.append(np.packbits(hit).tobytes())
    return pa.table({"block": pa.array(blocks, pa.int64()), "owner": table.column("owner"), "shared": pa.array(bits, pa.binary())})


def _suspects(batches):
    for b in batches:
        found = []
        for codes, twice, shared in zip(*(b.column(i).to_pylist() for i in range(3))):
            v = golomb_unpack(codes)
            flag = np.frombuffer(twice, np.uint8) | np.frombuffer(shared, np.uint8)
            found.append(v[np.unpackbits(flag, count=len(v)).astype(bool)])
        fps = np.concatenate(found) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((fps ^ _SIGN).view(np.int64))], names=["fp"])


def exact_groups(pois: DataFrame, key: str = "poi_id", text: str = "address") -> DataFrame:
    """Groups of records whose texts are equal after lower-casing A-Z only (null: empty text).

    Each block of a partition sends its sorted distinct 64-bit fingerprints,
    Golomb-coded, to the owners of their ranges and receives bitmaps of those
    that other blocks hold too.  Only texts of suspect fingerprints are shuffled
    and compared, byte by byte, as grouping keys (pre-aggregated before the
    shuffle, so a group of any size is one row for each task).

    Returns one row for each input row: key, keep_id, group_size, kept,
    text_sha256 (of the lower-cased UTF-8).  The largest key of a group stays;
    null is the smallest key.  Of rows repeated with the same key and text one
    is kept.  An empty table gives no rows; other columns are not read.
    """
    kind = pois.schema[key].dataType.simpleString()
    rows = spool(pois.select(F.col(key).alias("key"), text_bytes(text).alias("text")).mapInArrow(
        _fingerprints, f"key {kind}, fp bigint, text_sha256 string",
    ).withColumn("row", F.monotonically_increasing_id()))
    owners = shuffle_width(pois)
    sent = spool(rows.select("fp").mapInArrow(_send(owners), "block bigint, owner int, codes binary, twice binary"))
    answers = sent.select("block", "owner", "codes").groupBy("owner").applyInArrow(_answer, "block bigint, owner int, shared binary")
    suspects = spool(sent.join(answers, ["block", "owner"]).select("codes", "twice", "shared").mapInArrow(
        _suspects, "fp bigint",
    ).distinct())
    bodies = pois.select(text_bytes(text).alias("text")).mapInArrow(_lowered, "fp bigint, body binary").join(suspects, "fp", "left_semi")
    same = bodies.groupBy("fp", "body").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    same = spool(same.select("fp", F.sha2("body", 256).alias("text_sha256"), "group_size"))
    # grouped before it meets the verified groups, so a hot group is one row for each task
    last = rows.groupBy("fp", "text_sha256").agg(
        F.max(F.struct(F.col("key").isNotNull().alias("known"), F.col("key").alias("key"), F.col("row").alias("row"))).alias("last"),
        F.count(F.lit(1)).alias("n"),
    ).filter("n > 1")
    groups = spool(same.join(last, ["fp", "text_sha256"]).select(
        "fp", "text_sha256", "group_size", F.col("last.key").alias("keep_id"), F.col("last.row").alias("keep_row"),
    ))
    return rows.join(groups, ["fp", "text_sha256"], "left").select(
        F.col("key").alias(key), F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_sha256",
    )


def without_dropped(records: DataFrame, marks: DataFrame, key: str = "poi_id", text: str = "address") -> DataFrame:
    """Records whose row ``exact_groups`` keeps, with all their columns.

    A key that has both kept and dropped rows (repeated rows, or a key used
    twice) is settled by key and lower-cased text; null keys likewise.
    """
    per = spool(marks.groupBy(key).agg(
        F.max(F.col("kept").cast("int")).alias("some"), F.min(F.col("kept").cast("int")).alias("all"),
    ).filter("all = 0"))
    gone = per.filter(F.col("some") == 0).select(F.col(key).alias("_gone"))
    mixed = per.filter(F.col("some") == 1).select(F.col(key).alias("_gone"))
    left = records.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
    if mixed.isEmpty():
        return left
    digest = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    plain = left.join(mixed, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
    some = left.join(mixed, F.col(key).eqNullSafe(F.col("_gone")), "left_semi").withColumn("_sha", digest)
    keep = marks.filter("kept").select(F.col(key).alias("_k"), F.col("text_sha256").alias("_s"))
    some = some.join(keep, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s")), "left_semi")
    return plain.unionByName(some.dropDuplicates([key, "_sha"]).drop("_sha"))
