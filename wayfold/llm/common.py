"""Small helpers of the text operators: words, hashes and compressed sorted numbers."""

from __future__ import annotations

import struct

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

CACHE_WORDS = 1 << 16


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes beyond ASCII are left alone)."""
    return text.lower().split()


def text_bytes(name: str) -> Column:
    """A text column as UTF-8; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo a number; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def golomb_pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as Golomb codes of their gaps (divisor a power of two near the mean gap).

    Quotients in unary and remainders stand in two separate bit streams, so
    that both directions work on whole arrays.
    """
    n = len(values)
    if n == 0:
        return struct.pack("<QBQ", 0, 0, 0)
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, (int(values[-1]) // n).bit_length() - 1)
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, dtype=np.uint8)
    unary[stops] = 1
    head = np.packbits(unary)
    low = np.unpackbits(gaps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :k]
    return struct.pack("<QBQ", n, k, len(head)) + head.tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_unpack(blob: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from("<QBQ", blob)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    at = struct.calcsize("<QBQ")
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at)))[:n]
    high = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + size), count=n * k).reshape(n, k)
        wide = np.zeros((n, 64), dtype=np.uint8)
        wide[:, :k] = bits
        high |= np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
    return np.cumsum(high, dtype=np.uint64)


def keep_table(df: DataFrame) -> DataFrame:
    """Like ``runtime.spool``, compressed harder: for tables of packed numbers."""
    import uuid

    from wayfold.runtime import shared_dir

    path = f"{shared_dir(df.sparkSession)}/wayfold/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_buckets(df: DataFrame, key: str, width: int) -> DataFrame:
    """Like :func:`keep_table`, in buckets by key: joins on it leave these rows where they are."""
    import uuid

    from wayfold.runtime import shared_dir

    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/wayfold/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(width, key).saveAsTable(name)
    kept = spark.table(name)
    # only the name goes, the files stay
    spark.sql(f"DROP TABLE {name}")
    return kept
