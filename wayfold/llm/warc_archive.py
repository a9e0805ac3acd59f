"""Archives of records: WARC files whose records are Zstandard frames sharing a dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayfold.llm.common import text_bytes
from wayfold.runtime import spool

LEAST_BYTES = 1000
FILE_BYTES = 16 << 20
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1024, 1 << 15, 1 << 16
LEVEL = 6

# fixed values of the archive and frame formats
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "\x50\x2a\x4d\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_KIND = "`key` string, uri string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def poi_documents(pois: DataFrame, key: str = "poi_id", dataset: str = "dataset_id") -> DataFrame:
    """Points of interest as archive records: key, uri (``urn:poi:<dataset>:<key>``) and the whole record as JSON.

    Null fields are left out of the JSON, a null dataset or key is empty in the uri.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return pois.select(F.col(key), F.concat_ws(":", F.lit("urn:poi"), part(dataset), part(key)).alias("uri"), F.to_json(F.struct("*")).alias("document"))


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; where samples are too few or too alike to train one, their own first bytes serve as content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary_frame(dictionary: bytes) -> bytes:
    """A skippable frame, passed over by readers that do not know it."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_end(data, at: int) -> int:
    """Where the frame that starts at ``at`` ends: by its block headers, nothing is decompressed."""
    magic, size = struct.unpack_from("<II", data, at)
    if magic >> 4 == 0x184D2A5:
        return at + 8 + size
    head = bytes(data[at:at + 18])
    end = at + zstandard.frame_header_size(head)
    last = False
    while not last:
        block = int.from_bytes(data[end:end + 3], "little")
        last, kind, length = block & 1, block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else length)
    return end + (4 if zstandard.get_frame_parameters(head).has_checksum else 0)


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _record_id(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{digest}')}>"


def archive_record(key: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, date: str, kind: str) -> bytes:
    """One response, or a revisit that names the response's key and keeps only the payload's size and digest (hex SHA-1)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    place = lambda k: None if k is None else quote(k, safe="")
    return _record([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(key, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", quote(uri, safe=":/?#[]@!$&'()*+,;=%") if uri else None), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", _record_id(refers_to, digest) if revisit else None),
        ("X-Record-Key", place(key)), ("X-Refers-To-Key", place(refers_to) if revisit else None),
    ], http if revisit else http + payload)


def _compress(dictionary: bytes, date: str, kind: str, file_bytes: int):
    def run(batches):
        packer = zstandard.ZstdCompressor(
            level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        info = packer.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>"),
            ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        start = [dictionary_frame(dictionary), info]
        held, size = list(start), 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                frame = packer.compress(archive_record(*row, date, kind))
                if size and size + len(frame) > file_bytes:
                    yield out()
                    held, size = list(start), 0
                held.append(frame)
                size += len(frame)
        if size:
            yield out()

    return run


def write_archive(
    records: DataFrame, path: str, key: str = "poi_id", payload: str = "document", uri: str | None = None, *,
    date: str = "2020-01-01T00:00:00Z", content_type: str = "application/json; charset=utf-8", least_bytes: int = LEAST_BYTES,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Archives records (of points: ``poi_documents``) as dictionary-compressed WARC 1.1 files under ``path``.

    A file starts with a skippable frame that holds the dictionary; after it every record is a frame of its own.  The
    dictionary is trained on at most about SAMPLE_ROWS records, drawn by hash from those of at most SAMPLE_BYTES.  Of records with equal
    payloads (whole bytes, compared by SHA-256) of at least ``least_bytes``, the one with the largest key is a response
    and the others revisit it; shorter payloads are always responses.  ``payload`` is written in UTF-8, null as
    empty.  Null is the smallest key; rows that repeat the largest key of their payload are all responses.  An empty table gives no file with records;
    other columns are not read.

    Spark's text writer puts one file's bytes after the other through the commit protocol, so lost executors leave no half
    files; its line separator is an empty skippable frame, which every Zstandard reader passes over.  A file holds about ``file_bytes``.
    """
    rows = records.select(
        F.col(key).alias("key"), (F.col(uri).cast("string") if uri else F.lit(None).cast("string")).alias("uri"), text_bytes(payload).alias("payload"),
    )
    size = F.octet_length("payload")
    # a group of any size is one row for each task before it is shuffled
    groups = spool(rows.filter(size >= least_bytes).groupBy(F.sha2("payload", 256).alias("sha")).agg(
        F.count(F.lit(1)).alias("n"), F.max("key").alias("last"), ).filter("n > 1").select("sha", "last"))
    some = rows.filter(size.between(1, SAMPLE_BYTES)).select("payload", F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "payload"), F.lit(1 << 20)).alias("at"))
    n = some.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 20)
    # about SAMPLE_ROWS rows of bounded size, in a fixed order
    drawn = sorted(bytes(r[0]) for r in some.filter(F.col("at") < share).select("payload").collect())
    dictionary = train_dictionary(drawn) if drawn else b""
    marked = rows.withColumn("sha", F.when(size >= least_bytes, F.sha2("payload", 256))).join(groups, "sha", "left")
    revisit = F.col("sha").isNotNull() & F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    files = marked.select(
        F.col("key").cast("string").alias("key"), "uri", "payload", F.sha1("payload").alias("digest"), F.col("last").cast("string").alias("refers_to"), revisit.alias("revisit"),
    ).mapInArrow(_compress(dictionary, date, content_type, file_bytes), "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}


def read_file(data: bytes):
    """Records of a file as (fields, HTTP fields, payload), by the dictionary in its leading frame."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(view, at)
        if view[at + 3] == DICTIONARY_MAGIC >> 24 and view[at] >> 4 == 5:
            if view[at] == DICTIONARY_MAGIC & 255 and end > at + 8:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8:end])))
        else:
            head, _, rest = unpack.decompress(bytes(view[at:end])).partition(b"\r\n\r\n")
            fields = _fields(head)
            block = rest[:int(fields["content-length"])]
            if fields["warc-type"] != "warcinfo":
                http, _, payload = block.partition(b"\r\n\r\n")
                yield fields, _fields(http), payload
        at = end


def _read(with_payload: bool):
    names = [x.split()[0].strip("`") for x in _KIND.split(", ")]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for f, http, payload in read_file(data.as_py()):
                    digest, size = base64.b32decode(f["warc-payload-digest"][5:]).hex(), int(http["content-length"])
                    revisit = f["warc-type"] == "revisit"
                    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {f['warc-record-id']}")
                    place = lambda name: unquote(f[name]) if name in f else None
                    rows.append((
                        place("x-record-key"), place("warc-target-uri"), f["warc-type"], place("x-refers-to-key"), size, digest, payload if with_payload and not revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    return run


def read_archive(spark: SparkSession, path: str, key: str = "poi_id", kind: str = "string", with_payload: bool = True) -> DataFrame:
    """Records of archives: key (of type ``kind``), uri, record_type, refers_to, payload_bytes, payload_digest (hex SHA-1), payload.

    Size and digest of a response are those of the payload read and are held against the headers (a damaged record
    raises); a revisit has those of the full payload from its headers and no payload.  Without ``with_payload`` that column is left out.
    """
    # one file a row: files are of bounded size, but for single records beyond it
    got = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read(with_payload), _KIND)
    got = got.withColumn("key", F.col("key").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)).withColumnRenamed("key", key)
    return got if with_payload else got.drop("payload")
