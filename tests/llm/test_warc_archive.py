"""Archives against brute force, by round trips and by a plain Zstandard reader."""

import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from wayfold.llm.warc_archive import DICTIONARY_MAGIC, frame_end, poi_documents, read_archive, read_file, train_dictionary, write_archive

SCHEMA = "poi_id string, dataset_id string, name string, address string, province string, key string, sha string, last string, file string, payload string"


def points():
    same, long = "Jl. Masjid Raya No. 1, " * 60, "ü" * 500
    rows = [(f"asia_{i}", "asia", f"Masjid {i}", f"Jalan {i} Kota Bandung", "Jawa Barat") for i in range(40)]
    rows += [("asia_90", "asia", "a", same, None), ("asia_91", "asia", "b", same, None), ("asia_92", None, None, same, ""), (None, "asia", "c", same, None)]
    rows += [("x/ y%\r\né", "asia", "d", long, None), ("z", "asia", "e", long, None), ("s1", "asia", "f", "short", None), ("s2", "asia", "g", "short", None)]
    rows += [("e1", None, None, None, None), ("e2", None, None, "", None), ("r", "asia", "h", same + "r", None), ("r", "asia", "h", same + "r", None)]
    rows += [("huge", "asia", "i", "very long text " * 60_000, None)]
    return [(*r, "k", "s", "l", "f", "p") for r in rows]


def expected(rows):
    last = {}
    for r in rows:
        t = (r[3] or "").encode()
        last[t] = max(last.get(t, ""), r[0] or "")
    out = []
    for r in rows:
        t = (r[3] or "").encode()
        first = len(t) < 1000 or (r[0] or "") == last[t]
        out.append((r[0] or "", len(t), hashlib.sha1(t).hexdigest(), "response" if first else "revisit", None if first else last[t], t if first else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("file_bytes", [1 << 20, 300])
def test_archive_round_trip(spark, tmp_path, file_bytes):
    path = str(tmp_path / "a")
    pois = spark.createDataFrame(points(), SCHEMA).repartition(3)
    write_archive(pois, path, payload="address", uri="name", file_bytes=file_bytes)
    got = read_archive(spark, path)
    cols = ["payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    have = [(r.poi_id or "", *[bytes(r[c]) if c == "payload" and r[c] is not None else r[c] for c in cols]) for r in got.collect()]
    assert sorted(have, key=repr) == expected(points())
    assert {r.uri for r in got.filter("poi_id = 'asia_3'").collect()} == {"Masjid 3"}
    assert read_archive(spark, path, with_payload=False).columns == ["poi_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest"]


def test_files_are_plain_zstandard(spark, tmp_path):
    path = tmp_path / "a"
    pois = spark.createDataFrame(points(), SCHEMA).coalesce(1)
    write_archive(pois, str(path), payload="address")
    (file,) = [f for f in path.iterdir() if f.name.startswith("part-")]
    data = file.read_bytes()
    assert int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC
    first = frame_end(data, 0)
    assert first > 8
    # a reader that knows nothing but the dictionary passes over the skippable frames
    words = zstandard.ZstdCompressionDict(data[8:first])
    text = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == len(points()) + 1
    assert text.count(b"WARC-Type: revisit") == 4 and len(data) < len(text) / 4
    assert len(list(read_file(data))) == len(points())
    with pytest.raises(zstandard.ZstdError):
        list(read_file(data[:first + 40] + b"\xff" + data[first + 41:]))


def test_numbers_as_keys_and_documents(spark, tmp_path):
    rows = [(i, "asia", "n" * 1200, None) for i in (9, 10, 11)] + [(None, None, None, None)]
    pois = spark.createDataFrame(rows, "poi_id bigint, dataset_id string, name string, rating double")
    docs = poi_documents(pois)
    assert {r.uri for r in docs.collect()} == {"urn:poi:asia:9", "urn:poi:asia:10", "urn:poi:asia:11", "urn:poi::"}
    assert docs.filter("poi_id = 9").first().document == '{"poi_id":9,"dataset_id":"asia","name":"%s"}' % ("n" * 1200)
    write_archive(docs, str(tmp_path / "d"), uri="uri")
    assert {r.record_type for r in read_archive(spark, str(tmp_path / "d"), kind="bigint").collect()} == {"response"}
    write_archive(pois, str(tmp_path / "n"), payload="name")
    got = {r.poi_id: r.refers_to for r in read_archive(spark, str(tmp_path / "n"), kind="bigint").collect()}
    assert got == {9: 11, 10: 11, 11: None, None: None}


def test_empty_table_and_small_dictionaries(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    write_archive(none, str(tmp_path / "e"), payload="address")
    assert read_archive(spark, str(tmp_path / "e")).count() == 0
    assert train_dictionary([b"few"]) == b"few"
    blank = spark.createDataFrame([("a", None), ("b", "")], "poi_id string, address string")
    write_archive(blank, str(tmp_path / "b"), payload="address")
    assert read_archive(spark, str(tmp_path / "b")).filter("payload_bytes = 0 and record_type = 'response'").count() == 2
