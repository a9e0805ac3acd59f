"""The stages of the corpus pipeline on a small corpus, each against brute force on its own input."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm.queries import tokenizer_path
from wayfold.runtime import spool


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(folder, [(name, input rows, output rows)]) of a whole run, over a cut of the smallest tables."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    odd = [(900001, None, None, "s", 0), (900002, "", "en", "s", 0), (900003, "12 34 !!", None, None, 8)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.orderBy("doc_id").limit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        then = spool(stage(spark, now, folder))
        out.append((name, now, then))
        now = then
    return folder, out


def lower(text):
    return (text or "").encode().lower()


def shingles(text):
    w = lower(text).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_order_and_columns(stages):
    names = [n for n, _, _ in stages[1]]
    assert names == ["language", "exact_copies", "near_copies", "mixture", "sequences"] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(set(o.columns) == set(i.columns) for _, i, o in stages[1][:-1])


def test_language(stages):
    _, before, after = stages[1][0]
    assert rows(after) == [r for r in rows(before) if any(c.isalpha() for c in r[1] or "")]


def test_exact_copies(stages):
    _, before, after = stages[1][1]
    best = {}
    for r in rows(before):
        best[lower(r[1])] = max(best.get(lower(r[1]), r[0]), r[0])
    assert sorted(r[0] for r in rows(after)) == sorted(best.values())


def test_near_copies(stages):
    _, before, after = stages[1][2]
    docs = [(r[0], shingles(r[1])) for r in rows(before)]
    root = {d: d for d, _ in docs}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r[0] for r in rows(after)} == {d for d in root if find(d) == d}


def test_mixture(spark, stages):
    folder, all_stages = stages
    _, before, after = all_stages[3]
    was, now = [r[0] for r in rows(before)], [r[0] for r in rows(after)]
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1 AND coalesce(toxic, 0) = 0")
    good = {r.doc_id for r in labels.collect()} & set(was)
    assert good and good <= set(now) and set(now) <= set(was)
    assert 0.85 * len(was) < len(now) < 1.15 * len(was) and max(now.count(d) for d in set(now)) <= 2


def test_sequences(stages):
    from tokenizers import Tokenizer

    _, before, after = stages[1][4]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in rows(before):
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            piece = ids[k:k + 2048]
            want.append((r[0], k // 2048, k, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))))
    got = after.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048


def test_run(spark, stages):
    folder, all_stages = stages
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == all_stages[4][2].columns and got.count() == all_stages[4][2].count()
    assert got.agg(F.sum("length")).first()[0] == all_stages[4][2].agg(F.sum("length")).first()[0]
