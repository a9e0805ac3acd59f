"""Text operators on point records against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm.common import golomb_pack, golomb_unpack, remainder
from wayfold.llm.exact_dedup import exact_groups, without_dropped
from wayfold.llm.jaccard_join import near_groups, without_copies
from wayfold.llm.language import identify_language, without_unidentified
from wayfold.llm.language_model import score_texts
from wayfold.llm.mixing import apply_mix, mix_to_targets
from wayfold.llm.packing import pack_sequences, sum_of_squares
from wayfold.llm.private_data import _best, _threshold, find_private, joined
from wayfold.llm.queries import tokenizer_path
from wayfold.llm.ranked_search import bm25_top
from wayfold.llm.token_files import canonical_codes, code_lengths, decode_ids, decode_table, encode_ids, read_token_files, write_token_files
from wayfold.llm.url_rules import judge_urls

SCHEMA = "poi_id bigint, address string, lang string, category string, row string, n string, class string, score double, key string, text string"


def addresses():
    rng = np.random.default_rng(5)
    word = lambda kind: "".join(rng.choice(kind, 3))
    id_, en = ["ja", "lan", "ra", "ya", "ban", "ke"], ["str", "eet", "th", "ing", "low", "er"]
    base = [" ".join(word(id_ if i % 2 else en) for _ in range(60)) for i in range(14)]
    near = base[2].split()
    near[30] = "changed"
    rows = [(i, t, "id" if i % 2 else "en", "mosque" if i % 3 else "hall") for i, t in enumerate(base)]
    rows += [
        (20, base[1].upper(), "id", None), (21, " ".join(near), "en", None), (22, None, None, None), (23, "", "en", "hall"), (24, "  \n\t", None, None),
        (25, "jalan raya", "id", "mosque"), (26, "12 34 !!", None, None), (27, "word " * 30_000, "en", None), (28, base[3], None, None), (28, base[3], None, None),
        (29, "mail imam.1@masjid.example.id or +62 (812) 555-0199, 10.0.0.255 and 10.0.0.256, 4111 1111 1111 1111 é a@b.c_d@e.f", None, None),
        (30, "Jalan Raya", None, None), (None, "no key here", None, None), (31, "7" * 50_000, None, None),
    ]
    return [(*r, "x", "y", "z", 1.0, "k", "t") for r in rows]


@pytest.fixture(scope="module")
def pois(spark):
    return spark.createDataFrame(addresses(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_golomb_round_trip():
    for v in (np.empty(0, np.uint64), np.array([0, 0, 3, 2**63 + 5], np.uint64), np.sort(np.random.default_rng(1).integers(0, 2**60, 999).astype(np.uint64))):
        assert (golomb_unpack(golomb_pack(v)) == v).all()


def test_huffman_round_trip_and_limit():
    counts = np.array([2**i for i in range(24)] + [0, 5])
    lengths = code_lengths(counts, 12)
    assert lengths.max() <= 12 and lengths[24] == 0 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = np.random.default_rng(2).integers(0, 24, 1000)
    stream, at, checks = encode_ids(ids, np.array([1000]), lengths, canonical_codes(lengths))
    n = np.minimum(64, 1000 - 64 * np.arange(len(checks)))
    assert (decode_ids(stream, checks, n, *decode_table(lengths)) == ids).all()


def test_token_files(spark, pois, none, tmp_path):
    from tokenizers import Tokenizer

    write_token_files(pois.filter("poi_id IS NOT NULL"), str(tmp_path / "t"), tokenizer_path())
    got = sorted(tuple(r) for r in read_token_files(spark, str(tmp_path / "t")).collect())
    t, start, expected = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted((r for r in addresses() if r[0] is not None), key=lambda r: r[0]):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    write_token_files(none, str(tmp_path / "e"), tokenizer_path())
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_token_files_of_text_keys(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(f"asia_{i}", f"jalan raya {i} " * (i % 5)) for i in range(60)] + [(None, "no key"), ("asia_20", "again, and longer than it was"), ("", None)]
    write_token_files(spark.createDataFrame(rows, "poi_id string, address string").repartition(3), str(tmp_path / "t"), tokenizer_path())
    t = Tokenizer.from_file(tokenizer_path())
    ids = [(k, t.encode(x or "", add_special_tokens=False).ids + [2]) for k, x in rows]
    expected, start = [], 0
    for k, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or "", len(r[1]))):
        expected.append((k, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = [tuple(r) for r in read_token_files(spark, str(tmp_path / "t")).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected


def test_packing(pois, none):
    rows = pack_sequences(pois, tokenizer_path(), capacity=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by) <= math.ceil(total / 256) * 1.1 + 1 and len({r.poi_id for r in rows}) == len({r[0] for r in addresses()})
    assert pack_sequences(none, tokenizer_path()).count() == 0


def test_sum_of_squares_rule():
    bins, offsets = sum_of_squares(np.array([6, 4, 6, 4, 10]), 10)
    assert bins.tolist() == [0, 0, 1, 1, 2] and offsets.tolist() == [0, 6, 0, 6, 0]


def test_exact_groups(pois, none):
    low = {r[0]: hashlib.sha256((r[1] or "").encode().lower()).hexdigest() for r in addresses()}
    sizes = Counter(hashlib.sha256((r[1] or "").encode().lower()).hexdigest() for r in addresses())
    rows = exact_groups(pois).collect()
    assert len(rows) == len(addresses())
    for r in rows:
        assert r.text_sha256 == low[r.poi_id] and r.group_size == sizes[low[r.poi_id]]
        assert r.keep_id == max((k for k, v in low.items() if v == low[r.poi_id] and k is not None), default=None)
    assert sum(r.kept for r in rows) == len(sizes)
    kept = without_dropped(pois, exact_groups(pois))
    assert kept.columns == pois.columns and kept.count() == len(sizes)
    assert exact_groups(none).count() == 0


def test_near_groups(pois, none):
    sets = {}
    for r in addresses():
        w = words(r[1])
        sets[r[0]] = {tuple(w)} if 0 < len(w) < 5 else set(zip(*(w[i:] for i in range(5))))
    parent = {k: k for k in sets}
    ids = sorted(k for k in sets if k is not None)
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[b] = min(parent[a], parent[b])
    rows = near_groups(pois).collect()
    assert len(rows) == len(addresses())
    for r in rows:
        assert r.n_shingles == len(sets[r.poi_id])
        assert r.poi_id is None or r.component_id == parent[r.poi_id]
    assert near_groups(none).count() == 0
    left = without_copies(pois, near_groups(pois)).filter("poi_id IS NOT NULL").select("poi_id").distinct().count()
    assert left == len(set(parent[k] for k in ids))


def test_language(pois, none):
    rows = {r.poi_id: r for r in identify_language(pois, pois).collect()}
    right = [rows[r[0]].lang_pred == r[2] for r in addresses()[:14]]
    assert all(right) and all(0 <= r.score <= 1 for r in rows.values())
    assert {rows[k].lang_pred for k in (22, 23, 24, 26, 31)} == {"und"}
    kept = without_unidentified(pois, pois)
    assert kept.columns == pois.columns and kept.count() == len(addresses()) - 5
    assert {r.lang_pred for r in identify_language(pois, none).collect()} == {"und"} and identify_language(none, pois).count() == 0


def test_scores(pois, none):
    held = {r[0]: zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 7 == 2 for r in addresses()}
    texts = [(r[0], words(r[1]) + [b"\n"]) for r in addresses()]
    c = Counter(w for k, t in texts if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    want = {k: (held[k], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for k, t in texts}
    rows = score_texts(pois, remainder("poi_id", 7) == 2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) == want[r.poi_id] and r.score < 0
    assert score_texts(none, remainder("poi_id", 7) == 2).count() == 0


@pytest.mark.parametrize("shard_tokens", [1 << 20, 300])
def test_bm25(pois, none, monkeypatch, shard_tokens):
    monkeypatch.setattr("wayfold.llm.ranked_search.SHARD_TOKENS", shard_tokens)
    docs = [(r[0], Counter(words(r[1]))) for r in addresses() if r[0] is not None]
    avg = sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    asked = pois.filter("poi_id IN (1, 20, 22, 25)").select(F.col("poi_id").alias("query_id"), F.col("address").alias("text"))
    got = {}
    for r in bm25_top(pois, asked, k=4).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.poi_id, round(r.score, 6)))
    for q in (1, 20, 22, 25):
        text = next(c for k, c in docs if k == q)
        scores = []
        for k, c in docs:
            s = sum(m * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w, m in text.items() if w in c)
            if s > 0:
                scores.append((-round(s, 9), k))
        assert got.get(q, []) == [(k, round(-s, 6)) for s, k in sorted(scores)[:4]]
    assert bm25_top(none, asked).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/esp",
            "http://example.org?utm_source=a", "http://example.org/a?page=2&ref=z", "ftp://h", "http://net/fr/x", "http://net/fr/x"]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) and got[0] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block")
    assert got[5][2:] == ("com/", "allow") and got[6][2:] == ("net/es/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "block") and got[10] == ("h", "", None, "allow") and got[11] == got[12]


def test_private_data(pois, none):
    rows = {r.poi_id: r for r in find_private(pois).withColumn("s", joined(F.col("spans"))).collect()}
    t = next(r[1] for r in addresses() if r[0] == 29)
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    at = lambda kind, s: f"{kind}:{t.index(s)}:{t.index(s) + len(s)}"
    assert rows[29].s == ",".join([*want, at("ip", "10.0.0.255"), at("card", "4111 1111 1111 1111"), at("phone", "+62 (812) 555-0199")])
    assert all(r.s == "" for k, r in rows.items() if k != 29) and find_private(none).count() == 0


def test_url_rules_of_open_tokens_and_blanks(spark):
    urls = ["http://m.a.org/b/12.htmlx", "http://m.a.org/b/", "http://m.a.org/c/", "http://a.org/1.html", "http://a b.com/x", "http://a b.net/es/x", "http://a.org/com#/"]
    got = [r.verdict + " " + str(r.rule) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).orderBy("page_id").collect()]
    assert got == ["block None", "allow None", "allow None", "allow None", "allow com/", "block net/es/", "allow None"]


def private_texts(kinds, n=160):
    """Matches of the fixed patterns that pass beside a cue word, and alike ones that fail without one."""
    rng = np.random.default_rng(3)
    some = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    check = lambda d: str(-sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10)
    octet = lambda: rng.integers(1, 256)
    texts = []
    for i in range(n):
        d = some(15)
        good, bad = d + check(d), d + str((int(check(d)) + 1) % 10)
        cut = lambda x: [x, f"{x[:4]} {x[4:8]} {x[8:12]} {x[12:]}", f"{x[:4]} {x[4:10]} {x[10:]}"][i % 3]
        phone = [f"+{some(2)} {some(3)} {some(4)}", f"+{some(1)} ({some(3)}) {some(3)}-{some(4)}", f"+{some(2)}.{some(3)}.{some(3)}", f"+{some(4)}-{some(4)}-{some(4)}"][i % 4]
        ip = f"{octet()}.{octet()}.{octet()}"
        texts += {
            "card": [f"pay by card {cut(good)} today", f"about {cut(bad)} trees grow"],
            "phone": [f"please call {phone} today", f"about {phone} {some(4)} {some(4)} birds"],
            "ip": [f"the server host {ip}.{octet()} runs", f"section {ip}.999 ends"],
            "email": [f"mail to a.b{i}@masjid.id today", f"about {i + 10} birds"],
        }[kinds[i % len(kinds)]]
    return texts


LOOSE_TEXTS = {
    ("phone",): {
        "please call (555) 123-4567 today": "phone:12:26", "please call 0812-3456-7890 today": "phone:12:26", "please call 555.123.4567 today": "phone:12:24",
    },
    ("card",): {"pay by card 3782 822463 10005 today": "card:12:29"},
    ("ip", "email"): {"the server host 2001:db8:85a3:8a2e:370:7334 runs": "ip:16:43", "mail to imam12 (at) masjid.id today": "email:8:29"},
}


@pytest.mark.parametrize("kinds", LOOSE_TEXTS)
def test_private_data_adds_over_failed_matches(spark, kinds):
    want = LOOSE_TEXTS[kinds]
    texts = private_texts(kinds, 320) + list(want)
    rows = find_private(spark.createDataFrame(list(enumerate(texts)), "poi_id bigint, address string")).withColumn("s", joined(F.col("spans"))).collect()
    got = {texts[r.poi_id]: r for r in rows}
    assert {t: got[t].s for t in want} == want and all(not got[t].base for t in want)
    # a base span keeps its place alone
    assert all(r.spans == r.base for r in rows if r.base)


def test_private_data_of_rare_kinds(spark, monkeypatch):
    """A rare kind beside many failed cards keeps its examples; a table with few examples of a label is judged too."""
    monkeypatch.setattr("wayfold.llm.private_data.TRAIN_ROWS", 1600)
    many = [f"about {i} {1000 + i} birds {2000 + i} trees {3000 + i} hills {i + 7} days" for i in range(6000)]
    few = [f"mail to {a}.{b}@masjid.id today" for a in "abcdefgh" for b in "uvwxyz"] + [f"about {i} birds" for i in range(10, 28)]
    for texts, want in (
        (private_texts(("phone",), 240) + many + ["please call 555.123.4567 today"], ["phone:12:24"]),
        (few + ["mail to imam (at) masjid.id today"], ["email:8:27"]),
    ):
        rows = find_private(spark.createDataFrame(list(enumerate(texts)), "poi_id bigint, address string")).withColumn("s", joined(F.col("spans"))).collect()
        got = {r.poi_id: r.s for r in rows}
        assert [got[len(texts) - len(want) + i] for i in range(len(want))] == want


def test_private_data_learns_from_every_match(spark, monkeypatch):
    """TRAIN_ROWS only scales weights: below HELD_OUT passed rows a draw of that size could teach nothing."""
    monkeypatch.setattr("wayfold.llm.private_data.TRAIN_ROWS", 80)
    want = LOOSE_TEXTS[("phone",)]
    texts = private_texts(("phone",), 320) + list(want)
    rows = find_private(spark.createDataFrame(list(enumerate(texts)), "poi_id bigint, address string")).withColumn("s", joined(F.col("spans"))).collect()
    assert {texts[r.poi_id]: r.s for r in rows if texts[r.poi_id] in want} == want


def test_private_data_holds_every_match_out_and_leaves_none_untaught(spark, monkeypatch):
    """All matches set the thresholds and teach the trees, also in a table without any failed match."""
    from pyspark.ml import Pipeline

    taught, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: taught.append(df.count()) or fit(self, df))
    monkeypatch.setattr("wayfold.llm.private_data.HELD_OUT", 10)
    texts = private_texts(("phone",), 320)
    find_private(spark.createDataFrame(list(enumerate(texts)), "poi_id bigint, address string")).count()
    assert sum(taught[:-1]) == 3 * taught[-1] and len(taught) == 5
    passed = [f"mail to {a}.{b}@masjid.id today" for a in "abcdefgh" for b in "uvwxyz"] + ["mail to imam (at) masjid.id today"]
    rows = find_private(spark.createDataFrame(list(enumerate(passed)), "poi_id bigint, address string")).withColumn("s", joined(F.col("spans"))).collect()
    assert [r.s for r in rows if r.poi_id == 48] == ["email:8:27"]


def test_threshold_of_few_rows():
    rows = lambda ok, failed: [dict(s=80, n=ok, ok=ok, w=1.0 * ok, good=1.0 * ok), dict(s=60, n=failed, ok=0, w=1.0 * failed, good=0.0)]
    assert _threshold(rows(19, 0)) is None and _threshold(rows(20, 30)) == 61
    assert _threshold(rows(19, 0), 20 / 21) == 50 and _threshold(rows(19, 19), 0.5) is None and _threshold([], 0.99) is None


def test_best_candidates_of_overlapping_ones(spark):
    rows = [(1, 0, 0, 5, 0.9), (1, 1, 4, 10, 0.8), (1, 2, 9, 12, 0.7), (1, 3, 12, 14, 0.6), (2, 0, 0, 5, 0.6), (2, 1, 4, 10, 0.8), (3, 2, 0, 5, 0.7), (3, 3, 0, 6, 0.7)]
    got = _best(spark.createDataFrame(rows, "row bigint, no int, start bigint, end bigint, p double")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 5), (1, 2, 9, 12), (1, 3, 12, 14), (2, 1, 4, 10), (3, 3, 0, 6)]


def test_mixing(pois, none):
    targets = {"mosque": 0.5, "hall": 0.5}
    rows = mix_to_targets(pois, pois.filter("poi_id < 14"), targets).collect()
    total = sum(r.n_tokens for r in rows)
    assert len(rows) == len(addresses()) and total == sum(len(words(r[1])) for r in addresses())
    assert all(r.rate >= 0 and abs(r.p_hall + r.p_mosque - 1) < 1e-9 and math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in rows)
    assert abs(sum(r.rate * r.n_tokens * r.p_hall for r in rows) / total - 0.5) < 0.02
    rates = mix_to_targets(pois, pois.filter("poi_id < 14"), targets)
    assert apply_mix(pois, rates).count() == sum(r.copies for r in rows)
    assert mix_to_targets(none, none, targets).count() == 0
