"""Word divergence of sources against brute force with Python's whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import divergence
from wayfold.llm.divergence import audit_divergence, share, slice_counts, sort_words, word_pointers

SCHEMA = "address string, province string, dataset_id string, region int, term string, grp int, n int, value string, item int, rank int"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def points():
    rng = np.random.default_rng(3)
    words = ["Masjid", "raya", "JALAN", "Éhad", "al-huda", "kota", "straße", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghx", "ﷺ", "no7"]
    rows = []
    for i in range(260):
        text = " ".join(words[int(k)] for k in rng.zipf(1.4, 12) % len(words))
        rows.append((text, ["Jawa", "Bali", "Aceh", None][i % 4], [f"set{i % 7}", None, "", "ü"][int(rng.integers(0, 4))]))
    rows += [(None, "Jawa", "lonely"), ("", None, None), ("12 34", "Empty", "only"), ("once", "Empty", "other"), ("a" * 70_000, "Jawa", "set1"), ("mesjid " * 30_000, "Jawa", "set2")]
    rows += [rows[5]] * 9
    return rows


def brute(rows, least_docs, top):
    texts = [(lower(t or ""), r or "", s or "") for t, r, s in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, r, s in texts:
        found = Counter(TERM.findall(t))
        df[r].update(found.keys())
        counts[r, s].update(found)
        groups[r].add(s)
    out = []
    for r, sources in groups.items():
        kept = [t for t, n in df[r].items() if n >= least_docs]
        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}
        whole = Counter()
        for s in sources:
            whole.update(counts[r, s])
        p, q = {s: shares(counts[r, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[r, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(r, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])]
    return sorted(out)


@pytest.mark.parametrize("slice_bytes,cells,top", [(1 << 24, 1 << 18, 200), (900, 3, 2)])
def test_divergence(spark, monkeypatch, slice_bytes, cells, top):
    monkeypatch.setattr(divergence, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = points()
    pois = spark.createDataFrame([(*r, 1, "t", 2, 3, "v", 4, 5) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in audit_divergence(pois, top=top).select("province", "dataset_id", "part", "item", "value", "rank").collect())
    assert got == brute(rows, 3, top)


def test_empty_table(spark):
    assert audit_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pointers_and_order():
    texts = ["ab", "cd Ab", "", "  ", "abcdefghij abcdefgh abcdefghijklmnopqr é"]
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    low = divergence._LOW[np.frombuffer(b"".join(raw), np.uint8)]
    start, end = word_pointers(low, offsets)
    words = [low[i:j].tobytes().decode() for i, j in zip(start, end)]
    assert words == ["ab", "cd", "ab", "abcdefghij", "abcdefgh", "abcdefghijklmnopqr", "é"]
    order, run = sort_words(low, start, end)
    assert [words[i] for i in order] == sorted(words, key=str.encode) and run.tolist() == [0, 0, 1, 2, 3, 4, 5]
    text, ends, runs, groups, n, docs = slice_counts(low, offsets, np.array([1, 0, 0, 0, 1]))
    assert text.tobytes().decode()[:4] == "abab" and (runs[0], groups[0], n[0], docs[0]) == (0, 0, 1, 1)


def test_random_words_sort_like_bytes():
    rng = np.random.default_rng(1)
    raw = b" ".join(bytes(rng.choice(list(b"ab\xc3"), int(rng.integers(1, 30)))) for _ in range(3000))
    low = divergence._LOW[np.frombuffer(raw, np.uint8)]
    start, end = word_pointers(low, np.array([0, len(low)]))
    order, run = sort_words(low, start, end)
    words = [raw[start[i]:end[i]] for i in order]
    assert words == sorted(words) and len(set(words)) == run[-1] + 1


def test_share_is_exact():
    for c, t in ((1, 3), (10**12, 10**12), (7 * 10**14 + 1, 9 * 10**15 - 1), (0, 5)):
        assert int(share(np.int64(c), np.int64(t))) == 10**9 * c // t
