"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import spelling
from wayfold.llm.spelling import follow, near_words, spelling_variants

SCHEMA = "poi_id string, address string, word string, n int, sig string, own int, near string, form int, key string, text int"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(rows, slip):
    count = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{key or ''}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def points():
    rng = np.random.default_rng(8)
    base = ["masjid", "mesjid", "masjidd", "masji", "jalan", "jalän", "jalÄn", "jallan", "bandung", "bandug", "bandong", "straße", "strasse", "×alan", "aaaaa", "aaaaaa", "aaaaaaa"]
    base += ["".join(rng.choice(list("abcü"), int(rng.integers(5, 8)))) for _ in range(160)]
    rows = []
    for i in range(500):
        words = [base[int(k) % len(base)] for k in rng.zipf(1.25, 14)]
        rows.append((f"asia_{i}", " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    rows += [(None, "masjid masjid"), ("n", None), ("e", ""), ("d", "12 3!"), ("huge", "mesjid-raya " * 20_000), ("one", "q" * 30_000)]
    return rows + rows[3:4] * 4


@pytest.mark.parametrize("slip,parts,held", [(None, 4, 1 << 18), (5, 4, 8), (7, 3, 1 << 18)])
def test_variants(spark, monkeypatch, slip, parts, held):
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    rows = points()
    pois = spark.createDataFrame([(*r, "w", 1, "s", 2, "n", 3, "k", 4) for r in rows], SCHEMA).repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(pois, slip=slip, parts=parts).collect()}
    want = brute(rows, slip)
    assert got == want and any(v[4] != v[2] for v in want.values() if v[2])


def test_near_words_of_all_edits(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abé"), int(rng.integers(1, 7)))) for _ in range(400)})
    got = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).select("word", "near").collect()}
    assert got == {(a, b) for a in words for b in words if is_near(a, b)}


def test_long_chains_and_empty_tables(spark):
    links = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(37)], "word string, form string")
    assert {r.root for r in follow(links).collect()} == {"w037"}
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
