import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wayfold.llm import language_model as lm


def test_numbers_and_words_come_back():
    rng = np.random.default_rng(0)
    for shape in ((4, 0), (4, 1), (4, 500)):
        x = rng.integers(-5, 1 << 40, shape)
        assert (lm.unpack_numbers(lm.pack_numbers(x), 4) == x).all()
    known = np.unique(rng.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2))
    for frequent in (known, known[:0]):
        for n in (1, 40):
            v = np.unique(np.concatenate([known[:n], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
            assert (lm._unpack_words(lm._pack_words(v, frequent), frequent) == v).all()
    runs, ctx, doc = rng.integers(1, 1 << 17, 3), rng.integers(0, 1 << 16, 9), rng.integers(0, 1 << 16, 9)
    for a, b in zip((runs, ctx, doc), lm._unpack_tokens(lm._pack_tokens(runs, ctx, doc), 3)):
        assert (a == b).all()


def test_counts_and_base_over_many_owners(spark, monkeypatch):
    """Frequent words spread over owners, rare ones with one owner: counts and base scores equal a plain count."""
    monkeypatch.setattr(lm, "OWN_CONTEXTS", 20)
    monkeypatch.setattr(lm, "OWNER_TOKENS", 150)
    monkeypatch.setattr(lm, "PIECE_TOKENS", 10)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    texts += [texts[0]] * 3 + [None, "", " only here "]
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "poi_id long, address string, held boolean")
    got = {r.poi_id: r for r in lm.score_texts(df, F.col("held")).collect()}
    tokens = {i: (t or "").lower().split() + ["\n"] for i, t, _ in rows}
    seen = Counter(w for i, _, h in rows if not h for w in tokens[i])
    total, kinds = sum(seen.values()), len(seen)
    assert len(got) == len(rows)
    for i, _, held in rows:
        r = got[i]
        base = sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(tokens[i]), sum(seen[w] > 0 for w in tokens[i]), total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    # a context tells more than the counts alone
    repeated = [got[i] for i in (0, 60, 62)]
    assert all(r.score > r.base_score for r in repeated)


def test_contexts_come_back():
    rng = np.random.default_rng(1)
    far = np.unique(rng.integers(0, 1 << 48, 300).astype(np.uint64))
    for n in (0, 1, 500):
        at = rng.integers(0, len(far), n)
        assert (lm._unpack_contexts(lm._pack_contexts(far, at)) == far[at]).all()


def test_rare_contexts_have_restaurants_of_their_own(spark, monkeypatch):
    """More rare contexts than any shared set held: each predicts the word that always follows it."""
    monkeypatch.setattr(lm, "OWN_CONTEXTS", 20)
    monkeypatch.setattr(lm, "OWNER_TOKENS", 20_000)
    n = 9000
    rows = [(0, " ".join([f"c{i} {'ab'[i % 2]}"] * 4), False) for i in range(n) for _ in range(2)]
    rows += [(0, f"c{i} {x}", True) for i in range(0, n, 9) for x in "ab"]
    rows = [(j, t, h) for j, (_, t, h) in enumerate(rows)]
    df = spark.createDataFrame(rows, "poi_id long, address string, held boolean")
    got = {r.poi_id: r.score for r in lm.score_texts(df, F.col("held")).collect()}
    assert len(got) == len(rows)
    for i in range(0, n, 9):
        a, b = (got[2 * n + i // 9 * 2 + j] for j in (0, 1))
        assert (a - b if i % 2 == 0 else b - a) > 0.5, i
