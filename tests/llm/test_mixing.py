"""Rates against brute-force least squares, and what a mixture keeps."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm.mixing import apply_mix, fit_rates, mix_to_targets

ROWS = "n_tokens bigint, p0 double, p1 double, p2 double"


def brute(n, p, goal, pull, steps=60_000):
    """Plain projected gradient on all rates, with many small steps."""
    weight, rate = n / n.sum(), np.ones(len(n))
    for _ in range(steps):
        miss = (weight * rate) @ p - goal
        rate = np.maximum(0, rate - (p @ miss + pull * (rate - 1)))
    return rate


@pytest.mark.parametrize("goal", [[1 / 3] * 3, [0.9, 0.08, 0.02]])
def test_rates_are_least_squares(spark, goal):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.9, 0.2, 0.1], 150)
    n = rng.integers(1, 50, len(p))
    rows = spark.createDataFrame([(int(a), *map(float, x)) for a, x in zip(n, p)], ROWS).coalesce(1).cache()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got, reached = fit_rates(rows, goal, pull=3e-3)
    rates = np.array([r.rate for r in got.orderBy("p0").collect()])
    order = np.argsort(p[:, 0])
    want = brute(n[order], p[order], np.array(goal), 3e-3)
    assert (np.abs(rates - want) / np.maximum(1, want)).max() < 5e-3
    assert np.allclose((n[order] * rates) @ p[order] / n.sum(), reached, atol=1e-9)


def test_rates_of_reachable_and_unreachable_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.9, 0.2, 0.1], 2000)
    n = rng.integers(1, 50, len(p))
    rows = spark.createDataFrame([(int(a), *map(float, x)) for a, x in zip(n, p)], ROWS).coalesce(1).cache()
    before = n @ p / n.sum()
    goal = before * [1.0, 0.75, 0.5]
    goal = goal / goal.sum()
    got, reached = fit_rates(rows, goal.tolist())
    assert np.abs(np.array(reached) / goal - 1).max() < 0.02 and got.agg(F.max("rate")).first()[0] < 1.5
    flat = spark.createDataFrame([(5, 1 / 3, 1 / 3, 1 / 3)] * 4, ROWS)
    with pytest.warns(UserWarning, match="not met"):
        got, reached = fit_rates(flat, [0.6, 0.3, 0.1])
    assert np.allclose(reached, 1 / 3, atol=1e-3)
    none, reached = fit_rates(flat.limit(0), [0.5, 0.3, 0.2])
    assert none.count() == 0 and reached == [0.0] * 3


def texts(n=300):
    rng = np.random.default_rng(1)
    vocabulary = {"mosque": ["raya", "agung", "jami"], "hall": ["balai", "gedung", "aula"], "spam": ["promo", "klik", "gratis"]}
    kinds = rng.choice(["mosque", "hall", "spam"], n, p=[0.8, 0.15, 0.05])
    return [(i, " ".join(rng.choice(vocabulary[k] + ["kota", "jalan"], int(rng.integers(5, 60)))), str(k)) for i, k in enumerate(kinds)]


def test_mixture_keeps_what_it_does_not_lower(spark):
    rows = texts() + [(900, None, "mosque"), (901, "", None), (5, texts()[5][1], "mosque"), (None, "raya agung", "mosque")]
    pois = spark.createDataFrame(rows, "poi_id bigint, address string, category string").repartition(3).cache()
    labelled = pois.filter("poi_id % 2 = 0")
    weights = {"mosque": 1.0, "hall": 0.8, "spam": 0.5}
    rates = mix_to_targets(pois, labelled, weights, relative=True).cache()
    got = {(r.poi_id, r.text_hash): r for r in rates.collect()}
    assert rates.count() == len(rows) and max(r.rate for r in got.values()) < 1.3
    kept = apply_mix(pois, rates)
    assert kept.columns == pois.columns
    ids = [r.poi_id for r in kept.collect()]
    assert {i for i, _, k in texts() if k == "mosque"} <= set(ids) and 0.85 * len(rows) < len(ids) < 1.15 * len(rows)
    total, after = sum(r.n_tokens for r in got.values()), sum(r.n_tokens * r.copies for r in got.values())
    assert abs(after / total - 1) < 0.05
    spam = sum(r.n_tokens * r.p_spam for r in got.values())
    want = {d: sum(r.n_tokens * r[f"p_{d}"] for r in got.values()) * w for d, w in weights.items()}
    assert abs(sum(r.n_tokens * r.p_spam * r.rate for r in got.values()) / (total * want["spam"] / sum(want.values())) - 1) < 0.02 and spam > 0


def test_labels_of_one_domain_only_and_none(spark):
    pois = spark.createDataFrame(texts(40), "poi_id bigint, address string, category string")
    one = mix_to_targets(pois, pois.filter("category = 'mosque'"), {"mosque": 1.0, "hall": 1.0}, relative=True).collect()
    assert len(one) == 40 and all(abs(r.rate - 1) < 1e-6 and r.copies == 1 for r in one)
    same = mix_to_targets(pois, pois.limit(0), {"mosque": 0.5, "hall": 0.5}).collect()
    assert all(abs(r.rate - 1) < 1e-6 and abs(r.p_hall - 0.5) < 1e-9 for r in same)
