"""Document rates that bring a corpus to target domain weights."""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from wayfold.llm.common import text_bytes
from wayfold.runtime import spool

BUCKETS = 1 << 12
TRAIN_ROWS = 4096
EVIDENCE, KNOWN = 64.0, 12.0
PULL, SETTLED, MOST_STEPS = 1e-4, 1e-6, 200
HISTORY, SPOOL_STEPS = 10, 4


def word_list(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def ending(word: Column) -> Column:
    """Bucket of a word's last two characters, behind the buckets of whole words."""
    return F.pmod(F.xxhash64(F.right(word, F.lit(2))), F.lit(BUCKETS)).cast("int")


def fit_domains(pois: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str, label: str, train_rows: int) -> tuple[dict, list, list]:
    """(log priors, word weights, ending weights) of a naive Bayes model; weights relative to the first domain.

    Learnt from at most about ``train_rows`` labelled rows, chosen by hash.
    """
    rows = labelled.filter(F.col(label).isin(domains)).select(F.col(key).alias("k"), F.col(label).alias("d"))
    n = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    prior = {d: math.log((n.get(d, 0) + 1) / (total + len(domains))) for d in domains}
    share = min(1.0, train_rows / max(1, total))
    some = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share * (1 << 20))
    # at most about train_rows rows
    texts = pois.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k")
    words = texts.select("d", F.explode(word_list("t")).alias("w"))
    tables = []
    for part in (bucket, ending):
        got = words.groupBy("d", part(F.col("w")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {d: [0] * BUCKETS for d in domains}
        for r in got:
            counts[r["d"]][r["b"]] = r["n"]
        logs = {d: [math.log((x + 0.5) / (sum(c) + 0.5 * BUCKETS)) for x in c] for d, c in counts.items()}
        tables.append([[round(a - b, 4) for a, b in zip(logs[d], logs[domains[0]])] for d in domains[1:]])
    return prior, tables[0], tables[1]


def posteriors(pois: DataFrame, labelled: DataFrame, model: tuple, domains: list[str], key: str, text: str, label: str) -> DataFrame:
    """key, h (hash of the text), n_tokens and the posterior of each domain (p0, p1 ...); a record's own label counts as KNOWN nats of evidence."""
    prior, whole, ends = model
    table = lambda x: F.from_json(F.lit(json.dumps(x)), "array<double>")
    fields = [f"s{i}" for i in range(1, len(domains))]

    def add(acc, w):
        return F.struct(*[
            (acc[f] + F.get(table(whole[i]), bucket(w)) + F.get(table(ends[i]), ending(w))).alias(f) for i, f in enumerate(fields)
        ])

    sums = F.aggregate("w", F.struct(*[F.lit(0.0).alias(f) for f in fields]), add)
    rows = pois.select(F.col(key).alias("key"), F.xxhash64(text_bytes(text)).alias("h"), word_list(text).alias("w"))
    rows = rows.select("key", "h", F.size("w").cast("long").alias("n_tokens"), sums.alias("s"))
    # evidence of a long text counts as that of a fixed number of words, so membership stays soft
    scale = F.lit(EVIDENCE) / F.greatest(F.lit(EVIDENCE), F.col("n_tokens"))
    rows = rows.select("key", "h", "n_tokens", F.array(F.lit(0.0), *[
        F.col("s")[f] * scale + (prior[d] - prior[domains[0]]) for d, f in zip(domains[1:], fields)]).alias("e"))
    known = labelled.filter(F.col(label).isin(domains)).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("known"))
    rows = rows.join(known, "key", "left").select("key", "h", "n_tokens", F.array(*[
        F.col("e")[i] + F.when(F.col("known") == d, KNOWN).otherwise(0.0) for i, d in enumerate(domains)]).alias("l"))
    top = rows.select("*", F.transform("l", lambda x: F.exp(x - F.array_max("l"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return top.select("key", "h", "n_tokens", *[(F.col("e")[i] / total).alias(f"p{i}") for i in range(len(domains))])


def domain_shares(rows: DataFrame, k: int) -> list[float]:
    """Share of each domain in all tokens, by the memberships (0 without tokens)."""
    n = F.col("n_tokens")
    got = rows.agg(F.sum(n), *[F.sum(n * F.col(f"p{i}")) for i in range(k)]).first()
    return [x / got[0] for x in got[1:]] if got[0] else [0.0] * k


def fit_rates(rows: DataFrame, goal: list[float], pull: float = PULL) -> tuple[DataFrame, list[float]]:
    """``rows`` with their ``rate``, and the domain shares reached: least squares by projected gradient steps.

    Minimised over all nonnegative rates: half the squared misses of the domain totals (in shares of all tokens), plus ``pull`` times half
    the token-weighted squared distance of the rates from 1, so that of all rates that meet reachable targets nearly the ones closest to 1 are found.
    From rates of 1, every step moves each rate against its gradient, memberships times misses plus the pull, and cuts at 0.  Step lengths are spectral
    (Barzilai and Borwein) with a nonmonotone line search over the last HISTORY heights; the plain step 1 / (1 + pull), which always descends, is taken where
    that fails.  A step is one pass of sums over the table; rates are written every SPOOL_STEPS steps, which bounds the expressions.
    Ends when the projected gradient is at most SETTLED, or after MOST_STEPS with the best rates met; targets that stay missed are told in a warning.
    """
    k = len(goal)
    goal, n, p = np.array(goal), F.col("n_tokens"), [F.col(f"p{i}") for i in range(k)]
    state = rows.withColumn("rate", F.lit(1.0))
    total = rows.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if not total:
        return state, [0.0] * k
    now = np.array(domain_shares(rows, k))
    plain = step = 1 / (1 + pull)
    heights = [float((now - goal) @ (now - goal)) / 2]
    best = heights[0], state, now
    for turn in range(1, MOST_STEPS + 1):
        def moved(size):
            slope = sum((x * float(m) for x, m in zip(p, now - goal)), F.lit(0.0))
            new = F.greatest(F.lit(0.0), F.col("rate") * (1 - size * pull) + size * pull - slope * size)
            table = state.withColumn("next", new)
            d, e = F.col("next") - F.col("rate"), F.col("next") - 1
            got = np.array(table.agg(F.sum(n * d * d), F.sum(n * e * e), *[F.sum(n * x * F.col("next")) for x in p]).first(), dtype=float) / total
            return table, got[0], float((got[2:] - goal) @ (got[2:] - goal) + pull * got[1]) / 2, got[2:]

        table, way, height, then = moved(step)
        if height > max(heights[-HISTORY:]) - 1e-4 * way / step:
            step = plain
            table, way, height, then = moved(step)
        state = table.withColumn("rate", F.col("next")).drop("next")
        if turn % SPOOL_STEPS == 0:
            state = spool(state)
        rise = float((then - now) @ (then - now)) + pull * way
        settled, now = math.sqrt(way) / step <= SETTLED, then
        heights.append(height)
        if height <= best[0]:
            best = height, state, now
        if settled:
            break
        step = min(1 / pull, way / rise) if rise > 0 else plain
    _, state, now = best
    if (np.abs(now - goal) > 0.02 * np.maximum(goal, pull)).any():
        warnings.warn(f"targets {goal.tolist()} are not met; domain shares reached: {now.tolist()}")
    return state, now.tolist()


def mix_to_targets(
    pois: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "poi_id", text: str = "address", label: str = "category",
    train_rows: int = TRAIN_ROWS, relative: bool = False, pull: float = PULL,
) -> DataFrame:
    """Nonnegative rate of every record, so that expected domain token totals match target weights.

    ``labelled`` has ``key`` and ``label`` (a domain of ``targets``) for some records; a classifier learnt from
    a bounded sample of them gives every text soft memberships (tokens being words), those of labelled records led by their label.  ``targets`` are weights of the domains in all tokens;
    ``relative`` ones multiply the shares that the memberships give before (a weight of 1 for each changes nothing), so that they stay within
    reach.  Rates are those of ``fit_rates``: least squares on the misses of the domain totals, pulled towards 1 by ``pull``.  ``copies`` is the rate
    rounded up or down by a hash of key and text, so that totals are met on average.

    Returns key, text_hash, n_tokens, p_<domain> for each target, rate, copies: one row for
    each input row.  Null and empty texts have no tokens and the prior's membership;
    repeated rows get equal rates; of several labels of a key the smallest counts; without labels all memberships are equal
    priors.  Other columns are not read.
    """
    domains = sorted(targets)
    model = fit_domains(pois, labelled, domains, key, text, label, train_rows)
    rows = spool(posteriors(pois, labelled, model, domains, key, text, label))
    goal = np.array([targets[d] for d in domains])
    if relative:
        goal = goal * domain_shares(rows, len(domains))
    rated, _ = fit_rates(rows, (goal / (goal.sum() or 1.0)).tolist(), pull)
    chance = F.pmod(F.xxhash64(F.col("key").cast("string"), "h", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return rated.select(
        F.col("key").alias(key), F.col("h").alias("text_hash"), "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
        (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
    )


def apply_mix(records: DataFrame, rates: DataFrame, key: str = "poi_id", text: str = "address") -> DataFrame:
    """Records as often as ``copies`` says (0: dropped), with all their columns."""
    per = rates.select(F.col(key).alias("_k"), F.col("text_hash").alias("_h"), F.col("copies").alias("_n")).distinct()
    names = records.columns
    with_hash = records.withColumn("_t", F.xxhash64(text_bytes(text)))
    got = with_hash.join(per, (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_t") == F.col("_h"))).filter("_n > 0")
    return got.select(*names, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).select(*names)
