"""Personal data in free texts: fixed patterns, and further candidates judged by boosted trees."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from wayfold.runtime import spool

KINDS = ["email", "ip", "card", "phone"]
# The fixed patterns, with look-behinds (a run is tried once, from its start) and possessive
# repeats (no deep recursion on long runs); both find the same matches.
FIXED = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators of further candidates: more than is wanted.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){3,7}+",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{2,6}+){2,4}+(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{3,4}+){2,3}+(?![0-9])",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CONTEXT = 24
TRAIN_ROWS = 20_000  # weight of all training rows together, shared equally by the kinds
# a leaf of fewer examples would only repeat single failed matches that candidates cover
LEAF_ROWS = 10
PRECISION = 0.98
HELD_OUT = 20
FOLDS = 4


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits ends with a right check digit."""
    back = F.reverse(d)
    value = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    weighed = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + weighed(i)) % 10 == 0


def passes(kind: Column, found: Column) -> Column:
    d = digits(found)
    card = F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    return (
        F.when(kind == "email", True).when(kind == "ip", found.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", card).otherwise(F.length(d).between(8, 15))
    )


def candidates(pois: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each match of each generator, and one for texts without any: row, key, kind, fixed, found, start, before, after.

    ``row`` tells input rows apart.  Places come from the lengths of what stands
    between the matches, in code points.
    """
    rows = pois.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = []
    for fixed, patterns in ((True, FIXED), (False, LOOSE)):
        for kind, p in patterns.items():
            t = F.col("text")
            parts.append(F.when(t.rlike(p), F.struct(
                F.lit(kind).alias("kind"), F.lit(fixed).alias("fixed"),
                F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("found"), F.split(t, p, -1).alias("gaps"),
            )))
    lists = rows.select("row", "key", F.explode_outer(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("g")).select("row", "key", "g.*")
    gaps = F.transform(F.col("gaps"), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(g, F.lit(CONTEXT)).alias("after")))
    lists = lists.select("row", "key", "kind", "fixed", "found", gaps.alias("gaps"))
    each = F.transform(F.col("found"), lambda m, i: F.struct(
        m.alias("found"), i.alias("i"), F.col("gaps")[i]["n"].alias("gap"), F.col("gaps")[i]["before"].alias("before"), F.col("gaps")[i + 1]["after"].alias("after")))
    flat = lists.select("row", "key", "kind", "fixed", F.explode_outer(each).alias("m")).select("row", "key", "kind", "fixed", "m.*")
    from pyspark.sql import Window

    w = Window.partitionBy("row", "kind", "fixed").orderBy("i")
    start = F.sum(F.col("gap") + F.length("found")).over(w) - F.length("found")
    return flat.select("row", "key", "kind", "fixed", "found", start.alias("start"), "before", "after")


def features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context of a candidate, as numbers; nothing that a fixed pattern's own check decides."""
    m, around = F.col("found"), F.lower(F.concat_ws(" ", "before", "after"))
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    made = {
        "f_length": F.length(m).cast("double"), "f_digits": count(m, "[0-9]"), "f_groups": count(m, "[0-9]+"), "f_letters": count(m, "[A-Za-z]"),
        "f_spaces": count(m, r"[\x20]"), "f_dashes": count(m, "-"), "f_dots": count(m, r"\."), "f_brackets": count(m, r"[()\[\]]"), "f_colons": count(m, ":"),
        "f_longest": F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda x: F.length(x))).cast("double"),
        "f_distinct": F.size(F.array_distinct(F.split(digits(m), ""))).cast("double"),
        "f_zero": (F.substr(digits(m), F.lit(1), F.lit(1)) == "0").cast("double"),
        "f_near_digits": count(around, "[0-9]"), "f_near_letters": count(around, r"\p{L}"), "f_near_marks": count(around, r"[^\p{L}0-9\x20]"),
        "f_cue": around.rlike(r"phone|call|tel|fax|mail|contact|card|visa|pay|server|host|addr").cast("double"),
        "f_touches": (F.col("before").rlike(r"[\p{L}0-9]$") | F.col("after").rlike(r"^[\p{L}0-9]")).cast("double"),
        "f_kind": F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("double"),
    }
    return df.withColumns(made), list(made)


def find_private(pois: DataFrame, key: str = "poi_id", text: str = "address") -> DataFrame:
    """Spans of personal data in whole texts (null: empty): places as code points, end exclusive.

    Fixed patterns give the base spans of each kind (leftmost, not overlapping;
    failing matches are dropped).  Looser generators propose more candidates.  Matches of
    the fixed patterns, passed or failed, teach boosted trees on format and
    context (DataFrame-based MLlib): all of them, and all kinds weigh the same.  Every match is held out
    once (a quarter at a time, by hash) to set the thresholds: each kind gets the lowest one that keeps a
    precision of PRECISION, and a kind with fewer than HELD_OUT passed rows the threshold of all kinds together, where rows
    missing to HELD_OUT count as the matches at large.  Candidates above it that overlap no base span are added,
    also where they overlap a failed match; of overlapping candidates the likeliest, then the
    first, then the longest stays.  Only without any match of a fixed pattern is there nothing to learn and nothing added.

    Returns one row for each input row: key, n_email, n_ip, n_card, n_phone, base
    and spans, both arrays of (kind number from 0, start, end) in that order.
    Repeated rows and null keys keep their rows; an empty table gives none.
    """
    found = spool(candidates(pois, key, text))
    real = found.filter("found IS NOT NULL").withColumn("end", F.col("start") + F.length("found")).withColumn(
        "no", (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1).cast("int"))
    real = spool(real.withColumn("ok", F.when(F.col("fixed"), passes(F.col("kind"), F.col("found")))))
    span = F.struct("no", "start", "end")
    base = real.filter("fixed AND ok").select("row", span.alias("span"))
    added = _added(real)
    both = found.select("row", "key").distinct()
    spans = base.withColumn("is_base", F.lit(True))
    if added is not None:
        spans = spans.unionByName(added.select("row", span.alias("span"), F.lit(False).alias("is_base")))
    lists = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_base"), F.col("span")))).alias("base"), F.array_sort(F.collect_list("span")).alias("spans"),
    )
    out = both.join(lists, "row", "left")
    fill = lambda c: F.coalesce(F.col(c), F.array().cast("array<struct<no:int,start:bigint,end:bigint>>"))
    out = out.select(F.col("key").alias(key), fill("base").alias("base"), fill("spans").alias("spans"))
    n = lambda i: F.size(F.filter("base", lambda s: s["no"] == i)).cast("long")
    return out.select(key, *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], "base", "spans")


def _added(real: DataFrame) -> DataFrame | None:
    known, names = features(real.filter("fixed"))
    fold = F.pmod(F.xxhash64("found", "before", "after"), F.lit(FOLDS)).cast("int")
    known = known.withColumn("fold", fold).withColumn("label", F.col("ok").cast("double"))
    n = {(r["kind"], r["ok"]): r["n"] for r in real.filter("fixed").groupBy("kind", "ok").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return None
    # within a kind the labels keep their shares; all kinds weigh the same
    of_kind = {k: sum(x for (kind, _), x in n.items() if kind == k) for k in KINDS}
    kinds = [k for k in KINDS if of_kind[k]]
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(TRAIN_ROWS / len(kinds) / of_kind[k])) for k in kinds])
    examples = spool(known.select("fold", "kind", "label", weight.alias("w"), *names))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="_v"),
        GBTClassifier(
            featuresCol="_v", labelCol="label", weightCol="w", maxIter=12, maxDepth=4, stepSize=0.3, minInstancesPerNode=LEAF_ROWS, seed=11),
    ])
    score = F.floor(vector_to_array("probability")[1] * 100).cast("int")

    def curve(i):
        train = examples.filter(F.col("fold") != i)
        if train.isEmpty():
            return []
        sums = (F.count(F.lit(1)).alias("n"), F.sum("label").alias("ok"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("good"))
        return model.fit(train).transform(examples.filter(F.col("fold") == i)).groupBy("kind", score.alias("s")).agg(*sums).collect()

    # every example is held out once, and all of them teach the trees that judge
    scored = [r for i in range(FOLDS) for r in curve(i)]
    fitted = model.fit(examples)
    held = lambda k: sum(r["ok"] for r in scored if r["kind"] == k)
    passed = sum(x for (_, ok), x in n.items() if ok)
    pooled = _threshold(scored, (passed + 1) / (sum(n.values()) + 2))
    limits = {k: pooled if held(k) < HELD_OUT else _threshold([r for r in scored if r["kind"] == k]) for k in KINDS}
    limits = {k: x for k, x in limits.items() if x is not None}
    if not limits:
        return None
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("kind")]
    loose, _ = features(real.filter("not fixed"))
    taken = real.filter("fixed AND ok").select(F.col("row").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    # per text only: both sides share the row
    free = loose.join(taken, (F.col("row") == F.col("_r")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    good = fitted.transform(free).withColumn("s", score).filter(F.col("s") >= limit)
    return _best(good.select("row", "no", "start", "end", vector_to_array("probability")[1].alias("p")))


def _threshold(scored: list, share: float | None = None) -> int | None:
    """Lowest score from 50 on that keeps the precision of weighed held-out rows.

    At least HELD_OUT rows have to reach it; with a ``share`` some row has to, and the missing ones count as passed by that share.
    """
    for limit in range(50, 101):
        above = [r for r in scored if r["s"] >= limit]
        rows, weight = sum(r["n"] for r in above), sum(r["w"] for r in above)
        if not rows or (rows < HELD_OUT and share is None):
            return None
        if rows >= HELD_OUT:
            right = sum(r["good"] for r in above) >= PRECISION * weight
        else:
            right = rows * sum(r["good"] for r in above) / weight + (HELD_OUT - rows) * share >= PRECISION * HELD_OUT
        if right:
            return limit
    return None


def _best(good: DataFrame) -> DataFrame:
    """Of overlapping candidates the likeliest stays, then the first, the longest, the first kind."""
    from pyspark.sql import Window

    by = Window.partitionBy("row").orderBy("start", F.desc("end"), "no")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    # chains of overlaps: what starts behind all ends before it is free of what came before
    chained = good.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(0))).withColumn("chain", F.sum("new").over(by))
    order = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "start", (-F.col("end")).alias("end"), "no")))
    lists = chained.groupBy("row", "chain").agg(order.alias("all"))
    empty = F.array().cast("array<struct<p:double,start:bigint,end:bigint,no:int>>")
    kept = F.aggregate("all", empty, lambda got, x: F.when(
        F.exists(got, lambda y: (x["start"] < -y["end"]) & (y["start"] < -x["end"])), got).otherwise(F.concat(got, F.array(x))))
    return lists.select("row", F.explode(kept).alias("x")).select("row", F.col("x.no").alias("no"), F.col("x.start").alias("start"), (-F.col("x.end")).alias("end"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["no"] + 1), s["start"], s["end"])), ",")
