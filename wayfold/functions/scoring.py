"""Scores and labels as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Weights of (time, cost, prayer, capacity, priority) per profile.
PROFILE_WEIGHTS = {
    "fastest": (0.70, 0.10, 0.10, 0.05, 0.05),
    "prayer_priority": (0.20, 0.10, 0.60, 0.05, 0.05),
    "low_cost": (0.20, 0.60, 0.10, 0.05, 0.05),
    "balanced": (0.40, 0.20, 0.20, 0.10, 0.10),
}
# Capacity classes as numbers; anything else counts 0.5.
CAPACITY_SCORES = {"large": 1.0, "medium": 0.65, "small": 0.35}
# Cost assumptions in rupiah.
COST_DEFAULTS = {
    "fuel_price_per_liter": 10_000.0,
    "fuel_efficiency_km_per_liter": 12.0,
    "operating_cost_per_km": 300.0,
    "toll_cost_per_km": 1_000.0,
}


def choose(c: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def capacity_score(c: Column) -> Column:
    return choose(c, CAPACITY_SCORES, 0.5)


def capacity_class(name: Column, kind: Column, reviews: Column, rating: Column, n_facilities: Column) -> Column:
    label = F.lower(F.concat_ws(" ", name, kind))
    return (
        F.when(
            label.contains("islamic_center") | label.contains("raya") | (reviews >= 80) | (n_facilities >= 5), "large"
        )
        .when((reviews >= 15) | (rating >= 4.5) | (n_facilities >= 3), "medium")
        .otherwise("small")
    )


def type_bonus(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.contains("islamic") | k.contains("masjid"), 1.0).otherwise(0.6)


def tier(score: Column) -> Column:
    return F.when(score >= 0.78, "A").when(score >= 0.58, "B").when(score >= 0.38, "C").otherwise("D")


def minmax(value: Column, low: Column, high: Column, reverse: bool = False) -> Column:
    """Position between the group's extremes; a constant or empty group is 0."""
    out = F.when(low.isNull() | (low == high), 0.0).otherwise((value - low) / (high - low))
    return 1.0 - out if reverse else out


def priority_score(rating, reviews_norm, facilities_norm, capacity, kind) -> Column:
    raw = (
        (F.coalesce(rating, F.lit(4.0)) - 1.0) / 4.0 * 0.35 + reviews_norm * 0.20 + facilities_norm * 0.20
        + capacity_score(capacity) * 0.15 + type_bonus(kind) * 0.10
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def travel_cost(distance_km: Column, toll_km: Column, **parameters: Column) -> Column:
    """Struct of fuel, operating and toll cost; missing assumptions take defaults."""
    def p(name: str) -> Column:
        given = parameters.get(name)
        return F.lit(COST_DEFAULTS[name]) if given is None else F.coalesce(given.cast("double"), F.lit(COST_DEFAULTS[name]))

    zero = F.lit(0.0)
    distance = F.greatest(zero, distance_km)
    toll = F.greatest(zero, F.least(distance, toll_km))
    liters = distance / F.greatest(F.lit(0.1), p("fuel_efficiency_km_per_liter"))
    fuel = liters * F.greatest(zero, p("fuel_price_per_liter"))
    operating = distance * F.greatest(zero, p("operating_cost_per_km"))
    tolls = toll * F.greatest(zero, p("toll_cost_per_km"))
    return F.struct(
        F.round(liters, 3).alias("fuel_liters"),
        F.round(fuel, 2).alias("fuel_cost_rupiah"),
        F.round(operating, 2).alias("operating_cost_rupiah"),
        F.round(tolls, 2).alias("toll_cost_rupiah"),
        F.round(fuel + operating + tolls, 2).alias("estimated_cost_rupiah"),
    )


def arrival_fit(travel_minutes: Column, departure_min: Column, target_min: Column) -> tuple[Column, Column, Column]:
    """(penalty, status, minutes before the event); clocks are minutes of day.

    A target earlier than the departure belongs to the next day.
    """
    target = F.when(target_min < departure_min, target_min + 1440).otherwise(target_min)
    before = target - (departure_min + travel_minutes)
    unknown = departure_min.isNull() | target_min.isNull()
    penalty = (
        F.when(unknown, 0.3)
        .when(before < 0, F.least(F.lit(1.0), F.lit(0.6) - before / 30.0))
        .when(before <= 25, 0.0)
        .otherwise(F.least(F.lit(0.5), before / 90.0))
    )
    status = F.when(unknown, "unknown").when(before < 0, "after_prayer").otherwise("before_prayer")
    return penalty, status, F.when(unknown, 0.0).otherwise(before)


def arrival_label(status: Column, minutes_before: Column) -> tuple[Column, Column]:
    """(late | tight | safe | unavailable, progress percent)."""
    known = minutes_before.isNotNull() & status.isin("before_prayer", "after_prayer")
    late = known & ((status == "after_prayer") | (minutes_before < 0))
    tight = known & (minutes_before <= 15)
    label = F.when(late, "late").when(tight, "tight").when(known, "safe").otherwise("unavailable")
    progress = (
        F.when(late, 0.0)
        .when(tight, F.least(F.lit(100.0), F.greatest(F.lit(10.0), minutes_before / 15.0 * 100.0)))
        .when(known, F.least(F.lit(100.0), minutes_before / 30.0 * 100.0))
        .otherwise(0.0)
    )
    return label, progress


def profile_table(spark: SparkSession) -> DataFrame:
    """The weight profiles as a four-row dimension table."""
    return spark.createDataFrame(
        [(k, *v) for k, v in PROFILE_WEIGHTS.items()],
        "profile string, w_time double, w_cost double, w_prayer double, w_capacity double, w_priority double",
    )


def with_weights(rows: DataFrame, profile: str = "profile") -> DataFrame:
    """Attach the weights of each row's profile; unknown profiles are balanced."""
    known = F.lower(F.col(profile))
    key = F.when(known.isin(*PROFILE_WEIGHTS), known).otherwise("balanced")
    names = ["w_time", "w_cost", "w_prayer", "w_capacity", "w_priority"]
    return rows.select("*", *[
        choose(key, {p: w[i] for p, w in PROFILE_WEIGHTS.items()}, PROFILE_WEIGHTS["balanced"][i]).alias(n)
        for i, n in enumerate(names)
    ])


def multi_objective(rows: DataFrame, request: str = "request_id") -> DataFrame:
    """G6 for rows (candidates) grouped per request; candidate lists are bounded.

    Needs minutes, cost, prayer_penalty, capacity_score, priority_score and the
    weight columns; adds multi_objective_score.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(request)
    t, c = F.col("minutes"), F.col("cost")
    time_n = minmax(t, F.min(t).over(w), F.max(t).over(w))
    cost_n = minmax(c, F.min(c).over(w), F.max(c).over(w))
    score = (
        F.col("w_time") * time_n + F.col("w_cost") * cost_n
        + F.col("w_prayer") * F.coalesce(F.col("prayer_penalty"), F.lit(0.3))
        + F.col("w_capacity") * (1.0 - F.coalesce(F.col("capacity_score"), F.lit(0.5)))
        + F.col("w_priority") * (1.0 - F.coalesce(F.col("priority_score"), F.lit(0.5)))
    )
    return rows.withColumn("multi_objective_score", F.round(score, 4))
