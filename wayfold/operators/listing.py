"""Filters, listings, validation and dataset summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfold.functions.geo import KM_PER_DEGREE, lon_scale
from wayfold.operators.cleaning import in_box
from wayfold.operators.quantiles import exact_quantiles

MAX_AREA_KM2 = 1100.0


def in_region(df: DataFrame, dataset_id: str | None = None, kabko: str | None = None) -> DataFrame:
    """Optional dataset ("all" = every dataset) and city filters."""
    if dataset_id and dataset_id != "all":
        df = df.filter(F.col("dataset_id") == dataset_id)
    if kabko:
        df = df.filter(F.lower("kabko") == kabko.lower())
    return df


def quick_filter(
    df: DataFrame, *, top_rated: bool = False, tier_a: bool = False, facilities: list[str] | None = None, text: str = "",
) -> DataFrame:
    """Marker filters; facilities match by part of a name."""
    if top_rated:
        number = F.replace(F.coalesce(F.col("rating").cast("string"), F.lit("0")), F.lit(","), F.lit(".")).try_cast("double")
        df = df.filter(~(number < 4.8) | number.isNull())
    if tier_a:
        df = df.filter(F.col("tier") == "A")
    for wanted in facilities or []:
        df = df.filter(F.exists("facilities", _contains(wanted)))
    if text.strip():
        q = text.lower()
        df = df.filter(F.lower("name").contains(q) | F.lower("address").contains(q))
    df = df.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        & (F.col("latitude") != 0) & (F.col("longitude") != 0)
    )
    return df.dropDuplicates(["id"])


def _contains(wanted: str):
    return lambda f: F.lower(f).contains(wanted)


def suggest(df: DataFrame, text: str, order: list[Column], limit: int = 6) -> DataFrame:
    """First matches of a name or district substring."""
    if not text.strip():
        return df.limit(0)
    q = text.lower()
    return df.filter(F.lower("name").contains(q) | F.lower("kecamatan").contains(q)).orderBy(*order).limit(limit)


def page(df: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Listing by priority; a top-k with offset, limit 1-30000."""
    limit, offset = min(max(int(limit), 1), 30_000), max(int(offset), 0)
    return df.orderBy(F.col("priority_score").desc(), F.col("poi_id")).offset(offset).limit(limit)


# Accepted ranges, patterns and lengths of request and event fields.
ID_PATTERN = r"^[A-Za-z0-9_-]+$"
CLOCK_PATTERN = r"^(?:[01]\d|2[0-3]):[0-5]\d$"
NUMBER_PATTERN = r"^\d+(?:\.\d+)?$"


def _text(c, lo, hi, pattern=None, required=False) -> Column:
    v = F.col(c)
    bad = (F.length(v) < lo) | (F.length(v) > hi)
    if pattern:
        bad = bad | ~v.rlike(pattern)
    return v.isNull() | bad if required else F.coalesce(bad, F.lit(False))


def _range(c, lo, hi, required=False, open_low=False, open_high=False) -> Column:
    v = F.col(c)
    bad = (v <= lo) if open_low else (v < lo)
    bad = bad | ((v >= hi) if open_high else (v > hi)) | F.isnan(v.cast("double"))
    return v.isNull() | bad if required else F.coalesce(bad, F.lit(False))


def _one_of(c, values, required=False) -> Column:
    bad = ~F.col(c).isin(*values)
    return F.col(c).isNull() | bad if required else F.coalesce(bad, F.lit(False))


def rules(kind: str) -> dict[str, Column]:
    """Name -> violated? for the four kinds of rows."""
    profiles = ["fastest", "prayer_priority", "low_cost", "balanced"]
    if kind == "location_event":
        return {
            "user_id": _text("user_id", 3, 128, ID_PATTERN, True),
            "session_id": _text("session_id", 3, 128, ID_PATTERN, True),
            "latitude": _range("latitude", -90, 90, True),
            "longitude": _range("longitude", -180, 180, True),
            "occurred_at": F.col("occurred_at").isNull(),
            "dataset_id": _text("dataset_id", 0, 160),
            "region_id": _text("region_id", 0, 80),
            "road_segment_id": _text("road_segment_id", 0, 160),
            "speed_kph": _range("speed_kph", 0, 300),
            "heading_degrees": _range("heading_degrees", 0, 360, open_high=True),
            "accuracy_m": _range("accuracy_m", 0, 5000),
        }
    if kind == "nearest":
        return {
            "latitude": _range("lat", -90, 90, True),
            "longitude": _range("lon", -180, 180, True),
            "limit": _range("k", 1, 50, True),
            "radius_km": _range("radius_km", 0.5, 200, True),
        }
    if kind == "recommend":
        return {
            "origin": F.col("o_lat").isNull() | F.col("o_lon").isNull(),
            "departure_time": F.col("departure").isNull(),
            "prayer": F.col("prayer").isNull(),
            "profile": _one_of("profile", profiles, True),
            "search_radius_km": _range("search_radius_km", 1, 200, True),
            "maximum_results": _range("maximum_results", 1, 10, True),
            "fuel_price_per_liter": _range("fuel_price_per_liter", 0, 100_000),
            "fuel_efficiency_km_per_liter": _range("fuel_efficiency_km_per_liter", 0, 100, open_low=True),
            "operating_cost_per_km": _range("operating_cost_per_km", 0, 100_000),
            "toll_cost_per_km": _range("toll_cost_per_km", 0, 100_000),
        }
    if kind == "settings":
        return {
            "user_id": _text("user_id", 3, 128, ID_PATTERN, True),
            "algorithm": _one_of("algorithm", ["dijkstra", "astar"]),
            "profile": _one_of("profile", profiles),
            "departureMode": _one_of("departureMode", ["now", "scheduled"]),
            "currentTime": _text("currentTime", 0, 5, CLOCK_PATTERN),
            "prayer": _one_of("prayer", ["auto", "subuh", "dzuhur", "ashar", "maghrib", "isya"]),
            "maxCandidates": _text("maxCandidates", 0, 2, r"^(?:[1-9]|10)$"),
            "bufferKm": _text("bufferKm", 0, 1 << 30, r"^(?:[2-9]|[1-9]\d|1\d\d|200)(?:\.\d+)?$"),
            "fuelPricePerLiter": _text("fuelPricePerLiter", 0, 64, NUMBER_PATTERN),
        }
    raise ValueError(f"unknown kind of row: {kind}")


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``violations``, the names of broken rules (empty = accepted)."""
    checks = [F.when(bad, F.lit(name)) for name, bad in rules(kind).items()]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and the quarantine with its reasons."""
    checked = validate(df, kind)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def completed_datasets(profiles: DataFrame) -> DataFrame:
    """Datasets whose processing finished."""
    return profiles.filter(F.col("processed") & (F.col("status") == "completed"))


def robust_bbox(pois: DataFrame) -> DataFrame:
    """Extent of each dataset without outliers, bounded to about 1100 km2."""
    total = pois.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_rows"))
    ok = pois.filter(in_box(F.col("latitude"), F.col("longitude"))).select("dataset_id", "latitude", "longitude")
    axes = {"latitude": F.col("latitude"), "longitude": F.col("longitude")}
    q = exact_quantiles(ok, ["dataset_id"], axes, [0.25, 0.75])

    def one(m, p):
        return F.max(F.when((F.col("measure") == m) & (F.col("prob") == p), F.col("quantile")))

    fence = q.groupBy("dataset_id").agg(
        one("latitude", 0.25).alias("a1"), one("latitude", 0.75).alias("a3"),
        one("longitude", 0.25).alias("o1"), one("longitude", 0.75).alias("o3"),
    )
    rows = ok.join(fence, "dataset_id").select(
        "dataset_id", "latitude", "longitude",
        (
            (F.col("latitude") >= F.col("a1") - (F.col("a3") - F.col("a1")) * 1.5)
            & (F.col("latitude") <= F.col("a3") + (F.col("a3") - F.col("a1")) * 1.5)
            & (F.col("longitude") >= F.col("o1") - (F.col("o3") - F.col("o1")) * 1.5)
            & (F.col("longitude") <= F.col("o3") + (F.col("o3") - F.col("o1")) * 1.5)
        ).alias("_in"),
    )
    kept_any = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("valid_rows"), F.max("_in").alias("_some"))
    used = rows.join(kept_any, "dataset_id").filter(F.col("_in") | ~F.col("_some"))
    box = used.groupBy("dataset_id", "valid_rows").agg(
        F.count(F.lit(1)).alias("used_rows"),
        F.min("latitude").alias("s"), F.max("latitude").alias("n"),
        F.min("longitude").alias("w"), F.max("longitude").alias("e"),
    )
    med = exact_quantiles(used, ["dataset_id"], axes, [0.5]).groupBy("dataset_id").agg(
        one("latitude", 0.5).alias("mlat"), one("longitude", 0.5).alias("mlon"),
    )
    area = (
        F.abs(F.col("n") - F.col("s")) * KM_PER_DEGREE * F.abs(F.col("e") - F.col("w")) * KM_PER_DEGREE
        * lon_scale((F.col("n") + F.col("s")) / 2.0)
    )
    box = box.join(med, "dataset_id").join(total, "dataset_id").withColumn("raw", area)
    half = MAX_AREA_KM2 ** 0.5 / 2.0
    dlat = F.lit(half / KM_PER_DEGREE)
    dlon = F.lit(half) / (F.lit(KM_PER_DEGREE) * lon_scale(F.col("mlat")))
    big = F.col("raw") > MAX_AREA_KM2
    pick = lambda a, b: F.when(big, a).otherwise(b)
    return box.select(
        "dataset_id", "total_rows", "valid_rows", "used_rows",
        (F.col("valid_rows") - F.col("used_rows")).alias("ignored_outliers"),
        big.alias("adjusted_to_area_limit"),
        F.round("raw", 2).alias("raw_area_km2"),
        F.struct(
            pick(F.col("mlat") + dlat, F.col("n") + 0.02).alias("north"),
            pick(F.col("mlat") - dlat, F.col("s") - 0.02).alias("south"),
            pick(F.col("mlon") + dlon, F.col("e") + 0.02).alias("east"),
            pick(F.col("mlon") - dlon, F.col("w") - 0.02).alias("west"),
        ).alias("bbox"),
    )


def count_points(df: DataFrame) -> DataFrame:
    """Number of points per dataset and city (city compared without case)."""
    return df.groupBy("dataset_id", F.lower("kabko").alias("kabko")).agg(F.count(F.lit(1)).alias("points"))


def national_total(profiles: DataFrame) -> DataFrame:
    """Sum of the first counter each dataset has."""
    return profiles.agg(
        F.sum(F.coalesce("enriched_rows", "profile_enriched_rows", "mosque_count", F.lit(0))).alias("total_points")
    )


def _quality() -> list[Column]:
    filled = lambda c: F.avg(F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1.0).otherwise(0.0))
    return [
        F.count(F.lit(1)).alias("points"),
        filled("rating").alias("rating_fill"), filled("kelurahan").alias("kelurahan_fill"),
        F.avg("rating").alias("mean_rating"),
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in "ABCD"],
    ]


def quality_profile(pois: DataFrame) -> DataFrame:
    """Fill ratios, mean rating and tier counts per dataset."""
    return pois.groupBy("dataset_id").agg(*_quality())


def quality_rollup(pois: DataFrame, levels: tuple[str, ...] = ("province", "kabko", "kecamatan")) -> DataFrame:
    """C8 over region levels: the same figures for every district, city and province and for all points, in one pass.

    ``level`` is the grouping id: 0 for the innermost level, one more bit set for each level summed over (7: all points).  A
    missing region stays a row of its own, told from the sums by ``level``.
    """
    return pois.rollup(*levels).agg(F.grouping_id().cast("long").alias("level"), *_quality())


def job_progress(items: DataFrame) -> DataFrame:
    """Counts of a bulk job by outcome."""
    status = F.col("status")
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.isin("succeeded", "failed", "skipped")).alias("completed"),
        F.count_if(status == "succeeded").alias("succeeded"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
    )
