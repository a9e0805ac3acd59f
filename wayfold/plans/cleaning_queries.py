"""Registered queries over raw uploads and listings: B, C1-C8, E1, E6, G1-G3."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.fixtures import sql_with, table
from wayfold.functions.text import parse_decimal, parse_int, slugify_dataset, slugify_key, split_facilities
from wayfold.operators import cleaning, listing

QUERIES = {}
ORACLE = {}


def _raw(spark, sf):
    return table(spark, sf, "raw_poi").withColumnRenamed("uuid", cleaning.KEY_COLUMN)


# ---- shared SQL steps of the cleaning chain -------------------------------
def _dec(c):
    t = f"trim({c})"
    body = (
        f"replace(CASE WHEN regexp_matches({t}, '^-?\\d{{1,3}}(\\.\\d{{3}})+,\\d+') THEN replace({t}, '.', '') ELSE {t} END, ',', '.')"
    )
    return (
        f"(CASE WHEN {t} = '' OR lower({t}) IN ('nan','none','null') THEN NULL "
        f"ELSE TRY_CAST(regexp_replace({body}, '[^0-9.\\-]', '', 'g') AS DOUBLE) END)"
    )


def _int(c):
    return f"CAST(coalesce(round_even({_dec(c)}, 0), 0) AS INT)"


def _fac(c):
    t = f"lower(trim(coalesce({c}, '')))"
    alias = (
        "CASE i WHEN 'wudhu_area' THEN 'wudu_area' WHEN 'wudu' THEN 'wudu_area' WHEN 'tempat_wudhu' THEN 'wudu_area' "
        "WHEN 'toilets' THEN 'toilet' WHEN 'woman_area' THEN 'women_area' WHEN 'sound' THEN 'sound_system' ELSE i END"
    )
    return (
        f"(CASE WHEN {t} IN ('','nan','none','null') THEN [] ELSE list_sort(list_distinct(list_filter(list_transform("
        f"list_transform(regexp_split_to_array({t}, '[|,;/]+'), lambda p: regexp_replace(trim(p), '\\s+', '_', 'g')), "
        f"lambda i: {alias}), lambda i: i <> ''))) END)"
    )


def _fix(v, lo, hi):
    tries = " ".join(f"WHEN {v}/1e{e} BETWEEN {lo} AND {hi} THEN {v}/1e{e}" for e in range(1, 10))
    return f"(CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {v} {tries} ELSE {v} END)"


_LAT, _LON = ("-115e-1", "65e-1"), ("94e0", "1425e-1")


def _ok(a, b):
    return f"coalesce({a} BETWEEN {_LAT[0]} AND {_LAT[1]} AND {b} BETWEEN {_LON[0]} AND {_LON[1]}, false)"


CLEAN_SQL = {
    "parsed0": f"SELECT *, {_dec('latitude')} AS la, {_dec('longitude')} AS lo, {_dec('rating')} AS rating_numeric, "
               f"{_int('review_count')} AS review_n FROM raw_poi",
    "parsed1": f"SELECT *, {_fix('la', *_LAT)} AS fla, {_fix('lo', *_LON)} AS flo FROM parsed0",
    "verdict0": f"SELECT dataset_id, count(*) FILTER ({_ok('la','lo')}) AS plain, count(la) AS parsed, "
                f"count(*) FILTER ({_ok('fla','flo')}) AS fixed, count(*) FILTER ({_ok('lo','la')}) AS swapped FROM parsed1 GROUP BY 1",
    "verdict1": "SELECT dataset_id, plain = 0 AND parsed > 0 AND NOT (fixed = 0 AND swapped > 0) AS fixit, "
                "plain = 0 AND fixed = 0 AND swapped > 0 AS swapit FROM verdict0",
    "placed0": "SELECT p.*, v.fixit, v.swapit, CASE WHEN swapit THEN lo WHEN fixit THEN fla ELSE la END AS lat2, "
               "CASE WHEN swapit THEN la WHEN fixit THEN flo ELSE lo END AS lon2 FROM parsed1 p JOIN verdict1 v USING (dataset_id)",
    "placed1": f"SELECT * FROM placed0 WHERE {_ok('lat2','lon2')}",
    "firsts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, "
              "CASE WHEN dataset_id = 'EUROPE' THEN uuid ELSE name END, CASE WHEN dataset_id = 'EUROPE' THEN 0 ELSE lat2 END, "
              "CASE WHEN dataset_id = 'EUROPE' THEN 0 ELSE lon2 END ORDER BY input_pos) AS keep_rn FROM placed1) WHERE keep_rn = 1",
    "numbered": "SELECT *, CASE WHEN dataset_id = 'EUROPE' THEN uuid ELSE concat(dataset_id, '_', CAST(row_number() OVER "
                "(PARTITION BY dataset_id ORDER BY input_pos) - 1 AS STRING)) END AS id FROM firsts",
    "texted": "SELECT dataset_id, input_pos, id, lat2, lon2, rating_numeric, review_n, trim(name) AS name, "
              "trim(coalesce(kabko,'')) AS kabko, trim(mosque_type) AS mosque_type, provinsi, "
              f"{_fac('facilities')} AS fac0 FROM numbered",
    "medians": "SELECT dataset_id, coalesce(quantile_cont(rating_numeric, 5e-1), 4e0) AS med FROM texted GROUP BY 1",
    "rated": "SELECT t.*, round(greatest(1e0, least(5e0, coalesce(rating_numeric, med))), 2) AS rating, "
             "CASE WHEN rating_numeric IS NOT NULL THEN 'original' ELSE 'median_imputation' END AS rating_source, "
             "CASE WHEN len(fac0) > 0 THEN fac0 WHEN review_n >= 10 THEN ['parking'] ELSE ['wudu_area'] END AS fac, "
             "CASE WHEN len(fac0) > 0 THEN 'original' ELSE 'rule_based_prediction' END AS facilities_source "
             "FROM texted t JOIN medians USING (dataset_id)",
    "sized": "SELECT *, len(fac) AS nf, ln(1e0 + review_n) AS lr, CASE WHEN lower(concat(name,' ',mosque_type)) LIKE '%islamic\\_center%' ESCAPE '\\' "
             "OR lower(concat(name,' ',mosque_type)) LIKE '%raya%' OR review_n >= 80 OR len(fac) >= 5 THEN 'large' "
             "WHEN review_n >= 15 OR rating >= 45e-1 OR len(fac) >= 3 THEN 'medium' ELSE 'small' END AS capacity_proxy FROM rated",
    "spanned": "SELECT *, min(lr) OVER w AS r0, max(lr) OVER w AS r1, min(nf) OVER w AS f0, max(nf) OVER w AS f1 "
               "FROM sized WINDOW w AS (PARTITION BY dataset_id)",
    "scored": "SELECT *, round(greatest(0e0, least(1e0, 35e-2*(rating-1e0)/4e0 + 20e-2*(CASE WHEN r1=r0 THEN 0e0 ELSE (lr-r0)/(r1-r0) END) "
              "+ 20e-2*(CASE WHEN f1=f0 THEN 0e0 ELSE CAST(nf-f0 AS DOUBLE)/(f1-f0) END) "
              "+ 15e-2*(CASE capacity_proxy WHEN 'large' THEN 1e0 WHEN 'medium' THEN 65e-2 ELSE 35e-2 END) "
              "+ 10e-2*(CASE WHEN lower(mosque_type) LIKE '%islamic%' OR lower(mosque_type) LIKE '%masjid%' THEN 1e0 ELSE 6e-1 END))), 4) AS priority_score FROM spanned",
}


def _sql(last, body):
    return sql_with(["raw_poi", last], body, CLEAN_SQL)


# ---- B2-B5, B12: parsers ---------------------------------------------------
def parsers(spark, sf):
    r = table(spark, sf, "raw_poi")
    return r.select(
        "input_pos",
        slugify_dataset(F.concat("dataset_id", F.lit(" Kota--"), F.col("input_pos").cast("string"), F.lit(".CSV"))).alias("dataset_slug"),
        slugify_key(F.col("kabko")).alias("city_key"),
        parse_decimal(F.col("latitude")).alias("lat"),
        parse_decimal(F.col("rating")).alias("rating"),
        parse_int(F.col("review_count")).alias("reviews"),
        F.array_join(split_facilities(F.col("facilities")), "|").alias("facilities"),
    )


QUERIES["B2_B5_B12_parsers"] = parsers
ORACLE["B2_B5_B12_parsers"] = sql_with(["raw_poi"], f"""
SELECT input_pos,
  trim(regexp_replace(regexp_replace(lower(concat(dataset_id, ' Kota--', CAST(input_pos AS STRING), '.CSV')), '\\.[a-z0-9]+$', ''), '[^a-z0-9]+', '_', 'g'), '_') AS dataset_slug,
  coalesce(nullif(trim(regexp_replace(lower(coalesce(kabko,'')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'empty') AS city_key,
  {_dec('latitude')} AS lat, {_dec('rating')} AS rating, {_int('review_count')} AS reviews,
  array_to_string({_fac('facilities')}, '|') AS facilities
FROM raw_poi
""")


# ---- B1, B6-B8 ---------------------------------------------------------------
def coordinates(spark, sf):
    df = cleaning.keep_national(cleaning.repair_coordinates(cleaning.normalise_columns(_raw(spark, sf))))
    return df.select(
        "dataset_id", "input_pos", "decimal_repaired", "axes_swapped",
        F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"),
    )


QUERIES["B6_B8_coordinate_repair"] = coordinates
ORACLE["B6_B8_coordinate_repair"] = _sql("placed1", """
SELECT dataset_id, input_pos, fixit AS decimal_repaired, swapit AS axes_swapped,
  round(lat2, 9) AS latitude, round(lon2, 9) AS longitude FROM placed1
""")


# ---- B9-B13 ------------------------------------------------------------------
def deduplicated(spark, sf):
    df = cleaning.clean(_raw(spark, sf))
    return df.select(
        "dataset_id", "id", "input_pos", "name", "kabko",
        F.array_join("facilities_original", "|").alias("facilities"),
        "has_original_facilities", "has_original_rating",
    )


QUERIES["B9_B13_dedupe_and_text"] = deduplicated
ORACLE["B9_B13_dedupe_and_text"] = _sql("texted", """
SELECT dataset_id, id, input_pos, name, kabko, array_to_string(fac0, '|') AS facilities,
  len(fac0) > 0 AS has_original_facilities, rating_numeric IS NOT NULL AS has_original_rating FROM texted
""")


# ---- B15, C3, C4, J3, G1-G3 ----------------------------------------------------
def enriched(spark, sf):
    df = cleaning.enrich(cleaning.clean(_raw(spark, sf)))
    return df.select(
        "dataset_id", "_key", "id", F.round("rating", 2).alias("rating"), "review_count", "fasilitas",
        "capacity_proxy", "priority_score", "tier",
        F.col("data_quality.rating_source").alias("rating_source"),
        F.col("data_quality.facilities_source").alias("facilities_source"),
        F.round(F.col("coordinate")[0], 9).alias("lon"), F.round(F.col("coordinate")[1], 9).alias("lat"),
    )


QUERIES["B15_C3_G3_enriched"] = enriched
ORACLE["B15_C3_G3_enriched"] = _sql("scored", """
SELECT dataset_id, concat(dataset_id, '_', id) AS _key, id, round(rating,2) AS rating, review_n AS review_count,
  array_to_string(fac, ', ') AS fasilitas, capacity_proxy, priority_score,
  CASE WHEN priority_score >= 78e-2 THEN 'A' WHEN priority_score >= 58e-2 THEN 'B' WHEN priority_score >= 38e-2 THEN 'C' ELSE 'D' END AS tier,
  rating_source, facilities_source, round(lon2, 9) AS lon, round(lat2, 9) AS lat FROM scored
""")


# ---- B14 -----------------------------------------------------------------------
def synonyms(spark, sf):
    r = table(spark, sf, "raw_poi")
    df = r.select(
        "input_pos",
        F.when(F.col("input_pos") % 2 == 0, F.col("provinsi")).alias("province"),
        F.when(F.col("input_pos") % 3 == 0, F.col("provinsi")).alias("provinsi"),
        F.when(F.col("input_pos") % 2 == 0, F.col("facilities")).alias("fasilitas"),
        F.when(F.col("input_pos") % 5 == 0, F.array(F.lit("ac"), F.col("mosque_type"))).alias("facilities"),
    )
    df = cleaning.sync_synonyms(df)
    return df.select("input_pos", "province", "provinsi", "fasilitas", F.array_join("facilities", "+").alias("facilities"))


QUERIES["B14_synonyms"] = synonyms
ORACLE["B14_synonyms"] = sql_with(["raw_poi"], """
, e AS (SELECT input_pos, CASE WHEN input_pos%2=0 THEN provinsi END AS p1, CASE WHEN input_pos%3=0 THEN provinsi END AS p2,
  CASE WHEN input_pos%2=0 THEN facilities END AS f1, CASE WHEN input_pos%5=0 THEN ['ac', mosque_type] END AS f2 FROM raw_poi)
SELECT input_pos, coalesce(p1,p2) AS province, coalesce(p2,p1) AS provinsi, coalesce(f1, array_to_string(f2, ', ')) AS fasilitas,
  array_to_string(coalesce(f2, list_filter(list_transform(regexp_split_to_array(f1, '[|,;]+'), lambda x: trim(x)), lambda x: x <> '')), '+') AS facilities
FROM e
""")


# ---- C1, C2 ----------------------------------------------------------------------
def profiles(spark, sf):
    raw = _raw(spark, sf)
    done = cleaning.clean(raw)
    p = cleaning.dataset_profiles(raw, done, cleaning.dataset_labels(done))
    return p.select(
        "dataset_id", "dataset_label", "raw_rows", "valid_coordinate_rows", "enriched_rows",
        *[F.round(F.col(f"bbox.{s}"), 9).alias(s) for s in ("south", "north", "west", "east")],
    )


QUERIES["C1_C2_dataset_profile"] = profiles
ORACLE["C1_C2_dataset_profile"] = _sql("texted", """
, labels0 AS (SELECT dataset_id, provinsi, count(*) AS c FROM texted GROUP BY 1, 2),
labels1 AS (SELECT dataset_id, provinsi AS dataset_label FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY c DESC, provinsi) AS rn FROM labels0) WHERE rn = 1),
r AS (SELECT dataset_id, count(*) AS raw_rows FROM raw_poi GROUP BY 1),
t AS (SELECT dataset_id, count(*) AS n, round(min(lat2),9) AS south, round(max(lat2),9) AS north, round(min(lon2),9) AS west, round(max(lon2),9) AS east FROM texted GROUP BY 1)
SELECT r.dataset_id, dataset_label, raw_rows, n AS valid_coordinate_rows, n AS enriched_rows, south, north, west, east
FROM r LEFT JOIN t USING (dataset_id) LEFT JOIN labels1 USING (dataset_id)
""")


# ---- C5 -----------------------------------------------------------------------
def robust(spark, sf):
    p = table(spark, sf, "poi").select(
        "dataset_id",
        F.when(F.col("poi_id") % 97 == 0, F.col("lat") - 4.0).otherwise(F.col("lat")).alias("latitude"),
        F.when(F.col("poi_id") % 89 == 0, F.lit(150.0)).otherwise(
            F.when(F.col("dataset_id") == "ASIA", F.col("lon") / 2 + 50).otherwise(F.col("lon"))
        ).alias("longitude"),
    )
    b = listing.robust_bbox(p)
    return b.select(
        "dataset_id", "total_rows", "valid_rows", "used_rows", "ignored_outliers", "adjusted_to_area_limit",
        F.round("raw_area_km2", 1).alias("raw_area_km2"),
        *[F.round(F.col(f"bbox.{s}"), 7).alias(s) for s in ("south", "north", "west", "east")],
    )


QUERIES["C5_robust_bbox"] = robust
ORACLE["C5_robust_bbox"] = sql_with(["poi"], """
, p AS (SELECT dataset_id, CASE WHEN poi_id%97=0 THEN lat-4e0 ELSE lat END AS a,
  CASE WHEN poi_id%89=0 THEN 150e0 WHEN dataset_id='ASIA' THEN lon/2e0+50e0 ELSE lon END AS o FROM poi),
v AS (SELECT * FROM p WHERE a BETWEEN -115e-1 AND 65e-1 AND o BETWEEN 94e0 AND 1425e-1),
q AS (SELECT dataset_id, count(*) AS nv, quantile_cont(a,25e-2) a1, quantile_cont(a,75e-2) a3, quantile_cont(o,25e-2) o1, quantile_cont(o,75e-2) o3 FROM v GROUP BY 1),
u AS (SELECT v.* FROM v JOIN q USING (dataset_id) WHERE a BETWEEN a1-15e-1*(a3-a1) AND a3+15e-1*(a3-a1) AND o BETWEEN o1-15e-1*(o3-o1) AND o3+15e-1*(o3-o1)),
b AS (SELECT dataset_id, count(*) AS nu, min(a) s, max(a) n, min(o) w, max(o) e, quantile_cont(a,5e-1) ma, quantile_cont(o,5e-1) mo FROM u GROUP BY 1),
c AS (SELECT *, abs(n-s)*111e0*abs(e-w)*111e0*greatest(cos(radians((n+s)/2e0)),2e-1) AS raw FROM b),
t AS (SELECT dataset_id, count(*) AS total_rows FROM p GROUP BY 1)
SELECT dataset_id, total_rows, nv AS valid_rows, nu AS used_rows, nv-nu AS ignored_outliers, raw > 1100 AS adjusted_to_area_limit,
  round(round(raw,2),1) AS raw_area_km2,
  round(CASE WHEN raw>1100 THEN ma - sqrt(1100e0)/2e0/111e0 ELSE s-2e-2 END,7) AS south,
  round(CASE WHEN raw>1100 THEN ma + sqrt(1100e0)/2e0/111e0 ELSE n+2e-2 END,7) AS north,
  round(CASE WHEN raw>1100 THEN mo - sqrt(1100e0)/2e0/(111e0*greatest(cos(radians(ma)),2e-1)) ELSE w-2e-2 END,7) AS west,
  round(CASE WHEN raw>1100 THEN mo + sqrt(1100e0)/2e0/(111e0*greatest(cos(radians(ma)),2e-1)) ELSE e+2e-2 END,7) AS east
FROM c JOIN q USING (dataset_id) JOIN t USING (dataset_id)
""")


# ---- B16-B18, C6-C8, E1, E6, B19, B21 ---------------------------------------------
def region_filter(spark, sf):
    p = listing.in_region(table(spark, sf, "poi"), "ASIA", "kota 7")
    return p.select("poi_id", "dataset_id", "kabko")


QUERIES["B16_region_filter"] = region_filter
ORACLE["B16_region_filter"] = sql_with(["poi"], "SELECT poi_id, dataset_id, kabko FROM poi WHERE dataset_id = 'ASIA' AND lower(kabko) = 'kota 7'")

_FACS = "array_compact(array(if(facility_bits & 1 > 0, 'ac', null), if(facility_bits & 2 > 0, 'Parking_lot', null), if(facility_bits & 4 > 0, 'toilet', null)))"


def markers(spark, sf):
    p = table(spark, sf, "poi").select(
        F.concat(F.lit("p"), (F.col("poi_id") - F.col("poi_id") % 2).cast("string")).alias("id"),
        "name", "address", "tier", F.replace(F.col("rating").cast("string"), F.lit("."), F.lit(",")).alias("rating"),
        F.expr(_FACS).alias("facilities"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
    )
    return listing.quick_filter(p, top_rated=True, facilities=["parking"], text="RAYA").select("id")


QUERIES["B17_quick_filters"] = markers
ORACLE["B17_quick_filters"] = sql_with(["poi"], """
SELECT DISTINCT concat('p', CAST(poi_id - poi_id % 2 AS STRING)) AS id FROM poi
WHERE coalesce(rating, 0) >= 48e-1 AND (facility_bits & 2) > 0 AND (lower(name) LIKE '%raya%' OR lower(address) LIKE '%raya%')
""")


def suggestions(spark, sf):
    return listing.suggest(table(spark, sf, "poi"), "Kec. 10", [F.col("poi_id")]).select("poi_id", "name")


QUERIES["B18_suggestions"] = suggestions
ORACLE["B18_suggestions"] = sql_with(["poi"], "SELECT poi_id, name FROM poi WHERE lower(name) LIKE '%kec. 10%' OR lower(kecamatan) LIKE '%kec. 10%' ORDER BY poi_id LIMIT 6")


def counts(spark, sf):
    return listing.count_points(table(spark, sf, "poi"))


QUERIES["C6_counts"] = counts
ORACLE["C6_counts"] = sql_with(["poi"], "SELECT dataset_id, lower(kabko) AS kabko, count(*) AS points FROM poi GROUP BY 1, 2")


def _profile_rows(spark, sf):
    return table(spark, sf, "poi").groupBy("province").agg(
        F.count("*").alias("n"), F.min("poi_id").alias("m"),
    ).select(
        "province", (F.col("m") % 2 == 0).alias("processed"),
        F.when(F.col("m") % 3 == 0, "completed").otherwise("failed").alias("status"),
        F.when(F.col("m") % 2 == 0, F.col("n")).alias("enriched_rows"),
        F.when(F.col("m") % 3 == 0, F.col("n") * 10).alias("profile_enriched_rows"),
        F.when(F.col("m") % 5 == 0, F.col("n") * 100).alias("mosque_count"),
    )


_PROFILE_SQL = """
, pr AS (SELECT province, count(*) AS n, min(poi_id) AS m FROM poi GROUP BY 1),
ps AS (SELECT province, m%2=0 AS processed, CASE WHEN m%3=0 THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN m%2=0 THEN n END AS c1, CASE WHEN m%3=0 THEN n*10 END AS c2, CASE WHEN m%5=0 THEN n*100 END AS c3 FROM pr)
"""


def national(spark, sf):
    return listing.national_total(_profile_rows(spark, sf))


QUERIES["C7_national_total"] = national
ORACLE["C7_national_total"] = sql_with(["poi"], _PROFILE_SQL + "SELECT CAST(sum(coalesce(c1,c2,c3,0)) AS BIGINT) AS total_points FROM ps")


def completed(spark, sf):
    return listing.completed_datasets(_profile_rows(spark, sf)).select("province", "status")


QUERIES["B21_completed_datasets"] = completed
ORACLE["B21_completed_datasets"] = sql_with(["poi"], _PROFILE_SQL + "SELECT province, status FROM ps WHERE processed AND status = 'completed'")


def quality(spark, sf):
    q = listing.quality_profile(table(spark, sf, "poi"))
    return q.select(
        "dataset_id", "points", *[F.round(c, 8).alias(c) for c in ("rating_fill", "kelurahan_fill", "mean_rating")],
        "tier_a", "tier_b", "tier_c", "tier_d",
    )


QUERIES["C8_quality_profile"] = quality
ORACLE["C8_quality_profile"] = sql_with(["poi"], """
SELECT dataset_id, count(*) AS points, round(avg(CASE WHEN rating IS NULL THEN 0e0 ELSE 1e0 END),8) AS rating_fill,
  round(avg(CASE WHEN trim(kelurahan) = '' THEN 0e0 ELSE 1e0 END),8) AS kelurahan_fill, round(avg(rating),8) AS mean_rating,
  count(*) FILTER (tier='A') AS tier_a, count(*) FILTER (tier='B') AS tier_b, count(*) FILTER (tier='C') AS tier_c, count(*) FILTER (tier='D') AS tier_d
FROM poi GROUP BY 1
""")


def rollup(spark, sf):
    """Quality figures of all region levels; points without a city name keep a row of their own on each level."""
    p = table(spark, sf, "poi").withColumn("kabko", F.when(F.col("poi_id") % 29 != 0, F.col("kabko")))
    q = listing.quality_rollup(p)
    return q.select(
        "level", "province", "kabko", "kecamatan", "points", *[F.round(c, 8).alias(c) for c in ("rating_fill", "kelurahan_fill", "mean_rating")],
        "tier_a", "tier_b", "tier_c", "tier_d",
    )


QUERIES["C8_region_rollup"] = rollup
ORACLE["C8_region_rollup"] = sql_with(["poi"], """
, p AS (SELECT province, CASE WHEN poi_id % 29 <> 0 THEN kabko END AS kabko, kecamatan, kelurahan, rating, tier FROM poi)
SELECT GROUPING(province, kabko, kecamatan) AS level, province, kabko, kecamatan, count(*) AS points,
  round(avg(CASE WHEN rating IS NULL THEN 0e0 ELSE 1e0 END),8) AS rating_fill,
  round(avg(CASE WHEN trim(kelurahan) = '' THEN 0e0 ELSE 1e0 END),8) AS kelurahan_fill, round(avg(rating),8) AS mean_rating,
  count(*) FILTER (tier='A') AS tier_a, count(*) FILTER (tier='B') AS tier_b, count(*) FILTER (tier='C') AS tier_c, count(*) FILTER (tier='D') AS tier_d
FROM p GROUP BY ROLLUP (province, kabko, kecamatan)
""")


def listed(spark, sf):
    return listing.page(table(spark, sf, "poi"), 100, 40).select("poi_id", "priority_score")


QUERIES["E1_listing"] = listed
ORACLE["E1_listing"] = sql_with(["poi"], "SELECT poi_id, priority_score FROM poi ORDER BY priority_score DESC, poi_id LIMIT 100 OFFSET 40")


def progress(spark, sf):
    items = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed")
        .when(F.col("o_orderkey") % 2 == 0, "skipped").otherwise("running").alias("status"),
    )
    return listing.job_progress(items)


QUERIES["E6_job_progress"] = progress
ORACLE["E6_job_progress"] = """
WITH i AS (SELECT o_custkey % 40 AS job_id, CASE WHEN o_orderstatus='F' THEN 'succeeded' WHEN o_orderstatus='O' THEN 'failed'
  WHEN o_orderkey%2=0 THEN 'skipped' ELSE 'running' END AS status FROM orders)
SELECT job_id, count(*) AS total, count(*) FILTER (status <> 'running') AS completed, count(*) FILTER (status='succeeded') AS succeeded,
  count(*) FILTER (status='failed') AS failed, count(*) FILTER (status='skipped') AS skipped FROM i GROUP BY 1
"""


def validated(spark, sf):
    t = table(spark, sf, "trips").select(
        "request_id", "o_lat", F.when(F.col("request_id") % 10 != 0, F.col("o_lon")).alias("o_lon"),
        F.col("departure_min").cast("string").alias("departure"), "prayer", "profile", "fuel_price_per_liter",
        (F.col("request_id") % 230).cast("double").alias("search_radius_km"),
        (F.col("request_id") % 12).cast("int").alias("maximum_results"),
        (F.col("request_id") % 9 - 1.0).alias("fuel_efficiency_km_per_liter"),
        F.lit(None).cast("double").alias("operating_cost_per_km"), F.lit(1000.0).alias("toll_cost_per_km"),
    )
    return listing.validate(t, "recommend").select("request_id", F.array_join("violations", ",").alias("violations"))


QUERIES["B19_validation"] = validated
ORACLE["B19_validation"] = sql_with(["trips"], """
SELECT request_id, concat_ws(',', CASE WHEN request_id%10=0 THEN 'origin' END,
  CASE WHEN profile NOT IN ('fastest','prayer_priority','low_cost','balanced') THEN 'profile' END,
  CASE WHEN request_id%230 < 1 OR request_id%230 > 200 THEN 'search_radius_km' END,
  CASE WHEN request_id%12 < 1 OR request_id%12 > 10 THEN 'maximum_results' END,
  CASE WHEN request_id%9 - 1 <= 0 THEN 'fuel_efficiency_km_per_liter' END) AS violations FROM trips
""")
