"""Registered queries on change sets, hierarchy, catalog, benchmarks: C14, C15, D7-D9, D11-D16, F17."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.fixtures import sql_with, table
from wayfold.operators import benchmarks, catalog, changes

QUERIES = {}
ORACLE = {}


def _pois(spark, sf):
    p = table(spark, sf, "poi")
    return p.select(
        "dataset_id", F.concat(F.lit("p"), F.col("poi_id").cast("string")).alias("id"), "poi_id",
        F.concat_ws("_", "dataset_id", F.concat(F.lit("p"), F.col("poi_id").cast("string"))).alias("_key"),
        "name", "province", "kabko", "kecamatan", "kelurahan", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.array("lon", "lat").alias("coordinate"), "priority_score",
    )


def hierarchy_nodes(spark, sf):
    return changes.admin_nodes(_pois(spark, sf))


def hierarchy_edges(spark, sf):
    return changes.admin_edges(_pois(spark, sf)).select("edge_type", "key", "src", "dst")


_slug = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
_KEYED = {"keyed": f"SELECT concat(dataset_id, '_p', CAST(poi_id AS STRING)) AS pk, province, kabko, kecamatan, kelurahan, {_slug('province')} AS k1, "
                   f"{_slug('kabko')} AS k2, {_slug('kecamatan')} AS k3, CASE WHEN kelurahan<>'' THEN {_slug('kelurahan')} END AS k4 FROM poi"}
QUERIES["D8_admin_nodes"] = hierarchy_nodes
ORACLE["D8_admin_nodes"] = sql_with(["keyed"], """
SELECT 'province' AS level, k1 AS key, max(province) AS name FROM keyed GROUP BY 2 UNION ALL SELECT 'city', k2, max(kabko) FROM keyed GROUP BY 2
UNION ALL SELECT 'district', k3, max(kecamatan) FROM keyed GROUP BY 2 UNION ALL SELECT 'village', k4, max(kelurahan) FROM keyed WHERE k4 IS NOT NULL GROUP BY 2
""", _KEYED)
QUERIES["D8_admin_edges"] = hierarchy_edges
ORACLE["D8_admin_edges"] = sql_with(["keyed"], """
SELECT DISTINCT 'belongs_to_province' AS edge_type, concat(k2,'_',k1) AS key, k2 AS src, k1 AS dst FROM keyed
UNION ALL SELECT DISTINCT 'belongs_to_city', concat(k3,'_',k2), k3, k2 FROM keyed
UNION ALL SELECT DISTINCT 'belongs_to_district', concat(k4,'_',k3), k4, k3 FROM keyed WHERE k4 IS NOT NULL
UNION ALL SELECT DISTINCT 'located_in_village', concat(pk,'_',k4), pk, k4 FROM keyed WHERE k4 IS NOT NULL
""", _KEYED)


def looked_up(spark, sf):
    keys = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "all").otherwise("ASIA").alias("dataset_id"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id"),
    )
    return changes.lookup(keys, _pois(spark, sf)).select("request_id", "found_dataset", "poi_id")


QUERIES["D9_lookup"] = looked_up
ORACLE["D9_lookup"] = sql_with(["poi"], """
SELECT o_orderkey AS request_id, dataset_id AS found_dataset, poi_id FROM orders JOIN poi ON poi_id = o_custkey
WHERE o_orderkey % 3 = 0 OR dataset_id = 'ASIA'
""")


def inserted(spark, sf):
    new = table(spark, sf, "supplier").select(
        F.lit("ASIA").alias("dataset_id"), F.concat(F.lit("p"), (F.col("s_suppkey") * 30).cast("string")).alias("id"),
        F.col("s_name").alias("name"), F.lit(-6.5).alias("latitude"), F.lit(107.0).alias("longitude"),
    )
    r = changes.insert_points(_pois(spark, sf), new)
    return r.groupBy("dataset_id").agg(
        F.count("*").alias("points"), F.count_if(F.col("latitude") == -6.5).alias("added"),
        F.round(F.sum(F.when(F.col("latitude") == -6.5, F.col("priority_score"))), 4).alias("added_priority"),
    )


QUERIES["D11_insert"] = inserted
ORACLE["D11_insert"] = sql_with(["poi"], """
, kept AS (SELECT dataset_id FROM poi p WHERE NOT (dataset_id = 'ASIA' AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey*30 = p.poi_id))),
r AS (SELECT dataset_id, 0 AS a FROM kept UNION ALL SELECT 'ASIA', 1 FROM supplier)
SELECT dataset_id, count(*) AS points, count(*) FILTER (a=1) AS added, CASE WHEN sum(a) > 0 THEN CAST(sum(a) AS DOUBLE) END AS added_priority FROM r GROUP BY 1
""")


def _patches(spark, sf):
    """Two patches for some points, and patches of keys that do not exist."""
    o = table(spark, sf, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 2 == 0, "ASIA").otherwise("EUROPE").alias("dataset_id"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("N"), F.col("o_orderkey").cast("string"))).alias("name"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") / 1e6).alias("latitude"),
        F.lit(None).cast("string").alias("kabko"),
    )


def patched(spark, sf):
    out, _ = changes.apply_patches(_pois(spark, sf), _patches(spark, sf))
    return out.select("poi_id", "name", "kabko", F.round("latitude", 8).alias("latitude"), F.round(F.col("coordinate")[1], 8).alias("point_lat"))


_PATCH = {"patches": "SELECT CASE WHEN o_orderkey%2=0 THEN 'ASIA' ELSE 'EUROPE' END AS dataset_id, o_custkey AS poi_id, o_orderkey AS seq, "
                     "CASE WHEN o_orderkey%3=0 THEN concat('N', CAST(o_orderkey AS STRING)) END AS nm, CASE WHEN o_orderkey%5=0 THEN o_orderkey/1e6 END AS la FROM orders"}
QUERIES["D12_patches"] = patched
ORACLE["D12_patches"] = sql_with(["poi", "patches"], """
, l AS (SELECT dataset_id, poi_id, arg_max(nm, seq) FILTER (nm IS NOT NULL) AS nm, arg_max(la, seq) FILTER (la IS NOT NULL) AS la FROM patches GROUP BY 1, 2)
SELECT p.poi_id, coalesce(nm, name) AS name, kabko, round(coalesce(la, lat), 8) AS latitude, round(coalesce(la, lat), 8) AS point_lat
FROM poi p LEFT JOIN l ON l.poi_id = p.poi_id AND l.dataset_id = p.dataset_id
""", _PATCH)


def unknown_patches(spark, sf):
    return changes.apply_patches(_pois(spark, sf), _patches(spark, sf))[1].select("dataset_id", "id", "seq")


QUERIES["D12_unknown_patches"] = unknown_patches
ORACLE["D12_unknown_patches"] = sql_with(["poi", "patches"], """
SELECT dataset_id, concat('p', CAST(poi_id AS STRING)) AS id, seq FROM patches x WHERE NOT EXISTS (
  SELECT 1 FROM poi p WHERE p.poi_id = x.poi_id AND p.dataset_id = x.dataset_id)
""", _PATCH)


def deleted(spark, sf):
    pois = _pois(spark, sf)
    keys = table(spark, sf, "supplier").select(F.lit("ASIA").alias("dataset_id"), F.concat(F.lit("p"), (F.col("s_suppkey") * 7).cast("string")).alias("id"))
    sets = pois.filter(F.col("dataset_id") == "AFRICA").select("dataset_id").distinct()
    rest, edges = changes.delete_points(pois, changes.admin_edges(pois), keys, sets)
    a = rest.groupBy("dataset_id").agg(F.count("*").alias("n")).select(F.lit("points").alias("what"), F.col("dataset_id").alias("part"), "n")
    b = edges.groupBy("edge_type").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.col("edge_type").alias("part"), "n")
    return a.unionByName(b)


QUERIES["D13_deletes"] = deleted
ORACLE["D13_deletes"] = sql_with(["poi", "keyed"], """
, gone AS (SELECT concat(dataset_id, '_p', CAST(poi_id AS STRING)) AS pk FROM poi WHERE dataset_id = 'AFRICA' OR (dataset_id = 'ASIA' AND poi_id IN (SELECT s_suppkey*7 FROM supplier))),
kept AS (SELECT * FROM poi WHERE concat(dataset_id, '_p', CAST(poi_id AS STRING)) NOT IN (SELECT pk FROM gone))
SELECT 'points' AS what, dataset_id AS part, count(*) AS n FROM kept GROUP BY 2
UNION ALL SELECT 'edges', 'located_in_village', count(*) FROM keyed WHERE k4 IS NOT NULL AND pk NOT IN (SELECT pk FROM gone)
UNION ALL SELECT 'edges', 'belongs_to_province', count(*) FROM (SELECT DISTINCT k2, k1 FROM keyed)
UNION ALL SELECT 'edges', 'belongs_to_city', count(*) FROM (SELECT DISTINCT k3, k2 FROM keyed)
UNION ALL SELECT 'edges', 'belongs_to_district', count(*) FROM (SELECT DISTINCT k4, k3 FROM keyed WHERE k4 IS NOT NULL)
""", _KEYED)


def settings(spark, sf):
    cur = table(spark, sf, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.create_map(F.lit("profile"), F.lit("balanced"), F.lit("bufferKm"), F.lit("15")).alias("search_settings"),
        F.create_map(F.lit("fajr"), F.lit("04:30")).alias("prayer_settings"), F.lit("2026-01-01").alias("client_updated_at"),
    )
    upd = table(spark, sf, "orders").select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("bufferKm"), F.col("o_orderkey").cast("string"))).alias("search_settings"),
        F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("isha"), F.col("o_orderkey").cast("string"))).alias("prayer_settings"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("client_updated_at"),
    )
    m = changes.merge_settings(cur, upd)
    return m.select(
        "user_id", F.col("search_settings")["profile"].alias("profile"), F.col("search_settings")["bufferKm"].alias("buffer"),
        F.col("prayer_settings")["fajr"].alias("fajr"), F.col("prayer_settings")["isha"].alias("isha"), "client_updated_at",
    )


QUERIES["D14_settings_merge"] = settings
ORACLE["D14_settings_merge"] = """
WITH u AS (SELECT o_custkey AS k, max(o_orderkey) FILTER (o_orderkey%2=0) AS b, max(o_orderkey) FILTER (o_orderkey%3=0) AS i, max(o_orderkey) AS c FROM orders GROUP BY 1)
SELECT concat('u', CAST(coalesce(c_custkey, k) AS STRING)) AS user_id, CASE WHEN c_custkey IS NOT NULL THEN 'balanced' END AS profile,
  coalesce(CAST(b AS STRING), CASE WHEN c_custkey IS NOT NULL THEN '15' END) AS buffer, CASE WHEN c_custkey IS NOT NULL THEN '04:30' END AS fajr,
  CAST(i AS STRING) AS isha, coalesce(concat('c', CAST(c AS STRING)), '2026-01-01') AS client_updated_at
FROM customer FULL JOIN u ON k = c_custkey
"""


def settings_reset(spark, sf):
    """Users with settings: those who ordered; every customer asks for a reset, then what is left is listed as kept."""
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string")).alias("user_id")
    have = table(spark, sf, "orders").filter("o_custkey IS NOT NULL").select(name("o_custkey"), F.lit("balanced").alias("profile")).distinct()
    asked = table(spark, sf, "customer").select(name("c_custkey"))
    rest, answers = changes.delete_settings(have, asked)
    return answers.unionByName(rest.select("user_id", F.lit("kept").alias("status")))


QUERIES["D14_settings_reset"] = settings_reset
ORACLE["D14_settings_reset"] = """
WITH h AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL), c AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey IS NOT NULL)
SELECT concat('u', CAST(k AS STRING)) AS user_id, CASE WHEN k IN (SELECT k FROM h) THEN 'success' ELSE 'not_found' END AS status FROM c
UNION ALL SELECT concat('u', CAST(k AS STRING)), 'kept' FROM h WHERE k NOT IN (SELECT k FROM c)
"""


def assigned(spark, sf):
    keys = table(spark, sf, "customer").select(F.lower(F.concat("c_mktsegment", F.lit("_"), "c_nationkey")).alias("dataset_id"))
    rules = table(spark, sf, "nation").select(
        F.explode(F.array(
            F.struct(F.lit("auto*").alias("pattern"), F.lit("w1").alias("target")),
            F.struct(F.lit("automobile_1*").alias("pattern"), F.lit("w2").alias("target")),
            F.struct(F.concat(F.lit("building_"), F.col("n_nationkey").cast("string")).alias("pattern"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("target")),
        )).alias("r")
    ).select("r.*").distinct()
    return catalog.assign_by_prefix(keys, rules, "w0")


QUERIES["D15_prefix_assignment"] = assigned
ORACLE["D15_prefix_assignment"] = """
SELECT DISTINCT dataset_id, CASE WHEN dataset_id LIKE 'building\\_%' ESCAPE '\\' THEN concat('b', substr(dataset_id, 10)) WHEN dataset_id LIKE 'automobile\\_1%' ESCAPE '\\' THEN 'w2'
  WHEN dataset_id LIKE 'auto%' THEN 'w1' ELSE 'w0' END AS target FROM (SELECT lower(concat(c_mktsegment, '_', CAST(c_nationkey AS STRING))) AS dataset_id FROM customer)
"""


def ledger(spark, sf):
    prof = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("dataset_id"), F.lit(3).cast("long").alias("data_revision"), F.col("n_nationkey").cast("long").alias("mosque_count"))
    log = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).cast("string").alias("dataset_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 50 == 0, (F.col("o_orderkey") % 1000)).cast("long").alias("requested_revision"),
        ((F.col("o_orderkey") * 7) % 11 - 5).alias("delta"),
    )
    return changes.revision_ledger(prof, log)


QUERIES["D16_revision_ledger"] = ledger
ORACLE["D16_revision_ledger"] = """
WITH m AS (SELECT o_custkey%25 AS d, (o_orderkey*7)%11-5 AS delta, CASE WHEN o_orderkey%50=0 THEN o_orderkey%1000 END AS req,
  row_number() OVER (PARTITION BY o_custkey%25 ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey%25) AS n,
  sum((o_orderkey*7)%11-5) OVER (PARTITION BY o_custkey%25 ORDER BY o_orderkey) AS run FROM orders)
SELECT CAST(n_nationkey AS STRING) AS dataset_id, CAST(greatest(3+max(n), coalesce(max(req-i+1)+max(n), 0)) AS BIGINT) AS data_revision,
  CAST(sum(delta) + greatest(n_nationkey, -min(run)) AS BIGINT) AS mosque_count
FROM nation JOIN m ON d = n_nationkey GROUP BY n_nationkey
"""


# ---- corridor plans, covering graphs, catalog ------------------------------------
def plans(spark, sf):
    t = table(spark, sf, "trips").withColumn("dataset_id", F.lit("dki jakarta")).withColumn("buffer_km", (F.col("request_id") % 12).cast("double"))
    p = catalog.corridor_plan(t)
    return p.select("request_id", "graph_id", "plan_buffer_km", "area_km2", *[F.round(c, 6).alias(c) for c in ("north", "south", "east", "west")])


_PLAN = {
    "buf0": "SELECT request_id, o_lat, o_lon, d_lat, d_lon, greatest(25e-1, least(6e0, request_id%12)) AS b0 FROM trips",
    "buf1": "SELECT *, i, CASE i WHEN 0 THEN b0 WHEN 1 THEN greatest(25e-1,b0*75e-2) WHEN 2 THEN greatest(25e-1,greatest(25e-1,b0*75e-2)*75e-2) "
            "WHEN 3 THEN greatest(25e-1,greatest(25e-1,greatest(25e-1,b0*75e-2)*75e-2)*75e-2) ELSE 25e-1 END AS bk FROM buf0, (SELECT unnest(range(5)) AS i)",
    "buf2": "SELECT *, ceil((greatest(o_lat,d_lat)+bk/111e0)/25e-3)*25e-3 AS n, floor((least(o_lat,d_lat)-bk/111e0)/25e-3)*25e-3 AS s, "
            "ceil((greatest(o_lon,d_lon)+bk/(111e0*greatest(cos(radians((o_lat+d_lat)/2e0)),2e-1)))/25e-3)*25e-3 AS e, "
            "floor((least(o_lon,d_lon)-bk/(111e0*greatest(cos(radians((o_lat+d_lat)/2e0)),2e-1)))/25e-3)*25e-3 AS w FROM buf1",
    "buf3": "SELECT *, abs(n-s)*111e0*abs(e-w)*111e0*greatest(cos(radians((n+s)/2e0)),2e-1) AS a FROM buf2",
    "buf4": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN a<=350 THEN i ELSE 100-i END) AS rn FROM buf3 WHERE a<=1500) WHERE rn=1",
}
QUERIES["F17_corridor_plan"] = plans
ORACLE["F17_corridor_plan"] = sql_with(["buf4", "trips"], """
SELECT t.request_id, CASE WHEN a IS NOT NULL THEN concat('dki_jakarta-', substr(sha256(concat('{"bounds":[', CAST(round(n,6) AS STRING), ',', CAST(round(s,6) AS STRING), ',', CAST(round(e,6) AS STRING), ',', CAST(round(w,6) AS STRING),
  '],"dataset_id":"dki jakarta","network_type":"drive"}')), 1, 16)) END AS graph_id,
  round(bk,3) AS plan_buffer_km, round(a,2) AS area_km2, round(n,6) AS north, round(s,6) AS south, round(e,6) AS east, round(w,6) AS west
FROM trips t LEFT JOIN buf4 USING (request_id)
""", _PLAN)


def _catalog(spark, sf):
    """Graph bounds around every supplier's point."""
    q = table(spark, sf, "query_points")
    half = 0.05 + (F.col("query_id") % 10) * 0.02
    g = q.select(
        F.concat(F.lit("g"), F.lpad(F.col("query_id").cast("string"), 6, "0")).alias("graph_id"),
        F.when(F.col("query_id") % 2 == 0, "east").otherwise("west").alias("dataset_id"),
        (F.col("lat") + half).alias("north"), (F.col("lat") - half).alias("south"), (F.col("lon") + half).alias("east"), (F.col("lon") - half).alias("west"),
        (F.col("query_id") % 10).cast("double").alias("area_km2"), (F.col("query_id") % 7 * 1000).cast("double").alias("created_at"),
        F.when(F.col("query_id") % 3 == 0, (F.col("query_id") % 5 * 1000).cast("double")).alias("last_used_at"),
        F.when(F.col("query_id") % 11 == 0, "failed").when(F.col("query_id") % 13 == 0, "building").otherwise("ready").alias("status"),
        (F.col("query_id") * 1000003).alias("size_bytes"),
    )
    return g


_CAT = {"catalog0": "SELECT *, 5e-2 + (query_id%10)*2e-2 AS h, concat('g', lpad(CAST(query_id AS STRING),6,'0')) AS graph_id, (query_id%7*1000) AS created_at, "
                    "CASE WHEN query_id%3=0 THEN query_id%5*1000 END AS last_used_at, CASE WHEN query_id%11=0 THEN 'failed' WHEN query_id%13=0 THEN 'building' ELSE 'ready' END AS status FROM query_points"}


def covering(spark, sf):
    t = table(spark, sf, "trips").withColumn("dataset_id", F.when(F.col("request_id") % 2 == 0, "east").otherwise("west"))
    return catalog.covering_graphs(t, _catalog(spark, sf)).select("request_id", "graph_id")


QUERIES["D7_covering_graph"] = covering
ORACLE["D7_covering_graph"] = sql_with(["catalog0", "trips"], """
, m AS (SELECT t.request_id, g.graph_id, row_number() OVER (PARTITION BY t.request_id ORDER BY g.query_id%10, -coalesce(last_used_at, created_at), graph_id) AS rn
  FROM (SELECT *, 5e-1/111e0 AS dy, 5e-1/(111e0*greatest(cos(radians((o_lat+d_lat)/2e0)),2e-1)) AS dx FROM trips) t JOIN catalog0 g
  ON g.status='ready' AND g.query_id%2 = t.request_id%2 AND o_lat BETWEEN lat-h-dy AND lat+h+dy AND d_lat BETWEEN lat-h-dy AND lat+h+dy
  AND o_lon BETWEEN lon-h-dx AND lon+h+dx AND d_lon BETWEEN lon-h-dx AND lon+h+dx)
SELECT request_id, graph_id FROM m WHERE rn = 1
""", _CAT)


def summary(spark, sf):
    return catalog.catalog_summary(_catalog(spark, sf))


QUERIES["C15_catalog_summary"] = summary
ORACLE["C15_catalog_summary"] = sql_with(["catalog0"], """
SELECT count(*) AS total, count(*) FILTER (status='ready') AS ready, count(*) FILTER (status='building') AS building, count(*) FILTER (status='failed') AS failed,
  round(CAST(sum(query_id*1000003) FILTER (status='ready') AS DOUBLE)/1048576e0, 2) AS total_size_mb FROM catalog0
""", _CAT)


def latest(spark, sf):
    return catalog.latest_graphs(_catalog(spark, sf), 20).select("graph_id", "status")


QUERIES["C15_latest_graphs"] = latest
ORACLE["C15_latest_graphs"] = sql_with(["catalog0"], """
SELECT graph_id, status FROM catalog0 ORDER BY coalesce(nullif(last_used_at, 0), created_at, 0) DESC, graph_id LIMIT 20
""", _CAT)


# ---- C14 ----------------------------------------------------------------------------
def _results(spark, sf):
    l = table(spark, sf, "lineitem")
    r = l.select(
        F.col("l_suppkey").alias("run"), (F.col("l_extendedprice") / 100).alias("dijkstra_ms"),
        (F.col("l_extendedprice") * (1 + F.col("l_discount")) / 100).alias("astar_ms"),
        F.col("l_quantity").alias("route_distance_km"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("external_distance_km"),
        (F.col("l_quantity") * 60).alias("route_travel_time_seconds"), (F.col("l_quantity") * 60 * (1 - F.col("l_tax"))).alias("external_duration_seconds"),
        F.col("l_quantity").alias("dijkstra_cost"), (F.col("l_quantity") + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0.0)).alias("astar_cost"),
    )
    return benchmarks.with_errors(r)


def metrics(spark, sf):
    m = benchmarks.metric_summary(_results(spark, sf), {"dijkstra_ms": "dijkstra_ms", "astar_ms": "astar_ms", "km": "route_distance_km"})
    return m.select("measure", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99", "min", "max")])


_RES = {"res": "SELECT l_extendedprice/100 AS dms, l_extendedprice*(1+l_discount)/100 AS ams, l_quantity AS q, l_tax, l_linenumber AS ln FROM lineitem"}
QUERIES["C14_metric_summary"] = metrics
ORACLE["C14_metric_summary"] = sql_with(["res"], " UNION ALL ".join(
    f"SELECT '{n}' AS measure, round(avg({c}),6) AS mean, round(quantile_cont({c},5e-1),6) AS median, round(quantile_cont({c},95e-2),6) AS p95, "
    f"round(quantile_cont({c},99e-2),6) AS p99, round(min({c}),6) AS min, round(max({c}),6) AS max FROM res"
    for n, c in (("dijkstra_ms", "dms"), ("astar_ms", "ams"), ("km", "q"))), _RES)


def compared(spark, sf):
    l = table(spark, sf, "lineitem")
    r = benchmarks.compare_pairs(l.select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7.77).alias("dijkstra_ms"),
        (F.col("l_extendedprice") * (1 + F.col("l_discount")) / 7.77).alias("astar_ms"),
        F.col("l_partkey").alias("dijkstra_nodes"), (F.col("l_partkey") + F.col("l_linenumber") - 3).alias("astar_nodes"),
    ))
    return r.drop("dijkstra_ms", "astar_ms", "dijkstra_nodes", "astar_nodes")


QUERIES["C14_comparison"] = compared
ORACLE["C14_comparison"] = """
WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice/777e-2 AS d, l_extendedprice*(1+l_discount)/777e-2 AS a, l_partkey AS dn, l_partkey+l_linenumber-3 AS an FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a = d THEN 'Sama' WHEN a < d THEN 'A*' WHEN d < a THEN 'Dijkstra' END AS faster_algorithm,
  round(abs(d-a), 2) AS time_difference_ms, round(CASE WHEN greatest(d,a) > 0 THEN abs(d-a)/greatest(d,a)*100e0 ELSE 0e0 END, 1) AS efficiency_gain_percent,
  CASE WHEN an = dn THEN 'Sama' WHEN an < dn THEN 'A*' WHEN dn < an THEN 'Dijkstra' END AS fewer_explored_algorithm,
  abs(dn-an) AS explored_nodes_difference, greatest(0, dn-an) AS nodes_saved FROM m
"""


def duel(spark, sf):
    d = benchmarks.duel(_results(spark, sf))
    return d.select(
        "first_wins", "second_wins", "ties", "optimal_cost_matches", F.round("match_rate_percent", 6).alias("match_rate_percent"),
        F.round("max_cost_difference_seconds", 6).alias("max_cost_difference_seconds"), "validated_pairs",
        F.round("distance_mape_percent", 6).alias("distance_mape_percent"), F.round("duration_mape_percent", 6).alias("duration_mape_percent"),
    )


QUERIES["C14_duel"] = duel
ORACLE["C14_duel"] = sql_with(["res"], """
SELECT count(*) FILTER (dms<ams) AS first_wins, count(*) FILTER (ams<dms) AS second_wins, count(*) FILTER (dms=ams) AS ties,
  count(*) FILTER (ln<>3) AS optimal_cost_matches, round(count(*) FILTER (ln<>3)*100e0/count(*),6) AS match_rate_percent, round(max(CASE WHEN ln=3 THEN 5e-1 ELSE 0e0 END),6) AS max_cost_difference_seconds,
  count(*) AS validated_pairs, round(avg(abs(q-q*(1+l_tax))/(q*(1+l_tax))*100),6) AS distance_mape_percent,
  round(avg(abs(q*60-q*60*(1-l_tax))/(q*60*(1-l_tax))*100),6) AS duration_mape_percent FROM res
""", _RES)
