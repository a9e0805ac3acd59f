"""Inputs derived from the generic driver tables.

The texts run unchanged in Spark and in DuckDB; every view covers its whole
source table.  ``sql_with`` puts the views a query needs into a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["poi"] = """
SELECT c.c_custkey AS poi_id, n.n_name AS province, r.r_name AS dataset_id, c.c_mktsegment AS category,
  concat('Masjid ', n.n_name, ' ', CAST(c.c_custkey % 211 AS STRING)) AS name,
  -64e-1 + (c.c_custkey*7919 % 10007)/10007e0*5e-1 AS lat,
  1066e-1 + (c.c_custkey*104729 % 10009)/10009e0*4e-1 AS lon,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE 1e0 + (c.c_custkey*31 % 41)/10e0 END AS rating,
  CAST((c.c_custkey*17) % 120 AS INT) AS review_count,
  CAST(c.c_custkey % 8 AS INT) AS facility_bits,
  (c.c_custkey*37 % 101)/100e0 AS priority_score,
  CASE c.c_custkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' WHEN 2 THEN 'small' ELSE 'unknown' END AS capacity_proxy,
  CASE WHEN c.c_custkey*37 % 101 >= 78 THEN 'A' WHEN c.c_custkey*37 % 101 >= 58 THEN 'B'
       WHEN c.c_custkey*37 % 101 >= 38 THEN 'C' ELSE 'D' END AS tier,
  concat('Kota ', CAST(c.c_custkey % 23 AS STRING)) AS kabko,
  concat('Kec. ', CAST(c.c_custkey % 101 AS STRING)) AS kecamatan,
  CASE WHEN c.c_custkey % 13 = 0 THEN '' ELSE concat('Desa-', CAST(c.c_custkey % 307 AS STRING)) END AS kelurahan,
  concat('Jl. Raya ', CAST(c.c_custkey % 89 AS STRING)) AS address
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["query_points"] = """
SELECT s_suppkey AS query_id, -64e-1 + (s_suppkey*6007 % 9973)/9973e0*5e-1 AS lat,
  1066e-1 + (s_suppkey*7001 % 9967)/9967e0*4e-1 AS lon, 10e0 AS radius_km, 6 AS k FROM supplier
"""

VIEWS["trips"] = """
SELECT o_orderkey AS request_id,
  -64e-1 + (o_orderkey*3571 % 9973)/9973e0*4e-1 AS o_lat, 1066e-1 + (o_orderkey*2741 % 9967)/9967e0*4e-1 AS o_lon,
  -64e-1 + (o_orderkey*4271 % 9949)/9949e0*4e-1 AS d_lat, 1066e-1 + (o_orderkey*5519 % 9941)/9941e0*4e-1 AS d_lon,
  CAST((o_orderkey*53) % 1440 AS INT) AS departure_min,
  CASE o_orderkey % 5 WHEN 0 THEN 'fastest' WHEN 1 THEN 'prayer_priority' WHEN 2 THEN 'low_cost'
       WHEN 3 THEN 'balanced' ELSE 'scenic' END AS profile,
  CASE o_orderkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'Maghrib' WHEN 2 THEN 'dzuhur' ELSE '' END AS prayer,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 9000e0 + (o_orderkey % 11)*500e0 END AS fuel_price_per_liter
FROM orders
"""

VIEWS["road_nodes"] = """
SELECT p_partkey AS node, CAST((p_partkey - p_partkey % 50)/50 AS BIGINT) AS rw, p_partkey % 50 AS cl,
  -64e-1 + CAST((p_partkey - p_partkey % 50)/50 AS BIGINT)*1e-2 AS lat,
  1066e-1 + (p_partkey % 50)*8e-3 AS lon FROM part
"""

VIEWS["pairs"] = """
SELECT a.node AS u, b.node AS v FROM road_nodes a JOIN road_nodes b ON b.node = a.node + 1 AND a.cl < 49
UNION ALL SELECT a.node, b.node FROM road_nodes a JOIN road_nodes b ON b.node = a.node + 50
"""

VIEWS["dirs"] = """
SELECT u, v FROM pairs UNION ALL SELECT v AS u, u AS v FROM pairs WHERE (u*13) % 11 <> 0
"""

VIEWS["road_edges"] = """
SELECT d.u, d.v,
  1000e0*2e0*6371e0*atan2(sqrt(h.a), sqrt(1e0-h.a)) * (1e0 + ((d.u*7) % 5)/10e0) AS length,
  CASE WHEN d.u % 9 = 0 THEN 'yes' ELSE 'no' END AS toll,
  CASE d.u % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'residential' ELSE 'service' END AS highway
FROM dirs d JOIN (
  SELECT x.u, x.v, power(sin(radians(b.lat-a.lat)/2e0),2)
    + cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lon-a.lon)/2e0),2) AS a
  FROM dirs x JOIN road_nodes a ON a.node=x.u JOIN road_nodes b ON b.node=x.v) h ON h.u=d.u AND h.v=d.v
"""

VIEWS["timed_edges"] = """
SELECT u, v, length, toll, highway,
  length / (CASE highway WHEN 'primary' THEN 60e0 WHEN 'secondary' THEN 50e0 WHEN 'residential' THEN 30e0 ELSE 20e0 END / 36e-1)
    AS travel_time
FROM road_edges
"""

VIEWS["location_events"] = """
SELECT event_id, ts AS occurred_at, user_id, concat('R', CAST(user_id % 6 AS STRING)) AS region_id,
  concat('S', regexp_extract(props, '([0-9]+)', 1)) AS road_segment_id, value AS speed_kph,
  CAST((event_id*37) % 150 AS DOUBLE) AS accuracy_m FROM events
"""

# One upload per region, with the faults uploads have: AFRICA lost its decimal
# separators, AMERICA has latitude and longitude exchanged, the others mix
# separators and contain rows outside the national box.
VIEWS["raw_poi"] = """
SELECT r.r_name AS dataset_id, c.c_custkey AS input_pos,
  CASE WHEN r.r_name = 'EUROPE' THEN CAST(c.c_custkey - c.c_custkey % 10 + CASE WHEN c.c_custkey % 10 = 9 THEN 8 ELSE c.c_custkey % 10 END AS STRING) END AS uuid,
  concat(' Masjid ', CAST(c.c_custkey % 997 AS STRING), CASE WHEN c.c_custkey % 50 = 0 THEN ' Raya ' ELSE '' END) AS name,
  CASE r.r_name
    WHEN 'AFRICA' THEN concat('-6', lpad(CAST((c.c_custkey*7919) % 10000 AS STRING), 4, '0'), '00')
    WHEN 'AMERICA' THEN concat('106.', lpad(CAST((c.c_custkey*3571) % 1000 AS STRING), 3, '0'))
    ELSE CASE WHEN c.c_custkey % 17 = 0 THEN 'n/a' WHEN c.c_custkey % 19 = 0 THEN '51,5'
         WHEN c.c_custkey % 2 = 0 THEN concat('-6,', lpad(CAST((c.c_custkey*7919) % 1000 AS STRING), 3, '0'))
         ELSE concat('-6.', lpad(CAST((c.c_custkey*7919) % 1000 AS STRING), 3, '0')) END END AS latitude,
  CASE r.r_name
    WHEN 'AFRICA' THEN concat('106', lpad(CAST((c.c_custkey*104729) % 10000 AS STRING), 4, '0'))
    WHEN 'AMERICA' THEN concat('-7.', lpad(CAST((c.c_custkey*7919) % 1000 AS STRING), 3, '0'))
    ELSE concat('106,', lpad(CAST((c.c_custkey*104729) % 1000 AS STRING), 3, '0')) END AS longitude,
  CASE c.c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' NaN ' WHEN 2 THEN concat(CAST(c.c_custkey % 5 AS STRING), ',5')
    WHEN 3 THEN '1.234.567,89' WHEN 4 THEN concat(CAST(1 + c.c_custkey % 4 AS STRING), '.25') ELSE '4 stars' END AS rating,
  CASE c.c_custkey % 5 WHEN 0 THEN CAST(c.c_custkey % 120 AS STRING) WHEN 1 THEN '2,5' WHEN 2 THEN '3,5'
    WHEN 3 THEN '1.234,5' ELSE NULL END AS review_count,
  CASE c.c_custkey % 7 WHEN 0 THEN 'Wudhu_Area|toilets/ AC ' WHEN 1 THEN 'parking, sound; wifi ,library|canteen'
    WHEN 2 THEN 'none' WHEN 3 THEN 'Tempat  Wudhu' WHEN 4 THEN ' woman_area ;; AC' ELSE '' END AS facilities,
  n.n_name AS provinsi,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE concat(' Kota ', CAST(c.c_custkey % 23 AS STRING), ' ') END AS kabko,
  concat('Kec. ', CAST(c.c_custkey % 101 AS STRING)) AS kecamatan,
  concat('Desa ', CAST(c.c_custkey % 307 AS STRING)) AS kelurahan,
  concat('Jl. ', CAST(c.c_custkey % 89 AS STRING)) AS address,
  CASE c.c_custkey % 4 WHEN 0 THEN 'Masjid Jami' WHEN 1 THEN 'Islamic_Center' WHEN 2 THEN 'Musholla' ELSE '' END AS mosque_type
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def _needs(text: str, known: dict[str, str]) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", text))
    return [v for v in known if v in words]


def _in_order(names: list[str], known: dict[str, str]) -> list[str]:
    """The named views and everything they use, each after what it uses."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for dep in _needs(known[name], known):
            if dep != name:
                add(dep)
        ordered.append(name)

    for n in names:
        add(n)
    return ordered


def with_clause(names: list[str], extra: dict[str, str] | None = None) -> str:
    """WITH clause holding the named views and everything they use."""
    known = {**VIEWS, **(extra or {})}
    ordered = _in_order(names, known)
    return "WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in ordered) + "\n"


def sql_with(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    return with_clause(names, extra) + body.strip()


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # the size of its compressed files hides its rows: road nodes meet by sorting and never pass the driver as a broadcast
    return df.hint("merge") if name == "part" else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived view."""
    if name in BASE:
        return _base(spark, sf_dir, name)
    views = _in_order([name], VIEWS)
    text = with_clause([name])
    for base in BASE:
        if re.search(rf"\b{base}\b", text):
            _base(spark, sf_dir, base).createOrReplaceTempView(base)
    # one view after the other: a WITH clause would lose the hints on what it reads
    for view in views[:-1]:
        spark.sql(VIEWS[view]).createOrReplaceTempView(view)
    return spark.sql(VIEWS[name])
