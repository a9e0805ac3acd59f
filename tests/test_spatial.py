import math
import random

import pytest

from pyspark.sql import functions as F

from wayfold import runtime
from wayfold.operators import geometry, nearest, ranked_join


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_nearest_with_a_third_of_all_points_in_one_spot(spark):
    rnd = random.Random(7)
    pts = [(i, -6.2, 106.8) if i % 3 == 0 else (i, -6.2 + rnd.gauss(0, 0.002 if i % 3 == 1 else 0.4), 106.8 + rnd.gauss(0, 0.002 if i % 3 == 1 else 0.4)) for i in range(1500)]
    qs = [(j, -6.2, 106.8, 5.0, 60) if j % 3 == 0 else (j, -6.2 + rnd.gauss(0, 0.2), 106.8 + rnd.gauss(0, 0.2), 0.5 + j, 1 + j % 9) for j in range(30)]
    index = nearest.poi_index(spark.createDataFrame(pts, "poi_id long, lat double, lon double"), capacity=16)
    got = {(r.query_id, r.position): r.poi_id for r in nearest.nearest_points(
        spark.createDataFrame(qs, "query_id long, lat double, lon double, radius_km double, k int"), index).collect()}
    want = {}
    for q, la, lo, r, k in qs:
        best = sorted((km(la, lo, a, b), p) for p, a, b in pts)
        for n, (_, p) in enumerate([x for x in best if x[0] <= r][: min(50, k)]):
            want[(q, n + 1)] = p
    assert got == want


def test_polyline_round_trip_and_known_text(spark):
    line = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    df = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in line],)], "line array<struct<lat:double,lon:double>>")
    r = df.select(geometry.encode_polyline(F.col("line")).alias("e")).select("e", geometry.decode_polyline(F.col("e")).alias("d")).first()
    assert r.e == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert [(p.lat, p.lon) for p in r.d] == line


def test_simplify_and_cut(spark):
    line = [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 0.5}, {"lat": 0.0, "lon": 1.0}, {"lat": 1.0, "lon": 1.0}]
    df = spark.createDataFrame([(line,)], "line array<struct<lat:double,lon:double>>")
    r = geometry.simplify(df).select(
        "kept_points", geometry.sub_line(F.col("line"), F.lit(0.25), F.lit(0.75)).alias("cut"),
        geometry.sub_line(F.col("line"), F.lit(0.75), F.lit(0.25)).alias("back")).first()
    assert r.kept_points == 3
    assert [(round(p.lat, 9), round(p.lon, 9)) for p in r.cut] == [(0.0, 0.5), (0.0, 1.0), (0.5, 1.0)]
    assert [tuple(p) for p in r.back] == [tuple(p) for p in reversed(r.cut)]


def test_crowded_spot_keeps_both_orders(spark):
    """More points on one spot than the index keeps: by priority and by id the right ones survive; asking for more is refused."""
    from wayfold.operators import nearest

    pois = spark.range(40).select(F.col("id").alias("poi_id"), F.lit(-6.2).alias("lat"), F.lit(106.8).alias("lon"), (F.col("id") / 40.0).alias("priority_score"))
    index = nearest.retrieval_index(pois, max_k=5)
    ask = spark.createDataFrame([(1, -6.2, 106.8, 1.0, 3)], "query_id long, lat double, lon double, radius_km double, k int")
    assert sorted(r.poi_id for r in nearest.nearest_points(ask, index, max_k=5).collect()) == [0, 1, 2]
    trip = spark.createDataFrame([(1, -6.2, 106.8, -6.2, 106.9, 5.0, 5.0, 3)], "request_id long, o_lat double, o_lon double, d_lat double, d_lon double, corridor_km double, fallback_radius_km double, k int")
    assert sorted(r.poi_id for r in nearest.corridor_candidates(trip, index, max_k=5).collect()) == [37, 38, 39]
    with pytest.raises(ValueError):
        nearest.nearest_points(ask, index, max_k=6)


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    """Points met by sorting give the same rows, and no join sends points or cells through the driver."""
    rnd = random.Random(3)
    pts = spark.createDataFrame([(i, -6.2 + rnd.gauss(0, 0.3), 106.8 + rnd.gauss(0, 0.3)) for i in range(2000)], "poi_id long, lat double, lon double")
    qs = spark.createDataFrame([(j, -6.2 + rnd.gauss(0, 0.2), 106.8 + rnd.gauss(0, 0.2), 20.0, 5) for j in range(40)], "query_id long, lat double, lon double, radius_km double, k int")
    ask = lambda: nearest.nearest_points(qs, nearest.poi_index(pts, capacity=8))
    want = sorted(map(tuple, ask().collect()))
    monkeypatch.setattr("wayfold.operators.ranked_join.BROADCAST_ROWS", 100)
    got = ask()
    assert sorted(map(tuple, got.collect())) == want and len(want) == 200
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_straight_estimate_sorts_its_pairs(spark, tmp_path):
    from wayfold.plans.schedule_queries import QUERIES

    tables = {
        "region": "SELECT id AS r_regionkey, concat('R', id) AS r_name FROM range(2)",
        "nation": "SELECT id AS n_nationkey, concat('N', id) AS n_name, id % 2 AS n_regionkey FROM range(3)",
        "customer": "SELECT id AS c_custkey, id % 3 AS c_nationkey, 'X' AS c_mktsegment FROM range(30)",
        "orders": "SELECT id AS o_orderkey FROM range(20)",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["F14_straight_estimate"](spark, str(tmp_path))
    assert sorted((r.request_id, r.poi_id) for r in got.collect()) == sorted((t, (t * 7 + i * 211) % 30) for t in range(20) for i in range(6))
    pairs = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [poi_id" in line]
    assert pairs and all("SortMergeJoin" in line for line in pairs)


def test_first_leaves_close_the_others(spark, monkeypatch):
    """Corridor and box searches score the most promising leaves first and leave out what these rule out."""
    pois = spark.range(6000).selectExpr(
        "id AS poi_id", "-6.4 + (id * 7919 % 10007) / 10007e0 * 0.4 AS lat", "106.6 + (id * 104729 % 10009) / 10009e0 * 0.4 AS lon",
        "(id * 37 % 101) / 100e0 AS priority_score",
    )
    trips = spark.range(12).selectExpr(
        "id AS request_id", "-6.35 + id * 0.01 AS o_lat", "106.65 AS o_lon", "-6.1 AS d_lat", "106.7 + id * 0.02 AS d_lon",
        "5.0 AS corridor_km", "25.0 AS fallback_radius_km", "12 AS k", "6.0 AS buffer_km", "3 AS maximum_results",
    )
    index = nearest.retrieval_index(pois)
    plain = sorted(map(tuple, nearest.corridor_candidates(trips, index).collect()))
    around = sorted(map(tuple, nearest.retrieve_candidates(trips, index).select("request_id", "poi_id").collect()))
    scored, close = [], ranked_join._close_leaves

    def watched(front, *rest):
        out = close(front, *rest)
        scored.append(tuple(f.agg({"_n": "sum"}).first()[0] for f in (front, out)))
        return out

    monkeypatch.setattr(ranked_join, "FLOOR_ROWS", 0)
    monkeypatch.setattr(ranked_join, "_close_leaves", watched)
    assert sorted(map(tuple, nearest.corridor_candidates(trips, index).collect())) == plain
    assert sorted(map(tuple, nearest.retrieve_candidates(trips, index).select("request_id", "poi_id").collect())) == around
    assert len(plain) == 144 and len(around) == 12 * 72
    assert scored[0][1] < scored[0][0] / 2 and all(after <= before for before, after in scored)


def test_bounds_of_cells_repeat_no_arithmetic(spark):
    """Each bound takes two sines; inside a condition the planner evaluated every repetition."""
    import re

    sides = [F.col(c) for c in ("south", "north", "west", "east", "cos_south", "cos_north")]
    for bound in ranked_join.distance_bounds(ranked_join.Cell(*sides, {}), F.col("lat"), F.col("lon")):
        assert len(re.findall(r"\bsin\(", str(bound), re.I)) == 2


def test_descent_runs_in_methods_the_jvm_compiles(spark, monkeypatch):
    """Every level of the descent runs under the limit; the session keeps its own setting, also after an error."""
    limit, spool, seen = "spark.sql.codegen.hugeMethodLimit", ranked_join.spool, []
    usual = spark.conf.get(limit)
    pois = spark.range(400).select(F.col("id").alias("poi_id"), (F.col("id") % 20 / 50.0 - 6.4).alias("lat"), (F.col("id") / 900.0 + 106.6).alias("lon"))
    index = nearest.poi_index(pois, capacity=4)
    ask = spark.createDataFrame([(1, -6.2, 106.8, 9.0, 7), (2, -6.3, 106.7, 20.0, 3)], "query_id long, lat double, lon double, radius_km double, k int")
    monkeypatch.setattr(ranked_join, "spool", lambda df: seen.append(spark.conf.get(limit)) or spool(df))
    monkeypatch.setattr(ranked_join, "FLOOR_ROWS", 1)
    got = {(r.query_id, r.position): r.poi_id for r in nearest.nearest_points(ask, index).collect()}
    at = {r.poi_id: (r.lat, r.lon) for r in pois.collect()}
    for q, la, lo, radius, k in [(1, -6.2, 106.8, 9.0, 7), (2, -6.3, 106.7, 20.0, 3)]:
        best = sorted((km(la, lo, *at[p]), p) for p in at)
        assert [got.get((q, n + 1)) for n in range(k)] == ([p for x, p in best if x <= radius][:k] + [None] * k)[:k]
    assert len(seen) > 2 and set(seen) == {"8000"} and spark.conf.get(limit) == usual
    with pytest.raises(RuntimeError), runtime.compiled(spark):
        raise RuntimeError
    assert spark.conf.get(limit) == usual


def test_floor_of_a_query_that_comes_twice_with_other_limits(spark, monkeypatch):
    """Rows of one id share the floor of the larger number asked for."""
    monkeypatch.setattr(ranked_join, "FLOOR_ROWS", 1)
    pois = spark.range(600).select(F.col("id").alias("_p"), F.lit(0.0).alias("p_lat"), (F.col("id") / 1000.0).alias("p_lon"))
    index = ranked_join.build_index(pois, lat="p_lat", lon="p_lon", capacity=4)
    ask = spark.createDataFrame([(1, 0.0, 0.3, 2), (1, 0.0, 0.3, 9)], "_q long, q_lat double, q_lon double, q_k int")
    lat, lon = F.col("q_lat"), F.col("q_lon")
    found = ranked_join.best_k(
        ask, index, qid="_q", box=ranked_join.radius_box(lat, lon, F.lit(50.0)), k=F.col("q_k"), max_k=9,
        bounds=lambda cell: ranked_join.distance_bounds(cell, lat, lon),
        score=F.abs(F.col("p_lon") - lon) * 111.2, order=[F.col("q_k"), F.col("_p")],
    )
    rows = found.collect()
    assert {r._p for r in rows} <= {298, 299, 300, 301, 302} and sum(r._p == 300 for r in rows) == 2
