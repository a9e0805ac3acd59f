"""Registered queries on clocks, schedules and scores: H1-H8, G4-G7, I1-I6, F14."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.fixtures import sql_with, table
from wayfold.functions import clock, geo, scoring
from wayfold.operators import routes, schedule
from wayfold.plans.sqltext import km, leg_km

QUERIES = {}
ORACLE = {}
NOW = "2026-07-11 03:07:45"
TODAY = "2026-07-11"

_DEP = """CASE request_id % 9 WHEN 0 THEN '' WHEN 1 THEN '06:45' WHEN 2 THEN '2026-07-11T17:10:30+07:00' WHEN 3 THEN '2026-03-02T23:50:10Z'
 WHEN 4 THEN '2026-12-31T08:15:59' WHEN 5 THEN 'soon' WHEN 6 THEN '25:00' WHEN 7 THEN ' 19:30 ' ELSE '2026-02-10 04:05' END"""


def _spread(spark, sf):
    """Trips moved over three zones with departure texts of every kind."""
    return table(spark, sf, "trips").select(
        "request_id", "prayer", "departure_min",
        (F.col("o_lat") + (F.col("request_id") % 5) * 2.0).alias("o_lat"),
        (F.col("o_lon") + (F.col("request_id") % 3) * 12.0).alias("o_lon"),
        F.expr(_DEP).alias("departure"),
    )


_SPREAD = "SELECT request_id, prayer, departure_min, o_lat + (request_id%5)*2e0 AS o_lat, o_lon + (request_id%3)*12e0 AS o_lon, " + _DEP + " AS departure FROM trips"
_ZONE = "CASE WHEN o_lon >= 126 THEN 9 WHEN o_lon >= 110 THEN 8 ELSE 7 END"
_LOCAL = f"""SELECT *, {_ZONE} AS off, TIMESTAMP '2026-07-11 03:07:00' + to_hours({_ZONE}) AS nowl FROM spreads"""
_DEPARTED = """SELECT *, CASE request_id % 9 WHEN 1 THEN date_trunc('day', nowl) + INTERVAL '405 minutes' WHEN 7 THEN date_trunc('day', nowl) + INTERVAL '1170 minutes'
  WHEN 2 THEN TIMESTAMP '2026-07-11 10:10:00' + to_hours(off) WHEN 3 THEN TIMESTAMP '2026-03-02 23:50:00' + to_hours(off)
  WHEN 4 THEN TIMESTAMP '2026-12-31 08:15:00' WHEN 8 THEN TIMESTAMP '2026-02-10 04:05:00' ELSE nowl END AS dep FROM localz"""


def departures(spark, sf):
    d = schedule.with_departure(_spread(spark, sf).drop("departure_min"), NOW)
    return d.select("request_id", "zone_abbreviation", "utc_offset_hours", F.col("departure_date").cast("string").alias("departure_date"), "departure_min")


QUERIES["H1_H2_departure"] = departures
_H = {"spreads": _SPREAD, "localz": _LOCAL, "departed": _DEPARTED}
ORACLE["H1_H2_departure"] = sql_with(["departed"], """
SELECT request_id, CASE off WHEN 9 THEN 'WIT' WHEN 8 THEN 'WITA' ELSE 'WIB' END AS zone_abbreviation, off AS utc_offset_hours,
  strftime(dep, '%Y-%m-%d') AS departure_date, CAST(hour(dep)*60+minute(dep) AS INT) AS departure_min FROM departed
""", _H)


def _solar_sql(source: str, lat: str, lon: str, day: str) -> dict[str, str]:
    """CTEs that end in ``solar`` with minute columns of the five events."""
    ha = lambda alt, fb: (
        f"(CASE WHEN abs(den) >= 1e-6 AND (sin({alt})-sin(phi)*sin(decl))/den BETWEEN -1 AND 1 "
        f"THEN degrees(acos((sin({alt})-sin(phi)*sin(decl))/den))/15e0 ELSE {fb} END)"
    )
    mins = lambda h: f"CAST((floor({h})*60 + round(({h}-floor({h}))*60)) % 1440 AS INT)"
    wrap = lambda h: f"((({h}) % 24e0 + 24e0) % 24e0)"
    return {
        "sun0": f"SELECT *, CAST(dayofyear({day}) AS DOUBLE) AS n, radians({lat}) AS phi, {lon} AS slon FROM {source}",
        "sun1": "SELECT *, radians(2345e-2*sin(radians(360e0/365e0*(284e0+n)))) AS decl, radians(360e0/364e0*(n-81e0)) AS bb, "
                "CASE WHEN slon<110 THEN 105e0 WHEN slon<126 THEN 120e0 ELSE 135e0 END AS mer FROM sun0",
        "sun2": "SELECT *, cos(phi)*cos(decl) AS den, 12e0+(mer-slon)/15e0-(987e-2*sin(2e0*bb)-753e-2*cos(bb)-15e-1*sin(bb))/60e0 AS tr, "
                "atan(1e0/(1e0+tan(abs(phi-decl)))) AS sh FROM sun1",
        "sun3": f"SELECT *, {wrap('tr-' + ha('radians(-20e0)', '6e0'))} AS h0, {wrap('tr+4e0/60e0')} AS h1, {wrap('tr+' + ha('sh', '3e0'))} AS h2, "
                f"{wrap('tr+' + ha('radians(-833e-3)', '6e0') + '+2e0/60e0')} AS h3, {wrap('tr+' + ha('radians(-18e0)', '6e0'))} AS h4 FROM sun2",
        "solar": f"SELECT *, {mins('h0')} AS fajr, {mins('h1')} AS dhuhr, {mins('h2')} AS asr, {mins('h3')} AS maghrib, {mins('h4')} AS isha FROM sun3",
    }


def _clock(m):
    return f"concat(lpad(CAST({m}//60 AS VARCHAR),2,'0'), ':', lpad(CAST({m}%60 AS VARCHAR),2,'0'))"


def schedules(spark, sf):
    p = table(spark, sf, "query_points").select("query_id", (F.col("lat") + (F.col("query_id") % 4)).alias("lat"), (F.col("lon") + (F.col("query_id") % 3) * 12).alias("lon"))
    s = schedule.daily_schedule(p, "2026-01-01", "2026-01-31")
    return s.select("query_id", F.col("day").cast("string").alias("day"), *clock.EVENTS)


QUERIES["H3_daily_schedule"] = schedules
ORACLE["H3_daily_schedule"] = sql_with(["solar"], f"""
SELECT query_id, strftime(day, '%Y-%m-%d') AS day, {', '.join(_clock(e) + ' AS ' + e for e in clock.EVENTS)} FROM solar
""", {"places": "SELECT query_id, lat + (query_id%4) AS lat, lon + (query_id%3)*12 AS lon, CAST(d AS DATE) AS day FROM query_points, "
      "(SELECT unnest(generate_series(DATE '2026-01-01', DATE '2026-01-31', INTERVAL 1 DAY)) AS d)", **_solar_sql("places", "lat", "lon", "day")})


def targets(spark, sf):
    d = schedule.with_departure(_spread(spark, sf).drop("departure_min"), NOW)
    t = schedule.with_target(d)
    late = t.withColumn("arrives", schedule.arrival(F.col("departure_local"), (F.col("request_id") % 200) / 4.0))
    return late.select(
        "request_id", "automatic_target", "target_event", "target_min", "target_day_offset",
        F.col("target_date").cast("string").alias("target_date"),
        F.date_format("arrives", "yyyy-MM-dd HH:mm").alias("arrival"),
    )


_D1 = _solar_sql("daysrows", "o_lat", "o_lon", "sday")
QUERIES["H4_H5_target_and_arrival"] = targets
ORACLE["H4_H5_target_and_arrival"] = sql_with(["solar"], """
, ev AS (SELECT request_id, prayer, dep, dayoff, hour(dep)*60+minute(dep) AS dm, u.i, u.m, u.name FROM solar,
  LATERAL (SELECT * FROM (VALUES (0, fajr, 'fajr'), (1, dhuhr, 'dhuhr'), (2, asr, 'asr'), (3, maghrib, 'maghrib'), (4, isha, 'isha')) x(i, m, name)) u),
w AS (SELECT *, CASE lower(prayer) WHEN 'maghrib' THEN 'maghrib' WHEN 'dzuhur' THEN 'dhuhr' END AS want FROM ev),
c AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY dayoff, i) AS rn FROM w WHERE dayoff*1440+m >= dm AND (want IS NULL OR want = name))
SELECT request_id, want IS NULL AS automatic_target, name AS target_event, m AS target_min, CAST(dayoff AS INT) AS target_day_offset,
  strftime(dep + to_days(CAST(dayoff AS INT)), '%Y-%m-%d') AS target_date,
  strftime(dep + to_seconds((request_id%200)/4e0*60e0), '%Y-%m-%d %H:%M') AS arrival FROM c WHERE rn = 1
""", {**_H, "daysrows": "SELECT departed.*, dayoff, CAST(dep AS DATE) + CAST(dayoff AS INT) AS sday FROM departed, (VALUES (0), (1)) o(dayoff)", **_D1})


def resolved(spark, sf):
    rows = _spread(spark, sf).withColumn(
        "prayer", F.expr("CASE request_id % 6 WHEN 0 THEN '18:05' WHEN 1 THEN 'Isya' WHEN 2 THEN 'noon' WHEN 3 THEN '' WHEN 4 THEN 'SUBUH' ELSE 'asr' END")
    )
    return schedule.resolve_clock(rows, TODAY).select("request_id", "resolved_clock")


QUERIES["H6_resolve_clock"] = resolved
ORACLE["H6_resolve_clock"] = sql_with(["solar"], f"""
SELECT request_id, CASE request_id % 6 WHEN 0 THEN '18:05' WHEN 1 THEN {_clock('isha')} WHEN 4 THEN {_clock('fajr')} WHEN 5 THEN {_clock('asr')} END AS resolved_clock FROM solar
""", {"spreads": _SPREAD, "dated": "SELECT *, DATE '2026-07-11' AS sday FROM spreads", **_solar_sql("dated", "o_lat", "o_lon", "sday")})


def countdowns(spark, sf):
    rows = _spread(spark, sf)
    for n, m in clock.solar_minutes(F.col("o_lat"), F.col("o_lon"), F.lit(TODAY).cast("date")).items():
        rows = rows.withColumn(n, m)
    c = clock.countdown(F.col("departure_min"), {n: F.col(n) for n in clock.EVENTS})
    return rows.select("request_id", c["minutes"].alias("minutes_left"), c["event"].alias("event"))


QUERIES["H7_countdown"] = countdowns
ORACLE["H7_countdown"] = sql_with(["solar"], """
, ev AS (SELECT request_id, u.i, u.name, CASE WHEN (u.m-departure_min+1440)%1440=0 THEN 1440 ELSE (u.m-departure_min+1440)%1440 END AS lft FROM solar,
  LATERAL (SELECT * FROM (VALUES (0, fajr, 'fajr'), (1, dhuhr, 'dhuhr'), (2, asr, 'asr'), (3, maghrib, 'maghrib'), (4, isha, 'isha')) x(i, m, name)) u)
SELECT request_id, CAST(lft AS INT) AS minutes_left, name AS event FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY lft, i) AS rn FROM ev) WHERE rn=1
""", {"spreads": _SPREAD, "dated": "SELECT *, DATE '2026-07-11' AS sday FROM spreads", **_solar_sql("dated", "o_lat", "o_lon", "sday")})


def shared(spark, sf):
    s = schedule.shared_schedule(table(spark, sf, "poi").select("poi_id", "lat", "lon"), TODAY)
    return s.select("poi_id", "fajr", "maghrib")


QUERIES["H8_shared_schedule"] = shared
ORACLE["H8_shared_schedule"] = sql_with(["solar"], f"SELECT poi_id, {_clock('fajr')} AS fajr, {_clock('maghrib')} AS maghrib FROM solar",
    {"dated": "SELECT poi_id, round(lat,2) AS la, round(lon,2) AS lo, DATE '2026-07-11' AS sday FROM poi", **_solar_sql("dated", "la", "lo", "sday")})


# ---- G4-G7, F14: straight estimate and scores over (trip, point) pairs -------
def _scored_rows(spark, sf):
    """Six candidate points per trip, picked by key arithmetic (equi-join)."""
    t = table(spark, sf, "trips")
    p = table(spark, sf, "poi").select("poi_id", "lat", "lon", "capacity_proxy", "priority_score")
    n = p.count()
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    t = t.withColumn("poi_id", F.pmod(F.col("request_id") * 7 + F.col("i") * 211, F.lit(n)))
    # an odd price keeps sums off exact half cents, where engines round differently
    t = t.withColumn("fuel_price_per_liter", F.col("fuel_price_per_liter") + 0.03717)
    # sorted on both sides: the planner sees the trips' size before they are multiplied by six and would broadcast them
    rows = t.join(p.hint("merge"), "poi_id").withColumn("target_min", F.when(F.col("request_id") % 8 != 0, (F.col("departure_min") + F.col("request_id") % 120) % 1440).cast("int"))
    return rows.withColumnRenamed("i", "candidate_position")


def estimated(spark, sf):
    e = routes.straight_estimate(_scored_rows(spark, sf))
    return e.select("request_id", "poi_id", "distance_km", "minutes", "minutes_to_stop")


_CAND = {
    "np": "SELECT count(*) AS n FROM poi",
    "cand": "SELECT t.*, i, (request_id*7+i*211) % n AS poi_id FROM trips t, (SELECT unnest(range(6)) AS i), np",
    "legs": f"SELECT c.*, p.lat, p.lon, p.capacity_proxy, p.priority_score, CASE WHEN request_id%8<>0 THEN (departure_min+request_id%120)%1440 END AS tm, "
            f"125e-2*{km('o_lat','o_lon','p.lat','p.lon')} AS d1, 125e-2*{km('p.lat','p.lon','d_lat','d_lon')} AS d2 FROM cand c JOIN poi p USING (poi_id)",
    "est": "SELECT *, round(d1+d2,3) AS km, round((d1+d2)/30e0*60e0,2) AS mins, d1/30e0*60e0 AS tostop FROM legs",
    "fit0": "SELECT *, CASE WHEN tm < departure_min THEN tm+1440 ELSE tm END - (departure_min+tostop) AS bef FROM est",
    "fit": "SELECT *, CASE WHEN bef IS NULL THEN 3e-1 WHEN bef<0 THEN least(1e0, 6e-1-bef/30e0) WHEN bef<=25 THEN 0e0 ELSE least(5e-1, bef/90e0) END AS pen, "
           "CASE WHEN bef IS NULL THEN 'unknown' WHEN bef<0 THEN 'after_prayer' ELSE 'before_prayer' END AS status, "
           "round(km/12e0*coalesce(fuel_price_per_liter+3717e-5,1e4)+km*300e0, 2) AS cost FROM fit0",
    "nrm": "SELECT *, min(mins) OVER w AS m0, max(mins) OVER w AS m1, min(cost) OVER w AS c0, max(cost) OVER w AS c1 FROM fit WINDOW w AS (PARTITION BY request_id)",
    "wts": "SELECT *, CASE profile WHEN 'fastest' THEN [70,10,10,5,5] WHEN 'prayer_priority' THEN [20,10,60,5,5] WHEN 'low_cost' THEN [20,60,10,5,5] ELSE [40,20,20,10,10] END AS w, "
           "CASE WHEN m1=m0 THEN 0e0 ELSE (mins-m0)/(m1-m0) END AS tn, CASE WHEN c1=c0 THEN 0e0 ELSE (cost-c0)/(c1-c0) END AS cn, "
           "CASE capacity_proxy WHEN 'large' THEN 1e0 WHEN 'medium' THEN 65e-2 WHEN 'small' THEN 35e-2 ELSE 5e-1 END AS cap FROM nrm",
    "moo": "SELECT *, (w[1]*tn+w[2]*cn+w[3]*pen+w[4]*(1e0-cap)+w[5]*(1e0-priority_score))/1e2 AS score FROM wts",
}
QUERIES["F14_straight_estimate"] = estimated
ORACLE["F14_straight_estimate"] = sql_with(["est"], """
SELECT request_id, poi_id, km AS distance_km, mins AS minutes, round(tostop,2) AS minutes_to_stop FROM est
""", _CAND)


def scored(spark, sf):
    r = routes.rank_stops(routes.straight_estimate(_scored_rows(spark, sf)))
    label, progress = scoring.arrival_label(F.col("arrival_status"), F.when(F.col("arrival_status") != "unknown", F.col("minutes_before")))
    return r.select(
        "request_id", "poi_id", F.col("multi_objective_score").alias("score"), F.round("prayer_penalty", 6).alias("penalty"),
        "arrival_status", "cost", label.alias("label"), F.round(progress, 3).alias("progress"), "position",
    )


QUERIES["G4_G7_E3_scores"] = scored
ORACLE["G4_G7_E3_scores"] = sql_with(["moo"], """
, mb AS (SELECT *, round(bef,1) AS rb FROM moo)
SELECT request_id, poi_id, round(score,4) AS score, round(pen,6) AS penalty, status AS arrival_status, cost,
  CASE WHEN status='unknown' THEN 'unavailable' WHEN status='after_prayer' OR rb<0 THEN 'late' WHEN rb<=15 THEN 'tight' ELSE 'safe' END AS label,
  round(CASE WHEN status='unknown' OR status='after_prayer' OR rb<0 THEN 0e0 WHEN rb<=15 THEN least(100e0,greatest(10e0,rb/15e0*100e0)) ELSE least(100e0,rb/30e0*100e0) END,3) AS progress,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(score,4), i, poi_id) AS INT) AS position
FROM mb
""", _CAND)


# ---- I1-I6 ------------------------------------------------------------------
def geometry(spark, sf):
    t = table(spark, sf, "trips")
    mid_lat, mid_lon = F.col("o_lat") + 0.01, F.col("d_lon") - 0.02
    box = geo.buffered_bbox(F.least("o_lat", "d_lat"), F.greatest("o_lat", "d_lat"), F.least("o_lon", "d_lon"), F.greatest("o_lon", "d_lon"), (F.col("o_lat") + F.col("d_lat")) / 2.0, 4.0)
    rows = t.select("request_id", "o_lat", "o_lon", "d_lat", "d_lon", mid_lat.alias("p_lat"), mid_lon.alias("p_lon"), box.alias("b"))
    line = geo.two_leg_polyline("o_lat", "o_lon", "p_lat", "p_lon", "d_lat", "d_lon")
    dist = geo.haversine_km("o_lat", "o_lon", "d_lat", "d_lon")
    return rows.select(
        "request_id", F.round(dist, 6).alias("km"),
        F.round(geo.point_segment_km("p_lat", "p_lon", "o_lat", "o_lon", "d_lat", "d_lon"), 6).alias("off_km"),
        F.round(geo.bbox_area_km2(F.col("b.north"), F.col("b.south"), F.col("b.east"), F.col("b.west")), 3).alias("area"),
        geo.bbox_covers(F.col("b.north"), F.col("b.south"), F.col("b.east"), F.col("b.west"), F.col("p_lat"), F.col("p_lon"), F.col("p_lat"), 0.25).alias("covers"),
        F.size(line).alias("points"), F.round(line[12]["lat"], 8).alias("turn_lat"), F.round(line[18]["lon"], 8).alias("late_lon"),
        F.round(geo.metric_distance_m(F.col("o_lat") * 100, "o_lon", F.col("d_lat") * 100, "d_lon"), 4).alias("planar"),
        geo.format_distance(F.when(F.col("request_id") % 2 == 0, F.round(dist / 30, 4)).otherwise(F.round(dist * 100, 4))).alias("label"),
    )


QUERIES["I1_I6_geometry"] = geometry
ORACLE["I1_I6_geometry"] = sql_with(["trips"], f"""
, b AS (SELECT *, o_lat+1e-2 AS p_lat, d_lon-2e-2 AS p_lon, 4e0/111e0 AS dy, 4e0/(111e0*greatest(cos(radians((o_lat+d_lat)/2e0)),2e-1)) AS dx, {km('o_lat','o_lon','d_lat','d_lon')} AS k FROM trips),
c AS (SELECT *, greatest(o_lat,d_lat)+dy AS n, least(o_lat,d_lat)-dy AS s, greatest(o_lon,d_lon)+dx AS e, least(o_lon,d_lon)-dx AS w,
  CASE WHEN request_id%2=0 THEN round(k/30,4) ELSE round(k*100,4) END AS f FROM b),
g AS (SELECT *, CAST(round(f*100) AS BIGINT) AS ct FROM c)
SELECT request_id, round(k,6) AS km, round({leg_km('p_lat','p_lon','o_lat','o_lon','d_lat','d_lon','(o_lat+d_lat+p_lat)/3e0')},6) AS off_km,
  round(abs(n-s)*111e0*abs(e-w)*111e0*greatest(cos(radians((n+s)/2e0)),2e-1),3) AS area,
  p_lat BETWEEN s-25e-2/111e0 AND n+25e-2/111e0 AND p_lon BETWEEN w-25e-2/(111e0*greatest(cos(radians(p_lat)),2e-1)) AND e+25e-2/(111e0*greatest(cos(radians(p_lat)),2e-1)) AS covers,
  25 AS points, round(p_lat,8) AS turn_lat, round(p_lon+(d_lon-p_lon)*6e0/12e0,8) AS late_lon,
  round(sqrt(power(d_lat*100-o_lat*100,2)+power(d_lon-o_lon,2)),4) AS planar,
  CASE WHEN f < 1 THEN concat(CAST(CAST(floor(f*1000+5e-1) AS BIGINT) AS VARCHAR), ' m') ELSE concat(replace(format('{{:,}}', ct//100), ',', '.'), ',',
    CASE WHEN ct%10=0 THEN CAST((ct%100)//10 AS VARCHAR) ELSE lpad(CAST(ct%100 AS VARCHAR),2,'0') END, ' km') END AS label
FROM g
""")


_NOW = "2026-07-10T20:15:40"
# departures as users type them, and settings some of which break a rule
_REQUESTS = """
SELECT request_id, CASE WHEN request_id % 97 = 0 THEN NULL ELSE o_lat END AS o_lat, o_lon,
  CASE WHEN request_id % 9 = 0 THEN NULL ELSE d_lat END AS d_lat, d_lon, profile, CASE WHEN request_id % 31 <> 0 THEN prayer END AS prayer,
  CASE request_id % 6 WHEN 0 THEN '' WHEN 1 THEN '05:07' WHEN 2 THEN '2026-07-12T23:30:59Z' WHEN 3 THEN '2026-07-12 08:15:30'
    WHEN 4 THEN '2026-07-12T08:15:00+09:00' ELSE 'soon' END AS departure,
  CAST(request_id % 230 AS DOUBLE) AS search_radius_km, CAST(request_id % 12 AS INT) AS maximum_results, fuel_price_per_liter FROM trips
"""


def requests_prepared(spark, sf):
    """Every raw request, accepted with its local departure or quarantined with its reasons."""
    from wayfold.plans.recommend import prepare_requests

    table(spark, sf, "trips").createOrReplaceTempView("trips")
    trips, bad = prepare_requests(spark.sql(_REQUESTS), _NOW)
    none = lambda t: F.lit(None).cast(t)
    return trips.select(
        "request_id", F.date_format("departure_date", "yyyy-MM-dd").alias("day"), F.col("departure_min").cast("int").alias("departure_min"),
        F.round("d_lat", 6).alias("d_lat"), none("string").alias("violations"),
    ).unionByName(bad.select("request_id", none("string").alias("day"), none("int").alias("departure_min"), none("double").alias("d_lat"), F.array_join("violations", ",").alias("violations")))


QUERIES["B19_H2_requests"] = requests_prepared
ORACLE["B19_H2_requests"] = sql_with(["trips"], f"""
, req AS ({_REQUESTS}),
v AS (SELECT *, concat_ws(',', CASE WHEN o_lat IS NULL THEN 'origin' END, CASE WHEN prayer IS NULL THEN 'prayer' END,
    CASE WHEN profile NOT IN ('fastest', 'prayer_priority', 'low_cost', 'balanced') THEN 'profile' END,
    CASE WHEN search_radius_km < 1 OR search_radius_km > 200 THEN 'search_radius_km' END,
    CASE WHEN maximum_results < 1 OR maximum_results > 10 THEN 'maximum_results' END) AS bad,
  CASE request_id % 6 WHEN 1 THEN TIMESTAMP '2026-07-11 05:07:00' WHEN 2 THEN TIMESTAMP '2026-07-13 06:30:00' WHEN 3 THEN TIMESTAMP '2026-07-12 08:15:00'
    WHEN 4 THEN TIMESTAMP '2026-07-12 06:15:00' ELSE TIMESTAMP '2026-07-11 03:15:00' END AS dep FROM req)
SELECT request_id, CASE WHEN bad = '' THEN strftime(dep, '%Y-%m-%d') END AS day, CASE WHEN bad = '' THEN CAST(hour(dep)*60 + minute(dep) AS INT) END AS departure_min,
  CASE WHEN bad = '' THEN round(CASE WHEN d_lat IS NULL THEN o_lat ELSE d_lat END, 6) END AS d_lat, CASE WHEN bad <> '' THEN bad END AS violations FROM v
""")
