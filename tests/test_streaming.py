import hashlib
import hmac
import json
import os
import random

from pyspark.sql import functions as F

from wayfold.streaming import events, gps, traffic


def line(eid, at, speed=20.0, acc=5.0, seg="S1"):
    return json.dumps({"event_id": eid, "region_id": "R", "road_segment_id": seg, "speed_kph": speed, "accuracy_m": acc, "occurred_at": at})


def test_stream_drops_late_bad_and_repeated(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    first = [line("a", "2026-01-01T00:00:01Z", 10.0), line("b", "2026-01-01T00:00:02Z", 30.0), line("b", "2026-01-01T00:00:02Z", 30.0),
             "{broken", line("c", "2026-01-01T00:00:03Z", acc=100.1), line("d", "2026-01-01T00:00:03Z", acc=None), line("e", "2026-01-01T00:02:00Z")]
    (src / "1.txt").write_text("\n".join(first))
    os.utime(src / "1.txt", (1, 1))
    (src / "2.txt").write_text(line("late", "2026-01-01T00:00:05Z") + "\n" + line("f", "2026-01-01T00:05:00Z"))
    stream = events.read_location_stream(spark, "files", path=str(src), maxFilesPerTrigger=1)
    table = traffic.SnapshotTable(spark, str(tmp_path / "table"))
    q = traffic.start_snapshots(stream, table, str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination()
    seen = traffic.SnapshotTable(spark, str(tmp_path / "table")).read().collect()
    assert len(seen) == 1 and seen[0].road_segment_id == "S1"
    assert str(seen[0].window_started_at) == "2026-01-01 00:02:00" and seen[0].sample_count == 1
    # a repeated batch changes nothing
    table.upsert(table.read(), 0)
    assert table.read().collect() == seen


def test_window_values(spark):
    rows = [("R", s, 5.0, v, "2026-01-01 00:00:01") for s, v in (("z", 0.0), ("slow", 5.0), ("fast", 80.0), ("two", 10.0), ("two", 30.0))]
    df = spark.createDataFrame(rows, "region_id string, road_segment_id string, accuracy_m double, speed_kph double, occurred_at string").withColumn("occurred_at", F.to_timestamp("occurred_at"))
    got = {r.road_segment_id: (r.sample_count, r.travel_time_multiplier) for r in traffic.aggregate(df).collect()}
    assert got == {"z": (1, None), "slow": (1, 4.0), "fast": (1, 1.0), "two": (2, 2.0)}


def test_pseudonyms(spark):
    secret = b"k" * 70
    r = spark.createDataFrame([("user-1",)], "u string").select(events.pseudonym(F.col("u")).alias("a"), events.pseudonym(F.col("u"), secret).alias("b")).first()
    assert r.a == "sha256:" + hashlib.sha256(b"user-1").hexdigest()
    assert r.b == "hmac-sha256:" + hmac.new(secret, b"user-1", hashlib.sha256).hexdigest()


def test_gate_slices_equal_one_pass(spark, monkeypatch):
    rnd = random.Random(5)
    rows, lat = [], -6.0
    for i in range(300):
        lat += rnd.choice([0, 0, 0.00005, 0.0002, 0.001]) * rnd.choice([1, -1]) + (0.2 if i == 150 else 0)
        rows.append(("s", i, lat, 106.8, float(i * rnd.choice([1, 1]) * 4)))
    df = spark.createDataFrame(rows, "session_id string, fix_id long, latitude double, longitude double, t double")
    state, want = (float("nan"),) * 6, {}
    for _, i, a, b, t in rows:
        state, ok, ev = gps._step(state, a, b, t)
        want[i] = (ok, ev)
    monkeypatch.setattr(gps, "SLICE_ROWS", 17)
    got = {r.fix_id: (r.accepted, r.event) for r in gps.gate_batch(df).collect()}
    assert got == want and any(e == "region_reset" for _, e in want.values()) and any(e == "reroute" for _, e in want.values())


def test_gate_on_a_stream_equals_batch(spark, tmp_path):
    rows = [("s", i, -6.0 + i * 0.0003, 106.8, float(i * 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id string, fix_id long, latitude double, longitude double, t double")
    for part in range(2):  # two triggers, state carried over
        df.filter(F.floor(F.col("fix_id") / 20) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gps.gate_stream(stream).writeStream.format("memory").queryName("gated").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    key = lambda d: sorted((r.fix_id, r.accepted, r.event) for r in d.collect())
    assert key(spark.table("gated")) == key(gps.gate_batch(df))


def test_ordered_gate_equals_batch_and_forgets_silent_sessions(spark, tmp_path):
    """Fixes dealt out of order over triggers; one session pauses for longer than a session lives."""
    store = "spark.sql.streaming.stateStore.providerClass"
    rnd = random.Random(8)
    rows = []
    for session in ("a", "b", "c"):
        lat = -6.0
        for i in range(60):
            lat += rnd.choice([0, 0.00012, 0.0003, 0.001])
            t = i * 2.0 + 0.25 + (5000.0 if session == "b" and i >= 30 else 0.0)
            rows.append((session, i, lat, 106.8, t))
    far = [("z", 900, -6.0, 106.8, 20000.0), ("z", 901, -6.0, 106.8, 20001.0)]
    schema = "session_id string, fix_id long, latitude double, longitude double, t double"
    order = sorted(rows, key=lambda r: r[4] + rnd.uniform(0, 9))
    trigger = [order[i:i + 45] for i in range(0, len(order), 45)] + [[(None, 1, 1.0, 1.0, 1.0)], far[:1], far[1:]]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(trigger):
        f = tmp_path / "in" / f"{i}.json"
        f.write_text("\n".join(json.dumps(dict(zip(("session_id", "fix_id", "latitude", "longitude", "t"), r))) for r in part))
        os.utime(f, (i + 1, i + 1))
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = gps.gate_stream_ordered(stream).writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset(store)
    parts = [(f"{s}{int(s == 'b' and t > 5000)}", i, a, o, t) for s, i, a, o, t in rows]
    want = sorted((r.session_id[0], r.fix_id, r.accepted, r.event) for r in gps.gate_batch(spark.createDataFrame(parts, schema)).collect())
    got = sorted((r.session_id, r.fix_id, r.accepted, r.event) for r in spark.table("ordered").filter("session_id <> 'z'").collect())
    assert got == want and any(e == "reroute" for *_, e in want)
    assert left <= 6  # the last session's waiting fixes and timers only


def test_snapshots_survive_restarted_batch_numbers(spark, tmp_path):
    """Batches counted from 0 again after a lost checkpoint are not thrown away, and old versions go."""
    from wayfold.streaming.traffic import SnapshotTable

    table = SnapshotTable(spark, str(tmp_path / "snap"))
    row = lambda seg, end, n: spark.sql(
        f"SELECT 'R' AS region_id, '{seg}' AS road_segment_id, TIMESTAMP '2024-01-01 00:00:00' AS window_started_at, "
        f"TIMESTAMP '{end}' AS window_ended_at, {n}L AS sample_count")
    table.upsert(row("a", "2024-01-01 00:00:30", 1), 5)
    table.upsert(row("b", "2024-01-01 00:00:30", 2), 0)
    table.upsert(row("b", "2024-01-01 00:00:30", 2), 0)
    table.upsert(row("a", "2024-01-01 00:01:00", 3), 1)
    assert {(r.road_segment_id, r.sample_count) for r in table.read().collect()} == {("a", 3), ("b", 2)}
    # b's first folder is named by neither of the last two manifests
    assert len([p for p in (tmp_path / "snap").iterdir() if p.name.startswith("v")]) == 3
    assert len(list((tmp_path / "snap" / "_current").glob("[0-9]*"))) == 2


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    from wayfold.streaming.traffic import SnapshotTable

    table = SnapshotTable(spark, str(tmp_path / "snap"), buckets=8)
    rows = lambda ids, end, n: spark.range(ids).select(
        F.lit("R").alias("region_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("road_segment_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("window_started_at"), F.lit(end).cast("timestamp").alias("window_ended_at"), F.lit(n).alias("n"))
    table.upsert(rows(200, "2024-01-01 00:00:30", 1), 0)
    files = lambda: {str(p) for p in (tmp_path / "snap").glob("v*/bucket=*/*.parquet")}
    first = files()
    assert len({p.split("bucket=")[1].split("/")[0] for p in first}) == 8
    table.upsert(rows(1, "2024-01-01 00:01:00", 2), 1)
    assert len({p.split("/bucket=")[1].split("/")[0] for p in files() - first}) == 1 and first < files()
    table.upsert(rows(0, "2024-01-01 00:01:00", 2), 2)  # nothing arrives
    table.upsert(rows(1, "2024-01-01 00:00:10", 3), 3)  # older than what is known
    got = {r.road_segment_id: r.n for r in SnapshotTable(spark, str(tmp_path / "snap"), buckets=3).read().collect()}
    assert len(got) == 200 and got["s0"] == 2 and sum(got.values()) == 201
    assert len({p.split("/bucket=")[1].split("/")[0] for p in files()}) == 8 and not first <= files()


def test_table_without_rows(spark, tmp_path):
    from wayfold.streaming.traffic import SnapshotTable

    table = SnapshotTable(spark, str(tmp_path / "snap"))
    none = spark.createDataFrame([], "region_id string, road_segment_id string, window_started_at timestamp, window_ended_at timestamp, n long")
    assert table.read() is None
    table.upsert(none, 0)
    assert table.read().columns == none.columns and table.read().count() == 0


def test_lost_driver_leaves_the_state_before(spark, tmp_path, monkeypatch):
    import pytest
    from wayfold.streaming.traffic import SnapshotTable

    table = SnapshotTable(spark, str(tmp_path / "snap"))
    row = lambda n, end: spark.sql(
        f"SELECT 'R' AS region_id, 'a' AS road_segment_id, TIMESTAMP '2024-01-01 00:00:00' AS window_started_at, TIMESTAMP '{end}' AS window_ended_at, {n}L AS n")
    table.upsert(row(1, "2024-01-01 00:00:30"), 0)
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(row(2, "2024-01-01 00:01:00"), 1)
    assert [r.n for r in table.read().collect()] == [1]
    table.upsert(row(2, "2024-01-01 00:01:00"), 1)
    assert [r.n for r in table.read().collect()] == [2]


def test_matching_on_a_stream_closes_the_traffic_loop(spark, tmp_path):
    """Events without segments, from files to slowed edges, equal the stored-table jobs; a replayed batch adds nothing."""
    from wayfold.operators import snapping

    rnd = random.Random(3)
    nodes = spark.createDataFrame([(i, -6.0 + (i // 4) * 0.01, 106.8 + (i % 4) * 0.01) for i in range(16)], "node long, lat double, lon double")
    pairs = [(i, i + d) for i in range(16) for d in (1, 4) if i + d < 16 and (d == 4 or i % 4 < 3)]
    edges = spark.createDataFrame([(a, b, 100.0, 60.0) for a, b in pairs + [(b, a) for a, b in pairs]], "u long, v long, length double, travel_time double")
    index = snapping.edge_index(snapping.edge_lines(edges, nodes))
    lines = []
    for i in range(120):
        at = f"2026-01-01T00:{i // 30:02d}:{(i % 30) * 2:02d}Z"
        e = json.loads(line(f"e{i}", at, rnd.choice([8.0, 15.0, 30.0]), seg="0_1" if i % 10 == 0 else None))
        lines.append(json.dumps({**e, "latitude": -6.0 + rnd.random() * 0.03, "longitude": 106.8 + rnd.random() * 0.03}))
    lines.append(line("end", "2026-01-01T01:00:00Z", seg="9_9"))
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.txt").write_text("\n".join(lines[part * 60:(part + 1) * 60 + part]))
        os.utime(tmp_path / "in" / f"{part}.txt", (part + 1, part + 1))
    source = events.read_location_stream(spark, "files", path=str(tmp_path / "in"), maxFilesPerTrigger=1)
    out = str(tmp_path / "matched")
    match = lambda: traffic.start_matching(source, index, out, str(tmp_path / "cp1"), {"availableNow": True}).awaitTermination()
    match()
    commits = sorted((tmp_path / "cp1" / "commits").glob("[0-9]*"))
    before = sorted(p.name for p in (tmp_path / "matched").iterdir())
    for p in [commits[-1], commits[-1].parent / f".{commits[-1].name}.crc"]:
        p.unlink(missing_ok=True)  # the driver went down before the last batch was noted
    match()
    assert sorted(p.name for p in (tmp_path / "matched").iterdir()) == before and len(before) == 2
    table = traffic.SnapshotTable(spark, str(tmp_path / "table"))
    placed = traffic.read_matched(spark, out, source.schema, maxFilesPerTrigger=1)
    traffic.start_snapshots(placed, table, str(tmp_path / "cp2"), {"availableNow": True}).awaitTermination()
    stored = traffic.match_segments(events.parse_events(spark.read.text(str(tmp_path / "in"))).filter("event_id <> 'end'"), index)
    want = traffic.latest(traffic.aggregate(stored))
    key = lambda d: sorted(tuple(r) for r in d.select("region_id", "road_segment_id", "window_ended_at", "sample_count", "average_speed_kph").collect())
    assert key(table.read()) == key(want) and len(key(want)) > 10
    times = lambda d: sorted(tuple(r) for r in traffic.apply_traffic(edges, d, "R").collect())
    assert times(table.read()) == times(want) and max(r[3] for r in times(want)) > 60.0


def test_traffic_slows_both_directions_of_its_region(spark):
    edges = spark.createDataFrame([(1, 2, 10.0, "R"), (2, 1, 12.0, "R"), (1, 2, 10.0, "Q"), (9, 10, 5.0, "R"), (10, 9, 5.0, "R")], "u long, v long, travel_time double, region_id string")
    snaps = spark.createDataFrame([("R", "1_2", 2.0), ("Q", "2_1", None), ("Q", "9_10", 3.0), ("R", "10_9", 0.5), ("R", "S1", 4.0)], "region_id string, road_segment_id string, travel_time_multiplier double")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(traffic.apply_traffic(edges, snaps)) == [(1, 2, 10.0, "Q"), (1, 2, 20.0, "R"), (2, 1, 24.0, "R"), (9, 10, 5.0, "R"), (10, 9, 5.0, "R")]
    plain = edges.filter("region_id = 'R'").drop("region_id")
    assert key(traffic.apply_traffic(plain, snaps, "Q")) == [(1, 2, 10.0), (2, 1, 12.0), (9, 10, 15.0), (10, 9, 15.0)]
    assert key(traffic.apply_traffic(plain, snaps)) == [(1, 2, 20.0), (2, 1, 24.0), (9, 10, 15.0), (10, 9, 15.0)]
