"""GPS jitter gate and live re-route triggers (K6, K7), batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfold.runtime import number_rows, spool

MIN_MOVE_M, SLOW_MOVE_M, MAX_SILENCE_S = 25.0, 10.0, 15.0
REROUTE_M, REROUTE_S, JUMP_M = 75.0, 5.0, 10_000.0
SLICE_ROWS = 50_000
_STATE = "a_lat double, a_lon double, a_t double, o_lat double, o_lon double, o_t double"
_N = 6
_OUT = "session_id string, fix_id long, accepted boolean, event string"


def _metres(a, b, c, d) -> float:
    x = np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * np.arctan2(np.sqrt(x), np.sqrt(1 - x))


def _step(state: tuple, lat: float, lon: float, t: float) -> tuple[tuple, bool, str | None]:
    """Next state, accepted?, emitted event.  State: last accepted fix, then the
    fix of the last re-route; NaN = none yet."""
    alat, alon, at, olat, olon, ot = state
    if at == at:
        moved, quiet = _metres(alat, alon, lat, lon), max(0.0, t - at)
        if moved < MIN_MOVE_M and (moved < SLOW_MOVE_M or quiet < MAX_SILENCE_S):
            return state, False, None
        if moved >= JUMP_M:  # another region: start over
            return (lat, lon, t, np.nan, np.nan, np.nan), True, "region_reset"
    if ot != ot:
        return (lat, lon, t, lat, lon, t), True, None
    moved = _metres(olat, olon, lat, lon)
    if moved < REROUTE_M or t - ot < REROUTE_S or moved >= JUMP_M:
        return (lat, lon, t, olat, olon, ot), True, None
    return (lat, lon, t, lat, lon, t), True, "reroute"


def _run(state: tuple, pdf: pd.DataFrame) -> tuple[tuple, list, list]:
    ok, ev = [], []
    for lat, lon, t in zip(pdf["latitude"], pdf["longitude"], pdf["t"]):
        state, a, e = _step(state, lat, lon, t)
        ok.append(a)
        ev.append(e)
    return state, ok, ev


def gate_batch(fixes: DataFrame) -> DataFrame:
    """K6 + K7 over a stored table: session_id, fix_id, latitude, longitude, t (s).

    The gate is sequential, so a session is cut into bounded slices that run in
    parallel.  Each slice first starts from nothing; then slices whose
    predecessor ends otherwise than assumed run again, until all starts agree.
    Different starts meet at a common accepted fix after a few rows, so that
    takes few rounds, and the result is exactly the sequential one.
    """
    rows = number_rows(
        fixes.select("session_id", "fix_id", "latitude", "longitude", "t"), ["session_id"],
        [F.floor(F.col("t") / 3600.0)], [F.col("t"), F.col("fix_id")], "pos",
    )
    rows = spool(rows.withColumn("slice", F.floor(F.col("pos") / SLICE_ROWS).cast("long")))
    names = [c.split()[0] for c in _STATE.split(", ")]
    nothing = [F.lit(float("nan")).alias(n) for n in names]
    starts = spool(rows.select("session_id", "slice").distinct().select("session_id", "slice", *nothing))
    ends = None
    todo = starts
    while True:
        work = rows.join(todo, ["session_id", "slice"])
        done = work.groupBy("session_id", "slice").applyInPandas(
            _slice_end, f"session_id string, slice long, {_STATE}"
        )
        done = spool(done)
        if ends is None:
            ends = done
        else:
            ends = spool(ends.join(done.select("session_id", "slice"), ["session_id", "slice"], "left_anti").unionByName(done))
        new_starts = ends.select("session_id", (F.col("slice") + 1).alias("slice"), *names)
        joined = starts.alias("s").join(new_starts.alias("n"), ["session_id", "slice"])
        differs = ~F.lit(True)
        for n in names:
            differs = differs | ~F.col(f"s.{n}").eqNullSafe(F.col(f"n.{n}"))
        todo = spool(joined.filter(differs).select("session_id", "slice", *[F.col(f"n.{n}").alias(n) for n in names]))
        if todo.isEmpty():
            break
        starts = spool(starts.join(todo.select("session_id", "slice"), ["session_id", "slice"], "left_anti").unionByName(todo))
    return rows.join(starts, ["session_id", "slice"]).groupBy("session_id", "slice").applyInPandas(_slice_rows, _OUT)


def _start(pdf: pd.DataFrame) -> tuple:
    first = pdf.iloc[0]
    return tuple(float("nan") if first[n] is None else float(first[n]) for n in (c.split()[0] for c in _STATE.split(", ")))


def _slice_end(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    state, _, _ = _run(_start(pdf), pdf)
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pd.DataFrame([[pdf["session_id"].iloc[0], pdf["slice"].iloc[0], *state]], columns=["session_id", "slice", *names])


def _slice_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    _, ok, ev = _run(_start(pdf), pdf)
    return pd.DataFrame({"session_id": pdf["session_id"], "fix_id": pdf["fix_id"], "accepted": ok, "event": pd.Series(ev, dtype=object, index=pdf.index)})


def _stream_group(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = tuple(float("nan") if v is None else v for v in state.get) if state.exists else (float("nan"),) * _N
    pdf = pd.concat(list(batches)).sort_values(["t", "fix_id"])  # one trigger's fixes of one session
    now, ok, ev = _run(now, pdf)
    state.update(now)
    yield pd.DataFrame({"session_id": key[0], "fix_id": pdf["fix_id"], "accepted": ok, "event": pd.Series(ev, dtype=object, index=pdf.index)})


def gate_stream(fixes: DataFrame) -> DataFrame:
    """K6 + K7 on a stream of the same columns; state is six numbers per session."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return fixes.groupBy("session_id").applyInPandasWithState(
        _stream_group, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout,
    )


class _OrderedGate(StatefulProcessor):
    """Fixes of a session wait for the watermark, pass the gate in time order, and a silent session is forgotten."""

    def __init__(self, idle_s: float):
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", _STATE + ", last double")
        self.waiting = handle.getMapState("waiting", "t double, fix_id long", "latitude double, longitude double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = np.inf
        for pdf in rows:
            for fix, lat, lon, t in zip(pdf["fix_id"], pdf["latitude"], pdf["longitude"], pdf["t"]):
                self.waiting.updateValue((float(t), int(fix)), (float(lat), float(lon)))
                first = min(first, float(t))
        if first < np.inf:
            self.handle.registerTimer(_ms(first))
        yield _verdicts([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator())
        ready = [x for x in held if _ms(x[0][0]) <= now]
        *state, last = self.gate.get() if self.gate.exists() else _NEW
        state, out = tuple(state), []
        for (t, fix), (lat, lon) in ready:
            if t - last > self.idle_s:
                state = _NEW[:_N]
            state, ok, event = _step(state, lat, lon, t)
            out.append((key[0], fix, ok, event))
            last = t
            self.waiting.removeKey((t, fix))
        if len(held) > len(ready):
            self.handle.registerTimer(_ms(held[len(ready)][0][0]))
        if last == last and _ms(last + self.idle_s) < now:
            self.gate.clear()  # the next fix, waiting or yet to come, starts over anyway
        elif ready:
            self.gate.update((*map(float, state), last))
            self.handle.registerTimer(_ms(last + self.idle_s) + 1)
        yield _verdicts(out)

    def close(self) -> None:
        pass


_NEW = (float("nan"),) * (_N + 1)


def _verdicts(rows: list) -> pd.DataFrame:
    kinds = {"session_id": object, "fix_id": "int64", "accepted": bool, "event": object}
    return pd.DataFrame(rows, columns=list(kinds), dtype=object).astype(kinds)


def _ms(t: float) -> int:
    return int(np.ceil(t * 1000))


def gate_stream_ordered(fixes: DataFrame, delay: str = "10 seconds", idle_s: float = 3600.0) -> DataFrame:
    """K6 + K7 on a stream whose fixes may arrive out of order by up to ``delay``.

    A fix is held until the watermark has passed its time, so the verdicts are those
    of ``gate_batch`` whatever the triggers bring together; later ones are dropped.  A session that is
    silent for more than ``idle_s`` seconds starts over, and a timer clears its state.
    State: the fixes within ``delay`` and seven numbers per live session.  A fix id sent
    twice with one time counts once; fixes without session, place or time are left out.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    whole = fixes.dropna(subset=["session_id", "fix_id", "latitude", "longitude", "t"])
    timed = whole.withColumn("at", F.timestamp_micros(F.ceil(F.col("t") * 1000000).cast("long"))).withWatermark("at", delay)
    return timed.select("session_id", "fix_id", "latitude", "longitude", "t", "at").groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_OrderedGate(idle_s), outputStructType=_OUT, outputMode="append", timeMode="EventTime",
    )
