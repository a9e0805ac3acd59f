"""Exact "best k objects per query" over a spatial pyramid.

A plain radius join on fixed cells pairs every query with every object of a
crowded cell.  Here objects are counted on a pyramid of square cells; crowded
cells are split further, so every leaf is small whatever the skew.  A query
walks down the pyramid with ordinary equi-joins: at each level it keeps only
cells whose best possible score does not exceed the k-th best score already
guaranteed by the other cells.  Only the leaves that survive are joined with
objects.  Where these still hold many, the most promising leaves of a query are
scored first, and the k-th best score found there closes the others.  No radius
is guessed and nothing is dropped that could be a result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayfold.functions.geo import EARTH_KM
from wayfold.runtime import compiled, spool, spread

ROOT_LEVEL = 4       # 11.25 degrees
FINEST_LEVEL = 30    # about 2 cm
LEVEL_STEP = 2       # every cell has 16 children
WORLD = 180.0
BROADCAST_ROWS = 1 << 14  # more cells or objects are not sent to every task
FLOOR_ROWS = 1 << 22      # from so many objects in the leaves on, the first leaves are scored ahead of the others
FLOOR_SHARE = 4           # objects in the first leaves per wanted result; fewer of them than this share of all
_LEVELS = list(range(ROOT_LEVEL, FINEST_LEVEL + 1, LEVEL_STEP))


@dataclass
class Cell:
    """True extent of the objects in a pyramid cell, plus its statistics."""

    south: Column
    north: Column
    west: Column
    east: Column
    cos_south: Column
    cos_north: Column
    stats: dict[str, Column]


@dataclass
class SpatialIndex:
    tree: DataFrame      # scope.., _cls, _lvl, _cx, _cy, _n, _leaf, stats
    placed: DataFrame    # objects with the leaf they belong to
    scope: list[str]
    classes: list[tuple]  # (_cls, half height, half width, south, north, west, east); at most a few dozen
    deepest: int
    stats: list[str]
    top: int             # cells down to this level are few enough to be broadcast
    objects: int
    spot_k: int | None = None  # of points at one spot only so many per order are kept


def _size(level: Column) -> Column:
    return F.lit(WORLD) / F.pow(F.lit(2.0), level)


def build_index(
    objects: DataFrame,
    *,
    lat: str = "lat",
    lon: str = "lon",
    scope: list[str] | None = None,
    capacity: int = 64,
    half_lat: Column | None = None,
    half_lon: Column | None = None,
    stats: dict[str, tuple[str, str]] | None = None,
) -> SpatialIndex:
    """Count objects on the pyramid and attach every object to its leaf.

    ``stats`` maps a name to (column, "min"|"max"), kept per cell for bounds on
    scores.  Objects with an extent are grouped by the order of magnitude of
    that extent, so one long object does not blur the cells of small ones.
    """
    scope = scope or []
    stats = stats or {}
    extent = half_lat is not None
    hl = half_lat if extent else F.lit(0.0)
    hw = half_lon if half_lon is not None else F.lit(0.0)
    finest = WORLD / 2 ** FINEST_LEVEL
    obj = objects.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        "*",
        hl.alias("_hl"),
        hw.alias("_hw"),
        F.floor((F.col(lon) + 180.0) / finest).cast("long").alias("_fx"),
        F.floor((F.col(lat) + 90.0) / finest).cast("long").alias("_fy"),
    )
    magnitude = F.greatest(F.col("_hl"), F.col("_hw"), F.lit(1e-6))
    obj = obj.withColumn("_cls", F.ceil(F.log2(magnitude)).cast("int") if extent else F.lit(0))

    agg = {"min": F.min, "max": F.max}
    keys = scope + ["_cls"]
    fine = obj.groupBy(*keys, "_fx", "_fy").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_hl").alias("_mhl"),
        F.max("_hw").alias("_mhw"),
        F.min(lat).alias("_lat0"), F.max(lat).alias("_lat1"),
        F.min(lon).alias("_lon0"), F.max(lon).alias("_lon1"),
        *[agg[how](c).alias(n) for n, (c, how) in stats.items()],
    )
    levels = fine.withColumn("_lvl", F.explode(F.array(*[F.lit(v) for v in _LEVELS])))
    shift = lambda c, lvl="_lvl": F.expr(f"shiftright({c}, {FINEST_LEVEL} - {lvl})")
    counts = (
        levels.withColumn("_cx", shift("_fx")).withColumn("_cy", shift("_fy"))
        .groupBy(*keys, "_lvl", "_cx", "_cy")
        .agg(
            F.sum("_n").alias("_n"),
            F.max("_mhl").alias("_mhl"),
            F.max("_mhw").alias("_mhw"),
            F.min("_lat0").alias("_lat0"), F.max("_lat1").alias("_lat1"),
            F.min("_lon0").alias("_lon0"), F.max("_lon1").alias("_lon1"),
            *[agg[how](n).alias(n) for n, (_, how) in stats.items()],
        )
    )
    one_spot = (F.col("_lat0") == F.col("_lat1")) & (F.col("_lon0") == F.col("_lon1"))
    whole = (F.col("_n") <= capacity) | one_spot | (F.col("_lvl") == FINEST_LEVEL)
    counts = spool(counts.withColumn("_leaf", whole))
    cell = ["_lvl", "_cx", "_cy"]
    split = counts.filter(~F.col("_leaf")).select(
        *keys,
        (F.col("_lvl") + LEVEL_STEP).alias("_plvl"), F.col("_cx").alias("_px"), F.col("_cy").alias("_py"),
    )
    reachable = counts.select(
        "*",
        F.col("_lvl").alias("_plvl"),
        F.shiftright("_cx", LEVEL_STEP).alias("_px"),
        F.shiftright("_cy", LEVEL_STEP).alias("_py"),
    ).join(split, keys + ["_plvl", "_px", "_py"], "left_semi").drop("_plvl", "_px", "_py")
    roots = counts.filter(F.col("_lvl") == ROOT_LEVEL)
    tree = spool(roots.select(*reachable.columns).unionByName(reachable))

    leaves = tree.filter("_leaf")
    # bounded by the number of pyramid levels and size classes, not by the data
    sizes = sorted(tree.groupBy("_lvl").agg(
        F.count(F.lit(1)), F.count(F.when(F.col("_leaf"), 1)), F.coalesce(F.sum(F.when(F.col("_leaf"), F.col("_n"))), F.lit(0)),
    ).collect())
    leaf_levels = [r[0] for r in sizes if r[2]] or [ROOT_LEVEL]
    top, cells = ROOT_LEVEL - LEVEL_STEP, 0
    for level, n, *_ in sizes:
        cells += n
        if cells > BROADCAST_ROWS:
            break
        top = level
    else:
        top = FINEST_LEVEL
    classes = [
        tuple(r)
        for r in tree.filter(F.col("_lvl") == ROOT_LEVEL)
        .groupBy("_cls")
        .agg(F.max("_mhl"), F.max("_mhw"), F.min("_lat0"), F.max("_lat1"), F.min("_lon0"), F.max("_lon1"))
        .collect()
    ]
    placed = (
        obj.withColumn("_lvl", F.explode(F.array(*[F.lit(v) for v in sorted(leaf_levels)])))
        .withColumn("_cx", shift("_fx")).withColumn("_cy", shift("_fy"))
        .drop("_fx", "_fy", "_hl", "_hw")
        .join(_few(leaves.select(*keys, *cell), sum(r[2] for r in sizes)), keys + cell, "left_semi")
    )
    return SpatialIndex(tree, spool(placed), scope, classes, max(leaf_levels), list(stats), top, sum(r[3] for r in sizes))


def best_k(
    queries: DataFrame,
    index: SpatialIndex,
    *,
    qid: str,
    box: tuple[Column, Column, Column, Column],
    k: Column,
    max_k: int,
    bounds: Callable[[Cell], tuple[Column, Column]],
    score: Column,
    keep: Column | None = None,
    order: list[Column] | None = None,
    with_ties: bool = False,
) -> DataFrame:
    """Best ``k`` objects per query by (score, order).

    ``box`` = (south, north, west, east) that holds every acceptable object.
    ``bounds(cell)`` = (lower, upper): lower is a bound of the score of any
    acceptable object in the cell (null: the cell has none, upper is null too);
    upper is a bound that *every* object of the cell meets, all of them being
    acceptable (null: unknown).  ``score``, ``keep`` and ``order`` see query and object columns.
    Adds ``_score`` and ``_rank``.
    """
    south, north, west, east = box
    sc = index.scope
    q = queries.select("*", k.alias("_k"), south.alias("_qs"), north.alias("_qn"), west.alias("_qw"), east.alias("_qe"))
    # search box of each size class, cut to where objects of that class are
    names = ["_ch", "_cw", "_ds", "_dn", "_dw", "_de"]
    rows = [
        F.struct(F.lit(c[0]).cast("int").alias("_cls"), *[F.lit(float(v)).alias(n) for v, n in zip(c[1:], names)])
        for c in index.classes
    ] or [F.struct(F.lit(0).alias("_cls"), *[F.lit(0.0).alias(n) for n in names])]
    q = q.withColumn("_c", F.explode(F.array(*rows))).select("*", "_c.*").drop("_c")
    q = q.select(
        "*",
        F.greatest(F.col("_qs") - F.col("_ch"), F.col("_ds")).alias("_bs"),
        F.least(F.col("_qn") + F.col("_ch"), F.col("_dn")).alias("_bn"),
        F.greatest(F.col("_qw") - F.col("_cw"), F.col("_dw")).alias("_bw"),
        F.least(F.col("_qe") + F.col("_cw"), F.col("_de")).alias("_be"),
    ).filter((F.col("_bs") <= F.col("_bn")) & (F.col("_bw") <= F.col("_be")))
    span = F.greatest(F.col("_bn") - F.col("_bs"), F.col("_be") - F.col("_bw"), F.lit(1e-9))
    raw = F.floor(F.log2(F.lit(WORLD) / span)).cast("int")
    raw = raw - F.pmod(raw, F.lit(LEVEL_STEP))
    q = q.withColumn("_l0", F.greatest(F.lit(ROOT_LEVEL), F.least(F.lit(index.deepest), raw)))
    q = q.withColumn("_sz", _size(F.col("_l0")))
    edge = lambda c, o: F.floor((F.col(c) + o) / F.col("_sz")).cast("long")
    q = q.select(
        "*", edge("_bw", 180.0).alias("_x0"), edge("_be", 180.0).alias("_x1"),
        edge("_bs", 90.0).alias("_y0"), edge("_bn", 90.0).alias("_y1"),
    ).drop("_bs", "_bn", "_bw", "_be", "_sz", "_qs", "_qn", "_qw", "_qe", *names)
    value = (score, F.lit(True) if keep is None else keep)
    keys = sc + ["_cls", "_lvl", "_cx", "_cy"]
    with compiled(queries.sparkSession):
        front = _descend(q, index, qid, keys, bounds, value)
    hits = _score_leaves(front, index, qid, keys, value)
    rank = F.rank() if with_ties else F.row_number()
    w = Window.partitionBy(qid).orderBy(F.col("_score"), *([] if with_ties else order or []))
    hits = hits.withColumn("_rank", rank.over(w))
    hits = hits.filter((F.col("_rank") <= max_k) & (F.col("_rank") <= F.col("_k")))
    return hits.drop("_limit", "_k", "_l0", "_cls", "_lvl", "_cx", "_cy")


def _descend(q: DataFrame, index: SpatialIndex, qid: str, keys: list[str], bounds, value: tuple[Column, Column]) -> DataFrame:
    """Leaves that can hold results of each query, with the limits of their scores."""
    # cells of the start level that the box touches, and all their ancestors
    start = F.expr(
        f"flatten(transform(sequence({ROOT_LEVEL}, _l0, {LEVEL_STEP}), l -> flatten(transform("
        "sequence(shiftright(_x0, _l0 - l), shiftright(_x1, _l0 - l)), x -> transform("
        "sequence(shiftright(_y0, _l0 - l), shiftright(_y1, _l0 - l)), y -> "
        "named_struct('_lvl', l, '_cx', x, '_cy', y))))))"
    )
    front = spool(q).withColumn("_s", F.explode(start)).select("*", "_s.*").drop("_s", "_x0", "_x1", "_y0", "_y1")
    qcols = [c for c in front.columns if c not in ("_lvl", "_cx", "_cy")]

    front = _meet_cells(front, index, keys).filter(F.col("_leaf") | (F.col("_lvl") == F.col("_l0")))
    front = spool(_prune(front, qid, bounds, index))
    children = F.expr(
        "if(_leaf, array(named_struct('_lvl', _lvl, '_cx', _cx, '_cy', _cy)), "
        "flatten(transform(sequence(0, 3), i -> transform(sequence(0, 3), j -> named_struct("
        f"'_lvl', _lvl + {LEVEL_STEP}, '_cx', shiftleft(_cx, {LEVEL_STEP}) + i, "
        f"'_cy', shiftleft(_cy, {LEVEL_STEP}) + j)))))"
    )
    while not front.filter(~F.col("_leaf")).isEmpty():
        below = front.select(*qcols, "_limit", F.explode(children).alias("_s")).select(*qcols, "_limit", "_s.*")
        front = spool(_prune(_meet_cells(below, index, keys), qid, bounds, index))

    columns = [*qcols, "_lvl", "_cx", "_cy", "_limit"]
    front = _close_leaves(front.select(*columns, "_n", "_lb"), index, qid, keys, value)
    return front.select(*columns)


def _below(limit: Column) -> Column:
    """Largest score that a limit surely lets pass."""
    return F.coalesce(limit + F.abs(limit) * 1e-9 + 1e-9, F.lit(float("inf")))


def _held(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition over computed columns.

    The partition id keeps the filter above the projection, so that the
    arithmetic is done once and its common parts are shared.
    """
    df = df.withColumn("_task", F.spark_partition_id())
    return df.filter(F.coalesce(condition, F.lit(False)) & (F.col("_task") >= 0)).drop("_task")


def _score_leaves(front: DataFrame, index: SpatialIndex, qid: str, keys: list[str], value: tuple[Column, Column]) -> DataFrame:
    """Acceptable objects of the leaves of the front, with their scores up to the limit."""
    if index.objects <= BROADCAST_ROWS:
        front = spread(front, qid)
    score, keep = value
    # the score stands outside of any condition, where its common parts are evaluated once
    hits = front.join(_few(index.placed, index.objects), keys).withColumns({"_score": score, "_keep": keep})
    # one test for eligibility and for the guaranteed limit, before any sorting
    return _held(hits, F.col("_keep") & (F.col("_score") <= _below(F.col("_limit")))).drop("_keep")


def _close_leaves(front: DataFrame, index: SpatialIndex, qid: str, keys: list[str], value: tuple[Column, Column]) -> DataFrame:
    """The front without the leaves, and with the limits, that the most promising leaves' objects rule out.

    Bounds of cells are loose where a score mixes distance with other things.  The k-th
    best of any objects bounds the k-th best of all, so the leaves with the lowest
    bounds are scored ahead, as far as they hold a few times k objects.
    """
    held = front.agg(F.sum("_n")).first()[0] or 0
    if held < FLOOR_ROWS:
        return front
    before = Window.partitionBy(qid).orderBy("_lb").rowsBetween(Window.unboundedPreceding, -1)
    first = spread(front, qid).withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_most": F.max("_k").over(Window.partitionBy(qid)),
    })
    first = spool(first.filter(F.col("_before") < F.col("_k") * FLOOR_SHARE))
    if (first.agg(F.sum("_n")).first()[0] or 0) * FLOOR_SHARE > held:
        return front
    # k-th best: a number of rows a query, each of a key and a score
    found = _score_leaves(first.drop("_n", "_lb", "_before"), index, qid, keys, value).select(qid, "_most", "_score")
    found = found.withColumn("_rank", F.row_number().over(Window.partitionBy(qid).orderBy("_score")))
    floors = spool(found.filter(F.col("_rank") == F.col("_most")).select(qid, F.col("_score").alias("_floor")))
    front = front.hint("merge").join(floors, qid, "left").withColumn("_limit", F.least("_limit", "_floor"))
    return spool(front.filter(F.col("_lb") <= _below(F.col("_limit"))).drop("_floor"))


def _few(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join: broadcast if its rows are few, otherwise met by sorting."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side.hint("merge")


def _meet_cells(front: DataFrame, index: SpatialIndex, keys: list[str]) -> DataFrame:
    """Rows of the front with the cells they name.

    The upper cells, which many queries share, are few and broadcast; the others
    are met by sorting.  Left to itself the planner judges both sides by compressed
    files, the front before it is multiplied, and may send either through the driver.
    """
    if index.top == FINEST_LEVEL:
        return front.join(F.broadcast(index.tree), keys)
    upper, lower = F.col("_lvl") <= index.top, F.col("_lvl") > index.top
    near = front.filter(upper).join(F.broadcast(index.tree.filter(upper)), keys)
    return near.unionByName(front.filter(lower).join(index.tree.filter(lower).hint("merge"), keys))


def _prune(front: DataFrame, qid: str, bounds, index: SpatialIndex) -> DataFrame:
    # columns of their own: within larger expressions their arithmetic would be repeated
    front = front.withColumns({
        "_cs": F.col("_lat0") - F.col("_mhl"), "_cn": F.col("_lat1") + F.col("_mhl"),
        "_cw": F.col("_lon0") - F.col("_mhw"), "_ce": F.col("_lon1") + F.col("_mhw"),
    })
    sides = ["_cs", "_cn", "_cw", "_ce", "_cos0", "_cos1"]
    front = front.withColumns({"_cos0": F.cos(F.radians("_cs")), "_cos1": F.cos(F.radians("_cn"))})
    cell = Cell(*[F.col(c) for c in sides], {s: F.col(s) for s in index.stats})
    lower, upper = bounds(cell)
    known = "_limit" in front.columns
    front = front.withColumns({"_lb": lower, "_ub": upper}).drop(*sides)
    # cells that the limit of their parents rules out do not move
    front = _held(front, F.col("_lb") <= _below(F.col("_limit")) if known else F.col("_lb").isNotNull())
    front = spread(front.withColumnRenamed("_limit", "_above") if known else front, qid)
    # k-th best guaranteed score: first upper bound at which enough objects are certain
    certain = F.when(F.col("_ub").isNotNull(), F.col("_n")).otherwise(0)
    running = Window.partitionBy(qid).orderBy(F.col("_ub").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    front = front.withColumn("_cum", F.sum(certain).over(running))
    limit = F.min(F.when(F.col("_cum") >= F.col("_k"), F.col("_ub"))).over(Window.partitionBy(qid))
    front = front.withColumn("_limit", F.least(limit, F.col("_above")) if known else limit)
    return front.filter(F.col("_lb") <= _below(F.col("_limit"))).drop("_ub", "_cum", "_above")


def distance_bounds(cell: Cell, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Smallest and largest great-circle km from a point to a cell, give or take a ten-millionth.

    Every step is written once: inside a condition the planner evaluates common parts again and again.
    """
    def km(a: Column) -> Column:
        a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
        return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(a))

    def half_sin2(deg: Column) -> Column:
        return F.pow(F.sin(F.radians(deg) / 2.0), F.lit(2.0))

    def wrap(d: Column) -> Column:
        return F.least(d, F.abs(F.lit(360.0) - d))

    d1, d2 = F.abs(lat - cell.south), F.abs(lat - cell.north)
    dlat_min = F.when(lat.between(cell.south, cell.north), 0.0).otherwise(F.least(d1, d2))
    dlat_max = F.greatest(d1, d2)
    e1, e2 = F.abs(lon - cell.west), F.abs(lon - cell.east)
    dlon_min = F.when(lon.between(cell.west, cell.east), 0.0).otherwise(F.least(wrap(e1), wrap(e2)))
    dlon_max = F.least(F.greatest(e1, e2), F.lit(180.0))
    c = F.cos(F.radians(lat))
    cos_s, cos_n = cell.cos_south, cell.cos_north
    cos_min = F.greatest(F.least(cos_s, cos_n), F.lit(0.0))
    cos_max = F.when((cell.south <= 0) & (cell.north >= 0), 1.0).otherwise(F.greatest(cos_s, cos_n))
    low = km(half_sin2(dlat_min) + c * cos_min * half_sin2(dlon_min))
    high = km(half_sin2(dlat_max) + c * cos_max * half_sin2(dlon_max))
    # the arcsine loses digits near the antipode
    return low * (1.0 - 1e-7), high * (1.0 + 1e-7)


def radius_box(lat: Column, lon: Column, radius_km: Column) -> tuple[Column, Column, Column, Column]:
    """Box that surely holds the circle around a point."""
    dlat = radius_km / 111.0 + 1e-6  # 1 degree of latitude is 111.19 km on this sphere
    widest = F.least(F.abs(lat) + dlat, F.lit(90.0))
    squeeze = F.cos(F.radians(widest))
    dlon = F.when(squeeze < 1e-3, 360.0).otherwise(F.least(dlat / squeeze, F.lit(360.0)))
    # circles over the antimeridian search the full turn
    over = (lon - dlon < -180.0) | (lon + dlon > 180.0)
    return (
        lat - dlat, lat + dlat,
        F.when(over, -180.0).otherwise(lon - dlon),
        F.when(over, 180.0).otherwise(lon + dlon),
    )
