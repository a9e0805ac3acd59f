"""Road network tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfold.functions.geo import metric_distance_m
from wayfold.functions.scoring import choose
from wayfold.runtime import keep_first, spool

# Speed in km/h by road class; every other class 30.
ROAD_SPEEDS = {
    "motorway": 80.0, "trunk": 70.0, "primary": 60.0, "secondary": 50.0, "tertiary": 40.0,
    "residential": 30.0, "unclassified": 30.0, "service": 20.0, "living_street": 20.0,
}
DEFAULT_SPEED_MPS = 8.33


def infer_travel_time(edges: DataFrame) -> DataFrame:
    """speed_kph and travel_time from the road class."""
    speed = choose(F.col("highway"), ROAD_SPEEDS, 30.0)
    return edges.withColumn("speed_kph", speed).withColumn("travel_time", F.col("length") / (F.col("speed_kph") / 3.6))


def is_toll(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("yes", "true", "1", "designated"), F.lit(False))


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """Fastest edge per (u, v); the first key wins ties."""
    time = F.coalesce(F.col("travel_time"), F.col("length") / DEFAULT_SPEED_MPS)
    rows = edges.withColumn("travel_time", time).filter(F.col("length").isNotNull())
    return keep_first(rows, ["u", "v"], [F.col("travel_time"), F.col("key")])


def physical_edges(edges: DataFrame) -> DataFrame:
    """C11: one row per pair of joined nodes, whatever the directions."""
    rows = edges.filter(F.col("u") != F.col("v")).select("*", F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"))
    return keep_first(rows, ["_a", "_b"], [F.col("u")]).drop("_a", "_b")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, extent and largest degree per graph."""
    by_node = degrees(edges).groupBy("graph_id").agg(F.max("degree").alias("max_degree"))
    n = nodes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
    )
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "graph_id", "left").join(by_node, "graph_id", "left")


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree of every node that has edges."""
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def weak_components(edges: DataFrame) -> DataFrame:
    """Component label (smallest node) of every node with an edge.

    Alternating star contraction: links are re-hung onto the smallest known
    neighbour until each component is one star, in a logarithmic number of
    rounds whatever the diameter.  Every step is a map-side-combined minimum
    and an equi-join; hubs are never gathered.
    """
    links = spool(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    )
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = spool(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = spool(hung.union(low).filter(F.col("a") != F.col("b")).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest weakly connected part."""
    labels = nodes.select("node").join(weak_components(edges), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    labels = spool(labels)
    biggest = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("component", F.struct("n", (-F.col("component")).alias("x"))).alias("component")
    )
    members = labels.join(F.broadcast(biggest), "component", "left_semi").select("node")
    inside = edges.join(members.withColumnRenamed("node", "u"), "u", "left_semi")
    return nodes.join(members, "node", "left_semi"), inside


def speed_bound(nodes: DataFrame, edges: DataFrame, weight: str = "travel_time") -> DataFrame:
    """Largest straight metres per unit of cost; infinite if unbounded."""
    a = nodes.select(F.col("node").alias("u"), F.col("lat").alias("ulat"), F.col("lon").alias("ulon"))
    b = nodes.select(F.col("node").alias("v"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    rows = edges.join(a, "u").join(b, "v").select(
        metric_distance_m("ulat", "ulon", "vlat", "vlon").alias("m"), F.coalesce(F.expr(weight), F.lit(1.0)).cast("double").alias("c"),
    )
    inf = F.lit(float("inf"))
    invalid = F.isnan("c") | (F.col("c") == inf) | (F.col("c") < 0) | ((F.col("c") == 0) & (F.col("m") > 1e-9))
    out = rows.agg(
        F.coalesce(F.max(invalid), F.lit(False)).alias("bad"),
        F.max(F.when(F.col("c") > 0, F.col("m") / F.col("c"))).alias("ratio"),
    )
    ok = ~F.col("bad") & (F.col("ratio") > 0)
    return out.select(F.when(ok, F.col("ratio") * (1.0 + 1e-12)).otherwise(inf).alias("max_metres_per_cost"))


def cut_region(nodes: DataFrame, edges: DataFrame, north, south, east, west) -> tuple[DataFrame, DataFrame]:
    """F16: nodes inside a box and the edges between them."""
    inside = nodes.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    ids = inside.select("node")
    kept = edges.join(ids.withColumnRenamed("node", "u"), "u", "left_semi").join(
        ids.withColumnRenamed("node", "v"), "v", "left_semi"
    )
    return inside, kept
