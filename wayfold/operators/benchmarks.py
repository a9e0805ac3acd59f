"""Summary of path benchmark results (C14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayfold.operators.quantiles import exact_quantiles


# Names in comparisons.
SAME, ASTAR, DIJKSTRA = "Sama", "A*", "Dijkstra"


def metric_summary(results: DataFrame, metrics: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """mean, median, p95, p99, min and max per metric, in long form."""
    group = group or []
    long = results.select(*group, F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.expr(e).cast("double").alias("v")) for n, e in metrics.items()
    ])).alias("_m")).select(*group, "_m.*")
    basic = long.groupBy(*group, "measure").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(results, group, {n: F.expr(e) for n, e in metrics.items()}, [0.5, 0.95, 0.99])
    wide = q.groupBy(*group, "measure").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
        for n, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))
    ])
    return basic.join(wide, group + ["measure"])


def duel(results: DataFrame, a: str = "dijkstra_ms", b: str = "astar_ms") -> DataFrame:
    """Wins, ties, match rate, largest cost difference and errors against an
    external router."""
    n = F.count(F.lit(1))
    matches = F.count_if("optimal_cost_match")
    return results.agg(
        F.count_if(F.col(a) < F.col(b)).alias("first_wins"), F.count_if(F.col(b) < F.col(a)).alias("second_wins"),
        F.count_if(F.col(a) == F.col(b)).alias("ties"),
        matches.alias("optimal_cost_matches"), (matches * 100.0 / n).alias("match_rate_percent"),
        F.max("cost_difference_seconds").alias("max_cost_difference_seconds"),
        F.count("osrm_distance_error_percent").alias("validated_pairs"),
        F.avg("osrm_distance_error_percent").alias("distance_mape_percent"),
        F.avg("osrm_duration_error_percent").alias("duration_mape_percent"),
    )


def compare_pairs(results: DataFrame) -> DataFrame:
    """C14 per measured pair: who was faster, by how much, and who expanded fewer nodes.

    Needs dijkstra_ms, astar_ms, dijkstra_nodes, astar_nodes; other columns stay.
    The gain is the difference in percent of the slower time (0 where both took no
    time).  A missing measurement leaves the fields that need it null.
    """
    first = lambda a, b: F.when(a == b, SAME).when(b < a, ASTAR).when(a < b, DIJKSTRA)
    ms, nodes = (F.col("dijkstra_ms"), F.col("astar_ms")), (F.col("dijkstra_nodes"), F.col("astar_nodes"))
    apart, slower = F.abs(ms[0] - ms[1]), F.when(ms[0] > ms[1], ms[0]).otherwise(ms[1])
    return results.withColumns({
        "faster_algorithm": first(*ms), "time_difference_ms": F.round(apart, 2),
        "efficiency_gain_percent": F.round(F.when(slower > 0, apart / slower * 100.0).when(slower <= 0, 0.0), 1),
        "fewer_explored_algorithm": first(*nodes), "explored_nodes_difference": F.abs(nodes[0] - nodes[1]),
        "nodes_saved": F.when(nodes[0] > nodes[1], nodes[0] - nodes[1]).when(nodes[0] <= nodes[1], 0),
    })


def with_errors(results: DataFrame) -> DataFrame:
    """Percent errors and cost differences from raw pairs of measurements."""
    # costs match within a relative 1e-9 or an absolute 1e-7
    difference = F.abs(F.col("dijkstra_cost") - F.col("astar_cost"))
    tolerance = F.greatest(F.greatest(F.abs("dijkstra_cost"), F.abs("astar_cost")) * 1e-9, F.lit(1e-7))
    err = lambda x, y: F.abs(F.col(x) - F.col(y)) / F.nullif(F.col(y), F.lit(0.0)) * 100.0
    return results.select(
        "*",
        err("route_distance_km", "external_distance_km").alias("osrm_distance_error_percent"),
        err("route_travel_time_seconds", "external_duration_seconds").alias("osrm_duration_error_percent"),
        difference.alias("cost_difference_seconds"), (difference <= tolerance).alias("optimal_cost_match"),
    )
