"""Session helpers: intermediate tables and column utilities shared by the jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000
_fallback_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint setting.

    Only where that setting is missing (tests, notebooks) a temporary folder is
    created, once per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="wayfold-")
    return _fallback_dirs[app]


def spool(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Write an intermediate result once and return a reader over it.

    This cuts lineage, survives executor loss, and gives the planner the real
    size of the table, so later joins broadcast only what is truly small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfold/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash by key over the session's shuffle width before expensive arithmetic.

    Rows are small here but costly to work on; sized by bytes alone they would
    end up in a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Long arithmetic is compiled by the JVM; what is lazy has to run inside.

    A stage fused into one method of more than 8000 bytes stays in the JVM's interpreter.  With this
    limit such a stage runs operator by operator, its expressions cut into short methods.
    """
    usual = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, METHOD_BYTES)
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, usual)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clamp(c: Column, lo, hi) -> Column:
    """Value held between two limits; missing stays missing."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def keep_first(df: DataFrame, keys: list, order: list, name: str = "_rn") -> DataFrame:
    """First row per key in the given order (the limit is applied map-side too)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) == 1).drop(name)


def number_rows(df: DataFrame, keys: list[str], block: list[Column], order: list[Column], out: str) -> DataFrame:
    """0-based row number per key without sorting a whole key in one task.

    ``block`` cuts each key into ordered, bounded pieces; pieces are numbered
    separately and shifted by the number of rows in the pieces before them.
    """
    from pyspark.sql import Window

    cut = [f"_b{i}" for i in range(len(block))]
    df = df.select("*", *[b.alias(n) for b, n in zip(block, cut)])
    sizes = df.groupBy(*keys, *cut).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, *cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, *cut).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, keys + cut)
        .withColumn(out, F.col("_offset") + F.col("_rn") - 1)
        .drop("_rn", "_offset", *cut)
    )
