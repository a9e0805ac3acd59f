"""Administrative hierarchy and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfold.functions.text import slugify_key

LEVELS = [("province", "province"), ("city", "kabko"), ("district", "kecamatan"), ("village", "kelurahan")]
EDITABLE = ["name", "latitude", "longitude", "kecamatan", "kabko", "provinsi", "kelurahan", "address", "fasilitas"]


def _keys(pois: DataFrame, qualified: bool) -> DataFrame:
    out = pois
    parent = None
    for level, col in LEVELS:
        key = F.when(F.coalesce(F.col(col), F.lit("")) != "", slugify_key(F.col(col)))
        if qualified and parent is not None:
            key = F.when(key.isNotNull(), F.concat_ws("/", F.col(f"{parent}_key"), key))
        out = out.withColumn(f"{level}_key", key)
        parent = level
    return out


def admin_nodes(pois: DataFrame, qualified: bool = False) -> DataFrame:
    """Level, key, name.  Unqualified keys merge same-named places of
    different parents; ``qualified`` keeps them apart."""
    k = _keys(pois, qualified)
    rows = k.select(F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(f"{level}_key").alias("key"), F.col(col).alias("name"))
        for level, col in LEVELS
    ])).alias("_n")).select("_n.*").filter(F.col("key").isNotNull())
    return rows.groupBy("level", "key").agg(F.max("name").alias("name"))


def admin_edges(pois: DataFrame, qualified: bool = False) -> DataFrame:
    """edge_type, key, src, dst for three parent levels and point-to-village."""
    k = _keys(pois, qualified)
    def edge(kind: str, src: Column, dst: Column) -> Column:
        return F.when(
            src.isNotNull() & dst.isNotNull(),
            F.struct(F.lit(kind).alias("edge_type"), F.concat_ws("_", src, dst).alias("key"), src.alias("src"), dst.alias("dst")),
        )
    c = F.col
    all_edges = F.array_compact(F.array(
        edge("belongs_to_province", c("city_key"), c("province_key")),
        edge("belongs_to_city", c("district_key"), c("city_key")),
        edge("belongs_to_district", c("village_key"), c("district_key")),
        edge("located_in_village", c("_key"), c("village_key")),
    ))
    return k.select(F.explode(all_edges).alias("_e")).select("_e.*").distinct()


def lookup(keys: DataFrame, pois: DataFrame) -> DataFrame:
    """Points for a batch of (request_id, dataset_id, id); "all" searches
    every dataset (lowest dataset first), a named dataset only itself."""
    p = pois.withColumnRenamed("dataset_id", "found_dataset").withColumnRenamed("id", "found_id")
    named = keys.filter(F.col("dataset_id") != "all").join(
        p, (F.col("dataset_id") == F.col("found_dataset")) & (F.col("id") == F.col("found_id"))
    )
    first = pois.groupBy("id").agg(F.min("dataset_id").alias("found_dataset"))
    anywhere = keys.filter(F.col("dataset_id") == "all").join(first, "id").join(
        p.withColumnRenamed("found_dataset", "_fd"),
        (F.col("id") == F.col("found_id")) & (F.col("found_dataset") == F.col("_fd")),
    ).drop("_fd")
    cols = ["request_id", "found_dataset", "found_id", *[c for c in pois.columns if c not in ("dataset_id", "id")]]
    return named.select(*cols).unionByName(anywhere.select(*cols))


def insert_points(pois: DataFrame, new: DataFrame) -> DataFrame:
    """Add a change set; missing ids are random, priority defaults to 1."""
    given = F.col("id") if "id" in new.columns else F.lit(None).cast("string")
    n = new.withColumn("id", F.coalesce(given, F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))
    prio = F.col("priority_score") if "priority_score" in new.columns else F.lit(None).cast("double")
    n = n.withColumn("priority_score", F.coalesce(prio, F.lit(1.0)))
    n = n.withColumn("coordinate", F.array("longitude", "latitude")).withColumn("_key", F.concat_ws("_", "dataset_id", "id"))
    kept = pois.join(n.select("dataset_id", "id").distinct(), ["dataset_id", "id"], "left_anti")
    return kept.unionByName(n, allowMissingColumns=True).select(*pois.columns)


def apply_patches(pois: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the supplied fields changed, patches of unknown keys).

    ``patches``: dataset_id, id, seq and any of the editable fields; a null
    field was not supplied.  Later patches of a key win field by field.
    """
    fields = [c for c in EDITABLE if c in patches.columns and c in pois.columns]
    last = patches.groupBy("dataset_id", "id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_new_{c}") for c in fields
    ])
    merged = pois.join(last, ["dataset_id", "id"], "left")
    changed = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields}
    cols = [changed[c].alias(c) if c in changed else F.col(c) for c in pois.columns]
    out = merged.select(*cols)
    if "coordinate" in pois.columns:
        out = out.withColumn("coordinate", F.array("longitude", "latitude"))
    unknown = patches.join(pois.select("dataset_id", "id"), ["dataset_id", "id"], "left_anti")
    return out, unknown


def delete_points(pois: DataFrame, edges: DataFrame, keys: DataFrame | None = None, datasets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Remove listed (dataset_id, id) and whole datasets with their village edges."""
    gone = pois.select("dataset_id", "id", "_key").limit(0)
    if keys is not None:
        gone = pois.select("dataset_id", "id", "_key").join(keys, ["dataset_id", "id"], "left_semi")
    if datasets is not None:
        gone = gone.unionByName(pois.select("dataset_id", "id", "_key").join(datasets, "dataset_id", "left_semi"))
    rest = pois.join(gone, ["dataset_id", "id"], "left_anti")
    cut = gone.select(F.col("_key").alias("src"), F.lit("located_in_village").alias("edge_type"))
    return rest.select(*pois.columns), edges.join(cut, ["edge_type", "src"], "left_anti").select(*edges.columns)


def merge_settings(current: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """Overlay updates key by key on two setting maps per user.

    Both have user_id, search_settings, prayer_settings (map<string,string>),
    client_updated_at; ``updates`` has seq, the order they arrived in.
    """
    maps = ["search_settings", "prayer_settings"]
    rows = current.select("user_id", *maps, "client_updated_at", F.lit(-1).cast("long").alias("seq")).unionByName(
        updates.select("user_id", *maps, "client_updated_at", F.col("seq").cast("long").alias("seq"))
    )
    out = rows.groupBy("user_id").agg(
        F.max_by("client_updated_at", "seq").alias("client_updated_at"),
        F.max("seq").alias("last_seq"),
    )
    entries = rows.select("user_id", "seq", F.explode(F.array(*[
        F.struct(F.lit(m).alias("part"), F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))).alias("kv"))
        for m in maps
    ])).alias("_p")).select("user_id", "seq", "_p.part", F.explode("_p.kv").alias("kv"))
    last = entries.groupBy("user_id", "part", F.col("kv.key").alias("key")).agg(F.max_by("kv.value", "seq").alias("value"))
    # the number of settings of a user is bounded by the settings schema
    merged = last.groupBy("user_id").agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("part") == m, F.struct("key", "value"))
        ))).alias(m) for m in maps
    ])
    empty = F.create_map().cast("map<string,string>")
    return out.join(merged, "user_id", "left").select(
        "user_id", *[F.coalesce(m, empty).alias(m) for m in maps], "client_updated_at",
        (now if now is not None else F.current_timestamp()).alias("updated_at"), F.lit(1).alias("schema_version"),
    )


def delete_settings(current: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settings left, user_id and status of each user asked for: success or not_found).

    Asking twice for a user gives one answer; a null user is not found.
    """
    asked = users.select("user_id").distinct()
    known = current.select("user_id", F.lit(True).alias("_known")).distinct()
    answers = asked.join(known, "user_id", "left").select(
        "user_id", F.when(F.col("_known"), "success").otherwise("not_found").alias("status"),
    )
    return current.join(asked, "user_id", "left_anti"), answers


def revision_ledger(profiles: DataFrame, mutations: DataFrame) -> DataFrame:
    """Revision and point count of each dataset after a mutation log.

    ``profiles``: dataset_id, data_revision, mosque_count.  ``mutations``:
    dataset_id, seq, requested_revision, delta.  Each mutation raises the
    revision to max(known, requested) + 1 and adds its delta, floored at 0.
    Both are prefix recurrences, so they are computed from aggregates: with the
    m-th of n mutations requesting r, the end is the largest of known + n and
    r + n - m + 1; the floor likewise follows from the running sum's minimum.
    """
    from wayfold.runtime import number_rows

    m = number_rows(mutations, ["dataset_id"], [F.floor(F.col("seq") / 65536)], [F.col("seq")], "pos")
    block = F.floor(F.col("pos") / 65536)
    from pyspark.sql import Window

    inside = Window.partitionBy("dataset_id", "_blk").orderBy("pos")
    m = m.withColumn("_blk", block).withColumn("_run", F.sum(F.coalesce("delta", F.lit(0))).over(inside))
    blocks = m.groupBy("dataset_id", "_blk").agg(
        F.sum(F.coalesce("delta", F.lit(0))).alias("total"), F.min("_run").alias("low"),
        F.max(F.col("requested_revision") - F.col("pos")).alias("reach"), F.count(F.lit(1)).alias("n"),
    )
    before = Window.partitionBy("dataset_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("total").over(before), F.lit(0)))
    ends = blocks.groupBy("dataset_id").agg(
        F.sum("total").alias("total"), F.min(F.col("_before") + F.col("low")).alias("low"),
        F.max("reach").alias("reach"), F.sum("n").alias("n"),
    )
    p = profiles.select("dataset_id", F.coalesce("data_revision", F.lit(0)).alias("rev"), F.coalesce("mosque_count", F.lit(0)).alias("cnt"))
    r = p.join(ends, "dataset_id", "full")
    rev, n = F.coalesce("rev", F.lit(0)), F.coalesce("n", F.lit(0))
    start = F.coalesce("cnt", F.lit(0))
    count = F.coalesce("total", F.lit(0)) + F.greatest(start, -F.coalesce("low", F.lit(0)))
    return r.select(
        "dataset_id",
        F.greatest(rev + n, F.coalesce(F.col("reach") + n, rev)).cast("long").alias("data_revision"),
        count.cast("long").alias("mosque_count"),
    )
