"""From attribute-expanded raw rows to exposures, items, categories and the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import interaction_label

EXPOSURE = ["user_id", "pid", "exposed_time"]


def exposures(raw: DataFrame) -> DataFrame:
    """One row per (user, item, time): first ordinal, rows, exact duplicate rows, and the constant fields."""
    content = F.sha2(F.to_json(F.struct(*[c for c in sorted(raw.columns) if c != "ordinal"]), {"ignoreNullFields": "false"}), 256)
    return raw.withColumn("content", content).groupBy(*EXPOSURE).agg(
        F.min("ordinal").alias("first_ordinal"),
        F.count("*").alias("row_count"),
        (F.count("*") - F.count_distinct("content")).alias("duplicate_rows"),
        *[F.min_by(c, "ordinal").alias(c) for c in ("watch_time", "duration", "cvm_like", "click", "hate")],
    )


def behavior_events(raw: DataFrame) -> DataFrame:
    """Exposures as events: namespaced ids, milliseconds, label, index in (time, first ordinal) order."""
    e = exposures(raw)
    order = Window.partitionBy("user_id").orderBy("exposed_time", "first_ordinal")
    return e.select(
        F.concat(F.lit("tsv:user:"), "user_id").alias("user_id"),
        F.concat(F.lit("tsv:item:"), "pid").alias("item_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("interaction_index"),
        (F.col("exposed_time") * 1000).alias("occurred_at_ms"),
        F.col("watch_time").alias("value"),
        (F.col("watch_time") > 3).alias("effective_view"),
        interaction_label(F.col("hate"), F.col("watch_time"), [F.col("cvm_like")]).alias("label"),
    )


def category_paths(categories: DataFrame, depth: int = 16) -> DataFrame:
    """category_id, path: names from the root down, joined by ' > '.

    A hop that is missing, or a missing name, gives a null path; a cycle is an error, and so is a tree deeper than ``depth``.
    The walk joins the small tree with itself level by level.
    """
    tree = categories.select("category_id", "parent_id", "level", "name")
    up = tree.select(F.col("category_id").alias("c"), F.col("parent_id").alias("p"), F.col("level").alias("l"), F.col("name").alias("n"))
    walk = tree.select("category_id", F.col("category_id").alias("at"), F.array("name").alias("names"), F.array("category_id").alias("seen"), ((F.col("level") == 1) | (F.col("parent_id") == F.col("category_id"))).alias("done"), F.col("parent_id").alias("next"))
    done = walk.where("done").select("category_id", "names")
    open_ = walk.where("not done")
    for _ in range(depth):
        if open_.isEmpty():
            break
        if not open_.where(F.array_contains("seen", F.col("next"))).isEmpty():
            raise ValueError("the category tree has a cycle")
        met = open_.join(up, open_["next"] == up["c"], "left")
        step = met.select(
            "category_id", F.concat(F.array("n"), "names").alias("names"), F.concat("seen", F.array("next")).alias("seen"),
            (F.col("c").isNull() | (F.col("l") == 1) | (F.col("p") == F.col("c"))).alias("done"), F.col("p").alias("next"),
        )
        done = done.unionByName(step.where("done").select("category_id", "names"))
        open_ = step.where("not done")
    else:
        if not open_.isEmpty():
            raise ValueError(f"the category tree is deeper than {depth}")
    path = F.when(~F.exists("names", lambda x: x.isNull()), F.array_join("names", " > "))
    return done.select("category_id", path.alias("path"))


def item_catalog(raw: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per item: author, sticky title status, tags (all or none), paths in tree order.

    One missing title hides all valid ones; otherwise several different titles are a conflict. One missing tag makes
    all tags unavailable. Paths follow (level, root, id) and are listed once.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    rows = raw.join(paths, "category_id", "left").withColumn("t", F.when(title != "", title)).withColumn("tag", F.when(F.trim(F.coalesce("tag_name", F.lit(""))) != "", F.trim("tag_name")))
    items = rows.groupBy("pid").agg(
        F.min_by("author_id", "ordinal").alias("author_id"),
        F.bool_or(F.col("t").isNull()).alias("no_title"),
        F.array_sort(F.collect_set("t")).alias("titles"),
        F.bool_or(F.col("tag").isNull()).alias("no_tag"),
        F.array_sort(F.collect_set("tag")).alias("tags"),
        F.array_sort(F.collect_set(F.struct("category_level", "root_id", "category_id", "path"))).alias("categories"),
        F.count_distinct("author_fans_count").alias("fan_counts"),
    )
    status = F.when(F.col("no_title"), "missing").when(F.size("titles") == 1, "available").when(F.size("titles") == 0, "missing").otherwise("conflict")
    return items.select(
        "pid", "author_id", status.alias("title_status"),
        F.when(status == "available", F.element_at("titles", 1)).alias("title"),
        F.when(~F.col("no_tag"), F.array_join("tags", ",")).alias("tags"),
        F.array_join(F.array_distinct(F.filter(F.col("categories.path"), lambda p: p.isNotNull())), "|").alias("paths"),
        (F.col("fan_counts") > 1).alias("mutable_fans"),
    )


def adapter_audit(raw: DataFrame) -> DataFrame:
    """One row of counts; every input is reduced before it meets the others."""
    rows = raw.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("pid").alias("items"))
    e = exposures(raw).withColumn("label", interaction_label(F.col("hate"), F.col("watch_time"), [F.col("cvm_like")]))
    folded = e.agg(
        F.count("*").alias("exposures"), F.count_if(F.expr("row_count > 1")).alias("multi_row_exposures"), F.max("row_count").alias("largest_exposure"),
        F.sum("duplicate_rows").alias("duplicate_rows"), F.count_if(F.col("label") == "positive_v1").alias("positive"),
        F.count_if(F.col("label") == "explicit_negative_v1").alias("negative"), F.count_if(F.col("label") == "passive_nonpositive_v1").alias("passive"),
        F.count_if(F.expr("watch_time > duration")).alias("watch_over_duration"),
    )
    return rows.crossJoin(folded)  # one row each


def category_dictionary(rows: DataFrame) -> DataFrame:
    """Category rows by id; the English name is null on any conflict, which counts once for a category."""
    named = F.when(F.trim(F.coalesce("category_name_en", F.lit(""))) != "", F.trim("category_name_en"))
    g = rows.withColumn("en", named).groupBy("category_id").agg(
        F.min("category_level").alias("category_level"), F.min("parent_id").alias("parent_id"), F.min("root_id").alias("root_id"), F.min("category_name_cn").alias("category_name_cn"),
        F.count_distinct(F.struct("category_level", "parent_id", "root_id", "category_name_cn")).alias("variants"),
        F.count_distinct("en").alias("names"), F.min("en").alias("en"), F.bool_or(F.col("en").isNull()).alias("unnamed"),
    )
    conflict = F.col("variants") > 1
    return g.select(
        "category_id", F.when(conflict, F.raise_error(F.concat(F.lit("category declared differently: "), "category_id")).cast("int")).otherwise(F.col("category_level")).alias("category_level"),
        "parent_id", "root_id", "category_name_cn", F.when((F.col("names") == 1) & ~F.col("unnamed"), F.col("en")).alias("category_name_en"), (F.col("names") > 1).cast("int").alias("conflicts"),
    )
