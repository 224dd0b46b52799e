"""Constraints as violation queries: no row means valid. ``enforce`` turns violations into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.vector import norm


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(df: DataFrame, by: str, ordinal: str | list[str], partition: str | None = None) -> DataFrame:
    """Rows whose key is below the one before, in ordinal order (of each partition); further ordinals break ties.

    Over a whole table rows are numbered by ranges, and a row meets the one before it by its number: no task sorts the table.
    """
    if partition:
        w = Window.partitionBy(partition).orderBy(ordinal)
        return df.withColumn("before", F.lag(by).over(w)).where(F.col(by) < F.col("before"))
    from tidemark.operators.sequences import global_order

    numbered = global_order(df, [F.col(c) for c in ([ordinal] if isinstance(ordinal, str) else ordinal)], "ordered", "_place")
    before = numbered.select((F.col("_place") + 1).alias("_place"), F.col(by).alias("before"))
    return numbered.join(before, "_place").where(F.col(by) < F.col("before")).drop("_place")


def orphans(df: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    return df.join(parent.select(on).distinct(), on, "left_anti")


def not_contiguous(df: DataFrame, group: str, index: str) -> DataFrame:
    """Groups whose index is not 0 .. n-1, each once."""
    g = df.groupBy(group).agg(F.min(index).alias("least"), F.max(index).alias("most"), F.count("*").alias("n"), F.count_distinct(index).alias("d"))
    return g.where("least <> 0 or most <> n - 1 or d <> n")


def partly_timed(df: DataFrame, group: str, time: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(time).alias("timed"), F.count("*").alias("n")).where("timed not in (0, n)")


def over_limit(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where(F.col("n") > limit)


def failing(df: DataFrame, ok: Column) -> DataFrame:
    return df.where(~F.coalesce(ok, F.lit(False)))


def not_constant(df: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count_distinct(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("variants")).where("variants > 1")


def scattered(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Keys whose rows are not one run in ordinal order (gaps and islands).

    A key's rows are one run if their ordinals, ranked over the file, have no foreign row between: the rank distance
    from first to last equals the row count. Ranks come from ranges and offsets, not from one sorted task.
    """
    from tidemark.operators.sequences import global_order

    ranked = global_order(df.select(*key, ordinal), [F.col(ordinal)], "runs", "place")
    return ranked.groupBy(*key).agg((F.max("place") - F.min("place") + 1).alias("extent"), F.count("*").alias("n")).where("extent <> n")


def dictionary_mismatch(df: DataFrame, dictionary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    d = dictionary.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_known"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return df.join(d, key, "left").where(F.col("_known").isNull() | ~same).select(df.columns)


def coverage(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Keys missing from, extra in or repeated in ``actual``."""
    e, a = expected.groupBy(*key).agg(F.count("*").alias("e")), actual.groupBy(*key).agg(F.count("*").alias("a"))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") > 1, "duplicate")
    return e.join(a, key, "full_outer").withColumn("problem", problem).where("problem is not null").select(*key, "problem")


def case_collisions(df: DataFrame, root: str, key: str) -> DataFrame:
    return df.groupBy(root, F.lower(key).alias("folded")).agg(F.count_distinct(key).alias("n")).where("n > 1")


def partition_mismatch(counts: DataFrame, total: str, parts: list[str]) -> DataFrame:
    return counts.where(F.col(total) != sum((F.col(p) for p in parts[1:]), F.col(parts[0])))


def observation_status(df: DataFrame) -> DataFrame:
    """Status machine: unobserved has no attempt; succeeded has evidence and no reason; failed a reason and no evidence."""
    ok = (
        F.when(F.col("status") == "unobserved", (F.col("attempts") == 0) & (F.size("evidence") == 0) & F.col("reason").isNull())
        .when(F.col("status") == "succeeded", (F.col("attempts") > 0) & (F.size("evidence") > 0) & F.col("reason").isNull())
        .when(F.col("status") == "failed", (F.col("attempts") > 0) & (F.size("evidence") == 0) & F.col("reason").isNotNull())
        .otherwise(False)
    )
    return failing(df, ok)


def leaks(histories: DataFrame) -> DataFrame:
    """Histories with an event at or after the target's index."""
    return histories.where(F.array_max(F.col("history.interaction_index")) >= F.col("target_index"))


def not_unit(df: DataFrame, vector: str, tolerance: float = 1e-5) -> DataFrame:
    return failing(df, F.abs(norm(F.col(vector)) - 1) < tolerance)


def enforce(violations: DataFrame, message: str) -> None:
    """Raise if there is any violation; the first few are named."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")
