"""Popularity ranking over the full catalog by counting, and rank metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import constants as K
from tidemark.operators.sequences import global_order


def popularity(parts: DataFrame, vocab: DataFrame) -> DataFrame:
    """item_id, model_index, count in the train part, and the global rank by (-count, item_id)."""
    counted = parts.where("split = 'train'").groupBy("item_id").agg(F.count("*").alias("count"))
    full = vocab.join(counted, "item_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return global_order(full, [F.desc("count"), F.asc("item_id")], "popularity", "g")


def target_ranks(held: DataFrame, seen: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each warm target's rank among the unseen catalog and itself; cold targets have no rank and no candidates.

    Rank = global rank less the seen items that stand before it; no target meets the catalog row by row.
    """
    g = ranked.select("item_id", "g")
    placed = held.select("sample_id", "user_id", "split", "item_id", "warm").join(g, "item_id", "left")
    total = ranked.count()
    # the long side, what was seen, streams past hashed places and is neither sorted nor widened by the targets' ids
    own = seen.join(g.withColumnRenamed("g", "seen_g").hint("shuffle_hash"), "item_id").select("user_id", "split", "seen_g")
    place = placed.where("warm").select("user_id", "split", "g")
    counts = own.join(place.hint("shuffle_hash"), ["user_id", "split"]).groupBy("user_id", "split").agg(F.count_if(F.expr("seen_g < g")).alias("before"), F.count_if(F.expr("seen_g <> g")).alias("masked"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return placed.join(counts, ["user_id", "split"], "left").select(
        "sample_id", "user_id", "split", "item_id", "warm",
        F.when(F.col("warm"), F.col("g") - none("before")).alias("rank"),
        F.when(F.col("warm"), F.lit(total) - none("masked")).otherwise(0).cast("bigint").alias("candidates"),
    )


def top_unseen(held: DataFrame, seen: DataFrame, ranked: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """sample_id, user_id, split, place, item_id: the k most popular candidates of each warm target.

    Of the k + |seen| first global ranks, those of seen items are taken out in the target's row (a user has one target a
    split); only the k that are left become rows, and their items come by the rank.
    """
    g = ranked.select("item_id", "g")
    own = seen.join(g, "item_id").groupBy("user_id", "split").agg(F.collect_set("g").alias("masked"))
    met = held.where("warm").select("sample_id", "user_id", "split", "item_id").join(g, "item_id").join(own, ["user_id", "split"], "left")
    # the target itself stays a candidate, seen or not
    masked = F.array_remove(F.coalesce("masked", F.array().cast("array<bigint>")), F.col("g"))
    first = F.slice(F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint") + F.size("masked")), "masked"), 1, k)
    placed = met.withColumn("masked", masked).select("sample_id", "user_id", "split", F.posexplode(first).alias("i", "g"))
    return placed.join(g, "g").select("sample_id", "user_id", "split", (F.col("i") + 1).cast("bigint").alias("place"), "item_id")


def rank_metrics(ranked: DataFrame) -> DataFrame:
    """For each split: targets, warm, coverage, and six metrics over the warm ones."""
    r = F.col("rank")
    term = lambda k, x: F.when(r <= k, x).otherwise(0.0)
    gain = 1 / F.log2(r + 1)
    mean = lambda x: F.round(F.sum(F.when(F.col("warm"), x)) / F.sum(F.when(F.col("warm"), 1)), 9)
    return ranked.groupBy("split").agg(
        F.count("*").alias("targets"),
        F.count_if("warm").alias("warm_targets"),
        F.round(F.count_if("warm") / F.count("*"), 9).alias("coverage"),
        mean(term(10, gain)).alias("ndcg_10"), mean(term(10, F.lit(1.0))).alias("hr_10"),
        mean(term(20, gain)).alias("ndcg_20"), mean(term(20, F.lit(1.0))).alias("hr_20"),
        mean(term(10, 1 / r)).alias("mrr_10"), mean(term(100, F.lit(1.0))).alias("recall_100"),
    )


def best_by_score(scores: DataFrame, key: str, k: int | None) -> DataFrame:
    """The k best rows of each key by (-score, item_id), ranked; all rows where k is None."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "item_id"))
    ranked = scores.withColumn("rank", rank.cast("bigint"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def top_margin(ranked: DataFrame, key: str) -> DataFrame:
    """Difference of the first two scores of each key; null for one candidate."""
    w = Window.partitionBy(key).orderBy("rank")
    return ranked.withColumn("margin", F.round(F.col("score") - F.lead("score").over(w), 12)).where("rank = 1").select(key, "margin")
