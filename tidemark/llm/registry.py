"""The thirteen corpus queries over the whole of their tables, and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import oracles
from tidemark.session import shared_dir, table

#: Mixing: a domain for each source family, languages by weight, sources alike.
MIX_WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1} | {
    (f"domain{d}", lang): w for d in range(4) for lang, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 1))
}


def mix_levels() -> dict:
    number = F.coalesce(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("domain"), (number % 4).cast("string")), "language": F.col("lang"), "source_name": F.col("source")}


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labels table: 0 rejected, 1 accepted but toxic, 2 accepted and clean."""
    return labels.select("doc_id", F.expr("case when quality = 0 then 0 when toxic = 1 then 1 else 2 end").alias("grade"))


def toxic_labels(labels: DataFrame) -> DataFrame:
    """The chain's categories: low-grade writing first, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("junk"), F.col("toxic").alias("toxic"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import digest, judge

    return digest(judge(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import predict

    got = predict(table(spark, sf_dir, "documents"), toxic_labels(table(spark, sf_dir, "labels")), ["junk", "toxic"])
    return got.select("doc_id", "p_junk", "p_toxic", F.col("is_toxic").alias("toxic"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), grades(table(spark, sf_dir, "labels")))


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.search import search

    return search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.runs import digest, find_runs, repeat_tail

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    return digest(find_runs(docs, rewrite=repeat_tail, given=("h",)))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.infill import digest, infill

    return digest(infill(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import token_files

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.digest(token_files.read(spark, path, as_bytes=True))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
