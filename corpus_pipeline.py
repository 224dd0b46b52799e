"""The corpus pipeline: quality, near duplicates, decontamination, secrets, mixing; each stage on all that the one before kept.

Defined results of every stage: an empty table gives an empty table; other columns, whatever their names, come back as they
were (the last stage returns the mix instead); null ids are ids like others. See each stage for texts, ties and repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import registry
from tidemark.llm.decontaminate import clean
from tidemark.llm.mixing import mix
from tidemark.llm.neardup import keep_one
from tidemark.llm.quality import keep_good
from tidemark.llm.secrets import redact
from tidemark.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being accepted by the raters is one half at least.

    A null text is judged as an empty one. Repeated rows are judged alike, so all stay or go; ties at one half stay. Without
    a usable label everything stays.
    """
    return keep_good(docs, registry.grades(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id.

    Null and empty texts are one class. Of rows that agree in id one stays, by the least text key, then the least row; null
    ids come last. Texts of any length are compared whole.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark windows.

    A document without words stays, null texts too; an item without words contaminates nothing; repeated rows go together.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials replaced in their texts; widely copied examples stay.

    Null texts stay null; repeated rows change alike, and count as one repository and owner where these agree.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken.

    Documents without tokens (null, empty, blank) are never taken. Rows that share an id go by their texts' digests; equal rows
    are taken one by one as far as the budget reaches.
    """
    return mix(docs, registry.mix_levels(), registry.MIX_WEIGHTS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: SQL cannot express the classifier and the signatures; tests/llm compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
