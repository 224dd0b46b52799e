"""Segments, features and semantic texts of items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def segment_meta(segments: DataFrame) -> DataFrame:
    """The tagged union as one interval: files start at 0 and last their duration, ranges are half-open."""
    start = F.when(F.col("kind") == "file", 0).otherwise(F.col("start_ms")).cast("bigint")
    end = F.when(F.col("kind") == "file", F.col("duration_ms")).otherwise(F.col("end_ms"))
    return segments.select("item_id", "segment_id", "sequence_index", start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms"))


def item_segment_index(items: DataFrame, segments: DataFrame) -> DataFrame:
    """item_id with its ordered segments; items without any stay, empty."""
    listed = segments.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("sequence_index", "segment_id"))).alias("s"))
    ids = F.array_join(F.col("s.segment_id"), ",")
    return items.join(listed, "item_id", "left").select("item_id", F.coalesce(ids, F.lit("")).alias("segments"), F.greatest(F.coalesce(F.size("s"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))


def segment_proxies(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("item_id")
    return segment_meta(segments).withColumn("segment_count", F.count("*").over(w)).select("item_id", "segment_id", "sequence_index", "duration_ms", "segment_count")


def segment_catalog(segments: DataFrame) -> DataFrame:
    """item_id with its segments in (start, end, id) order, which is not the sequence order."""
    listed = segment_meta(segments).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "segment_id"))).alias("s"))
    return listed.select("item_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["segment_id"], x["start_ms"], x["end_ms"])), ",").alias("catalog"))


def unique_texts(texts: DataFrame, text: str) -> DataFrame:
    """Distinct texts by hash, with how many rows have each: encoding follows this, not the rows."""
    return texts.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("text_sha256")).agg(F.count("*").alias("n"), F.min(F.char_length(text)).cast("bigint").alias("length"))


#: What Python's ``strip`` takes off; canonical composition makes none of these out of other characters, nor others out of them.
_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most code points that canonical composition makes one of.
_COMPOSED = 4


def normalize_texts(df: DataFrame, text: str, most: int) -> DataFrame:
    """(value, reason): NFC and trimmed; 'missing' if nothing is left, 'invalid' with control characters or over ``most`` code points.

    Whole texts are trimmed and measured here; Python composes those alone that hold more than ASCII and may come to ``most`` code
    points, so that what it holds does not grow with the texts.
    """
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    df = df.withColumn("_t", F.btrim(text, F.lit(_SPACE)))
    composed = nfc(F.when((F.char_length("_t") <= _COMPOSED * most) & F.col("_t").rlike("[^\\x00-\\x7f]"), F.col("_t")))
    # null for the others: ASCII as it is, longer ones over ``most`` in any form
    n = F.coalesce(composed, "_t")
    df = df.withColumn("_n", F.coalesce(n, F.lit("")))
    reason = F.when(F.col("_n") == "", "missing").when(F.col("_n").rlike("[\\x00-\\x1f\\x7f-\\x9f]") | (F.char_length("_n") > most), "invalid")
    return df.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), F.col("_n"))).drop("_n", "_t")


def map_attributes(df: DataFrame, json: str, mapping: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """Typed extraction without coercion: output -> (source key, type, required). A wrong type or a missing required
    key is named in ``problem``; a missing optional key is null."""
    v = F.try_parse_json(json)
    kinds = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN"}
    problems, columns = [], {}
    for out, (key, kind, required) in mapping.items():
        found = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        missing = found.isNull() | (found == "VOID")
        fits = found.startswith("DECIMAL") | found.isin("DOUBLE", "BIGINT") if kind == "number" else found == kinds[kind]
        columns[out] = F.when(fits, F.try_variant_get(v, f"$.{key}", kinds[kind].lower()))
        problems.append(F.when(missing, F.lit(f"{key} is missing") if required else F.lit(None)).when(~fits, F.lit(f"{key} is no {kind}")))
    return df.withColumns(columns).withColumn("problem", F.concat_ws("; ", *problems))
