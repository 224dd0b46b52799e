"""Readers and writers of the domain's files: raw CSV, JSON lines, canonical JSON, verified bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark import constants as K
from tidemark.functions.scalar import parse_bool, parse_decimal, parse_int

EVENT = T.StructType(
    [
        T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("interaction_index", T.LongType()),
        T.StructField("occurred_at_ms", T.LongType()), T.StructField("interaction_type", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
    ]
)
ITEM = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("metadata", T.StringType())])
SEGMENT = T.StructType(
    [
        T.StructField("item_id", T.StringType()), T.StructField("segment_id", T.StringType()), T.StructField("sequence_index", T.LongType()),
        T.StructField("locator", T.StructType([T.StructField("kind", T.StringType()), T.StructField("media_ref", T.StringType()), T.StructField("duration_ms", T.LongType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])),
        T.StructField("metadata", T.StringType()),
    ]
)


def _text_schema(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def raw_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = K.RAW_COLUMNS) -> DataFrame:
    """Rows of a CSV with exactly this header, as strings, with the ordinal of the logical record (the header is 1).

    Records may span lines, so each file is one task; many files are read side by side, and ordinals are per file.
    """
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).option("mode", "FAILFAST")
    rows = read.schema(_text_schema(columns)).csv(path).withColumn("_file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    first = rows.groupBy("_file").agg(F.min("_id").alias("_first"))
    return rows.join(F.broadcast(first), "_file").withColumn("ordinal", F.col("_id") - F.col("_first") + 2).drop("_id", "_first", "_file")


def categories_csv(spark: SparkSession, path: str) -> DataFrame:
    return raw_csv(spark, path, K.CATEGORY_COLUMNS).withColumn("category_level", parse_int(F.col("category_level"), True))


def typed_interactions(raw: DataFrame) -> DataFrame:
    """Raw strings parsed; ``problem`` names the first field that does not parse."""
    typed = {
        **{c: parse_int(F.col(c), True) for c in ("exposed_time", "category_level")}, "author_fans_count": parse_int(F.col("author_fans_count")),
        "watch_time": parse_decimal(F.col("watch_time")), "duration": parse_decimal(F.col("duration"), True), **{c: parse_bool(F.col(c)) for c in K.FEEDBACK},
    }
    blank = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in ("user_id", "pid", "author_id", "category_id", "parent_id", "root_id")]
    problem = F.coalesce(*blank, *[F.when(v.isNull(), F.lit(c)) for c, v in typed.items()])
    return raw.withColumn("problem", problem).withColumns(typed)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed records, one a line; a broken line is an error. Open parts stay JSON text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def blank_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") == "")


def canonical_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON line a row: sorted keys, nulls kept."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def not_canonical(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that decoding and encoding again does not give back."""
    fields = T.StructType(sorted(schema.fields, key=lambda f: f.name))
    lines = spark.read.text(path)
    again = F.to_json(F.from_json("value", fields), {"ignoreNullFields": "false"})
    return lines.where(~again.eqNullSafe(F.col("value")))


def write_json_lines(df: DataFrame, path: str) -> None:
    canonical_lines(df).write.mode("errorifexists").text(path)


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file under a path, made on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def unverified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, extra, or of another size or hash than a manifest (name, size_bytes, sha256) says."""
    e = expected.select("name", F.col("size_bytes").alias("e_size"), F.col("sha256").alias("e_sha"))
    both = found.join(e, "name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("e_sha").isNull(), "extra").when(F.col("size_bytes") != F.col("e_size"), "size").when(F.col("sha256") != F.col("e_sha"), "sha256")
    return both.withColumn("problem", problem).where("problem is not null").select("name", "problem")
