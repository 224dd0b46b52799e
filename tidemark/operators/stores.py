"""Keyed stores: records filed by the hash of their identity, looked up by the partitions that their keys name.

A record's identity hash is the SHA-256 of its canonical key; its first two digits are the fan-out, the folder that it lies
in. A store is a table partitioned by fan-out and sorted by hash inside, so that a lookup reads the folders of its own
keys' hashes (256 at most, so the list is bounded) and in them the row groups whose range of hashes holds them.

A release has an inventory of references (store, key, checksum). The resolver gives the records that are asked for and
refuses what the inventory does not have, and what the store has otherwise than the inventory says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.scalar import canonical_json

FAN_OUT = 2


def identity_hash(**key: Column) -> Column:
    return F.sha2(canonical_json(**key), 256)


def file_key(kind: str, identity: Column, suffix: str = "json") -> Column:
    """Where a record would lie as a file of its own: kind/ab/abcdef...suffix."""
    return F.concat(F.lit(f"{kind}/"), F.substring(identity, 1, FAN_OUT), F.lit("/"), identity, F.lit(f".{suffix}"))


def checksum(df: DataFrame, columns: list[str]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(**{c: df[c] for c in columns}), 256))


def write_store(records: DataFrame, path: str, key: list[str]) -> None:
    """Save records under ``path`` by fan-out. Two records of one identity are for ``duplicates`` to find before."""
    filed = records.withColumn("identity", identity_hash(**{c: F.col(c) for c in key})).withColumn("checksum", checksum(records, records.columns))
    filed = filed.withColumn("fan_out", F.substring("identity", 1, FAN_OUT))
    # a fan-out is split among tasks by the next digit, so that 256 folders do not bound the writers
    filed.repartition("fan_out", F.substring("identity", FAN_OUT + 1, 1)).sortWithinPartitions("fan_out", "identity").write.partitionBy("fan_out").parquet(path)


def inventory(spark: SparkSession, path: str, store: str) -> DataFrame:
    """store, identity, checksum of all records: a release keeps it as a table."""
    return spark.read.parquet(path).select(F.lit(store).alias("store"), "identity", "checksum")


def narrowed(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The store's rows in the folders that the wanted identities name; the list of folders is 256 long at most."""
    folders = [r[0] for r in wanted.select(F.substring("identity", 1, FAN_OUT)).distinct().limit(16**FAN_OUT + 1).collect() if r[0] is not None]
    # as text: the folders' names are not numbers, even where they look like ones
    return spark.read.option("inferSchema", False).schema(_schema(spark, path)).parquet(path).where(F.col("fan_out").isin(folders))


def _schema(spark: SparkSession, path: str):
    from pyspark.sql import types as T

    found = spark.read.parquet(path).schema
    return T.StructType([T.StructField(f.name, T.StringType() if f.name == "fan_out" else f.dataType) for f in found.fields])


def resolve(spark: SparkSession, path: str, store: str, wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """Each wanted (identity) with its record, or with ``refused``: not in the inventory, not in the store, or changed.

    ``listed`` is the inventory of the release. Equal wishes are answered once each.
    """
    asked = wanted.select("identity").distinct()
    mine = listed.where(F.col("store") == store).select("identity", F.col("checksum").alias("listed"))
    held = narrowed(spark, path, asked).drop("fan_out")
    held = held.withColumn("record", F.struct(*[c for c in held.columns if c not in ("identity", "checksum")])).withColumn("found", checksum(held, [c for c in held.columns if c not in ("identity", "checksum")]))
    met = asked.join(mine, "identity", "left").join(held.select("identity", "record", "found"), "identity", "left")
    refused = F.when(F.col("listed").isNull(), "not in the inventory").when(F.col("found").isNull(), "not in the store").when(F.col("found") != F.col("listed"), "changed since the release")
    return met.select("identity", refused.alias("refused"), F.when(refused.isNull(), F.col("record")).alias("record"))
