"""Which rows can be among a set of keys: a bitmap of hashed keys, so that only rows that may match are shuffled.

The bitmap has a fixed number of bits whatever the number of keys, so its broadcast is bounded (4 MB). A row whose bit
is unset is surely not in the set; one whose bit is set may be, and a join on the keys themselves decides. Where keys
outnumber the bits, more rows pass and the joins read more; no result changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 25


def _place(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def bitmap(members: DataFrame, *keys: str, bits: int = BITS) -> DataFrame:
    """(bucket, bits) of the members' keys."""
    at = members.select(_place([F.col(k) for k in keys], bits).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def marked(rows: DataFrame, found: DataFrame, name: str, *keys: str, bits: int = BITS) -> DataFrame:
    """``rows`` with a boolean column ``name``: whether the bitmap has the row's keys. ``found`` is bounded by its bits."""
    at = _place([F.col(k) for k in keys], bits)
    placed = rows.withColumn(f"{name}_bucket", F.bitmap_bucket_number(at)).withColumn(f"{name}_bit", F.bitmap_bit_position(at))
    small = F.broadcast(found.select(F.col("bucket").alias(f"{name}_bucket"), F.col("bits").alias(f"{name}_bits")))
    byte = F.expr(f"cast(conv(hex(substring({name}_bits, cast({name}_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast({name}_bit % 8 as int))")) != 0
    return placed.join(small, f"{name}_bucket", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop(f"{name}_bucket", f"{name}_bit", f"{name}_bits")


def possible(rows: DataFrame, members: DataFrame, *keys: str, bits: int = BITS) -> DataFrame:
    """The rows that can have a match among ``members`` by ``keys``; no row with a match is lost."""
    return marked(rows, bitmap(members, *keys, bits=bits), "__possible", *keys, bits=bits).where("__possible").drop("__possible")
