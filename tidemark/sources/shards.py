"""Shards of little-endian 32-bit floats, named by their SHA-256, read by address.

A record is a vector or a matrix: its floats lie in one shard, behind those of the record before it in key order. Where a
record lies follows from sums over the records before it, made from range partitions and totals of the ranges; a shard
is packed by the task that holds its records, and its size is bounded. As a shard's name is its content, publishing
the same records again writes nothing, and bundles that share records share shards. A reader opens only the shards
that it is asked for, in the tasks of the rows that ask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.sources import shared

#: Vectors a shard, and floats a shard of matrices (a shard may end one matrix later).
SHARD_ROWS, SHARD_FLOATS = 4096, 1 << 22
FOLDER = "embedding-shards"


def running_total(df: DataFrame, order: list[Column], size: str, name: str, before: str) -> DataFrame:
    """``before``: the sum of ``size`` over all rows before a row in a total order, as a written table; no task sees all rows."""
    from tidemark.session import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_total"))
    base = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_base"))
    own = F.sum(size).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    # as many rows as shuffle partitions
    return ranged.join(F.broadcast(base), "_range").withColumn(before, (own + F.col("_base")).cast("bigint")).drop("_range", "_base")


def _pack(records: DataFrame, root: str) -> DataFrame:
    """(shard_no, shard, floats, created) from (shard_no, place, floats): each shard is written by the task of its rows, once the same for every try."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        flat = table.column("values").combine_chunks().flatten()
        data = flat.to_numpy(zero_copy_only=False).astype("<f4")
        if flat.null_count or not np.isfinite(data).all():
            raise ValueError("a record holds a null, NaN or infinite number")
        payload = data.tobytes()
        digest = hashlib.sha256(payload).hexdigest()
        created = shared.put(f"{root}/{FOLDER}/{digest}.f32", payload)
        return pa.table({"shard_no": table.column("shard_no").slice(0, 1), "shard": [digest], "floats": pa.array([len(data)], pa.int64()), "created": [created]})

    return records.select("shard_no", "place", F.col("values").cast("array<float>").alias("values")).groupBy("shard_no").applyInArrow(one, "shard_no long, shard string, floats long, created boolean")


def _checked(df: DataFrame, wrong: Column, message: str, column: str) -> DataFrame:
    return df.withColumn(column, F.when(wrong, F.raise_error(F.lit(message))).otherwise(F.col(column)))


def write_vectors(vectors: DataFrame, root: str, width: int, rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(index, shards) of (key, vector): index has key, shard, row_index, float_offset, count; shards has shard_no, shard, floats, created.

    The global position of a key decides: shard position div ``rows``, row position mod ``rows``. Keys are unique.
    """
    from tidemark.operators.sequences import global_order
    from tidemark.session import cut

    sized = _checked(vectors.select("key", "vector"), F.coalesce(F.size("vector") != width, F.lit(True)), f"a vector is not of width {width}", "vector")
    placed = global_order(sized, [F.col("key")], "vectors", "number").select("key", F.col("vector").alias("values"), F.expr(f"(number - 1) div {rows}").alias("shard_no"), ((F.col("number") - 1) % rows).alias("place"))
    shards = cut(_pack(placed, root), "shards")
    index = placed.drop("values").join(shards, "shard_no").select("key", "shard_no", "shard", F.col("place").alias("row_index"), (F.col("place") * width).alias("float_offset"), F.lit(width).cast("bigint").alias("count"))
    return index, shards


def write_matrices(matrices: DataFrame, root: str, floats: int = SHARD_FLOATS) -> tuple[DataFrame, DataFrame]:
    """(index, shards) of (key, matrix): row after row, matrix after matrix, in key order; index has n_rows and n_cols too.

    Records of no floats have no place and are left to the caller; rows of unequal length are an error.
    """
    from tidemark.session import cut

    cols = F.size(F.element_at("matrix", 1))
    even = F.forall("matrix", lambda r: F.size(r) == cols)
    m = matrices.where(F.coalesce(F.size("matrix") > 0, F.lit(False))).where(cols > 0)
    m = _checked(m, ~F.coalesce(even, F.lit(False)), "rows of a matrix differ in length", "matrix")
    flat = m.select("key", F.flatten("matrix").alias("values"), F.size("matrix").cast("bigint").alias("n_rows"), cols.cast("bigint").alias("n_cols")).withColumn("count", F.col("n_rows") * F.col("n_cols"))
    placed = running_total(flat, [F.col("key")], "count", "matrices", "place").withColumn("shard_no", F.expr(f"place div {floats}"))
    shards = cut(_pack(placed, root), "shards")
    first = placed.groupBy("shard_no").agg(F.min("place").alias("first"))
    index = placed.drop("values").join(first, "shard_no").join(shards.select("shard_no", "shard"), "shard_no")
    return index.select("key", "shard_no", "shard", F.col("place").alias("global_offset"), (F.col("place") - F.col("first")).alias("float_offset"), "n_rows", "n_cols", "count"), shards


def misplaced(index: DataFrame, shards: DataFrame) -> DataFrame:
    """Index rows that do not lie end to end in their shard: (key, problem). A shard's rows are a bounded group."""
    w = Window.partitionBy("shard_no", "shard").orderBy("float_offset", "key")
    met = index.join(shards.select("shard", F.col("floats").alias("_floats")).distinct(), "shard", "left")
    met = met.withColumn("_end", F.coalesce(F.lag(F.col("float_offset") + F.col("count")).over(w), F.lit(0))).withColumn("_last", F.lead("key").over(w).isNull())
    problem = (
        F.when(F.col("_floats").isNull(), "the shard is unknown").when(F.col("float_offset") < F.col("_end"), "it overlaps the record before").when(F.col("float_offset") > F.col("_end"), "a gap before it")
        .when(F.col("float_offset") + F.col("count") > F.col("_floats"), "it ends outside its shard").when(F.col("_last") & (F.col("float_offset") + F.col("count") < F.col("_floats")), "a gap behind it")
    )
    return met.select("key", problem.alias("problem")).where("problem is not null")


def read_floats(asked: DataFrame, root: str, unit: bool = False, verify: bool = True) -> DataFrame:
    """``asked`` (shard, float_offset, count and any others) with ``values``, in the tasks that hold the rows of a shard.

    ``verify`` reads a shard whole and checks that its name is its digest, once a task; else only the bytes asked for are
    read. A record outside its shard, one with NaN or infinity, and with ``unit`` one that is not of length 1 is an error.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*asked.schema.fields, T.StructField("values", T.ArrayType(T.FloatType()))])
    arrow, places = to_arrow_schema(schema), [asked.columns.index(c) for c in ("shard", "float_offset", "count")]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, total = None, None, 0
        for batch in batches:
            shard, start, count = (batch.column(i).to_pylist() for i in places)
            made = []
            for s, a, n in zip(shard, start, count, strict=True):
                uri = f"{root}/{FOLDER}/{s}.f32"
                if s != name:
                    name, total = s, shared.size(uri)
                    if total is None:
                        raise ValueError(f"the shard {s} is not there")
                    held = shared.read(uri) if verify else None
                    if verify and hashlib.sha256(held).hexdigest() != s:
                        raise ValueError(f"the shard {s} is not what its name says")
                if a < 0 or n < 0 or 4 * (a + n) > total:
                    raise ValueError(f"a record lies outside its shard {s}")
                if verify:
                    data = held[4 * a : 4 * (a + n)]
                else:
                    system, path = shared.at(uri)
                    with system.open_input_file(path) as f:
                        data = f.read_at(4 * n, 4 * a)
                x = np.frombuffer(data, "<f4")
                if not np.isfinite(x).all():
                    raise ValueError("a record holds NaN or infinity")
                if unit and abs(np.sqrt((x.astype(np.float64) ** 2).sum()) - 1) > 1e-5:
                    raise ValueError("a vector is not of length 1")
                made.append(x)
            sizes = np.cumsum([0, *map(len, made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(made) if made else np.empty(0, np.float32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema=arrow)

    near = asked.repartition("shard").sortWithinPartitions("shard", "float_offset")
    return near.mapInArrow(get, schema)
