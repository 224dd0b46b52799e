"""Line files in an exact order: a sorted sink with equal bytes for any partitioning, and sources with record numbers.

A large file is read by many tasks, as Spark splits it. Where a block of a file begins and which lines it has follow from
the scan; records are numbered by their place in the block and the counts of the blocks before it, so no task reads a
whole file. JSON lines need no shuffle for that. A quoted CSV field may hold line breaks, so there a line's place
between quotes is found first: the quotes of the blocks before decide for a block's first line, those of the lines
before for the rest; lines of a block meet in one task, and only records of several lines are gathered.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.session import cut
from tidemark.sources import shared

#: Lines of a file of the sorted sink.
FILE_LINES = 100_000


def write_ordered(df: DataFrame, order: list[Column], line: Column, path: str, lines: int = FILE_LINES) -> DataFrame:
    """Write one line a row in a total order, files of ``lines`` lines named by their place; (file, lines, sha256) of each.

    Names and bytes depend on the rows alone. Rows that are equal by ``order`` must give equal lines. A file that is there
    already must be equal, so a task that is tried again does no harm.
    """
    from tidemark.operators.sequences import global_order

    told = global_order(df.withColumn("_line", line), order, "lines", "_number")
    told = told.select(F.when(F.coalesce(F.contains("_line", F.lit("\n")), F.lit(True)), F.raise_error(F.lit("a line is null or holds a line break"))).otherwise(F.col("_line")).alias("line"), F.expr(f"(_number - 1) div {lines}").alias("file_no"), "_number")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("_number")
        data = "".join(f"{x}\n" for x in table.column("line").to_pylist()).encode()
        name = f"part-{table.column('file_no')[0].as_py():08d}.txt"
        shared.put(f"{path}/{name}", data)
        return pa.table({"file": [name], "lines": pa.array([table.num_rows], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

    return cut(told.groupBy("file_no").applyInArrow(one, "file string, lines long, sha256 string"), "files")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (its start), id (rising within a block) and value of every line; a carriage return at its end is no part of it."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
        F.regexp_replace("value", "\r$", "").alias("value"),
    )


def _before(blocks: DataFrame, count: str, name: str) -> DataFrame:
    """Blocks with the sum of ``count`` over the blocks of their file before them. As many rows as tasks."""
    w = Window.partitionBy("file").orderBy("block")
    return blocks.withColumn(name, F.sum(count).over(w) - F.col(count))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ordinal (from 1 in each file) and value of every line. Two scans, no shuffle of lines."""
    lines = _lines(spark, path)
    blocks = _before(lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first")), "n", "before")
    met = lines.join(F.broadcast(blocks), ["file", "block"])  # as many rows as the scan has splits
    value = F.when(F.col("id") - F.col("first") + F.col("before") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return met.select("file", (F.col("id") - F.col("first") + F.col("before") + 1).cast("bigint").alias("ordinal"), value.alias("value"))


def json_records(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Typed records with their line numbers. A blank line and one that is no record of the schema are errors that name file and line."""
    found = numbered_lines(spark, path).withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    where = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(", line "), F.col("ordinal"))
    whole = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    problem = F.when(F.trim("value") == "", F.concat(F.lit("a blank line: "), where)).when(whole.isNull(), F.concat(F.lit("no JSON object: "), where))
    for f in schema.fields:
        lost = F.col("record")[f.name].isNull() & whole[f.name].isNotNull()
        problem = problem.when(lost, F.concat(F.lit(f"{f.name} is not of its type: "), where))
    checked = found.withColumn("record", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("record")))
    return checked.select("file", "ordinal", "record.*")


def csv_records(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of CSV files with exactly this header, as strings, with the number of the record (the header is 1).

    Another header, and a record with more or fewer fields, are errors that name file and record. A field in quotes may hold
    line breaks and doubled quotes; a byte order mark is no part of the header.
    """
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("bigint")
    lines = _lines(spark, path).withColumn("quotes", quotes)
    blocks = _before(lines.groupBy("file", "block").agg(F.sum("quotes").alias("all_quotes")), "all_quotes", "open")
    in_block = Window.partitionBy("file", "block").orderBy("id")
    inside = (F.col("open") + F.sum("quotes").over(in_block) - F.col("quotes")) % 2 == 1  # the line begins between quotes
    placed = cut(lines.join(F.broadcast(blocks.select("file", "block", "open")), ["file", "block"]).withColumn("inside", inside), "csv-lines")
    starts = _before(placed.groupBy("file", "block").agg(F.count_if(~F.col("inside")).alias("n")), "n", "before")
    number = F.col("before") + F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(in_block)
    # whether a line goes on in the next is not known for the last line of a block: it is gathered
    goes_on = F.coalesce(F.lead("inside").over(in_block), F.lit(True))
    told = placed.join(F.broadcast(starts.select("file", "block", "before")), ["file", "block"]).withColumn("ordinal", number).withColumn("part", F.col("inside") | goes_on)
    alone = told.where(~F.col("part")).select("file", "ordinal", "value")
    several = told.where(F.col("part")).groupBy("file", "ordinal").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "id", "value")))["value"], "\n").alias("value"))
    records = alone.unionByName(several)
    where = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(", record "), F.col("ordinal"))
    clean = F.when(F.col("ordinal") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    # one field more than there should be: too few and too many both show in it
    wide = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns) + 1)])
    split = records.withColumn("value", clean).withColumn("r", F.from_csv("value", wide.simpleString()[7:-1].replace(":", " "), {"escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0000"}))
    fields = [F.col("r")[f"_{i}"] for i in range(len(columns))]
    wrong_head = F.array(*fields) != F.array(*[F.lit(c) for c in columns])
    odd = fields[-1].isNull() | F.col("r")[f"_{len(columns)}"].isNotNull()
    problem = F.when(odd, F.concat(F.lit(f"not {len(columns)} fields: "), where)).when((F.col("ordinal") == 1) & wrong_head, F.concat(F.lit("another header: "), where))
    checked = split.withColumn("r", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("r")))
    # every record is judged, the header too; then it goes
    return checked.where((F.col("ordinal") > 1) | F.col("r").isNull()).select("file", F.col("ordinal").cast("bigint").alias("ordinal"), *[f.alias(c) for f, c in zip(fields, columns, strict=True)])
