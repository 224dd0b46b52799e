"""What both repeat removers share: row keys, exact copies, content-chosen picks, and tie counting that survives hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import U64
from tidemark.llm.presence import bitmap, marked as maybe, possible
from tidemark.session import cut, drop

#: Low bits of an encoded pick that hold the position; the hash bits above decide.
_POSITION = U64((1 << 31) - 1)


#: What tells rows apart: the id (0 for null) and a hash of id and text. Rows that agree in both are equal rows.
ROW = ["i", "k"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), i and k (see ROW) and copy (digest of the text)."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("i", F.coalesce("doc_id", F.lit(0).cast("long")))
        .withColumn("k", F.xxhash64("doc_id", "text"))
        .withColumn("copy", F.md5("text"))
    )


def copies(source: DataFrame) -> DataFrame:
    """(i, k, n, spare) of every row whose text other rows have as well; all but one of a group are spare."""
    one = source.groupBy("copy", *ROW).agg(F.count("*").alias("m"))
    group = one.groupBy("copy").agg(F.sum("m").alias("n"), F.min(F.struct(*ROW)).alias("least")).where("n > 1")
    return one.join(group, "copy").select(*ROW, "n", (F.struct(*ROW) != F.col("least")).alias("spare"))


ENTRY = "h long, g long, i long, k long, pos array<int>"


def row_ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(part.schema.get_field_index(c)).to_numpy() for c in ROW)


def entries(h: np.ndarray, row: np.ndarray, ids: tuple[np.ndarray, np.ndarray], pos: np.ndarray, g: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each hash of each text, with all its positions: a text that repeats itself gives one row, not many.

    ``g`` is a second hash where equal hashes decide; 0 where they only nominate.
    """
    g = np.zeros(len(h), U64) if g is None else g
    order = np.lexsort([pos, g, h, row])
    h, g, row, pos = h[order], g[order], row[order], pos[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(h)), pa.int32()), pa.array(pos.astype(np.int32)))
    columns = [pa.array(h[new].astype(np.int64)), pa.array(g[new].astype(np.int64)), *(pa.array(x[row[new]]) for x in ids), lists]
    return pa.RecordBatch.from_arrays(columns, names=["h", "g", *ROW, "pos"])


def ties(found: DataFrame, spare: DataFrame | None = None) -> DataFrame:
    """(i, k, pos, n) of the entries whose hashes stand n > 1 times in all.

    Counting combines before the shuffle, and the way back is a join that splits a hot hash; no group is gathered.
    """
    if spare is not None:
        found = found.join(spare, ROW, "left_anti")
    often = found.groupBy("h", "g").agg(F.sum(F.size("pos")).alias("n")).where("n > 1")
    return found.join(often, ["h", "g"]).select(*ROW, "pos", "n")


def rare_ties(found: DataFrame, spare: DataFrame) -> DataFrame:
    """As ``ties``, where most entries stand alone: a bitmap tells which may be spare and which may be tied, only these are shuffled as rows."""
    told = maybe(found, bitmap(spare, *ROW), "spare", *ROW)
    own = told.where("not spare").drop("spare").unionByName(told.where("spare").drop("spare").join(spare, ROW, "left_anti"))
    often = cut(own.groupBy("h", "g").agg(F.sum(F.size("pos")).alias("n")).where("n > 1"), "often")
    return possible(own, often, "h", "g").join(often, ["h", "g"]).select(*ROW, "pos", "n")


def by_row(tied: DataFrame) -> DataFrame:
    """Rows with their tied positions (bounded by the length of one text)."""
    rest = [c for c in tied.columns if c not in ROW]
    return tied.groupBy(*ROW).agg(F.collect_list(F.struct(*rest)).alias("tied"))


def first_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the position of its least one (leftmost among equals)."""
    least = (h & ~_POSITION) | np.arange(len(h), dtype=U64)
    have = 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return (least & _POSITION).astype(np.int64)


def pick_runs(h: np.ndarray, gram: int, window: int, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pick, first window, last window): every window of every text is in the run of its pick.

    ``h`` are the hashes of all grams by start. A window's pick is its gram of least hash, a choice of content alone:
    equal windows have equal picks at equal places.
    """
    size = np.maximum(0, np.diff(off) - window + 1)
    total = int(size.sum())
    if not total:
        none = np.empty(0, np.int64)
        return none, none, none, none
    row = np.repeat(np.arange(len(size)), size)
    start = np.repeat(off[:-1] - np.cumsum(size) + size, size) + np.arange(total)
    pick = first_minima(h, window - gram + 1)[start]
    new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])]))
    return row[new], pick[new], start[new], start[np.append(new[1:], total) - 1]


def marked(part: pa.RecordBatch, off: np.ndarray, n: int) -> np.ndarray:
    """Tie count by position of the block, from the rows' ``tied`` lists."""
    tied = part.column(part.schema.get_field_index("tied"))
    flat = tied.flatten()
    lists, count = flat.field(0), flat.field(1).to_numpy()
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(part.num_rows), np.diff(tied.offsets.to_numpy()))
    out = np.zeros(n, np.int64)
    out[lists.flatten().to_numpy() + np.repeat(off[:-1][row], size)] = np.repeat(count, size)
    return out


def union_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, end); touching ranges join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist(), strict=True))


def candidates(source: DataFrame, tied: DataFrame, name: str) -> DataFrame:
    """i, k, text, tied of the rows with ties, as a table: only these are read again, and few other texts are shuffled."""
    held = cut(tied, "tied")
    rows = cut(possible(source.select(*ROW, "text"), held, *ROW).join(by_row(held), ROW).dropDuplicates(ROW), name)
    drop(held)
    return rows
