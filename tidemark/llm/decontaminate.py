"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``width`` consecutive benchmark words (an item of fewer words is one shorter pattern). For each
pattern length there is one table set: a block-shift table over hashed blocks of two words, and suffix buckets that
list the patterns ending in a block. A scan pointer looks at the block that ends its window: a positive shift skips
positions that cannot start any pattern; at shift zero the bucket's patterns are compared word by word. Many pointers
(one for each stretch of a block of texts) move together, so that the scan is vectorised.

The benchmark is cut into pattern blocks of bounded size; each is broadcast alone and scans all documents, and the
partial hits are united by document. One block (the usual case) needs no shuffle.

Defined results: a null text has no words and is clean; an empty benchmark contaminates nothing; benchmark rows with a
null item_id or text are no items; rows repeated under one item_id count as one item; repeated documents are judged
each on their own; an empty table gives no rows; other columns, whatever their names and types, are ignored by
``decontaminate`` and returned as they are by ``clean``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import LOWER, U64, blocks, mix, spread, words
from tidemark.llm.presence import bitmap, marked
from tidemark.session import cut

WIDTH = 13
#: Benchmark words in one broadcast pattern block: about 60 MB of tables.
BLOCK_WORDS = 500_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
STRETCH = 256
TABLE_BITS = 20


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_ASCII_LOWER))


def _word_hashes(ws: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(ws).encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), True)[0]


def _block(h: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at word ``last``."""
    return mix(h[last] if size == 1 else h[last - 1] * U64(0x9FB21C651E98DF25) + h[last])


class Patterns:
    """Shift table and suffix buckets of all patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[str, ...], list[str]]):
        self.length, self.size = length, min(2, length)
        self.text = list(patterns)
        self.items = [patterns[p] for p in self.text]
        self.words = np.stack([_word_hashes(list(p)) for p in self.text])
        shift = np.full(1 << TABLE_BITS, length - self.size + 1, np.int32)
        for end in range(self.size - 1, length):
            at = (_block(self.words.T, np.array([end]), self.size)[0] >> U64(64 - TABLE_BITS)).astype(np.int64)
            np.minimum.at(shift, at, length - 1 - end)
        self.shift = shift
        suffix = _block(self.words.T, np.array([length - 1]), self.size)[0]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def scan(self, h: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, pattern) of every hash-equal occurrence inside one text of the block."""
        starts = np.maximum(0, np.diff(word_off) - self.length + 1)
        pieces = -(-starts // STRETCH)
        at = np.repeat(word_off[:-1], pieces) + spread(pieces) * STRETCH
        end = np.minimum(at + STRETCH, np.repeat(word_off[:-1] + starts, pieces))
        found = []
        while len(at):
            block = _block(h, at + self.length - 1, self.size)
            move = self.shift[(block >> U64(64 - TABLE_BITS)).astype(np.int64)]
            if len(zero := np.flatnonzero(move == 0)):
                lo, hi = np.searchsorted(self.suffix, block[zero], "left"), np.searchsorted(self.suffix, block[zero], "right")
                n = hi - lo
                pos, pat = np.repeat(at[zero], n), self.order[np.repeat(lo, n) + spread(n)]
                for k in range(self.length):  # word by word; most candidates fall at the first words
                    same = h[pos + k] == self.words[pat, k]
                    pos, pat = pos[same], pat[same]
                found.append((pos, pat))
            at = at + np.maximum(move, 1)
            live = at < end
            at, end = at[live], end[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([p for p, _ in found]), np.concatenate([p for _, p in found])


def build(items: list[tuple[str, str]], width: int) -> list[Patterns]:
    by_length: dict[int, dict[tuple[str, ...], list[str]]] = {}
    for item, text in items:
        ws = item_words(text)
        if not ws:
            continue
        n = min(width, len(ws))
        group = by_length.setdefault(n, {})
        for k in range(len(ws) - n + 1):
            names = group.setdefault(tuple(ws[k : k + n]), [])
            if not names or names[-1] != item:
                names.append(item)
    return [Patterns(n, group) for n, group in sorted(by_length.items())]


def _item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``block_words`` words (one item at least); one block in driver memory at a time."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i", "text")
    part: list[tuple[str, str]] = []
    held = 0
    for row in rows.toLocalIterator():
        n = len(item_words(row.text))
        if part and held + n > block_words:
            yield part
            part, held = [], 0
        part.append((row.i, row.text))
        held += n
    yield part


_OUT = "doc_id long, n_words long, hits array<struct<s:int,e:int>>, items array<string>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))]
)


def scan_batches(batches: Iterator[pa.RecordBatch], tables: list[Patterns]) -> Iterator[pa.RecordBatch]:
    """Per document: words, merged hit ranges (in words) and the items found."""
    for rows, raw, off in blocks(batches):
        h, start, end, woff = words(raw, off, True)
        hits: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for t in tables:
            for pos, pat in zip(*(x.tolist() for x in t.scan(h, woff)), strict=True):
                text = t.text[pat]  # direct comparison of the words themselves
                if all(LOWER[raw[start[pos + k] : end[pos + k]]].tobytes() == w.encode() for k, w in enumerate(text)):
                    doc = int(np.searchsorted(woff, pos, "right")) - 1
                    hits.setdefault(doc, []).append((int(pos - woff[doc]), int(pos - woff[doc]) + t.length))
                    items.setdefault(doc, set()).update(t.items[pat])
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0).cast(pa.int64()),
                pa.array(np.diff(woff), pa.int64()),
                pa.array([[{"s": s, "e": e} for s, e in merge(hits.get(d, []))] for d in range(n)], _ARROW.field(2).type),
                pa.array([sorted(items.get(d, ())) for d in range(n)], _ARROW.field(3).type),
            ],
            schema=_ARROW,
        )


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, hits (merged word ranges), items (sorted ids with occurring windows)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = next(pieces := _item_blocks(benchmark, block_words))
    second = next(pieces, None)
    if second is None:
        shared = spark.sparkContext.broadcast(build(first, width))
        return source.mapInArrow(lambda it: scan_batches(it, shared.value), _OUT)
    # Several pattern blocks: unite the sparse hits by row, not the texts. Rows that agree in id and text are equal rows.
    keyed = source.select("doc_id", "text", *_row_key())
    out = "i long, k long, hits array<struct<s:int,e:int>>, items array<string>"
    parts = []
    for part in itertools.chain([first, second], pieces):
        shared = spark.sparkContext.broadcast(build(part, width))
        parts.append(keyed.select("i", "k", "text").mapInArrow(lambda it, shared=shared: _sparse(it, shared.value), out))
    sparse = parts[0]
    for x in parts[1:]:
        sparse = sparse.unionByName(x)
    united = sparse.groupBy("i", "k").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")
    )
    counted = keyed.select("i", "k", "doc_id", "text").mapInArrow(_counted, "i long, k long, doc_id long, n_words long")
    merged = "aggregate(_hits, cast(array() as array<struct<s:int,e:int>>), (a, x) -> if(size(a) > 0 and x.s <= element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.e) as e))), concat(a, array(x))))"
    return counted.join(united, ["i", "k"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.expr(merged), F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias("hits"),
        F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def _row_key() -> list:
    """i and k: the id (0 for null) and a hash of id and text, which tell rows apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("k")]


def _sparse(batches: Iterator[pa.RecordBatch], tables: list[Patterns]) -> Iterator[pa.RecordBatch]:
    """(i, k, hits, items) of the rows with a hit."""
    for batch in batches:
        place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(2)], names=["at", "text"])
        for found in scan_batches(iter([place]), tables):
            some = np.flatnonzero(np.diff(found.column(3).offsets.to_numpy()) > 0)
            at = pa.array(found.column(0).to_numpy()[some])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), found.column(2).take(pa.array(some)), found.column(3).take(pa.array(some))], names=["i", "k", "hits", "items"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, off in blocks(batches):
        woff = words(raw, off, True)[3]
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(3)), pa.array(np.diff(woff), pa.int64())], names=["i", "k", "doc_id", "n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words), items."""
    n_hit = F.coalesce(F.expr("aggregate(hits, 0L, (a, x) -> a + (x.e - x.s))"), F.lit(0))
    return find(docs, benchmark, width, block_words).select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    With one pattern block the scan itself drops rows. With several, only rows that a bitmap of the contaminated ones'
    keys may hold are looked up.
    """
    spark = docs.sparkSession
    first = next(pieces := _item_blocks(benchmark, block_words))
    if next(pieces, None) is None:
        shared = spark.sparkContext.broadcast(build(first, width))
        return docs.mapInArrow(lambda it: _clean_batches(it, shared.value), docs.schema)
    # contamination is a matter of the text alone: judged once for each digest of a text
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    ids = cut(keyed.select("digest").distinct().withColumn("doc_id", F.monotonically_increasing_id()), "digests")
    once = keyed.select("digest", F.col("doc.text").alias("text")).dropDuplicates(["digest"]).join(ids, "digest")
    bad = decontaminate(once, benchmark, width, block_words).where("contaminated").join(ids, "doc_id").select("digest")
    bad = cut(bad, "contaminated")
    split = marked(keyed, bitmap(bad, "digest"), "doubt", "digest")
    return split.where("not doubt").select("doc.*").unionByName(split.where("doubt").join(bad, "digest", "left_anti").select("doc.*"))


def _clean_batches(batches: Iterator[pa.RecordBatch], tables: list[Patterns]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
        place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], names=["at", "text"])
        bad = np.zeros(batch.num_rows, bool)
        for found in scan_batches(iter([place]), tables):
            hits = found.column(2)
            spans = hits.flatten()
            total = np.concatenate([[0], np.cumsum(spans.field(1).to_numpy().astype(np.int64) - spans.field(0).to_numpy())])
            ptr = hits.offsets.to_numpy() - hits.offsets[0].as_py()
            n_hit = total[ptr[1:]] - total[ptr[:-1]]
            bad[found.column(0).to_numpy()] = (n_hit > 0) & (20 * n_hit >= found.column(1).to_numpy())
        yield batch.filter(pa.array(~bad))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], width: int = WIDTH) -> dict:
    """The contract by plain loops, for tests."""
    windows: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        ws = item_words(text)
        if item is not None and ws:
            n = min(width, len(ws))
            for k in range(len(ws) - n + 1):
                windows.setdefault(tuple(ws[k : k + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        ws, hit, found = item_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if (got := windows.get(tuple(ws[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(ws), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(ws))
    return out
