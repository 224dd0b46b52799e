"""Exact BM25 top-k search: an inverted index by shard, block-max pruning, and an exact merge.

Index. Each shard (a run of documents of one task, bounded in postings) holds its terms as sorted hashes, and for each
term its postings in document order. Documents of a shard are put in order of their most frequent term and length, so
that blocks of 64 documents are alike; for each term and block the greatest impact is known (block-max).

Statistics are global: document count, mean length and each query term's document frequency are summed over all shards
before any score is made; so a shard's scores are final, and merging the shards' best k is exact.

Search (block-max WAND at the grain of blocks). The block maxima of a query's terms add up to a bound for every block.
Each query has a threshold, the k-th best score that it has so far, and a cursor: its pivot, the next block whose bound
reaches the threshold; blocks before it are skipped unread by that query. The least pivot of all queries is the block
that is read next, for the queries whose pivot it is and no others; their thresholds rise and their cursors move on to
their next pivots. The four most promising blocks of a query are read first, so that its threshold is high from the
start, and it is carried from shard to shard within a task. Scores of a block are made in single precision, frequent
terms by a matrix product and the others from their postings; documents that can still be among the best k, given the
rounding error, are scored again in double precision, and only those scores count. ``Shard.read`` and ``Shard.pairs``
count what was read, of how many (query, block) pairs there were.

Queries come in blocks of bounded size; each block is broadcast alone and runs against all shards.

Words are runs of letters, digits and non-ASCII, in lower case. A document is no hit of its own query (same doc_id);
only scores above 0 are hits; equal scores (at nine decimals) are in order of doc_id, nulls last.

Defined results: a null or empty text is indexed with length 0 and never a hit, and as a query it has none; repeated
rows are hits each; each distinct text of a query id is searched, with ranks of its own; an empty table gives no rows;
other columns, whatever their names and types, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.blocks import U64, blocks, mix, spread, words
from tidemark.session import cut

K1, B = 1.2, 0.75
BLOCK = 64
#: Bounds of a shard (documents, postings) and of a broadcast block of queries (queries, terms).
SHARD_DOCS, SHARD_POSTINGS = 16_384, 3_000_000
QUERIES, QUERY_TERMS = 4_096, 2_000_000
#: Queries scored together; a term in this share of a shard's documents goes by matrix product; relative slack for single precision.
BATCH, FREQUENT, SLACK = 64, 0.02, 1e-4
_INDEX = "doc_id binary, null_id binary, length binary, term binary, term_ptr binary, post_doc binary, post_tf binary, n_docs long, n_words long"


def term_counts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count, words of each row) of a block, sorted by row and term."""
    h, _, _, woff = words(raw, off, True)
    n = np.diff(woff)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort([h, row])
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.empty(0, np.int64)
    return row[new], h[new], np.diff(np.append(new, len(h))), n


class _Building:
    def __init__(self):
        self.ids, self.nulls, self.lengths, self.rows, self.terms, self.counts, self.docs, self.size = [], [], [], [], [], [], 0, 0

    def add(self, part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray) -> None:
        row, term, count, n = term_counts(raw, off)
        ids = part.column(0)
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
        self.lengths.append(n)
        self.rows.append(row + self.docs)
        self.terms.append(term)
        self.counts.append(count)
        self.docs += len(n)
        self.size += len(row)

    def shard(self) -> pa.RecordBatch:
        ids, nulls, length = np.concatenate(self.ids), np.concatenate(self.nulls), np.concatenate(self.lengths)
        row, term, count = np.concatenate(self.rows), np.concatenate(self.terms), np.concatenate(self.counts)
        top = np.zeros(len(ids), U64)  # the most frequent term of each document
        order = np.lexsort([term, count, row])
        last = order[np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True))] if len(order) else order
        top[row[last]] = term[last]
        place = np.lexsort([length, top])
        number = np.empty(len(ids), np.int64)
        number[place] = np.arange(len(ids))
        doc = number[row]
        order = np.lexsort([doc, term])
        doc, term, count = doc[order], term[order], count[order]
        new_term = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.empty(0, bool)
        values = [
            ids[place], nulls[place], length[place].astype(np.int32), term[new_term], np.append(np.flatnonzero(new_term), len(term)).astype(np.int64),
            doc.astype(np.uint16 if len(ids) <= 1 << 16 else np.int32), count.astype(np.uint16 if count.max(initial=0) < 1 << 16 else np.int32),
        ]
        names = ["doc_id", "null_id", "length", "term", "term_ptr", "post_doc", "post_tf", "n_docs", "n_words"]
        return pa.RecordBatch.from_arrays([*(pa.array([v.tobytes()], pa.binary()) for v in values), pa.array([len(ids)]), pa.array([int(length.sum())])], names=names)


def _build(batches: Iterator[pa.RecordBatch], shard_docs: int, shard_postings: int) -> Iterator[pa.RecordBatch]:
    now = _Building()
    for part, raw, off in blocks(batches):
        if now.docs and (now.docs + part.num_rows > shard_docs or now.size > shard_postings):
            yield now.shard()
            now = _Building()
        now.add(part, raw, off)
    if now.docs:
        yield now.shard()


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The index as a table, a row for each shard; every document is in it."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(source.mapInArrow(lambda it: _build(it, shard_docs, shard_postings), _INDEX), "index")


def _ints(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.int32)


class Shard:
    """One shard, reduced to the terms of a block of queries (``vocabulary``, sorted)."""

    def __init__(self, row: dict, vocabulary: np.ndarray, mean_length: float):
        self.doc_id, self.null_id, length = np.frombuffer(row["doc_id"], np.int64), np.frombuffer(row["null_id"], bool), np.frombuffer(row["length"], np.int32)
        term, ptr = np.frombuffer(row["term"], U64), np.frombuffer(row["term_ptr"], np.int64)
        docs, tfs = _ints(row["post_doc"], ptr[-1]), _ints(row["post_tf"], ptr[-1])
        self.sorted_id = np.sort(self.doc_id)
        self.n, self.blocks = len(self.doc_id), -(-len(self.doc_id) // BLOCK)
        at = np.minimum(np.searchsorted(term, vocabulary), max(0, len(term) - 1))
        have = np.flatnonzero(term[at] == vocabulary) if len(term) else np.empty(0, np.int64)
        at = at[have]
        size = ptr[at + 1] - ptr[at]
        index = np.repeat(ptr[at], size) + spread(size)
        self.doc, tf = docs[index].astype(np.int32), tfs[index].astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / mean_length))[self.doc])
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self.place = np.full(len(vocabulary), -1, np.int32)  # of a query term among the shard's
        self.place[have] = np.arange(len(have))
        term_of = np.repeat(np.arange(len(have), dtype=np.int32), size)
        block = self.doc // BLOCK
        entry = np.flatnonzero(np.concatenate([[True], (term_of[1:] != term_of[:-1]) | (block[1:] != block[:-1])])) if len(index) else np.empty(0, np.int64)
        top = np.maximum.reduceat(self.impact, entry) if len(entry) else np.empty(0)
        self.entry_ptr, self.entry_block, self.entry_top, self.entry_start = np.searchsorted(entry, self.ptr), block[entry], top, entry
        self.read = self.pairs = 0
        often = np.flatnonzero(size >= max(8, FREQUENT * self.n))
        self.column = np.full(len(have), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        self.dense_top = np.zeros((self.blocks, len(often)), np.float32)
        column = self.column[term_of]
        self.dense[self.doc[column >= 0], column[column >= 0]] = self.impact[column >= 0]
        e = self.column[term_of[entry]]
        self.dense_top[self.entry_block[e >= 0], e[e >= 0]] = top[e >= 0]
        # documents' own terms, for exact scores
        order = np.argsort(self.doc.astype(np.uint16) if self.n <= 1 << 16 else self.doc, kind="stable")
        self.own_term, self.own_impact = term_of[order], self.impact[order]
        self.own_ptr = np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def _rare(self, terms: np.ndarray, weights: np.ndarray, ptr: np.ndarray, where: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        n = ptr[terms + 1] - ptr[terms]
        index = np.repeat(ptr[terms], n) + spread(n)
        return np.bincount(where[index], np.repeat(weights, n) * value[index], size)

    def _entries(self, rare: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(block offsets, query, weight, first posting, end) of the queries' infrequent terms, in order of their blocks."""
        size = [self.entry_ptr[t + 1] - self.entry_ptr[t] for t, _ in rare]
        query = np.repeat(np.arange(len(rare)), [int(n.sum()) for n in size])
        term = np.concatenate([np.repeat(t, n) for (t, _), n in zip(rare, size, strict=True)])
        weight = np.concatenate([np.repeat(w, n) for (_, w), n in zip(rare, size, strict=True)])
        entry = np.concatenate([np.repeat(self.entry_ptr[t], n) + spread(n) for (t, _), n in zip(rare, size, strict=True)])
        order = np.argsort(self.entry_block[entry], kind="stable")
        query, weight, entry, term = query[order], weight[order], entry[order], term[order]
        end = np.where(entry + 1 < self.entry_ptr[term + 1], self.entry_start[np.minimum(entry + 1, len(self.entry_start) - 1)], self.ptr[term + 1]) if len(entry) else entry
        return np.searchsorted(self.entry_block[entry], np.arange(self.blocks + 1)), query, weight, self.entry_start[entry], end

    def _score(self, b: int, asking: np.ndarray, w: np.ndarray, rare: tuple[np.ndarray, ...], local: np.ndarray) -> np.ndarray:
        """Scores of block b's documents for the queries that ask for it."""
        part = w[asking] @ self.dense[b * BLOCK : (b + 1) * BLOCK].T
        ptr, query, weight, start, end = rare
        own = slice(ptr[b], ptr[b + 1])
        local[asking] = np.arange(len(asking))
        place = local[query[own]]
        local[asking] = -1
        mine = np.flatnonzero(place >= 0)
        if len(mine):
            place, weight, start, n = place[mine], weight[own][mine], start[own][mine], (end[own] - start[own])[mine]
            at = np.repeat(start, n) + spread(n)
            cell = np.repeat(place * BLOCK, n) + (self.doc[at] - b * BLOCK)
            part += np.bincount(cell, np.repeat(weight, n) * self.impact[at], part.size).reshape(part.shape).astype(np.float32)
        return part

    def search(self, batch: list, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, documents) for each (own id, terms, weights) of the batch that can be among its best k, given thresholds."""
        m, h = len(batch), self.dense.shape[1]
        # rows of the queries themselves are no hits: the k-th best stands so many places further down
        owns = np.array([own for own, _, _ in batch])
        k = k + int((np.searchsorted(self.sorted_id, owns, "right") - np.searchsorted(self.sorted_id, owns, "left")).max(initial=0))
        w, rare = np.zeros((m, h), np.float32), []
        for q, (_, terms, weights) in enumerate(batch):
            column = self.column[terms]
            w[q, column[column >= 0]] = weights[column >= 0]
            rare.append((terms[column < 0], weights[column < 0]))
        bound = (w @ self.dense_top.T).astype(np.float64)
        for q, (terms, weights) in enumerate(rare):
            bound[q] += self._rare(terms, weights, self.entry_ptr, self.entry_block, self.entry_top, self.blocks)
        bound *= 1 + SLACK
        score = np.zeros((m, self.blocks * BLOCK), np.float32)
        top = np.zeros((m, k), np.float32)  # the best k scores that each query has
        least, local, entries = least.copy(), np.full(m, -1), self._entries(rare)
        self.pairs += m * self.blocks

        def read(b: int, asking: np.ndarray) -> None:
            part = self._score(b, asking, w, entries, local)
            score[asking, b * BLOCK : (b + 1) * BLOCK] = part
            bound[asking, b] = -1
            better = part.max(axis=1) > top[asking].min(axis=1)
            if better.any():
                some = asking[better]
                top[some] = np.partition(np.hstack([top[some], part[better]]), part.shape[1], axis=1)[:, part.shape[1] :]
                least[some] = np.maximum(least[some], top[some].min(axis=1) * (1 - SLACK))
            self.read += len(asking)

        wants = lambda q, b: (bound[q, b] >= least[q]) & (bound[q, b] > 0)
        if self.blocks:
            first = np.argpartition(-bound, min(3, self.blocks - 1), axis=1)[:, :4]
            for b in np.unique(first).tolist():
                asking = np.flatnonzero((first == b).any(axis=1) & wants(slice(None), b))
                if len(asking):
                    read(b, asking)
        open_ = (bound >= least[:, None]) & (bound > 0)
        pivot = np.where(open_.any(axis=1), open_.argmax(axis=1), self.blocks) if self.blocks else np.zeros(m, np.int64)
        while self.blocks and (b := int(pivot.min())) < self.blocks:
            asking = np.flatnonzero(pivot == b)
            read(b, asking)
            ahead = (bound[asking, b + 1 :] >= least[asking, None]) & (bound[asking, b + 1 :] > 0)
            pivot[asking] = np.where(ahead.any(axis=1), b + 1 + ahead.argmax(axis=1), self.blocks) if ahead.shape[1] else self.blocks
        out = []
        full = np.zeros(len(self.column))
        for q, (own, terms, weights) in enumerate(batch):
            s = score[q]
            doc = np.flatnonzero((s > 0) & (s >= least[q] * (1 - SLACK)))
            doc = doc[doc < self.n]
            doc = doc[(self.doc_id[doc] != own) | self.null_id[doc]]
            full[terms] = weights
            n = self.own_ptr[doc + 1] - self.own_ptr[doc]
            index = np.repeat(self.own_ptr[doc], n) + spread(n)
            exact = np.bincount(np.repeat(np.arange(len(doc)), n), full[self.own_term[index]] * self.own_impact[index], len(doc))
            full[terms] = 0
            out.append((np.round(exact, 9), doc))
        return out


def _best(score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort([doc, null, -score])[:k]


def _search(batches: Iterator[pa.RecordBatch], block: dict, k: int, stats: dict) -> Iterator[pa.RecordBatch]:
    n = len(block["query_id"])
    best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, bool))] * n
    for part in batches:
        for i in range(part.num_rows):
            shard = Shard(part.slice(i, 1).to_pylist()[0], block["vocabulary"], stats["mean_length"])
            for at in range(0, n, BATCH):
                group = block["order"][at : at + BATCH]
                queries, least = [], np.zeros(len(group))
                for j, q in enumerate(group):
                    term, weight = (block[c][block["ptr"][q] : block["ptr"][q + 1]] for c in ("term", "weight"))
                    place = shard.place[term]
                    queries.append((block["query_id"][q], place[place >= 0], weight[place >= 0]))
                    if len(best[q][0]) == k:
                        least[j] = best[q][0][-1]
                for q, (s, d) in zip(group, shard.search(queries, k, least), strict=True):
                    if len(s):
                        score, doc, null = best[q]
                        score, doc, null = np.concatenate([score, s]), np.concatenate([doc, shard.doc_id[d]]), np.concatenate([null, shard.null_id[d]])
                        keep = _best(score, doc, null, k)
                        best[q] = score[keep], doc[keep], null[keep]
    size = [len(s) for s, _, _ in best]
    if sum(size):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(block["query_id"], size)),
                pa.array(np.repeat(block["text_key"], size)),
                pa.array(np.concatenate([d for _, d, _ in best]), mask=np.concatenate([z for _, _, z in best])),
                pa.array(np.concatenate([s for s, _, _ in best])),
            ],
            names=["query_id", "text_key", "doc_id", "score"],
        )


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, raw, off in blocks(batches):
        row, term, count, _ = term_counts(raw, off)
        ptr = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [part.column("query_id"), part.column("text_key"), pa.ListArray.from_arrays(ptr, pa.array(term.astype(np.int64))), pa.ListArray.from_arrays(ptr, pa.array(count, pa.int64()))],
            names=["query_id", "text_key", "term", "count"],
        )


def _query_blocks(queries: DataFrame, most: int, most_terms: int) -> Iterator[dict]:
    """Blocks of queries, one at a time on the driver; their size is bounded."""
    rows, terms = [], 0
    for r in queries.orderBy("query_id", "text_key").toLocalIterator():
        rows.append(r)
        terms += len(r.term)
        if len(rows) >= most or terms >= most_terms:
            yield _packed(rows)
            rows, terms = [], 0
    if rows:
        yield _packed(rows)


def _packed(rows: list) -> dict:
    term = np.concatenate([np.asarray(r.term, np.int64) for r in rows]).view(U64)
    vocabulary, place = np.unique(term, return_inverse=True)
    top = [r.term[int(np.argmax(r["count"]))] if len(r.term) else 0 for r in rows]
    return {
        "order": np.lexsort([[len(r.term) for r in rows], top]),  # like queries together
        "query_id": np.array([r.query_id for r in rows], np.int64),
        "text_key": np.array([r.text_key for r in rows], np.int64),
        "ptr": np.cumsum([0, *(len(r.term) for r in rows)]),
        "vocabulary": vocabulary,
        "term": place,
        "count": np.concatenate([np.asarray(r["count"], np.float64) for r in rows]),
    }


def _frequency(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary), np.int64)
    for part in batches:
        for row in part.to_pylist():
            term, ptr = np.frombuffer(row["term"], U64), np.frombuffer(row["term_ptr"], np.int64)
            at = np.minimum(np.searchsorted(term, vocabulary), max(0, len(term) - 1))
            if len(term):
                have = term[at] == vocabulary
                at = at[have]
                total[have] += ptr[at + 1] - ptr[at]
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "df"])


def search(docs: DataFrame, is_query: Column, k: int = 10, queries_a_block: int = QUERIES, terms_a_block: int = QUERY_TERMS, **shards: int) -> DataFrame:
    """query_id, rank, doc_id, score: the best k documents for the text of every row of ``docs`` with ``is_query``, equal rows once."""
    spark = docs.sparkSession
    index = build_index(docs, **shards)
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    stats = {"mean_length": max(1.0, total.w / max(1, total.n))}
    chosen = docs.where(is_query).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("query_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    chosen = chosen.select("query_id", F.xxhash64("text").alias("text_key"), "text")
    chosen = cut(chosen.mapInArrow(_query_terms, "query_id long, text_key long, term array<long>, count array<long>"), "queries")
    hits = None
    for block in _query_blocks(chosen, queries_a_block, terms_a_block):
        vocabulary = spark.sparkContext.broadcast(block["vocabulary"])
        found = index.select("term", "term_ptr").mapInArrow(lambda it, v=vocabulary: _frequency(it, v.value), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(block["vocabulary"]))
        df[found.column("place").to_numpy()] = found.column("df").to_numpy()
        idf = np.log1p((total.n - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast({k_: v for k_, v in block.items() if k_ != "count"} | {"weight": block["count"] * idf[block["term"]]})
        part = index.mapInArrow(lambda it, s=shared: _search(it, s.value, k, stats), "query_id long, text_key long, doc_id long, score double")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = spark.createDataFrame([], "query_id long, text_key long, doc_id long, score double")
    order = Window.partitionBy("query_id", "text_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
