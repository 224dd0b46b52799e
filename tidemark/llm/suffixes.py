"""Suffix-array dedup over bytes: blockwise suffix sorting with a difference cover.

Bytes covered by a string of ``window`` bytes that also starts elsewhere are removed. Beside that, bytes covered by a
string of ``passage`` bytes (250: fifty words of five bytes with their spaces) that also starts elsewhere are counted, not
removed. The suffixes that can matter are gathered bucket by bucket, and one bucket at a time is sorted in one task:

1. Buckets. Every string of ``passage`` bytes has a pick, its gram of least hash; equal strings have equal picks, so
   suffixes that share ``passage`` bytes (and so those that share ``window``) meet in one bucket. Picks that stand alone
   in the corpus drop out: no repeat can hold them. For each pick that is left, the bytes that ``window`` reaches over
   from its strings go to the bucket, filled up behind the end of a text.
2. Cover sample. In a bucket's bytes, positions whose residue modulo V (73) is in a perfect difference set are ranked
   before the sort: by their first V bytes, then by doubling (a sample position plus V is one again), up to 4 V bytes.
3. Sort. Suffixes are sorted by their first 16 bytes, then by ternary quicksort against pivots, all groups in step.
   Any two suffixes have a shift below V that takes both to sample positions; so a comparison reads at most V bytes,
   then looks up two ranks in place of the long common part, then reads the bytes behind the ranked part.
4. Suffixes that are equal over ``window`` bytes are neighbours, and so are those equal over ``passage``; they start the
   repeated strings. A filled suffix is no string of ``window`` bytes.

A bucket's memory is bounded: picks of more than ``hot`` places do not go to buckets; their strings of both lengths, from
every start, are counted by a digest of 128 bits instead, which combines before the shuffle. What repeats goes to the tasks
as a list where it is short, else by a join. All ways find the same strings. Exact copies of whole texts are told by digest first.

Defined results: a null text is empty; a text shorter than a window keeps all; windows never cross texts; repeated rows
are copies of each other; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import BYTE, U64, blocks, digests, prefix_hash, spread, window_hash
from tidemark.llm.repeats import ENTRY, ROW, by_row, candidates, copies, entries, keyed, marked, pick_runs, rare_ties, row_ids, union_of
from tidemark.session import cut, drop

WINDOW = 400
PASSAGE = 250
GRAM = 80
#: Bytes that a bucket is meant to hold.
BUCKET = 4 << 20
#: Places of one pick that a bucket takes: as many as fill it alone (a pick's strings reach over 485 bytes on average).
HOT = BUCKET // 485
#: Digests of repeated strings that are sent to every task (4 MB); more are joined.
FEW = 1 << 18

#: Perfect difference sets by modulus (every shift is the difference of one pair).
COVERS = {73: (1, 2, 4, 8, 16, 32, 37, 55, 64), 13: (0, 1, 3, 9)}
V = 73
#: A window must hold the longest shift, a ranked block, and 16 bytes for the first sort.
LEAST_WINDOW = 32


@functools.cache
def cover_for(depth: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(modulus, membership of each residue, the least shift that takes two residues into the cover) for windows of ``depth``."""
    if depth < LEAST_WINDOW:
        raise ValueError(f"a window of less than {LEAST_WINDOW} bytes")
    v = max(v for v in COVERS if 2 * v <= depth)
    inside = np.zeros(v, bool)
    inside[list(COVERS[v])] = True
    shift = np.array([[next(s for s in range(v) if inside[(a + s) % v] and inside[(b + s) % v]) for b in range(v)] for a in range(v)], np.int64)
    return v, inside, shift


def words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a big-endian number: compares like the bytes do. ``text`` ends in padding."""
    return np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text, strides=(1,))


def names(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by several keys, the first weighing most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


class Cover:
    """Ranks of the cover sample of a text, to as great a depth as fits a window behind the longest shift."""

    def __init__(self, text: np.ndarray, size: int, window: int):
        self.v, inside, self.shift = cover_for(window)
        doublings = 0
        while (self.v << (doublings + 1)) + self.v <= window:
            doublings += 1
        self.w, self.depth, self.window = words8(text), self.v << doublings, window
        sample = np.flatnonzero(np.tile(inside, size // self.v + 1)[:size])
        self.slot = np.zeros(len(text) + self.depth + self.v, np.int64)  # rank by position, 0 elsewhere
        rank = names([self.w[sample + o].astype(U64) for o in (*range(0, self.v - 8, 8), self.v - 8)]) if len(sample) else np.empty(0, np.int64)
        for d in range(doublings):
            self.slot[sample] = rank
            rank = names([rank, self.slot[sample + (self.v << d)]])
        self.slot[sample] = rank

    def compare(self, a: np.ndarray, b: np.ndarray, skip: int) -> np.ndarray:
        """-1, 0 or 1 for suffixes a against b over a window, of which the first ``skip`` bytes are known equal."""
        out = np.zeros(len(a), np.int8)
        shift = self.shift[a % self.v, b % self.v]
        open_ = np.arange(len(a))

        def settle(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal open_
            apart = x != y
            out[open_[apart]] = np.where(x[apart] < y[apart], -1, 1)
            open_ = open_[~apart]

        for o in range(skip, self.v - 1, 8):  # up to the shift; a word may reach beyond it, which is as good
            near = shift[open_] > o
            if not near.any():
                break
            p, q = a[open_] + o, b[open_] + o
            settle(np.where(near, self.w[p].astype(U64), U64(0)), np.where(near, self.w[q].astype(U64), U64(0)))
        settle(self.slot[a[open_] + shift[open_]], self.slot[b[open_] + shift[open_]])
        for o in range(self.depth, self.window, 8):  # behind the ranked part; the last word ends with the window
            at = np.minimum(shift[open_] + o, self.window - 8)
            settle(self.w[a[open_] + at].astype(U64), self.w[b[open_] + at].astype(U64))
        return out


def sort_bucket(text: np.ndarray, size: int, suffix: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, whether each equals its predecessor over a window). ``text`` is padded by V + 16 behind ``size``."""
    cover = Cover(text, size, window)
    one, two = cover.w[suffix].astype(U64), cover.w[suffix + 8].astype(U64)
    order = np.lexsort([two, one])
    suffix, one, two = suffix[order], one[order], two[order]
    new = np.ones(len(suffix), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    equal = np.zeros(len(suffix), bool)
    group = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(suffix))
    at = np.flatnonzero((np.diff(first) > 1)[group])  # places in order, of groups yet unsorted
    group = group[at]
    while len(at):
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        length = np.diff(np.append(start, len(at)))
        pivot = np.repeat(suffix[at[start + length // 2]], length)
        side = cover.compare(suffix[at], pivot, 16)
        key = np.repeat(np.arange(len(start)), length) * 3 + side + 1
        order = np.argsort(key, kind="stable")
        key, suffix[at] = key[order], suffix[at[order]]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        equal[at[same & (key % 3 == 1)]] = True
        lone = ~same & ~np.append(same[1:], False)
        going = (key % 3 != 1) & ~lone
        at, group = at[going], key[going]
    return suffix, equal


def equal_over(words: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` bytes from a and from b are equal."""
    open_ = np.arange(len(a))
    for o in range(0, width, 8):
        at = min(o, width - 8)
        open_ = open_[words[a[open_] + at] == words[b[open_] + at]]
    out = np.zeros(len(a), bool)
    out[open_] = True
    return out


def bucket_repeats(table: pa.Table, window: int, passage: int) -> pa.Table:
    """One bucket: sorts its suffixes and returns the starts of repeated strings as runs, by row (i, k, pos, n = run length, width).

    ``width`` is ``window`` or ``passage``. Equal byte runs from different places are laid into the bucket's text once: all
    their strings are repeated. The last ``fill`` bytes of a byte run are behind the end of its text.
    """
    first: dict[tuple[bytes, int], int] = {}
    whole, places, fills = (table.column(c).to_pylist() for c in ("bytes", "pos", "fill"))
    ids = [table.column(c).to_numpy() for c in ROW]
    own = np.array([first.setdefault(x, j) for j, x in enumerate(zip(whole, fills, strict=True))], np.int64)
    copies = np.bincount(own, [len(p) for p in places], len(whole)).astype(np.int64)
    one = np.flatnonzero(own == np.arange(len(whole)))
    size, fill = np.array([len(whole[j]) for j in one], np.int64), np.array([fills[j] for j in one], np.int64)
    count, off = size - window + 1, np.concatenate([[0], np.cumsum(size)])
    text = np.frombuffer(b"".join([*(whole[j] for j in one), bytes(V + 16)]), np.uint8)
    suffix = off[np.repeat(np.arange(len(one)), count)] + spread(count)
    ordered, equal = sort_bucket(text, int(off[-1]), suffix, window)
    near = equal.copy()
    rest = np.flatnonzero(~equal[1:]) + 1
    near[rest] = equal_over(words8(text), ordered[rest], ordered[rest - 1], passage)
    context = np.searchsorted(off, ordered, "right") - 1
    full = ordered + window <= off[context + 1] - fill[context]
    group = np.cumsum(~equal)
    found = {passage: near | np.append(near[1:], False), window: full & (np.bincount(group, full)[group] > 1)}
    again = [(j, x) for j in np.flatnonzero(copies[own] > 1).tolist() for x in places[j]]
    j, x = (np.array(v, np.int64) for v in zip(*again, strict=True)) if again else (np.empty(0, np.int64),) * 2
    out = []
    for width, hit in found.items():
        at = np.sort(ordered[hit])
        context = np.searchsorted(off, at, "right") - 1
        lone = copies[one[context]] == 1
        at, context = at[lone], context[lone]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (context[1:] != context[:-1])])) if len(at) else np.empty(0, np.int64)
        c = one[context[new]]
        length = np.array([len(w) - window + 1 - f * (width == window) for w, f in zip(whole, fills, strict=True)], np.int64)
        y, z = j[length[j] > 0], x[length[j] > 0]
        out.append(pa.table({
            **{name: pa.array(np.concatenate([v[c], v[y]])) for name, v in zip(ROW, ids, strict=True)},
            "pos": pa.array(np.concatenate([np.array([places[q][0] for q in c], np.int64) + at[new] - off[context[new]], z]).astype(np.int32)),
            "n": pa.array(np.concatenate([np.diff(np.append(new, len(at))), length[y]])),
            "width": pa.array(np.full(len(c) + len(y), width, np.int32)),
        }))
    return pa.concat_tables(out)


def pick_entries(batches: Iterator[pa.RecordBatch], passage: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part, raw, off in blocks(batches):
        if len(raw) < passage:
            continue
        h = window_hash(prefix_hash(BYTE[raw]), gram)
        row, pick, _, _ = pick_runs(h, gram, passage, off)
        yield entries(h[pick], row, row_ids(part), pick - off[row])


def contexts(batches: Iterator[pa.RecordBatch], window: int, passage: int, gram: int, hot: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For tied picks of at most ``hot`` places: the bytes that ``window`` reaches over from their strings, by bucket; once for a text that repeats them."""
    for part, raw, off in blocks(batches, limit=1 << 20):
        if len(raw) < passage:
            continue
        h = window_hash(prefix_hash(BYTE[raw]), gram)
        row, pick, first, last = pick_runs(h, gram, passage, off)
        n = marked(part, off, len(raw))[pick]
        ids = row_ids(part)
        seen: dict[tuple[int, bytes, int], tuple[int, list[int]]] = {}
        for j in np.flatnonzero((n > 0) & (n <= hot)).tolist():
            a, r = int(first[j]), int(row[j])
            fill = max(0, int(last[j]) + window - int(off[r + 1]))
            seen.setdefault((r, raw[a : int(last[j]) + window - fill].tobytes() + bytes(fill), fill), (int(h[pick[j]]) % buckets, []))[1].append(a - int(off[r]))
        rows = np.array([r for r, _, _ in seen], np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in seen.values()], pa.int32()), *(pa.array(x[rows], pa.int64()) for x in ids),
                pa.array([p for _, p in seen.values()], pa.list_(pa.int32())), pa.array([f for _, _, f in seen], pa.int32()), pa.array([x for _, x, _ in seen], pa.binary()),
            ],
            names=["bucket", *ROW, "pos", "fill", "bytes"],
        )


def hot_strings(batches: Iterator[pa.RecordBatch], width: int, passage: int, gram: int, hot: int) -> Iterator[pa.RecordBatch]:
    """For picks of more than ``hot`` places: a digest of each string of ``width`` bytes that starts where theirs do."""
    for part, raw, off in blocks(batches, limit=1 << 20):
        n = marked(part, off, len(raw))
        if len(raw) < width or n.max(initial=0) <= hot:
            continue
        row, pick, first, last = pick_runs(window_hash(prefix_hash(BYTE[raw]), gram), gram, passage, off)
        warm = np.flatnonzero(n[pick] > hot)
        size = np.maximum(0, np.minimum(last[warm], off[row[warm] + 1] - width) - first[warm] + 1)
        at, r = np.repeat(first[warm], size) + spread(size), np.repeat(row[warm], size)
        both = digests(raw, at, at + width)
        yield entries(both[:, 0], r, row_ids(part), at - off[r], both[:, 1])


RUN = "i long, k long, pos int, n long, width int"


def start_runs(batches: Iterator[pa.RecordBatch], width: int, known: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Starts by digest as runs of starts by row; of ``known`` digests only (pairs in order), where these are given."""
    for batch in batches:
        h, g, i, k = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("h", "g", *ROW))
        hit = np.ones(len(h), bool)
        if known is not None:
            pair = np.empty(len(h), known.dtype)
            pair["h"], pair["g"] = h, g
            hit = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair if len(known) else ~hit
        pos = batch.column(batch.schema.get_field_index("pos")).filter(pa.array(hit))
        size = pos.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        i, k, at = np.repeat(i[hit], size), np.repeat(k[hit], size), pos.flatten().to_numpy()
        order = np.lexsort([at, k, i])
        i, k, at = i[order], k[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i[new]), pa.array(k[new]), pa.array(at[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(at))).astype(np.int64)), pa.array(np.full(len(new), width, np.int32))],
            names=[*ROW, "pos", "n", "width"],
        )


def hot_repeats(strings: DataFrame, width: int, few: int = FEW) -> DataFrame:
    """Runs of the starts whose digests stand more than once."""
    often = cut(strings.groupBy("h", "g").agg(F.sum(F.size("pos")).alias("n")).where("n > 1").select("h", "g"), "often")
    if often.count() > few:
        return strings.join(often, ["h", "g"]).mapInArrow(lambda it: start_runs(it, width), RUN)
    pairs = often.toArrow()
    known = np.empty(pairs.num_rows, [("h", np.int64), ("g", np.int64)])
    for c in known.dtype.names:
        known[c] = pairs.column(c).to_numpy()
    known.sort()
    held = strings.sparkSession.sparkContext.broadcast(known)
    return strings.mapInArrow(lambda it: start_runs(it, width, held.value), RUN)


def _cut_bytes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Removed bytes, maximal removed runs, the digest of the rest and the bytes in repeated passages, for rows with repeats (tied: starts of runs, run lengths, widths)."""
    for part, raw, off in blocks(batches):
        removed, spans, shas, repeated = [], [], [], []
        tied = part.column(part.schema.get_field_index("tied"))
        for j in range(part.num_rows):
            runs = tied[j].values
            start, n, width = (runs.field(c).to_numpy().astype(np.int64) for c in range(3))
            end, deep = start + n - 1 + width, width == window
            ranges = union_of(start[deep], end[deep]) if deep.any() else []
            text, sha, at = raw[off[j] : off[j + 1]], hashlib.sha256(), 0
            for s, e in ranges:
                sha.update(text[at:s].tobytes())
                at = e
            sha.update(text[at:].tobytes())
            removed.append(sum(e - s for s, e in ranges))
            spans.append(len(ranges))
            shas.append(sha.hexdigest())
            repeated.append(sum(e - s for s, e in union_of(start, end)))
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, row_ids(part)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(repeated, pa.int64())],
            names=[*ROW, "removed", "spans", "kept", "repeated"],
        )


def repeated(
    docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET, few: int = FEW
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rows with the runs of starts of their repeated strings, exact copies)."""
    if not gram < passage <= window:
        raise ValueError("a gram must be shorter than a passage, and a passage no longer than a window")
    source = keyed(docs)
    copied = cut(copies(source), "copies")
    spare = copied.where("spare").select(*ROW).distinct()
    picks = cut(source.select(*ROW, "text").mapInArrow(lambda it: pick_entries(it, passage, gram), ENTRY), "picks")
    tied = cut(rare_ties(picks, spare), "tied")
    reach = tied.where(F.col("n") <= hot).count() * (window + (passage - gram) // 2)
    buckets = max(1, -(-reach // bucket_bytes))
    rows = candidates(source, tied, "rows")
    drop(picks, tied)
    found = rows.mapInArrow(lambda it: contexts(it, window, passage, gram, hot, buckets), "bucket int, i long, k long, pos array<int>, fill int, bytes binary")
    runs = found.groupBy("bucket").applyInArrow(lambda t: bucket_repeats(t.drop_columns(["bucket"]), window, passage), RUN)
    busy = rows.where(F.exists("tied", lambda t: t["n"] > hot))
    for width in sorted({window, passage}):
        strings = cut(busy.mapInArrow(lambda it, w=width: hot_strings(it, w, passage, gram, hot), ENTRY), "strings")
        runs = runs.unionByName(hot_repeats(strings, width, few))
    return source, rows.drop("tied").join(by_row(runs), ROW), copied


def remove_repeats(docs: DataFrame, window: int = WINDOW, passage: int | None = None, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated (bytes in strings of ``passage`` bytes that also start elsewhere) of every document."""
    passage = min(PASSAGE, window) if passage is None else passage
    source, rows, copied = repeated(docs, window, passage, **how)
    plain = source.select("doc_id", *ROW, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    removed = rows.mapInArrow(lambda it: _cut_bytes(it, window), "i long, k long, removed long, spans long, kept string, repeated long")
    whole = copied.select(*ROW).distinct().withColumn("whole", F.lit(True))
    out = plain.join(removed, ROW, "left").join(whole, ROW, "left")
    gone = F.col("whole").isNotNull() & (F.col("n_bytes") >= window)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(F.col("whole").isNotNull() & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("repeated", F.lit(0))).alias("n_repeated"),
    )


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict:
    """The contract by plain loops, for tests: index -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    texts = [(t or "").encode() for _, t in docs]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = {}
    for n, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[n] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
