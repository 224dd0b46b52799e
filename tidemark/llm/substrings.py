"""Substring dedup over words by level-wise doubling.

A window of ``window`` words is repeated only if all its parts are. Level by level, windows of a length (a quarter of
the target, then a half, then the whole) are tested for repeats over the corpus, and only what stands in a repeated
window is extended to twice that length, until no candidate survives or the target length is reached. At the shorter
levels one part of each window is tested, the one of least hash (the same choice wherever equal words stand), so a
level tests few places and misses no repeat. At these levels hashes only nominate. At the target length every surviving
window is tested by a digest of 128 bits of its words, joined by one space.

Exact copies of a whole text are told by their digest; one of them stands for all in the levels.

Defined results: a null text has no words; a text of fewer words than a window keeps all; windows never cross texts;
repeated rows are copies of each other (each loses what is repeated); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.blocks import blocks, digests, prefix_hash, window_hash, words
from tidemark.llm.repeats import ENTRY, ROW, candidates, copies, entries, keyed, marked, pick_runs, row_ids, ties
from tidemark.session import cut, drop

WINDOW = 35


def lengths(window: int) -> list[int]:
    """The levels: each twice the one before (rounded up), the last the window itself."""
    out = [window]
    while len(out) < 2 or len(out) < 3 and out[0] > 8:
        out.insert(0, -(-out[0] // 2))
    return out


def level_entries(batches: Iterator[pa.RecordBatch], window: int, length: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """What one level tests, as (hash, row, window position). With ``before``, only windows whose part of that length is tied."""
    for part, raw, off in blocks(batches):
        word, start, end, woff = words(raw, off, False)
        if len(word) < window:
            continue
        prefix = prefix_hash(word)
        k = row_ids(part)
        live = None
        if before is not None:
            tied = marked(part, woff, len(word))
            row, pick, first, last = pick_runs(window_hash(prefix, before), before, window, woff)
            ok = tied[pick] > 0
            step = np.zeros(len(word) + 1, np.int64)
            np.add.at(step, first[ok], 1)
            np.add.at(step, last[ok] + 1, -1)
            live = np.cumsum(step)[:-1] > 0
        if live is not None and length == window:
            pos = np.flatnonzero(live)
            row = np.searchsorted(woff, pos, "right") - 1
            joined, first, last = _joined(raw, start, end)
            both = digests(joined, first[pos], last[pos + window - 1])
            yield entries(both[:, 0], row, k, pos - woff[row], both[:, 1])
            continue
        h = window_hash(prefix, length)
        row, pick, first, last = pick_runs(h, length, window, woff)
        if live is not None:
            seen = np.concatenate([[0], np.cumsum(live)])
            ok = seen[last + 1] > seen[first]
            row, pick = row[ok], pick[ok]
        yield entries(h[pick], row, k, pick - woff[row])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and the digest of the words joined by one space, for every row."""
    for part, raw, off in blocks(batches):
        _, start, end, woff = words(raw, off, False)
        size = np.diff(woff)
        shas = [_joined_sha(raw, start[a:b], end[a:b]) for a, b in zip(woff[:-1], woff[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(size, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", *ROW, "n_words", "sha"])


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space behind each, and where each begins and ends in that."""
    # words and one byte behind each, then that byte made a space
    size = end - start + 1
    at = np.cumsum(size)
    index = np.arange(at[-1]) + np.repeat(start - at + size, size)
    out = raw[np.minimum(index, len(raw) - 1)]
    out[at - 1] = 32
    return out, at - size, at - 1


def _joined_sha(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    if not len(start):
        return hashlib.sha256(b"").hexdigest()
    return hashlib.sha256(_joined(raw, start, end)[0][:-1].tobytes()).hexdigest()


def _cut_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Removed words and the digest of the rest, for rows with repeated windows."""
    for part, raw, off in blocks(batches):
        _, start, end, woff = words(raw, off, False)
        hit = np.concatenate([[0], np.cumsum(marked(part, woff, len(start)) > 0)])
        at = np.arange(len(start))
        row = np.searchsorted(woff, at, "right") - 1
        covered = hit[at + 1] > hit[np.maximum(at + 1 - window, woff[row])]
        gone = np.concatenate([[0], np.cumsum(covered)])
        shas = []
        for a, b in zip(woff[:-1], woff[1:], strict=True):
            keep = ~covered[a:b]
            shas.append(_joined_sha(raw, start[a:b][keep], end[a:b][keep]))
        yield pa.RecordBatch.from_arrays([*map(pa.array, row_ids(part)), pa.array(gone[woff[1:]] - gone[woff[:-1]], pa.int64()), pa.array(shas, pa.string())], names=[*ROW, "removed", "kept"])


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rows with repeated windows and those windows' starts, exact copies)."""
    source = keyed(docs)
    copied = cut(copies(source), "copies")
    spare = copied.where("spare").select(*ROW).distinct()
    levels = lengths(window)
    level = cut(source.select(*ROW, "text").mapInArrow(lambda it: level_entries(it, window, levels[0], None), ENTRY), "level")
    rows = candidates(source, ties(level, spare), "rows")
    for before, length in zip(levels, levels[1:], strict=False):
        drop(level)
        level = cut(rows.mapInArrow(lambda it, b=before, n=length: level_entries(it, window, n, b), ENTRY), "level")
        older, rows = rows, candidates(rows, ties(level), "rows")
        drop(older)
    drop(level)
    return source, rows, copied


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    source, rows, copied = repeated(docs, window)
    plain = source.select("doc_id", *ROW, "text").mapInArrow(_plain, "doc_id long, i long, k long, n_words long, sha string")
    removed = rows.mapInArrow(lambda it: _cut_words(it, window), "i long, k long, removed long, kept string")
    whole = copied.select(*ROW).distinct().withColumn("whole", F.lit(True))
    out = plain.join(removed, ROW, "left").join(whole, ROW, "left")
    gone = F.col("whole").isNotNull() & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict:
    """The contract by plain loops, for tests: index -> (n_words, n_removed, kept_sha256)."""
    texts = [[w for w in _split(t or "") if w] for _, t in docs]
    seen: dict[tuple, int] = defaultdict(int)
    for ws in texts:
        for i in range(len(ws) - window + 1):
            seen[tuple(ws[i : i + window])] += 1
    out = {}
    for n, ws in enumerate(texts):
        gone: set[int] = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[n] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def _split(text: str) -> list[str]:
    import re

    return re.split("[\x20\x09-\x0d]+", text)
