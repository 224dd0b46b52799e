"""Hashed text features and sparse linear algebra in NumPy, for the two trained models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.blocks import BYTE, LOWER, U64, mix, prefix_hash, runs, span_hash, NOT_SPACE

#: Size of the hashed feature space.
DIM = 1 << 18

#: Letters by shape: lower, upper, digit, any letter beyond ASCII, and every other byte as itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97
IS_LETTER = np.zeros(256, bool)
IS_LETTER[48:58] = IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def _slot(h: np.ndarray, family: int) -> np.ndarray:
    return (mix(h + U64(family * 0xA0761D6478BD642F % (1 << 64))) >> U64(64 - 18)).astype(np.int64)


def counted(doc: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, slots, counts) of (document, slot) pairs."""
    key, count = np.unique(doc * DIM + slot, return_counts=True)
    return np.searchsorted(key, np.arange(n + 1) * DIM), key % DIM, count


def style_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality: word shapes, shape pairs, ends of words, lower-cased words and immediate repeats, as shares of the words.

    Values are the square root of each feature's share of the text's words, so a text's length doesn't count.
    """
    n = len(off) - 1
    start, end = runs(NOT_SPACE[raw], off)
    woff = np.searchsorted(start, off)
    doc = np.repeat(np.arange(n), np.diff(woff))
    shape = SHAPE[raw]
    keep = np.ones(len(raw), bool)
    if len(raw):
        keep[1:] = (shape[1:] != shape[:-1]) | ~NOT_SPACE[raw[1:]] | ~NOT_SPACE[raw[:-1]]
        keep[off[:-1][off[:-1] < len(raw)]] = True
    short = np.concatenate([[0], np.cumsum(keep)])
    shapes = span_hash(prefix_hash(BYTE[shape[keep]]), short[start], short[end])
    word = span_hash(prefix_hash(BYTE[LOWER[raw]]), start, end)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.empty(0, np.int64)
    last = shape[end - 1].astype(U64) if len(end) else np.empty(0, U64)
    again = inner[word[inner] == word[inner - 1]]
    docs = np.concatenate([doc, doc[inner], doc, doc, doc[again]])
    slots = np.concatenate([_slot(shapes, 1), _slot(shapes[inner - 1] * U64(3) + shapes[inner], 2), _slot(last, 3), _slot(word, 4), np.full(len(again), 7)])
    ptr, slot, count = counted(docs, slots, n)
    size = np.maximum(1, np.diff(woff))
    return ptr, slot, np.sqrt(count / np.repeat(size, np.diff(ptr)))


def word_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Toxicity: presence of words, and of their first five bytes for long ones (inflected and compound forms)."""
    n = len(off) - 1
    low = LOWER[raw]
    start, end = runs(IS_LETTER[low], off)
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(start, off)))
    prefix = prefix_hash(BYTE[low])
    stem = np.flatnonzero(end - start > 5)
    four = np.flatnonzero(end - start > 4)
    docs = np.concatenate([doc, doc[stem], doc[four]])
    slots = np.concatenate([_slot(span_hash(prefix, start, end), 5), _slot(span_hash(prefix, start[stem], start[stem] + 5), 6), _slot(span_hash(prefix, start[four], start[four] + 4), 8)])
    ptr, slot, count = counted(docs, slots, n)
    return ptr, slot, np.ones(len(slot))


def dot(ptr: np.ndarray, slot: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """X w, by rows."""
    total = np.concatenate([[0.0], np.cumsum(value * weights[slot])])
    return total[ptr[1:]] - total[ptr[:-1]]


def dot_t(ptr: np.ndarray, slot: np.ndarray, value: np.ndarray, by_row: np.ndarray, dim: int) -> np.ndarray:
    """X' g."""
    return np.bincount(slot, value * np.repeat(by_row, np.diff(ptr)), dim)


def minimise(fun, x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search. ``fun`` gives value and gradient."""
    f, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, coef = g.copy(), []
        for s, y, r in reversed(pairs):
            coef.append(a := r * (s @ q))
            q -= a * y
        if pairs:
            s, y, r = pairs[-1]
            q *= 1 / (r * (y @ y))
        else:
            q *= 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y, r), a in zip(pairs, reversed(coef), strict=True):
            q += (a - r * (y @ q)) * s
        slope, t = float(g @ q), 1.0
        if slope <= 1e-12:
            break
        while True:
            x2 = x - t * q
            f2, g2 = fun(x2)
            if f2 <= f - 1e-4 * t * slope or t < 1e-8:
                break
            t *= 0.5
        s, y = x2 - x, g2 - g
        if (sy := float(s @ y)) > 1e-12:
            pairs = [*pairs, (s, y, 1 / sy)][-memory:]
        done = abs(f - f2) <= 1e-7 * max(1.0, abs(f))
        x, f, g = x2, f2, g2
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def feature_rows(batches, features, extra: int):
    """Arrow rows (extra columns first, then slots and values) for training."""
    from tidemark.llm.blocks import blocks

    for rows, raw, off in blocks(batches):
        ptr, slot, value = features(raw, off)
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(i) for i in range(extra)), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(slot, pa.int32())), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(value, pa.float32()))],
            names=[*(rows.schema.names[i] for i in range(extra)), "slot", "value"],
        )


def compact(rows: pa.Table, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """CSR over the slots that ``least`` rows have: (ptr, column, value, slot of each column)."""
    n = rows.num_rows
    flat = lambda c: (rows.column(c).chunk(0) if n else None)
    if not n:
        return np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    size = np.diff(flat("slot").offsets.to_numpy())
    slot, value = flat("slot").flatten().to_numpy(), flat("value").flatten().to_numpy()
    used = np.flatnonzero(np.bincount(slot, minlength=DIM) >= min(least, max(1, n // 20)))
    column = np.full(DIM, -1, np.int32)
    column[used] = np.arange(len(used))
    keep = column[slot] >= 0
    ptr = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
    return ptr, column[slot[keep]], value[keep], used
