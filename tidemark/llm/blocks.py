"""Whole texts as NumPy byte blocks: the shared ground of the Arrow-batched operators.

A block is a run of rows whose texts lie end to end in one uint8 array. Work per block is vectorised and memory is
bounded by the block size (or by the longest single text, where that is larger).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the rolling polynomial (modulo 2^64) and its inverse.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=U64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random-looking 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the polynomial of values[i:j], scaled by BASE^i."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(BASE, len(values)), dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], wherever it stands; lengths are mixed in."""
    inverse = powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` values, by its start (windows across texts included: mask them)."""
    n = len(prefix) - width
    if n <= 0:
        return np.empty(0, U64)
    return mix((prefix[width:] - prefix[:n]) * powers(_INVERSE, n))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def settle() -> None:
    """Give freed memory back to the system: a worker that waits for its next task should not hold its last one's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20, most_rows: int = 1 << 12) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of at most ``most_rows`` rows and ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = min(at + most_rows, max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
        del batch, raw, off
    settle()


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross an offset."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: Word bytes of the decontamination and search words: 0-9, a-z and everything beyond ASCII, after lower-casing A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Words of more bytes are hashed by digest: polynomials modulo 2^64 agree for whole families of long strings (as of Thue and Morse), whatever their base.
LONG_WORD = 64
#: Bytes that are not space, tab, line feed, vertical tab, form feed or carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def words(raw: np.ndarray, off: np.ndarray, lower: bool, byte: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, per-text offsets into these) of the words of a block: IS_WORD after lower-casing, or NOT_SPACE."""
    text = LOWER[raw] if lower else raw
    start, end = runs((IS_WORD if lower else NOT_SPACE)[text], off)
    h = span_hash(prefix_hash(byte[text]), start, end)
    for j in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[j] = digests(text, start[j : j + 1], end[j : j + 1], person=byte[:2].tobytes())[0, 0]
    return h, start, end, np.searchsorted(start, off)


def digests(text: np.ndarray, start: np.ndarray, end: np.ndarray, person: bytes = b"") -> np.ndarray:
    """128 bits of BLAKE2 of each text[start:end], as two numbers a row: where equal hashes decide that bytes are equal."""
    view = memoryview(np.ascontiguousarray(text)).cast("B")
    out = b"".join([blake2b(view[a:b], digest_size=16, person=person).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, "<u8").reshape(-1, 2)


def spread(count: np.ndarray) -> np.ndarray:
    """0, 1, .. count[0]-1, 0, 1, .. count[1]-1, and so on."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)
