"""Periodic runs of words by Lyndon arrays over an ordered alphabet (after Ellert and Fischer), without suffix structures or hashes.

A run is a stretch of words with smallest period q and at least max(least_length, exponent * q) words that no neighbouring
word extends keeping the period. Every run of exponent two or more shows as an edge i -> next[i] of one of two Lyndon
arrays (the alphabet's order and its reverse): its root [i, i + q) is a longest Lyndon word, next[i] the first suffix to
the right that is smaller, and the extension of the match of both suffixes is the run's right end.

``edges`` finds an array from left to right with a stack. Words are only ever compared with words (<, =), so any ordered
alphabet will do. Two things keep the comparisons linear in the text:

* down the stack, the extension of a pair follows from the extension before it and that of the stack's own edge, unless
  both are equal; then matching goes on where it stood;
* the match that reaches farthest right is kept. What lies inside its right half is a copy of text that was handled
  before, so the extensions of pairs there are read off the copy's edges; words are compared beyond the match's end only.

So each equal comparison moves that end on, and each unequal one ends a pair. The left end of a run takes fewer than q
more comparisons, once for each run.

Defined results: a null or blank text has no words and no runs; runs never cross texts; repeated rows are judged each;
other columns come back as they were. Memory is bounded by the longest text (some 150 bytes a word).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LEAST_LENGTH, EXPONENT = 24, 3
#: Bytes of text that are handed back to Spark at once.
OUT_BYTES = 1 << 20

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def edges(w: list, up: bool) -> tuple[list[int], list[int]]:
    """(next, extension): for each suffix the first one to its right that is smaller, and how far the two agree.

    ``up``: in the order of the words, else in its reverse; the empty suffix is least in both.
    """
    n = len(w)
    after, ahead = [n] * n, [0] * n  # next smaller suffix, and the match with it
    before, behind = [-1] * n, [0] * n  # previous smaller suffix, and the match with it
    left = right = far = 0  # w[left:][:far - right] == w[right:far], the match that reaches farthest
    for r in range(1, n):
        c, at = w[r], r - 1
        if r >= far:  # nothing is known about w[r]: most pairs differ at once
            while at >= 0 and (x := w[at]) != c and (x > c) is up:
                after[at] = r
                at = before[at]
            if at < 0:
                continue
            if w[at] != c:
                before[r] = at
                continue
        known, shift, match, best, whose = far - r, right - left, 0, 0, -1
        while at >= 0:  # the suffixes at and r agree on match words at least
            if match < known and at >= right:
                twin, copy = at - shift, r - shift
                match = min(known, ahead[twin] if after[twin] == copy else behind[copy])
            if match >= known:
                while r + match < n and w[at + match] == w[r + match]:
                    match += 1
            if match >= best:
                best, whose = match, at
            if r + match < n and (w[at + match] > w[r + match]) is not up:
                before[r], behind[r] = at, match
                break
            while True:
                after[at], ahead[at] = r, match
                share, at = behind[at], before[at]
                if at < 0 or match >= share:
                    break
            if at >= 0 and match > share:
                before[r], behind[r] = at, share
                break
        if best and r + best >= far:
            left, right, far = whose, r, r + best
    return after, ahead


def runs_of(w: list, least_length: int = LEAST_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of comparable items, by start, then period. ``exponent`` is 2 at least."""
    found, n = set(), len(w)
    if n < max(least_length, exponent):
        return []
    for up in (True, False):
        after, ahead = edges(w, up)
        for i, match in enumerate(ahead):
            # of a run's roots the leftmost starts within its first period, so this much must follow
            if not match or match <= (exponent - 2) * (q := after[i] - i):
                continue
            if i >= q and after[i - q] == i and ahead[i - q] >= q:
                continue  # not the leftmost root
            start = i
            while start and i - start < q and w[start - 1] == w[start - 1 + q]:
                start -= 1
            length = i + q + match - start
            if length >= least_length and length >= exponent * q:
                found.add((start, length, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def kept_words(w: list, found: list[tuple[int, int, int]]) -> list:
    """The words outside of all runs, and of each run its first period (unless another run drops it)."""
    if not found:
        return w
    keep, upto = [], 0
    drops = sorted((start + q, start + length) for start, length, q in found)
    for a, b in drops:
        keep += w[upto:a]
        upto = max(upto, b)
    return keep + w[upto:]


def _batches(batches: Iterator[pa.RecordBatch], rest: list[int], text: int, rewrite: Callable | None, schema: pa.Schema, least_length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, size, found, kept, counts = 0, 0, [], [], []
        texts = batch.column(text)
        for i in range(batch.num_rows):
            value = texts[i].as_buffer()
            w = value.to_pybytes().split() if value is not None else []  # at the six ASCII white-space bytes
            if rewrite is not None:
                w = rewrite(w, *(batch.column(c)[i].as_py() for c in rest))
            got = runs_of(w, least_length, exponent)
            found.append([{"start": s, "length": n, "period": q} for s, n, q in got])
            kept.append(b" ".join(kept_words(w, got)))
            counts.append(len(w))
            size += len(kept[-1]) + 64 * len(got)
            if size > OUT_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(at, i + 1 - at)
                columns = [part.column(c) for c in range(batch.num_columns) if c != text]
                made = [pa.array(counts, pa.int64()), pa.array(found, _RUN), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *made], schema=schema)
                at, size, found, kept, counts = i + 1, 0, [], [], []


def find_runs(docs: DataFrame, text: str = "text", rewrite: Callable | None = None, given: tuple[str, ...] = (), least_length: int = LEAST_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Every row with ``n_words``, ``runs`` (start, length, period in words) and ``collapsed`` (the kept words, one space between) for its text.

    ``rewrite``, where given, gets the list of words (bytes) and the row's ``given`` columns, and returns the words to judge.
    One narrow pass: texts are neither shuffled nor gathered.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = ("n_words", "runs", "collapsed")
    others = [c for c in docs.columns if c not in (text, *new)]
    slim = docs.select(*others, F.col(text).cast("string").alias(text))
    made = T._parse_datatype_string(f"n_words long, runs {RUN}, collapsed string")
    schema = T.StructType([f for f in slim.schema.fields if f.name != text] + made.fields)
    arrow, rest, place = to_arrow_schema(schema), [slim.columns.index(c) for c in given], slim.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, rest, place, rewrite, arrow, least_length, exponent)

    return slim.mapInArrow(judge, schema)


def repeat_tail(words: list, h: int | None) -> list:
    """The contract's texts with a period: where h % 10 = 0, all words from g % n on repeat the first few of them."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exact exponent, and the digests of all runs and of the collapsed text."""
    # exact comparison of fractions: a is before b if its length/period is greater, then by start, then by period
    ahead = "a.length * b.period > b.length * a.period or (a.length * b.period = b.length * a.period and (a.start < b.start or (a.start = b.start and a.period < b.period)))"
    best = F.expr(f"aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, a) -> if(b is null or {ahead}, a, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute_force(w: list, least_length: int = LEAST_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs by trying every period, for tests."""
    n, found = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least_length, exponent * q) and not any(q % d == 0 and w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))
