"""Fill-in-middle transformation with a sparse checkpoint index.

A text is a row of units, each a word with the white space before it, and white space at the end of the text on its own.
Units are counted in chunks of bytes; while counting, the byte and the code-point offset of every ``step``-th unit's
start are recorded (``Index``). A cut is found by binary search among these checkpoints and by scanning again from there,
``step`` units at most. So a text costs one pass, a few numbers a thousand bytes, and two short scans, however long it is.

``infill`` cuts each text twice, at units drawn from a seeded digest of the document's id, and writes the parts in
prefix-suffix-middle or suffix-prefix-middle order between markers; ``restore`` gives the text back from output and form.

Defined results: a null text counts as empty, an empty text and one that holds a marker stay plain; a null id is drawn as
the empty string; rows of equal id are cut alike by their own lengths; other columns come back as they were.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.blocks import NOT_SPACE, settle

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = "42", 50, 80
#: Units between checkpoints, and bytes that are counted at once.
STEP, CHUNK = 256, 1 << 16
OUT_BYTES = 1 << 20

_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Index:
    """Offsets of units 0, step, 2 step, .. of a UTF-8 text: ``byte`` and ``point`` (code points), with the totals."""

    def __init__(self, text: bytes, step: int = STEP, chunk: int = CHUNK):
        self.text, self.step, self.n = text, step, 0
        self.byte, self.point = [0], [0]
        raw, points, inside = np.frombuffer(text, np.uint8), 0, False
        for at in range(0, len(raw), chunk):
            part = raw[at : at + chunk]
            word = NOT_SPACE[part]
            # a unit ends behind a word: where a byte is white space and the one before it is not
            before = np.empty(len(word), bool)
            before[0], before[1:] = inside, word[:-1]
            ends = np.flatnonzero(before & ~word)
            first = (-self.n - 1) % step  # the unit that ends at ends[first] is the next checkpoint's last before it
            if first < len(ends):
                marks = ends[first::step]
                start = np.cumsum((part & 0xC0) != 0x80)  # code points that begin up to each byte
                self.byte += (marks + at).tolist()
                self.point += (np.where(marks > 0, start[marks - 1], 0) + points).tolist()
            self.n += len(ends)
            points += int(np.count_nonzero((part & 0xC0) != 0x80))
            inside = bool(word[-1])
        # the last unit: a word that nothing follows, or the white space behind the last word
        self.n += bool(len(raw))
        self.points = points

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) where the first ``unit`` units end."""
        if unit >= self.n:
            return len(self.text), self.points
        place = bisect_right(range(0, len(self.byte) * self.step, self.step), unit) - 1
        byte, point = self.byte[place], self.point[place]
        left = unit - place * self.step
        if left:
            scan = _UNIT.finditer(self.text, byte)
            for _ in range(left):
                end = next(scan).end()
            point += len(self.text[byte:end].decode())
            byte = end
        return byte, point


def _form(text: bytes, h3: int, h4: int, rate: int, spm: int) -> str:
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def _cut_batches(batches: Iterator[pa.RecordBatch], rest: list[int], schema: pa.Schema, rate: int, spm: int, step: int) -> Iterator[pa.RecordBatch]:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        texts, draws = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        at, size, rows = 0, 0, []
        for i in range(batch.num_rows):
            value = texts[i].as_buffer()
            text = value.to_pybytes() if value is not None else b""
            h1, h2, h3, h4 = draws[i].as_py()
            index = Index(text, step)
            form, first, second = _form(text, h3, h4, rate, spm), None, None
            if form == "plain":
                rows.append((index.n, form, None, None, None, text))
            else:
                a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
                (first, head), (second, body) = index.cut(a), index.cut(b)
                x, y, z = text[:first], text[first:second], text[second:]
                rows.append((index.n, form, head, body - head, index.points - body, p + x + s + z + m + y if form == "psm" else s + z + p + x + m + y))
            size += len(text)
            if size > OUT_BYTES or i + 1 == batch.num_rows:
                n, kind, x, y, z, out = zip(*rows, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(kind, pa.string()), *(pa.array(c, pa.int64()) for c in (x, y, z)), pa.array(out, pa.binary()).cast(pa.string())]
                part = batch.slice(at, i + 1 - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], schema=schema)
                at, size, rows = i + 1, 0, []
    settle()


def infill(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM, step: int = STEP) -> DataFrame:
    """Every row with n (units), form (plain, psm, spm), prefix_chars, middle_chars, suffix_chars and ``output`` for its text.

    ``rate`` of 100 documents are cut, ``spm`` of 100 of these have the suffix first. One narrow pass, no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, suffix_chars long, output string")
    others = [c for c in docs.columns if c not in ("text", *new.names)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    # text and draws are told by place, so no column of the input can clash with them
    slim = docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")), draws)
    schema = T.StructType(slim.schema.fields[: len(others)] + new.fields)
    arrow, rest = to_arrow_schema(schema), list(range(len(others)))
    return slim.mapInArrow(lambda it: _cut_batches(it, rest, arrow, rate, spm, step), schema)


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form. Texts that hold a marker stay plain, so a marker's first place is its own."""
    at = lambda marker, start: F.locate(marker, output, start)
    between = lambda a, b: F.substring(output, a, b - a)
    mark, far = 3, F.length(output) + 1
    second_psm, second_spm = at(SUFFIX, 1), at(PREFIX, 1)
    middle = F.locate(MIDDLE, output)
    tail = between(middle + mark, far)
    psm = F.concat(between(F.lit(1 + mark), second_psm), tail, between(second_psm + mark, middle))
    spm = F.concat(between(second_spm + mark, middle), tail, between(F.lit(1 + mark), second_spm))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(done: DataFrame) -> DataFrame:
    """The contract's columns: digests of the outputs and of the texts that are rebuilt from them."""
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def brute_force(text: str | None, h: tuple[int, int, int, int], rate: int = RATE, spm: int = SPM) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) from the list of all units, for tests."""
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    n = len(units)
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(x), len(y), SUFFIX + z + PREFIX + x + MIDDLE + y
    return n, "psm", len(x), len(y), PREFIX + x + SUFFIX + z + MIDDLE + y
