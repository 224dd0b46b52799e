"""Token ids in binary files: documents' ids end to end, their boundaries as Elias-Fano lists.

Files of one folder: for each shard ``<name>.ids`` (ids as little-endian 16-bit or 32-bit numbers, document after document) and
``<name>.ef`` (two Elias-Fano lists: the n + 1 boundaries, and the doc_ids that are not null), and ``manifest.json``, which
names the shards in order with their sizes. Nothing is there until the manifest is: tasks write under names of their own,
the commit lists those whose task counted, so a task that is tried again or lost leaves nothing that is read.

``TokenFiles`` is a Spark data source for them (format ``token_files``): its writer takes (doc_id, ids), or (doc_id, text)
and the path of a vocabulary, in the order of the partitions; its reader gives (doc_id, start, n_tokens, ids), a task for each
range of documents, which selects its boundaries and reads these ids alone. ``write`` sorts, encodes and saves.

Encoding: a text is cut at ASCII white space, which the tokenizer drops and no token spans; each distinct piece is encoded once
by the tokenizers library, and kept up to a bound. The ids are those of the whole text.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows of equal doc_id go by a hash of
their texts; an empty table gives a manifest without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidemark.llm.blocks import column_bytes, settle
from tidemark.llm.elias_fano import EliasFano

FORMAT, VERSION = "token_files", 1
END_ID = 2
#: Distinct pieces, and parts of pieces, that a worker keeps (some 200 bytes each), and the longest that is kept.
KEPT_PIECES, LONGEST_PIECE = 400_000, 64
#: Bytes of text encoded at once, ids read at once, and documents that a reading task takes.
ENCODE_BYTES, READ_IDS, READ_DOCS = 1 << 22, 1 << 18, 1 << 16
#: Pieces whose ids are laid out at once.
GATHER = 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- encoding


class Kept:
    """A dictionary in two generations of ``most`` / 2 entries: what is asked for again moves to the younger, what isn't goes with the elder."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def absent(self, keys: set[bytes]) -> set[bytes]:
        """The keys that are in neither; all others are in the younger from here to the next call."""
        fresh = keys.difference(self.young)
        if len(self.young) + len(fresh) > self.half:
            self.young, self.old, fresh = {}, self.young, keys
        old = self.old
        self.young |= {k: old[k] for k in fresh if k in old}
        return fresh.difference(old)


#: A pre-tokenizer that ends with this takes runs of letters, single digits and runs of other marks apart.
_CLASSES = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = string.punctuation.encode()
#: A piece whose last ASCII letter or digit is followed by ASCII marks alone, the first of them no apostrophe.
_TAIL = re.compile(rb"(.*[A-Za-z0-9])([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)", re.DOTALL)


class Encoder:
    """Ids of whole texts, from a tokenizer that drops white space; distinct pieces are encoded once.

    Where the vocabulary says that runs of letters and of marks are tokenized apart, a new piece is cut before its closing marks,
    so that a word is encoded once whatever follows it; where it marks words' ends, new words of letters alone are
    encoded many in a text, with spaces between, and told apart by these marks (one each, else they are encoded alone).
    """

    def __init__(self, vocabulary: str, end_id: int, kept: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(vocabulary), np.int32(end_id).tobytes()
        self.pieces, self.parts = Kept(kept), Kept(kept)
        told = json.loads(vocabulary)
        added = [re.escape(t["content"].encode()) for t in told.get("added_tokens", [])]
        self.added = re.compile(b"|".join(added) if added else rb"(?!)").search
        patterns = [p.get("pattern", {}).get("Regex", "") for p in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.classes = len(patterns) > 0 and patterns[0].endswith(_CLASSES)
        suffix = told["model"].get("end_of_word_suffix")
        self.ends = None
        if self.classes and suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _alone(self, parts: list[bytes]) -> dict[bytes, bytes]:
        out = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return {p: array("i", e.ids).tobytes() for p, e in zip(parts, out, strict=True)}

    def _encoded(self, parts: set[bytes]) -> dict[bytes, bytes]:
        if self.ends is None:
            return self._alone(list(parts))
        words, others, texts = [], [], []
        for p in parts:
            text = p.decode()
            if text.isalpha():
                words.append(p)
                texts.append(text)
            else:
                others.append(p)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.int32)
        last = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(last) != len(words) or last and last[-1] != 4 * len(ids):
            return self._alone(list(parts))
        data = ids.tobytes()
        return {p: data[a:b] for p, a, b in zip(words, [0, *last], last, strict=False)} | self._alone(others)

    def _cut(self, piece: bytes) -> tuple[bytes, ...]:
        if not self.classes or self.added(piece):
            return (piece,)
        if found := _TAIL.fullmatch(piece):
            return found.groups()
        if piece[-1:] in _MARKS and not piece.isascii():  # a letter beyond ASCII before the marks; one that NFC takes apart might end in a mark
            text = piece.decode()
            head = text.rstrip(_MARKS.decode())
            if head and head[-1].isalpha() and text[len(head)] != "'" and unicodedata.is_normalized("NFC", head):
                return head.encode(), text[len(head) :].encode()
        return (piece,)

    def _new(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces that aren't kept."""
        cuts = {p: self._cut(p) for p in missing}
        new = self.parts.absent(set().union(*cuts.values()))
        part = self.parts.young
        part |= self._encoded(new)
        out = {p: part[cut[0]] if len(cut) == 1 else part[cut[0]] + part[cut[1]] for p, cut in cuts.items()}
        for p in new:
            if len(p) > LONGEST_PIECE:
                del part[p]
        return out

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        found = list(map(self.pieces.young.get, distinct))
        missing = {p for p, x in zip(distinct, found, strict=True) if x is None}
        if not missing:
            return found
        new = self._new(self.pieces.absent(missing))
        known = self.pieces.young
        known |= new
        found = [known[p] if x is None else x for p, x in zip(distinct, found, strict=True)]
        for p in new:
            if len(p) > LONGEST_PIECE:
                del known[p]
        return found

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, the end id behind them. Each distinct piece of the texts is looked up once."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        raw, off = column_bytes(coded.dictionary)
        raw, off = raw.tobytes(), off.tolist()
        distinct = [raw[a:b] for a, b in zip(off, off[1:], strict=False)]
        ids = [b"" if not p else x for p, x in zip(distinct, self._ids([p or b" " for p in distinct]), strict=True)] if b"" in distinct else self._ids(distinct)
        ids.append(self.end)  # stands behind each text
        index = np.insert(coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy()).cumsum(), len(distinct))
        flat, size = np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, length = np.cumsum(size) - size, size[index]
        end = np.cumsum(length)
        made = [flat[np.repeat(start[i] - (n.cumsum() - n), n) + np.arange(n.sum())] for i, n in ((index[a : a + GATHER], length[a : a + GATHER]) for a in range(0, len(index), GATHER))]
        bounds = np.concatenate([[0], end[np.flatnonzero(index == len(distinct))]])
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(made) if made else np.empty(0, np.int32)))


_encoders: dict[tuple, Encoder] = {}


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """(doc_ids, ids) of batches of (doc_id, text), of so many texts at once."""
    key = (hash(vocabulary), end_id)
    encoder = _encoders[key] if key in _encoders else _encoders.setdefault(key, Encoder(vocabulary, end_id))
    for batch in batches:
        column = pc.fill_null(batch.column(1), "")
        off = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + ENCODE_BYTES, "right")) - 1)
            yield batch.column(0).slice(at, to - at), encoder.encode(column.slice(at, to - at))
            at = to
    settle()


def _vocabulary(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (array<int>, the end id last) of every row, in its order. The vocabulary (a few MB, fixed) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([*x], names=["doc_id", "ids"]) for x in _encoded(it, shared.value, end_id)), "doc_id long, ids array<int>")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id across partitions and inside each; a hot doc_id is spread by text and place."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = slim.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    by = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("place")]
    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and save the ids in ascending doc_id order as token files in a folder that all executors share.

    The tasks that hold the sorted texts encode and write: ids don't travel.
    """
    register(docs.sparkSession)
    out = in_order(docs).write.format(FORMAT).mode("append").option("path", path)
    out.option("vocabulary", vocabulary or default_vocabulary()).option("end_id", end_id).save()


def save(ids: DataFrame, path: str, width: int = 4) -> None:
    """Save (doc_id, ids array<int>), ordered across partitions, as token files of ``width`` (2 or 4) bytes an id."""
    register(ids.sparkSession)
    ids.select("doc_id", "ids").write.format(FORMAT).mode("append").option("path", path).option("width", width).save()


def read(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids: array<int>, or their little-endian 32-bit bytes."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).option("as_bytes", str(as_bytes).lower()).load()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFiles)


# --- the files


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    uri = path if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else f"file:{os.path.abspath(path)}"
    return pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _manifest(path: str) -> dict:
    fs, at = _fs(path)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


@dataclass
class Shard(WriterCommitMessage):
    order: int
    name: str
    docs: int
    nulls: int
    ids: int
    width: int
    ef_bytes: int


@dataclass
class Range(InputPartition):
    shard: dict
    base: int
    first: int
    last: int


class _ShardWriter(DataSourceArrowWriter):
    """Appends ids to a shard's file as they come; lengths and doc_ids are all that it holds."""

    def __init__(self, path: str, width: int, vocabulary: str | None, end_id: int):
        self.path, self.width, self.vocabulary, self.end_id = path, width, vocabulary, end_id
        if vocabulary is not None:
            self.width = 2 if Encoder(vocabulary, end_id, 0).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        name = f"shard-{uuid.uuid4().hex}"
        lengths, docs = [], []
        parts = _encoded(iterator, self.vocabulary, self.end_id) if self.vocabulary is not None else ((b.column(0), b.column(1)) for b in iterator)
        with fs.open_output_stream(f"{at}/{name}.ids") as f:
            for own, lists in parts:
                flat = lists.flatten().to_numpy()
                if len(flat) and (flat.min() < 0 or flat.max() >> 8 * self.width):
                    raise ValueError(f"a token id is negative or takes more than {self.width} bytes")
                f.write(flat.astype(f"<u{self.width}").tobytes())
                lengths.append(np.diff(lists.offsets.to_numpy()))
                docs.append(own)
        sizes = np.concatenate([np.zeros(1, np.int64), *lengths]).astype(np.int64)
        ids = pa.chunked_array(docs, pa.int64())
        if ids.null_count and ids.slice(0, ids.null_count).null_count < ids.null_count:
            raise ValueError("null doc_ids must come first")
        lists = EliasFano.of(np.cumsum(sizes)).to_bytes() + EliasFano.of(ids.drop_null().to_numpy()).to_bytes()
        with fs.open_output_stream(f"{at}/{name}.ef") as f:
            f.write(lists)
        return Shard(TaskContext.get().partitionId(), name, len(ids), ids.null_count, int(sizes.sum()), self.width, len(lists))

    def commit(self, messages: list) -> None:
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        if fs.get_file_info(f"{at}/manifest.json").type != pa.fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds token files already")
        shards = [vars(m) for m in sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.order)]
        with fs.open_output_stream(f"{at}/manifest.json.new") as f:
            f.write(json.dumps({"version": VERSION, "docs": sum(s["docs"] for s in shards), "ids": sum(s["ids"] for s in shards), "shards": shards}, sort_keys=True).encode())
        fs.move(f"{at}/manifest.json.new", f"{at}/manifest.json")

    def abort(self, messages: list) -> None:
        fs, at = _fs(self.path)
        for m in messages:
            if m is not None:
                for end in ("ids", "ef"):
                    if fs.get_file_info(f"{at}/{m.name}.{end}").type != pa.fs.FileType.NotFound:
                        fs.delete_file(f"{at}/{m.name}.{end}")


class _ShardReader(DataSourceReader):
    def __init__(self, path: str, as_bytes: bool, docs: int):
        self.path, self.as_bytes, self.docs = path, as_bytes, docs

    def partitions(self) -> list[Range]:
        fs, at = _fs(self.path)
        out, base = [], 0
        for s in _manifest(self.path)["shards"]:
            for end, size in (("ids", s["ids"] * s["width"]), ("ef", s["ef_bytes"])):
                if fs.get_file_info(f"{at}/{s['name']}.{end}").size != size:
                    raise ValueError(f"{s['name']}.{end} is missing or not of the size that the manifest says")
            out += [Range(s, base, a, min(a + self.docs, s["docs"])) for a in range(0, s["docs"], self.docs)]
            base += s["ids"]
        return out or [Range({}, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.shard:
            return
        fs, at = _fs(self.path)
        s = part.shard
        with fs.open_input_stream(f"{at}/{s['name']}.ef") as f:
            data = f.read()
        bounds, place = EliasFano.from_bytes(data)
        docs, _ = EliasFano.from_bytes(data, place)
        if bounds.n != s["docs"] + 1 or docs.n != s["docs"] - s["nulls"] or bounds.select(s["docs"]) != s["ids"]:
            raise ValueError(f"{s['name']} is not what the manifest says")
        off = bounds.slice(part.first, part.last + 1)
        nulls = s["nulls"]
        own = pa.concat_arrays([pa.nulls(max(0, min(nulls, part.last) - part.first), pa.int64()), pa.array(docs.slice(max(0, part.first - nulls), max(0, part.last - nulls)))])
        kind, n = f"<u{s['width']}", part.last - part.first
        with fs.open_input_file(f"{at}/{s['name']}.ids") as f:
            i = 0
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + READ_IDS, "right")) - 1))
                size = int(off[j] - off[i]) * s["width"]
                ids = np.frombuffer(f.read_at(size, int(off[i]) * s["width"]), kind).astype("<u4")
                inner = (off[i : j + 1] - off[i]).astype(np.int32)
                if self.as_bytes:
                    made = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((inner * 4).astype(np.int32)), pa.py_buffer(ids)])
                else:
                    made = pa.ListArray.from_arrays(pa.array(inner), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([own.slice(i, j - i), pa.array(off[i:j] + part.base), pa.array(np.diff(off[i : j + 1])), made], names=["doc_id", "start", "n_tokens", "ids"])
                i = j


class TokenFiles(DataSource):
    """Options: ``path``; for reading ``as_bytes`` and ``docs`` (documents a task); for writing ``vocabulary`` and ``end_id``, or ``width``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"doc_id long, start long, n_tokens long, ids {'binary' if self._bytes() else 'array<int>'}"

    def _bytes(self) -> bool:
        return self.options.get("as_bytes", "false") == "true"

    def reader(self, schema) -> DataSourceReader:
        return _ShardReader(self.options["path"], self._bytes(), int(self.options.get("docs", READ_DOCS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("token files are written once; take a new folder")
        vocabulary = self.options.get("vocabulary")
        return _ShardWriter(self.options["path"], int(self.options.get("width", 4)), _vocabulary(vocabulary) if vocabulary else None, int(self.options.get("end_id", END_ID)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit numbers, from ``read(.., as_bytes=True)``."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
