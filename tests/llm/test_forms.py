"""Runs, fill-in-middle and token files against brute force, on odd texts and tables, and over whole small tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import infill, registry, runs, token_files
from tidemark.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0d]"


def periodic(rng, n, letters):
    w = []
    while len(w) < n:
        w += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
    return w[:n] + (w[: rng.randint(0, n)] if rng.random() < 0.5 else [])


def plain_edges(w, up):
    n = len(w)
    suffix = [[(x if up else -x) for x in w[i:]] for i in range(n)]
    after = [next((j for j in range(i + 1, n) if suffix[j] < suffix[i]), n) for i in range(n)]

    def agree(i, j):
        k = 0
        while i + k < n and j + k < n and w[i + k] == w[j + k]:
            k += 1
        return k

    return after, [agree(i, j) for i, j in enumerate(after)]


def test_lyndon_edges_and_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        w = periodic(rng, rng.randint(0, 40), rng.choice([1, 2, 3, 4]))
        for up in (True, False):
            assert runs.edges(w, up) == plain_edges(w, up)
        for least, exponent in ((24, 3), (2, 2), (6, 3)):
            assert runs.runs_of(w, least, exponent) == runs.brute_force(w, least, exponent)


class Counted:
    n = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.n += 1
        return self.v == other.v

    def __ne__(self, other):
        Counted.n += 1
        return self.v != other.v

    def __gt__(self, other):
        Counted.n += 1
        return self.v > other.v

    __hash__ = None  # the words must never be hashed


def test_comparisons_are_linear_whatever_the_text():
    rng = random.Random(4)
    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a
    cube = "a"
    for d in range(8):
        cube = cube * 3 + chr(98 + d)
    for s in ("a" * 20_000, "ab" * 10_000, b, cube, ("a" * 150 + "b") * 130, "".join(rng.choice("ab") for _ in range(20_000)), "".join(rng.choice("abcd") for _ in range(9_000)) * 2):
        Counted.n = 0
        runs.runs_of([Counted(c) for c in s])
        assert Counted.n < 12 * len(s)


def run_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs.brute_force(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *told, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_op11_against_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in registry.op11_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: run_row(r.doc_id, r.text) for r in docs if len(r.text) < 6000}
    assert len(want) > 150 and len(got) == len(docs)
    assert all(got[i] == w for i, w in want.items())
    assert sum(w[1] > 0 for w in want.values()) > 5


def test_runs_keep_other_columns_and_stand_odd_texts(spark, frame):
    long_text = "x y " * 40_000 + "z"
    docs = frame([(1, None), (2, ""), (3, " \t\n"), (4, long_text), (5, "a b c " * 8), (5, "a b c " * 8), (None, "q " * 24), (6, "q " * 23)])
    out = {(r.doc_id, r.text_n): r for r in runs.find_runs(docs.withColumn("runs", F.lit(1)).withColumn("text_n", F.length("text"))).collect()}
    assert out[1, None].runs == out[2, 0].runs == out[3, 3].runs == [] and out[3, 3].collapsed == ""
    assert [tuple(r) for r in out[4, len(long_text)].runs] == [(0, 80_000, 2)] and out[4, len(long_text)].collapsed == "x y z"
    assert [tuple(r) for r in out[5, 48].runs] == [(0, 24, 3)] and out[5, 48].k == "x" and out[5, 48].h == 1
    assert [tuple(r) for r in out[None, 48].runs] == [(0, 24, 1)] and out[6, 46].runs == []
    assert runs.find_runs(docs.limit(0)).count() == 0 and runs.digest(runs.find_runs(docs)).count() == 8


def test_overlapping_runs_are_dropped_together():
    assert runs.kept_words(list("abcdefghij"), [(0, 6, 2), (3, 6, 1)]) == list("abj")
    assert runs.kept_words(list("abc"), []) == list("abc")


def test_checkpoints_find_every_cut():
    rng = random.Random(5)
    for _ in range(3000):
        s = "".join(rng.choice("aé漢😀b \t\n\x0b ") for _ in range(rng.randint(0, 40)))
        units = re.findall(f"{SPACE}*[^\x20\x09-\x0d]+|{SPACE}+", s)
        index = infill.Index(s.encode(), rng.choice([1, 2, 3, 7]), rng.choice([1, 2, 5, 64]))
        assert (index.n, index.points) == (len(units), len(s))
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.cut(u) == (len(head.encode()), len(head))


def test_the_index_is_sparse():
    index = infill.Index(b"word " * 100_000)
    assert index.n == 100_001 and len(index.byte) == len(index.point) <= 100_001 // infill.STEP + 1
    assert index.cut(77_777) == (77_777 * 5 - 1, 77_777 * 5 - 1)


def draws(doc_id):
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def test_infill_on_odd_texts(spark, frame):
    rows = [(i, "one two  three\tfour é漢😀 five ") for i in range(60)] + [(None, "a b"), (100, None), (101, ""), (102, "has <M> in it"), (103, "<<S <P"), (104, "x " * 50_000), (7, "again"), (7, "again")]
    out = infill.infill(frame(rows).withColumn("form", F.lit("old")), rate=100)
    got = sorted((str(r.doc_id), r.text_n, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.withColumn("text_n", F.col("n_chars")).collect())
    want = sorted((str(i), None if t is None else len(t), *infill.brute_force(t, draws(i), rate=100)) for i, t in rows)
    assert got == want and {r[3] for r in want} == {"plain", "psm", "spm"}
    back = out.where("text is not null") if "text" in out.columns else out
    shown = sorted(r.t for r in back.select(infill.restore(F.col("output"), F.col("form")).alias("t")).collect())
    assert shown == sorted(t or "" for _, t in rows)
    assert out.limit(0).count() == 0 and infill.infill(frame(rows).limit(0)).count() == 0


@pytest.mark.parametrize("wide", [1, 10**6, 2**40, 2**62])
def test_elias_fano_lists(wide):
    rng = np.random.default_rng(wide)
    for n in (0, 1, 2, 511, 512, 513, 5000):
        v = np.sort(rng.integers(-wide, wide, n))
        made, end = EliasFano.from_bytes(b"x" + EliasFano.of(v).to_bytes() + b"y", 1)
        assert (made.slice(0, n) == v).all()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (made.slice(a, b) == v[a:b]).all()
            if a < n:
                assert made.select(int(a)) == v[a]
    with pytest.raises(ValueError, match="ascend"):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(ValueError, match="cut short"):
        EliasFano.from_bytes(EliasFano.of(np.arange(9)).to_bytes()[:-1])


def test_elias_fano_is_near_minimal():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    size = 8 * len(EliasFano.of(bounds).to_bytes()) / len(bounds)
    assert size < 2.2 + np.log2(bounds[-1] / len(bounds))


def test_pieces_give_the_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        vocabulary = f.read()
    odd = ["<|endoftext|>a b<|startoftext|>", "x\x0by\x0cz\x1cq\x85r\xa0s t", "e ́ ΣΑΣ Σ", "", "  ", "it's  'S don't<|endof text|>", "a\x00b c", "word " * 20_000, "q" * 500, "a.b, c'. d'.' e.'s f!'s <|endoftext|>. x<|endoftext|>!! 12.5, \u0958. \u0958\u0958 \u01c5,", "\u0958\u0915 " * 3]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + odd
    whole = [e.ids + [2] for e in Tokenizer.from_str(vocabulary).encode_batch(texts, add_special_tokens=False)]
    for kept in (10**6, 50):  # with and without much to keep
        encoder = token_files.Encoder(vocabulary, 2, kept)
        for at in range(0, len(texts), 50):
            assert encoder.encode(pa.array(texts[at : at + 50])).to_pylist() == whole[at : at + 50]


def test_op13_against_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = [], 0
    for (i, _), e in zip(docs, tokenizer.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids = e.ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, registry.op13_token_files(spark, SF).collect())) == want


def test_token_files_round_trip_and_refuse_what_changed(spark, frame, tmp_path):
    rows = [(None, "null one"), (None, None), (-5, "below zero"), (3, "b"), (3, "b"), (3, "a c d"), (2**62, "far"), (7, "x " * 30_000), (8, "")]
    path = f"{tmp_path}/files"
    token_files.write(frame(rows), path)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -5, 3, 3, 3, 7, 8, 2**62]
    assert all(r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in got) and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert got[7].ids == [2]
    few = spark.read.format("token_files").option("path", path).option("docs", 2).load()  # tasks of two documents select their own boundaries
    assert few.rdd.getNumPartitions() >= 5 and sorted(map(str, few.collect())) == sorted(map(str, got))
    with pytest.raises(Exception, match="already"):
        token_files.write(frame(rows), path)
    # a file that no manifest names, as a lost task leaves it, is not read
    (tmp_path / "files/shard-lost.ids").write_bytes(b"12345678")
    assert token_files.read(spark, path).count() == len(rows)
    shard = json.loads((tmp_path / "files/manifest.json").read_text())["shards"][0]
    ids = tmp_path / f"files/{shard['name']}.ids"
    assert ids.stat().st_size == 2 * shard["ids"]  # 16 bits an id
    ids.write_bytes(ids.read_bytes()[:-2])
    with pytest.raises(Exception, match="not of the size"):
        token_files.read(spark, path).count()


def test_token_files_of_wide_ids_and_of_nothing(spark, frame, tmp_path):
    wide = spark.createDataFrame([(1, [70_000, 1]), (2, []), (3, [2**31 - 1])], "doc_id long, ids array<int>").coalesce(1)
    token_files.save(wide, f"{tmp_path}/wide")
    assert sorted(map(tuple, token_files.read(spark, f"{tmp_path}/wide").collect())) == [(1, 0, 2, [70_000, 1]), (2, 2, 0, []), (3, 2, 1, [2**31 - 1])]
    token_files.write(frame([(1, "a")]).limit(0), f"{tmp_path}/none")
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def test_fit_gives_back_what_the_driver_held(spark, monkeypatch):
    """The sample's features are given back before the stages go on; repeated ratings count as often as they stand."""
    from tidemark.llm import quality

    docs = spark.createDataFrame([(i, f"good plain words number {i}" if i % 2 else f"!!! $$$ {i} ###") for i in range(40)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, float(i % 2)) for i in range(40)] + [(3, 1.0)] * 2, "doc_id long, grade double")
    settled = []
    monkeypatch.setattr(quality, "settle", lambda: settled.append(True))
    answers, (ptr, *_) = quality.training_rows(docs, ratings, quality.style_features, ["grade"], 100)
    assert len(ptr) == 43 and answers.sum() == 22
    quality.fit(docs, ratings)
    assert settled == [True]
