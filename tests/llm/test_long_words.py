"""Words on which polynomial hashes modulo 2^64 agree whatever their base: the operators must tell them apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, neardup, search, substrings, suffixes

N = 2048
ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(N))
OTHER = "".join("ba"[bin(i).count("1") % 2] for i in range(N))


def text(word, n=35, name="w"):
    return " ".join(word if i == n // 2 else f"{name}{i}" for i in range(n))


def test_the_pair_breaks_plain_polynomials_and_not_the_words():
    raw = np.frombuffer(f"{ONE} {OTHER}".encode(), np.uint8)
    prefix = blocks.prefix_hash(blocks.BYTE[raw])
    plain = blocks.span_hash(prefix, np.array([0, N + 1]), np.array([N, 2 * N + 1]))
    assert plain[0] == plain[1]  # why the digest is needed
    for lower in (True, False):
        h = blocks.words(raw, np.array([0, len(raw)]), lower)[0]
        assert h[0] != h[1]


def test_substrings_keep_what_is_not_repeated(frame):
    rows = [(1, text(ONE)), (2, text(OTHER)), (3, text(ONE) + " tail")]
    want = substrings.brute_force(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame(rows)).collect()}
    assert got == {i: want[n] for n, (i, _) in enumerate(rows)} and got[2][1] == 0 and got[1][1] == 35


@pytest.mark.parametrize("hot", [1, 10_000])
def test_suffixes_keep_what_is_not_repeated(frame, hot):
    rows = [(1, "x" * 30 + ONE + "y" * 400), (2, "x" * 30 + OTHER + "y" * 400), (3, "x" * 30 + ONE[:300] + "z" * 200)]
    want = suffixes.brute_force(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame(rows), hot=hot).collect()}
    assert got == {i: want[n] for n, (i, _) in enumerate(rows)}


def test_search_takes_them_for_two_terms(spark):
    docs = spark.createDataFrame([(0, f"{ONE} only"), (1, f"{OTHER} here"), (2, f"{ONE} there"), (3, "none of them")], "doc_id long, text string")
    got = {(r.query_id, r.doc_id) for r in search.search(docs, F.col("doc_id") == 0).collect()}
    assert got == {(0, 2)}


def test_near_duplicates_take_them_for_two_shingles(frame):
    # 36 shingles of five words, five of which hold the word: 31 of 41 are shared, less than 0.8
    rows = [(1, text(ONE, 40)), (2, text(OTHER, 40)), (3, text(ONE, 40) + " more"), (4, text("plain", 40, "v"))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
