"""The registered SQL on the driver's tables, plain versions of the fitted models, pruning counts, and odd tables and columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import prose
from tests.oracle import connect, same
from tidemark.llm import decontaminate, mixing, neardup, quality, registry, search, secrets, substrings, suffixes, tokens, toxicity
from tidemark.llm.features import sigmoid

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_registered_sql(spark, name):
    same(spark, connect(SF), SF, registry.queries()[name], registry.oracle_sql()[name])


def dense(rng, n, width):
    x = (rng.random((n, width)) < 0.3) * rng.random((n, width))
    row, column = np.nonzero(x)
    return x, np.searchsorted(row, np.arange(n + 1)), column, x[row, column]


def plain_minimum(loss, size):
    """Gradient descent on numeric gradients, from nothing of the module."""
    p, step = np.zeros(size), 0.5
    for _ in range(3000):
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(size) * 1e-5])
        while loss(p - step * g) > loss(p) - 0.5 * step * (g @ g) and step > 1e-9:
            step /= 2
        p, step = p - step * g, min(step * 1.5, 1.0)
        if np.abs(g).max() < 1e-4:
            break
    return p


def test_ordinal_fit_against_the_plain_likelihood():
    rng = np.random.default_rng(5)
    x, ptr, column, value = dense(rng, 120, 3)
    y = (rng.random(120)[:, None] < sigmoid((x @ [2.0, -1.0, 1.0])[:, None] - np.array([-0.5, 0.8]))).sum(1)

    def loss(p):
        w, cut = p[:3], np.array([p[3], p[3] + np.exp(p[4])])
        at_least = np.hstack([np.ones((120, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - cut))), np.zeros((120, 1))])
        return -sum(np.log(at_least[i, g] - at_least[i, g + 1]) for i, g in enumerate(y)) + 0.5 * (w @ w)

    model = quality.fit_ordinal(ptr, column, value, y, np.arange(3), 1.0, 3)
    p = plain_minimum(loss, 5)
    assert np.allclose(model.weights, p[:3], atol=0.02) and np.allclose(model.thresholds, [p[3], p[3] + np.exp(p[4])], atol=0.02)
    tails = model.tails(x @ model.weights)
    assert np.allclose(model.expected(tails), tails.sum(1)) and np.allclose(model.tail(tails, 2), tails[:, 1])


def test_chain_against_the_plain_likelihood(monkeypatch):
    monkeypatch.setattr(toxicity, "SCREEN", 0.0)
    rng = np.random.default_rng(6)
    n, ridge = 80, 1.0
    x, ptr, column, value = dense(rng, n, 2)
    first = (rng.random(n) < sigmoid(x @ [3.0, -2.0])).astype(float)
    second = (rng.random(n) < sigmoid(x @ [-1.0, 2.0] + 2 * first - 1)).astype(float)

    def fit(before, y, rows):
        z = np.hstack([x[rows], toxicity._logit(before[rows])])

        def loss(p):
            q = 1 / (1 + np.exp(-(z @ p[:-1] + p[-1])))
            return -(y[rows] * np.log(q) + (1 - y[rows]) * np.log(1 - q)).sum() + 0.5 * ridge * (p[:-1] @ p[:-1])

        p = plain_minimum(loss, z.shape[1] + 1)
        return p, lambda at, b: 1 / (1 + np.exp(-(np.hstack([x[at], toxicity._logit(b[at])]) @ p[:-1] + p[-1])))

    none, every = np.empty((n, 0)), np.arange(n)
    held_out = np.zeros((n, 1))
    for f in range(2):  # a document's own label never reaches the probability that the second link learns from
        held_out[every % 2 == f, 0] = fit(none, first, every[every % 2 != f])[1](every[every % 2 == f], none)
    want = [fit(none, first, every)[0], fit(held_out, second, every)[0]]
    chain = toxicity.fit_chain(ptr, column, value, np.arange(2), np.stack([first, second], 1), folds=2, ridge=ridge, dim=2)
    for link, p in zip(chain, want, strict=True):
        assert np.allclose([*link.weights, *link.chain, link.intercept], p, atol=0.02)


def test_search_skips_blocks(spark):
    topics = [(100 * t + i, " ".join(f"t{t}w{(i * 7 + j) % 30}" for j in range(20)) + f" all{i % 5}") for t in range(20) for i in range(100)]
    docs = spark.createDataFrame(topics, "doc_id long, text string").coalesce(1)
    row = search.build_index(docs).collect()[0].asDict()
    vocabulary = np.unique(np.concatenate([search.term_counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1] for _, t in topics]))
    shard = search.Shard(row, vocabulary, 21.0)
    queries = [(i, shard.place[np.searchsorted(vocabulary, np.unique(search.term_counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1]))], np.ones(21)) for i, t in topics[::100]]
    got = shard.search(queries, 5, np.zeros(len(queries)))
    assert shard.pairs == 20 * shard.blocks and 0 < shard.read < shard.pairs / 3  # most blocks are never read by a query
    for (own, terms, weights), (s, d) in zip(queries, got, strict=True):
        full = np.zeros(len(shard.column))
        full[terms] = weights
        plain = np.array([(full[shard.own_term[a:b]] * shard.own_impact[a:b]).sum() for a, b in zip(shard.own_ptr, shard.own_ptr[1:], strict=False)])
        plain[shard.doc_id == own] = 0
        assert np.allclose(np.sort(s)[::-1][:5], np.sort(plain)[::-1][:5], atol=1e-8)


CLASH = "_bad string, _k string, _key long, _row int, doc string, row long, i long, hash string, class long, place string, budget long, extra map<string,int>, times int"


def odd(spark, n=40):
    rng = random.Random(12)
    long_text = prose(rng, 60_000, 10**5) + " token=abcdef123456 " * 300
    rows = [(i, prose(rng, 50, 10**4), "en", "src1", 5) for i in range(n)] + [(None, None, None, None, None), (None, "", "en", "s", 0), (5, long_text, "en", "src2", 7), (6, "token=abcdef123456", "en", "src9", 18), (6, "token=abcdef123456", "en", "src9", 18)]
    full = [(*r, "a", "b", 1, 2, "c", 3, 4, "d", 5, "e", 6, {"x": 1}, 7) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


def test_clashing_columns_come_back_as_they_were(spark):
    docs = odd(spark)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta " * 20)], "item_id long, text string")
    dirty = docs.withColumn("text", F.when(F.col("doc_id") == 3, "alpha beta gamma").otherwise(F.col("text")))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    plain = sorted(map(str, dirty.where("doc_id is null or doc_id <> 3").select(*others).collect()))
    for block_words in (10**6, 3):
        kept = decontaminate.clean(dirty, bench, block_words=block_words)
        assert kept.columns == docs.columns and sorted(map(str, kept.select(*others).collect())) == plain
    red = secrets.redact(docs)
    assert red.columns == docs.columns and sorted(map(str, red.select(*others).collect())) == sorted(map(str, docs.select(*others).collect()))
    assert red.where("doc_id = 6 and text = '[SECRET]' and n_chars = 8").count() == 2
    assert red.where("doc_id = 5 and contains(text, 'abcdef123456')").count() == 0
    bare = secrets.redact(docs.drop("source", "lang"))
    assert bare.count() == docs.count()
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns and one.count() == 40 + 3  # nulls and empties are one, the repeated row is one
    good = quality.keep_good(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert good.columns == docs.columns and good.count() == docs.count()


def test_odd_tables_do_not_stop_any_operator(spark):
    docs, labels = odd(spark), spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    for table in (docs, docs.limit(0)):
        n = table.count()
        assert suffixes.remove_repeats(table).count() == n and substrings.remove_repeats(table).count() == n
        assert decontaminate.decontaminate(table, bench).count() == n and secrets.judge(table).count() == n
        assert toxicity.predict(table, registry.toxic_labels(labels), ["junk", "toxic"]).count() == n
        assert quality.classify(table, registry.grades(labels)).count() == n and tokens.count_tokens(table).count() == n
        assert neardup.near_duplicates(table).count() == n
        assert mixing.mix(table, registry.mix_levels(), registry.MIX_WEIGHTS).count() <= 2 * n
        assert search.search(table, F.col("doc_id") % 3 == 0).count() >= 0


def test_training_rows_are_bounded_by_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, grade int")
    answers, _ = quality.training_rows(docs, labels, quality.style_features, ["grade"], 10)
    assert answers[:, 0].tolist() == [1, 1, 0]


def test_mixing_stage_takes_what_the_stage_before_kept(spark, tmp_path):
    docs = odd(spark).where("text is not null")
    got = corpus_pipeline.mixing(spark, docs, SF).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
