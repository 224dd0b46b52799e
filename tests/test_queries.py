"""Every domain query with SQL against DuckDB; the others for their shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidemark.operators import ranking, sasrec, sequences
from tidemark.plans import registry
from tidemark.sources import driver_tables

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, con, name):
    same(spark, con, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_too_few_negatives_is_an_error(spark):
    parts = sequences.split(driver_tables.large_events(spark, SF))
    vocab = sequences.vocabulary(parts)
    held = sequences.targets(parts, vocab, "demo")
    with pytest.raises(Exception, match="too few negatives"):
        sequences.development_candidates(held, sequences.seen_items(parts), vocab, negatives=10_000).count()


def test_keyed_lookup_asks_for_the_customers_of_all_orders(spark, con):
    every = "SELECT row_number() OVER (ORDER BY k DESC) - 1 AS place, k AS c_custkey, c_name FROM (SELECT DISTINCT o_custkey AS k FROM orders) JOIN customer ON c_custkey = k"
    same(spark, con, SF, QUERIES["keyed_lookup"], every)


def test_padded_history_keeps_the_last_fifty_known_items(spark):
    parts = sequences.split(driver_tables.small_events(spark, SF))
    known = {r.item_id: r.model_index for r in sequences.vocabulary(parts).collect()}
    want = {}
    for r in sequences.histories(parts).collect():
        kept = [known[h.item_id] for h in r.history if h.item_id in known][-50:]
        if kept:
            want[r.user_id, r.split] = [0] * (50 - len(kept)) + kept
    got = {(r.user_id, r.split): [int(x) for x in r.padded.split(",")] for r in QUERIES["padded_history"](spark, SF).collect()}
    assert got == want and max(sum(x > 0 for x in v) for v in got.values()) > 20


def test_sequence_scores_come_from_the_sequence_model(spark):
    parts = sequences.split(driver_tables.small_events(spark, SF))
    known = {r.item_id: r.model_index for r in sequences.vocabulary(parts).collect()}
    weights = sasrec.random_weights(len(known), length=50)
    want, most = {}, 0
    for r in sequences.histories(parts).where("split = 'test'").collect():
        own = [known[h.item_id] for h in r.history if h.item_id in known]
        most = max(most, len(own))
        score = (sasrec.encode(np.array([[0] * (50 - len(own[-50:])) + own[-50:]]), weights) @ weights["item"].T)[0]
        want[r.user_id] = sorted((score[i] for i in known.values() if i not in own), reverse=True)[:10]
    got = {}
    for r in QUERIES["sequence_scores"](spark, SF).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.score)
    assert most > 50 and got.keys() == {u for u, x in want.items() if x}
    assert all(np.allclose(got[u], want[u], atol=2e-6) for u in got)


def test_every_candidate_of_a_large_run_has_a_rank(spark, monkeypatch):
    n = 1_000_001
    c = spark.range(n).select(F.lit(1).cast("bigint").alias("run_id"), F.when(F.col("id") == 0, "item:5").otherwise(F.concat(F.lit("other:"), "id")).alias("item_id"), F.col("id").cast("double").alias("score"))
    s = spark.createDataFrame([(1, "item:5", "segment_1", 0.5, "failed")], "run_id long, item_id string, segment_id string, value double, status string")
    monkeypatch.setattr(driver_tables, "scenario", lambda *_: (c, s))
    assert QUERIES["current_rank"](spark, SF).agg(F.count("*"), F.max("rank")).first() == (n, n)
    assert [r["rank"] for r in QUERIES["recommendation_state"](spark, SF).collect()] == [n]


def test_bench_keeps_its_slow_queries():
    import bench

    assert {"mostpop_top100", "train_negatives", "item_catalog", "memory_audit", "replay_violations"} <= set(bench.HEADLINE)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())


def test_walks_and_places_are_cut_short_before_they_become_rows(spark):
    vocab = spark.range(1, 301).selectExpr("concat('i', lpad(id, 3, '0')) AS item_id", "id AS model_index")
    ranked = vocab.withColumnRenamed("model_index", "g")
    held = spark.createDataFrame([("s1", "u1", "test", "i002", True), ("s2", "u2", "test", "i300", True), ("s3", "u3", "test", "cold", False)], "sample_id string, user_id string, split string, item_id string, warm boolean")
    seen = spark.createDataFrame([("u1", "test", i) for i in ("i001", "i002", "i004", "cold")], "user_id string, split string, item_id string")
    top = ranking.top_unseen(held, seen, ranked, 3)
    walked = sequences.development_candidates(held, seen, vocab, negatives=297)
    for df in (top, walked):  # rows of a target are neither numbered nor taken out by shuffles of them all
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.user_id, r.place, r.item_id) for r in top.collect()) == [("u1", 1, "i002"), ("u1", 2, "i003"), ("u1", 3, "i005"), ("u2", 1, "i001"), ("u2", 2, "i002"), ("u2", 3, "i003")]
    got = walked.collect()
    assert {r.item_id for r in got if r.user_id == "u1"} == {f"i{k:03}" for k in range(1, 301)} - {"i001", "i002", "i004"}
    assert sum(r.user_id == "u2" for r in got) == 297 and len({(r.sample_id, r.offset) for r in got}) == len(got) == 594 and min(r.offset for r in got) >= 0


def test_what_was_seen_meets_targets_without_a_sort(spark):
    parts = spark.createDataFrame([("u", i, p, s) for i, p, s in (("a", 1, "train"), ("b", 2, "train"), ("a", 3, "validation"), ("c", 4, "test"))], "user_id string, item_id string, pos long, split string")
    seen = sequences.seen_items(parts)
    assert "Join" not in seen._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in seen.collect()) == [("u", "test", "a"), ("u", "test", "b"), ("u", "validation", "a"), ("u", "validation", "b")]
    ranked = spark.createDataFrame([("b", 1), ("a", 2), ("d", 3)], "item_id string, g long")
    held = spark.createDataFrame([("s1", "u", "validation", "a", True), ("s2", "u", "test", "c", False), ("s3", "v", "test", "d", True)], "sample_id string, user_id string, split string, item_id string, warm boolean")
    got = {r.sample_id: (r["rank"], r.candidates) for r in ranking.target_ranks(held, seen, ranked).collect()}
    assert got == {"s1": (1, 2), "s2": (None, 0), "s3": (3, 3)}


def test_a_memory_view_replays_once(spark):
    df = QUERIES["memory_view"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("FlatMapGroups") == 0 and df.count() > 0


def test_validation_and_test_targets_have_development_candidates(spark):
    parts = sequences.split(driver_tables.large_events(spark, SF))
    held = sequences.targets(parts, sequences.vocabulary(parts), "demo")
    warm = {(r.user_id, r.split) for r in held.where("warm").collect()}
    past = {}
    for r in parts.collect():
        past.setdefault(r.user_id, []).append((r.pos, r.item_id))
    pos = {(r.user_id, r.split): r.pos for r in held.collect()}
    got = {}
    for r in QUERIES["dev_candidates"](spark, SF).collect():
        got.setdefault((r.user_id, r.split), []).append(r.item_id)
    assert {s for _, s in got} == {"validation", "test"} and got.keys() == warm
    for (user, split), items in got.items():
        assert len(set(items)) == len(items) == 100 and not set(items) & {i for p, i in past[user] if p <= pos[user, split]}
