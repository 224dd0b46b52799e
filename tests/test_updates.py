"""Evidence and observation updates: by hand, batch against SQL-free brute force, and the stream against the batch."""

import random

from pyspark.sql import functions as F

from tidemark.operators import failures, updates as U
from tidemark.sources import driver_tables
from tidemark.streaming import updates as live

SF = "/root/testdata/sf0.001"
RESULT = "run_id long, step long, item_id string, segment_id string, status string, evidence_id string, reason string"


def frames(spark, results):
    items = spark.createDataFrame([(r, i) for r in (1, 2) for i in ("a", "b")], "run_id long, item_id string")
    segments = spark.createDataFrame([(r, i, g) for r in (1, 2) for i in ("a", "b") for g in ("s1", "s2")], "run_id long, item_id string, segment_id string")
    return items, segments, spark.createDataFrame(results, RESULT)


def ok(run, step, item, segment, evidence):
    return run, step, item, segment, "succeeded", evidence, None


def test_each_problem_has_its_name_and_ends_its_run(spark):
    cases = {
        U.STEP: ok(1, 0, "a", "s1", "e"), U.ITEM: ok(1, 1, "z", "s1", "e"), U.SEGMENT: ok(1, 1, "a", "s9", "e"), U.STATUS: (1, 1, "a", "s1", "seen", "e", None),
        U.NO_EVIDENCE: (1, 1, "a", "s1", "succeeded", None, None), U.STRAY_EVIDENCE: (1, 1, "a", "s1", "failed", "e", "why"), U.NO_REASON: (1, 1, "a", "s1", "failed", None, None),
    }
    for name, bad in cases.items():
        items, segments, results = frames(spark, [bad, ok(1, 2, "b", "s1", "f"), ok(2, 1, "a", "s1", "e")])
        got = {(r.run_id, r.step): (r.problem, r.applied) for r in U.judge(results, items, segments).collect()}
        assert got == {(1, bad[1]): (name, False), (1, 2): (None, False), (2, 1): (None, True)}


def test_later_results_meet_the_earlier_ones(spark):
    rows = [ok(1, 1, "a", "s1", "e1"), ok(1, 2, "a", "s2", "e1"), ok(1, 3, "a", "s1", "e3"), ok(2, 1, "a", "s1", "e1"), ok(2, 1, "b", "s1", "e2"), ok(2, 2, "b", "s2", "e4")]
    items, segments, results = frames(spark, rows + rows)  # delivered twice: no result is a problem by that
    judged = U.judge(results, items, segments)
    got = {tuple(r)[:4]: (r.problem, r.applied) for r in judged.collect()}
    assert got == {
        (1, 1, "a", "s1"): (None, True), (1, 2, "a", "s2"): (U.USED, False), (1, 3, "a", "s1"): (U.AGAIN, False),
        (2, 1, "a", "s1"): (None, True), (2, 1, "b", "s1"): (U.TAKEN, False), (2, 2, "b", "s2"): (None, False),
    }
    evidence = {(r.run_id, r.item_id): r.evidence_ids for r in U.evidence_state(judged, items).collect()}
    assert evidence == {(1, "a"): ["e1"], (1, "b"): [], (2, "a"): ["e1"], (2, "b"): []}
    seen = {(r.run_id, r.item_id, r.segment_id): tuple(r)[3:] for r in U.observation_state(judged, segments).collect()}
    assert seen[1, "a", "s1"] == ("succeeded", 1, ["e1"], None, 1) and seen[1, "a", "s2"] == ("unobserved", 0, [], None, None) and len(seen) == 8
    asked = {r.run_id: tuple(r)[1:] for r in U.state_requests(judged, items, segments, 2).collect()}
    assert asked == {1: (1, 1, 2, 1, 3, U.USED), 2: (1, 1, 2, 1, 3, U.TAKEN)}


def by_hand(results, items, segments):
    out = {}
    for run in {r[0] for r in results}:
        log, seen, running = {}, set(), True
        mine = sorted({r[1:] for r in results if r[0] == run}, key=lambda r: [(x is not None, x) for x in r])
        for r in mine:
            step, item, segment, status, evidence, reason = r
            own = None
            if step < 1:
                own = U.STEP
            elif (run, item) not in items:
                own = U.ITEM
            elif (run, item, segment) not in segments:
                own = U.SEGMENT
            elif status == "failed" and reason is None:
                own = U.NO_REASON
            if own is None:
                keys = [(("step", step), U.TAKEN), (("look", item, segment), U.AGAIN)] + ([(("use", evidence), U.USED)] if evidence else [])
                own = next((p for k, p in keys if k in seen), None)
                seen |= {k for k, _ in keys}
            running &= own is None
            log[r] = own, running
        out |= {(run, *r): v for r, v in log.items()}
    return out


def test_driver_feed_against_loops(spark):
    items, segments, results = driver_tables.observation_results(spark, SF)
    want = by_hand([tuple(r) for r in results.collect()], {tuple(r) for r in items.collect()}, {tuple(r) for r in segments.collect()})
    got = {tuple(r)[:7]: (r.problem, r.applied) for r in U.judge(results, items, segments).collect()}
    assert got == want and {p for p, _ in want.values()} >= {None, U.ITEM, U.SEGMENT, U.NO_REASON, U.TAKEN, U.USED}


def test_stream_of_a_shuffled_repeated_feed_equals_the_batch(spark, tmp_path):
    items, segments, results = driver_tables.observation_results(spark, SF)
    few = [t.where("run_id < 300") for t in (items, segments, results)]
    rows = [tuple(r) for r in few[2].collect()] * 2
    random.Random(8).shuffle(rows)
    feed, schema = tmp_path / "feed", few[2].schema
    for i in range(4):
        part = rows[i::4]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(feed))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, df in (("items", few[0]), ("segments", few[1])):
            df.write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(feed))
        told = live.judge_stream(stream, spark.read.parquet(str(tmp_path / "items")), spark.read.parquet(str(tmp_path / "segments")))
        out, check = str(tmp_path / "out"), str(tmp_path / "check")
        run = told.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", check).trigger(availableNow=True).start()
        run.awaitTermination(300)
        assert run.exception() is None
    finally:
        spark.conf.unset(store)
    changes = spark.read.parquet(out)
    want = sorted(map(str, ((str(r[0]), *r[1:]) for r in map(tuple, U.judge(few[2], few[0], few[1]).collect()))))
    assert sorted(map(str, map(tuple, live.current(changes).collect()))) == want
    assert changes.agg(F.max("revision")).first()[0] > 1 and changes.count() > len(want)  # results that came late changed what was said


def test_snapshot_invariants(spark):
    items, segments, results = frames(spark, [ok(1, 1, "a", "s1", "e1"), (1, 2, "b", "s1", "failed", None, "dark"), ok(2, 1, "b", "s2", "e2")])
    judged = U.judge(results, items, segments)
    seen = U.observation_state(judged, segments)
    evidence = judged.where("applied and evidence_id is not null").select("run_id", "evidence_id", "item_id", "segment_id")
    ranks = spark.createDataFrame([(r, i, n, n, s) for r in (1, 2) for i, n, s in (("a", 1, 0.9), ("b", 2, 0.3))], "run_id long, item_id string, initial_rank int, current_rank int, score double")
    asked = U.state_requests(judged, items, segments, 2).withColumn("margin", F.lit(0.6))

    def found(e=evidence, o=seen, c=ranks, q=asked):
        return {(r.run_id, r.subject, r.problem) for r in U.snapshot_violations(e, o, c, q, 2).collect()}

    assert found() == set()
    assert found(e=evidence.where("run_id = 1")) == {(2, "e2", "an observation names unknown evidence")}
    assert found(e=evidence.withColumn("segment_id", F.lit("s1"))) == {(2, "e2", "evidence of another segment")}
    assert found(o=seen.where("run_id = 1")) == {(2, "e2", "evidence that no observation names")}
    assert found(o=seen.withColumn("failure_reason", F.lit(None).cast("string"))) == {(1, "b/s1", "an observation's status and its parts disagree")}
    assert found(c=ranks.withColumn("current_rank", F.col("current_rank") + F.when(F.col("item_id") == "b", 1).otherwise(0))) >= {(1, "current_rank", "ranks are not 1 to n")}
    assert found(c=ranks.withColumn("score", F.when(F.col("run_id") == 1, -F.col("score")).otherwise(F.col("score")))) == {(1, "a", "a rank is not in order of score"), (1, "margin", "the margin is not that of the two best")}
    assert found(q=asked.withColumn("remaining", F.lit(1))) == {(1, "remaining", "remaining is not the budget less the steps")}


def test_a_failure_of_every_role_ends_its_own_run_alone(spark):
    cases = {
        1: ([ok(1, 1, "a", "s1", "e1"), ok(1, 2, "a", "s2", "e2")], ("completed", None, None, None, 2, 2)),
        2: ([ok(2, 1, "a", "s1", "e1"), (2, 2, "b", "s1", "failed", None, None), ok(2, 3, "b", "s2", "e3")], ("failed", failures.PERCEPTION, U.NO_REASON, 2, 1, 1)),
        3: ([ok(3, 1, "a", "s1", "e1"), ok(3, 2, "b", "s1", "e1")], ("failed", failures.EVIDENCE, U.USED, 2, 1, 1)),
        4: ([ok(4, 1, "a", "s1", "e1"), ok(4, 2, "a", "s1", "e2")], ("failed", failures.OBSERVATION, U.AGAIN, 2, 1, 1)),
        5: ([ok(5, 1, "a", "s1", "e1"), ok(5, 2, "b", "s1", "lost"), ok(5, 3, "b", "s2", "e3")], ("failed", failures.SCORES, "no delta for lost", 2, 2, 2)),
        6: ([], ("failed", failures.RANKER, "the run has no candidates", None, 0, 0)),
    }
    runs = spark.createDataFrame([(r,) for r in cases], "run_id long")
    items = spark.createDataFrame([(r, i) for r in (1, 2, 3, 4, 5) for i in ("a", "b")], "run_id long, item_id string")
    segments = spark.createDataFrame([(r, i, g) for r in cases for i in ("a", "b") for g in ("s1", "s2")], "run_id long, item_id string, segment_id string")
    results = spark.createDataFrame([x for rows, _ in cases.values() for x in rows], RESULT)
    deltas = spark.createDataFrame([("e1", 0.5, -0.1), ("e2", 0.25, -0.05), ("e3", 1.0, -1.0)], "evidence_id string, own double, other double")
    scored = failures.with_scores(U.judge(results, items, segments), deltas)
    assert {r.run_id: tuple(r)[1:] for r in failures.outcomes(runs, items, scored).collect()} == {r: w for r, (_, w) in cases.items()}
    initial = items.withColumn("score", F.lit(1.0))
    got = {(r.run_id, r.item_id): r.score for r in failures.scores(initial, scored).collect()}
    assert got[1, "a"] == 1.75 and got[1, "b"] == 0.85 and got[5, "a"] == 1.5 and got[5, "b"] == 0.9 and len(got) == 10  # the partial state has the scores before


def test_runs_of_any_size_are_judged_alike_and_shuffled_once(spark):
    items, segments, results = driver_tables.observation_results(spark, SF)
    told = lambda df: sorted(map(str, df.collect()))
    whole = U.judge(results, items, segments)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    # the distinct items, the distinct segments, and the rows of all kinds by their run
    assert plan.count("Exchange hashpartitioning") == 3
    assert told(whole) == told(U.judge(results, items, segments, most=12)) == told(U.judge(results, items, segments, most=0))


def test_states_follow_from_the_rows_of_one_shuffle(spark):
    rows = driver_tables.observation_rows(spark, SF)
    items, segments, results = driver_tables.observation_results(spark, SF)
    told = lambda df: sorted(map(str, df.collect()))
    judged = U.judge(results, items, segments)
    for most in (U.MOST, 0):
        feed = U.tell(rows, most)
        for one, want in ((U.judged_of(feed), judged), (U.evidence_of(feed), U.evidence_state(judged, items)), (U.observations_of(feed), U.observation_state(judged, segments))):
            assert most == 0 or one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
            assert told(one) == told(want)
