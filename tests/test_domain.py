"""Small known answers, broken inputs, tampering and whole lifecycles."""

import hashlib
import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import scalar as S
from tidemark.operators import agent, artifacts, catalog, constraints as C, ingest, memory, sasrec, sequences as Q
from tidemark.plans import registry
from tidemark.sources import files
from tidemark.streaming import live

A, B, C_ = (1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)
DAY = K.DAY_MS


def observe(spark, rows):
    data = [("u", "c", i, t, f"item{v}", list(v)) for i, (v, t) in enumerate(rows)]
    return memory.replay(spark.createDataFrame(data, "user_id string, cutoff string, interaction_index long, occurred_at_ms long, item_id string, vector array<double>"))


def states(df, kind):
    return sorted(r.state for r in df.where(F.col("kind") == kind).collect())


def test_memory_promotes_matches_and_fades(spark):
    got = observe(spark, [(v, i * 1000) for i, v in enumerate([A, A, B, B, A, A, A, A, C_])]).cache()
    snap = got.where("kind = 'snapshot'").first()
    assert (snap.promotions, snap.observed) == (2, 9)
    assert states(got, "match") == ["emerging", "fading", "stable", "stable", "stable", "stable"]
    assert sum(s in ("stable", "fading") for s in states(got, "track")) == 2
    recent = [r.medoid_index for r in got.where("kind = 'match' and other_id is not null").orderBy("place").collect()]
    assert recent == [8, 7, 6, 5, 4]


def test_same_time_does_not_promote(spark):
    got = observe(spark, [(A, 5), (A, 5)])
    snap = got.where("kind = 'snapshot'").first()
    assert snap.promotions == 0 and snap.new_drift == 1.0 and states(got, "track") == ["pending"]


def test_dormant_track_revives(spark):
    asleep = [(A, 0), (A, 1), (B, 40 * DAY)]
    assert "inactive" in states(observe(spark, asleep), "track")
    assert "inactive" not in states(observe(spark, [*asleep, (A, 40 * DAY + 1)]), "track")


def runs(spark, n=40):
    rng = random.Random(3)
    c = [(r, f"i{j}", round(rng.random(), 3)) for r in range(n) for j in range(rng.randrange(1, 5))]
    s = [(r, i, f"s{j}", round(rng.random(), 3), rng.choice(["succeeded", "failed"])) for r, i, _ in c for j in range(rng.randrange(0, 3))]
    return spark.createDataFrame(c, "run_id long, item_id string, score double"), spark.createDataFrame(s, "run_id long, item_id string, segment_id string, value double, status string")


def loop_by_hand(c, s, budget):
    scores, open_, actions, ok = {i: x for i, x in c}, {(i, g): (v, t) for i, g, v, t in s}, 0, []
    for step in range(budget + 1):
        now = {i: round(x + sum(0.1 if e == i else -0.01 for e in ok), 12) for i, x in scores.items()}
        rank = sorted(now, key=lambda i: (-now[i], i))
        margin = round(now[rank[0]] - now[rank[1]], 12) if len(rank) > 1 else None
        top = (rank[0], round(now[rank[0]], 6))
        if step == budget:
            return actions, K.BUDGET, *top
        if not open_:
            return actions, K.NO_SEGMENTS, *top
        if margin is not None and margin >= K.MARGIN_THRESHOLD:
            return actions, K.CERTAIN, *top
        best = min(open_, key=lambda k: (-open_[k][0], k))
        if open_[best][0] < K.MIN_VALUE:
            return actions, K.TOO_LOW, *top
        actions += 1
        if open_.pop(best)[1] == "succeeded":
            ok.append(best[0])


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_decision_loop(spark, budget):
    c, s = runs(spark)
    played = agent.play(agent.runs(c, s), budget).cache()
    got = {r.run_id: tuple(r)[1:] for r in agent.results(played).collect()}
    cs, ss = c.collect(), s.collect()
    assert got == {k: loop_by_hand([tuple(r)[1:] for r in cs if r.run_id == k], [tuple(r)[1:] for r in ss if r.run_id == k], budget) for k in {r.run_id for r in cs}}
    assert agent.violations(agent.trace(played), c, s, budget).count() == 0


@pytest.mark.parametrize(
    "column, value, problem",
    [
        ("value", "value - 0.5", None),
        ("margin", "coalesce(margin + 0.2, 1)", "margin does not follow from the scores"),
        ("result", "if(result = 'failed', 'succeeded', 'failed')", "the result is not the segment's"),
        ("reason", f"if(reason = '{K.BUDGET}', '{K.NO_SEGMENTS}', reason)", "budget reason and budget disagree"),
        ("decision_index", "decision_index * 2 + 1", "decision indexes are not contiguous"),
        ("segment_id", "'none'", "the result is not the segment's"),
    ],
)
def test_tampered_traces_are_found(spark, column, value, problem):
    c, s = runs(spark)
    steps = agent.trace(agent.play(agent.runs(c, s)))
    kind = dict(steps.dtypes)[column]
    found = {r.problem for r in agent.violations(steps.withColumn(column, F.expr(value).cast(kind)), c, s).collect()}
    assert found and (problem is None or problem in found)


def test_constraints_fire(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, 3), ("a", 3, None), ("b", 0, None)], "g string, i long, t long")
    assert [r.g for r in C.not_contiguous(df, "g", "i").collect()] == ["a"]
    assert [r.g for r in C.partly_timed(df, "g", "t").collect()] == ["a"]
    assert C.out_of_order(df, "t", "i", "g").count() == 1
    assert C.duplicates(df, ["i"]).count() == 1
    with pytest.raises(ValueError, match="twice"):
        C.enforce(C.duplicates(df, ["i"]), "twice")
    scattered = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), ("z", 4), ("z", 5)], "k string, o long")
    assert [r.k for r in C.scattered(scattered, ["k"], "o").collect()] == ["x"]


def test_order_ties_are_broken(spark):
    rows = [("a", 1, 2, 5), ("a", 1, 1, 9), ("a", 2, 0, 7), ("b", 1, 1, 3), ("b", 1, 2, 4)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "g string, i long, j long, t long")
        assert [(r.g, r.i, r.j) for r in C.out_of_order(df, "t", ["i", "j"], "g").collect()] == [("a", 1, 2)]


def test_order_of_a_whole_table(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 7, 7, 6, 9, 1, 2])], "o long, k long").repartition(4)
    assert sorted((r.o, r.k, r.before) for r in C.out_of_order(df, "k", "o").collect()) == [(3, 6, 7), (5, 1, 9)]
    assert C.out_of_order(df.limit(0), "k", "o").count() == 0


def test_label_precedence(spark):
    rows = spark.createDataFrame([(True, 9.0, True), (False, 3.0, False), (False, 3.1, False), (False, None, True), (False, None, False)], "hate boolean, value double, action boolean")
    assert [r.label for r in Q.labelled(rows).collect()] == [K.NEGATIVE, K.PASSIVE, K.POSITIVE, K.POSITIVE, K.PASSIVE]


def test_negatives_of_users_who_hold_nearly_everything(spark):
    n, held = 400, {"hot": set(range(2, 401)), "warm": set(range(1, 391)), "cool": {7}}
    samples = [(f"s{u}{i}", u) for u in held for i in range(12)]
    own = spark.createDataFrame([(u, i) for u, x in held.items() for i in x], "user_id string, model_index long")
    vocab = spark.range(1, n + 1).select(F.col("id").alias("model_index"))
    want = {}
    for s, u in samples:
        counter = 0
        while True:
            text = f'{{"counter":{counter},"epoch":1,"negative_index":0,"recipe":"{K.NEGATIVE_RECIPE}","sample_id":"{s}","training_seed":7}}\n'
            found = int(hashlib.sha256(text.encode()).hexdigest()[:16], 16) % n + 1
            if found not in held[u]:
                break
            counter += 1
        want[s] = (counter, found)
    given = spark.createDataFrame(samples, "sample_id string, user_id string")
    got = Q.training_negatives(given, own, vocab, 7, 1)
    assert {r.sample_id: (r.counter, r.model_index) for r in got.collect()} == want and max(want.values())[0] > 128
    everything = own.unionByName(spark.createDataFrame([("hot", 1)], own.schema))
    with pytest.raises(Exception, match="whole vocabulary"):
        Q.training_negatives(given, everything, vocab, 7, 1).collect()


def test_category_cycle_is_an_error(spark):
    tree = spark.createDataFrame([("a", "b", 2, "A"), ("b", "a", 2, "B"), ("c", "x", 2, "C")], "category_id string, parent_id string, level int, name string")
    assert [r.path for r in ingest.category_paths(tree.where("category_id = 'c'")).collect()] == [None]
    with pytest.raises(Exception, match="cycle"):
        ingest.category_paths(tree).count()


def test_scalars(spark):
    one = spark.range(1)
    digest = "f" * 64
    assert one.select(S.hex_mod(F.lit(digest), 1, 4, F.lit(1009).cast("bigint"))).first()[0] == int("f" * 32, 16) % 1009
    assert one.select(S.canonical_json(b=F.lit(None).cast("int"), a=F.lit("é"))).first()[0] == '{"a":"é","b":null}\n'
    assert [one.select(S.parse_int(F.lit(x))).first()[0] for x in ("0", "07", "+1", "12", " 1", "")] == [0, None, None, 12, None, None]
    assert S.portable_path_problem("a/b.json") is None and all(S.portable_path_problem(p) for p in ("", "/a", "a//b", "../a", "con/x", "a\\b", "a."))
    text = one.select(F.lit(" é ").alias("t")).unionByName(one.select(F.lit("a\x07b").alias("t"))).unionByName(one.select(F.lit("  ").alias("t")))
    assert sorted((r.value or "", r.reason or "") for r in catalog.normalize_texts(text, "t", 8).collect()) == [("", "invalid"), ("", "missing"), ("é", "")]


def test_files_and_releases(spark, tmp_path):
    path = tmp_path / "raw.csv"
    line = lambda n, title: ",".join(["u1", f"p{n}", "a", "c", "2", "r", "r", "1700000000", "5", "3.5", "10", *["False"] * 7, "tag", title, "01", "20231115", *["x"] * 6])
    path.write_text(",".join(K.RAW_COLUMNS) + "\n" + line(1, '"two\nlines"') + "\n" + line(2, "plain") + "\n", encoding="utf-8")
    rows = files.raw_csv(spark, str(path))
    assert [(r.ordinal, r.title) for r in rows.orderBy("ordinal").collect()] == [(2, "two\nlines"), (3, "plain")]
    typed = files.typed_interactions(rows.withColumn("hate", F.when(F.col("pid") == "p2", "false").otherwise(F.col("hate"))))
    assert [r.problem for r in typed.orderBy("ordinal").collect()] == [None, "hate"]
    items = spark.createDataFrame([("b", "{}"), ("a", None)], "item_id string, metadata string")
    files.write_json_lines(items, str(tmp_path / "items"))
    assert files.json_lines(spark, str(tmp_path / "items"), files.ITEM).count() == 2
    assert files.not_canonical(spark, str(tmp_path / "items"), files.ITEM).count() == 0
    found = files.file_identities(spark, str(tmp_path / "items"))
    assert files.unverified(found, found).count() == 0
    assert files.unverified(found, found.withColumn("sha256", F.lit("0"))).count() == found.count()
    root = str(tmp_path / "releases")
    version, created = artifacts.publish(spark, root, {"items": items}, {"recipe": "r1"})
    assert created and artifacts.publish(spark, root, {"items": items.orderBy("item_id")}, {"recipe": "r1"}) == (version, False)
    assert artifacts.load(spark, root, version)["items"].count() == 2
    items.limit(1).write.mode("overwrite").parquet(f"{artifacts.folder(root, version)}/items")
    with pytest.raises(ValueError, match="was changed"):
        artifacts.load(spark, root, version)


def test_sequence_model(spark):
    w = sasrec.random_weights(30, dim=8, length=6)
    history = np.array([[0, 0, 3, 5, 7, 9], [0, 0, 0, 0, 0, 4]])
    assert np.allclose(sasrec.encode(history, w)[0], sasrec.encode(history[:1], w)[0], atol=1e-5)
    rows = spark.createDataFrame([(f"u{i}", h.tolist()) for i, h in enumerate(history)], "user_id string, padded array<long>")
    got = sasrec.score_users(rows, w, 5).toPandas()
    assert len(got) == 10 and not set(got[got.user_id == "u0"].model_index) & {0, 3, 5, 7, 9}


def test_streams_equal_batches(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.windowed_counts(stream, late="100 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).count()
    assert spark.table("w").count() == want and spark.table("w").agg(F.sum("n")).first()[0] == batch.count()


def test_two_cutoffs_are_one_replay_and_equal_two(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    schema = "user_id string, cutoff string, interaction_index long, occurred_at_ms long, item_id string, vector array<double>"
    part = lambda cutoff, n: [("u", cutoff, i, i * 3600_000, f"item{i}", v[i].tolist()) for i in range(n)]
    other = [("u", "other", i + 100, i * 3600_000, f"item{i}", v[i].tolist()) for i in range(7)]  # no prefix of the rest
    alone = [memory.replay(spark.createDataFrame(rows, schema)) for rows in (part("a", 25), part("b", 40), other)]
    want = sorted(str(r) for df in alone for r in df.collect())
    assert sorted(map(str, memory.replay(spark.createDataFrame(part("a", 25) + part("b", 40) + other, schema)).collect())) == want


def test_empty_snapshots_and_quantiles(spark):
    one = spark.createDataFrame([("u", "c", 0, 5, "item", [1.0, 0.0])], "user_id string, cutoff string, interaction_index long, occurred_at_ms long, item_id string, vector array<double>")
    asked = spark.createDataFrame([("u", "c"), ("v", "c"), ("v", "c")], "user_id string, cutoff string")
    got = {(r.user_id, r.observed, r.promotions, r.new_drift) for r in memory.replay(one, asked).where("kind = 'snapshot'").collect()}
    assert got == {("u", 1, 0, 1.0), ("v", 0, 0, None)}
    values = [3.0, 1.0, None, 2.0, 10.0, 2.0, 7.5]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    at = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert np.allclose(memory.quantiles(df, "x", at).first()[0], np.quantile([x for x in values if x is not None], at))
    assert memory.quantiles(df.where("x is null"), "x", at).first()[0] == [None] * 5


def test_runs_are_dealt_by_the_size_of_their_table(spark, monkeypatch):
    from tidemark import session
    from tidemark.plans import queries

    monkeypatch.setattr(session, "ROWS", 500)
    best = queries.best_segment(spark, "/root/testdata/sf0.001")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(run_id" in plan
    tasks = best.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 8  # rows of a task are bounded, whatever the number of shuffle partitions


def test_decision_runs_are_shuffled_once(spark, tmp_path):
    """the loop and its validator write no tables and meet a run's rows where they were dealt."""
    spark.range(400).selectExpr("id div 4 as l_orderkey", "id % 7 as l_partkey", "cast(id % 50 + 1 as double) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("agent_trace", "unobserved_segments", "replay_violations"):
        df = registry.queries()[name](spark, str(tmp_path))
        assert all("/lineitem.parquet/" in f for f in df.inputFiles()) and df.count() > 0
        dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
        assert dealt and all(re.fullmatch(r"run_id#\d+L", d) for d in dealt), dealt


def test_long_texts_do_not_go_to_python(spark, monkeypatch):
    """texts that cannot come to the limit are judged whole where they are; the others as Python composes and strips them."""
    rng = random.Random(1)
    marks = ["a", "e\u0301", "\u1f82", "\u0391\u0313\u0300\u0345", " ", "\u2000", "\u3000", "\x1f", "\n", "\x85", "\u212b", "\u200b"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(300)] + ["\u0391\u0313\u0300\u0345" * 8, "\u0391\u0313\u0300\u0345" * 9, " " * 50 + "\xe9" + "\u3000" * 50, None]

    def want(t):
        n = unicodedata.normalize("NFC", t or "").strip()
        reason = "missing" if not n else "invalid" if len(n) > 8 or any(unicodedata.category(c) == "Cc" for c in n) else None
        return None if reason else n, reason

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = catalog.normalize_texts(df, "t", 8)
    assert {r.i: (r.value, r.reason) for r in got.collect()} == dict(enumerate(map(want, texts)))
    sent = re.search(r"nfc\((.*)\)", got._jdf.queryExecution().analyzed().toString()).group(1)
    assert "32" in sent and "CASE WHEN" in sent, sent


def test_negatives_are_drawn_in_one_pass(spark, tmp_path):
    """what is drawn is not written, and no shuffle carries the samples' long identities."""
    spark.range(600).selectExpr("id div 6 as l_orderkey", "id % 6 as l_linenumber", "id as l_partkey", "id % 5 as l_suppkey", "cast(10 as double) as l_quantity", "'N' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).selectExpr("id as o_orderkey", "id % 9 as o_custkey", "timestamp_seconds(id) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    df = registry.queries()["train_negatives"](spark, str(tmp_path))
    assert df.count() > 0 and not any("/draws-" in f for f in df.inputFiles())
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert moved and not any("sample_id" in m for m in moved)


def test_a_view_has_texts_rows_matches_and_counts(spark):
    """a row for each snapshot, empty ones too, with whole atoms in the projection's order."""
    rows = [(v, i * 1000) for i, v in enumerate([A, A, B, B, A, A, A, A, C_])]
    data = [("u", "c", i, t, f"item{v}", f"proto{v}", list(v)) for i, (v, t) in enumerate(rows)]
    observed = spark.createDataFrame(data, "user_id string, cutoff string, interaction_index long, occurred_at_ms long, item_id string, prototype_id string, vector array<double>")
    asked = spark.createDataFrame([("u", "c"), ("v", "c")], "user_id string, cutoff string")
    semantics = spark.createDataFrame([(f"item{v}", f"text {v}", f"proto{v}", k) for k, v in enumerate((A, B, C_), 7)], "item_id string, text string, prototype_id string, row_index long")
    got = {r.user_id: r for r in memory.views(memory.replay(observed, asked), semantics).collect()}
    u, v = got["u"], got["v"]
    assert [(x.text, x.medoid_prototype_id, x.state, x.support_count, x.created_at_ms, x.last_seen_at_ms, x.embedding_row_index) for x in u.long_atoms] == [
        (f"text {A}", f"proto{A}", "stable", 6, 0, 7000, 0), (f"text {B}", f"proto{B}", "fading", 2, 2000, 3000, 1)]
    assert [(x.text, x.item_id, x.prototype_id, x.state, x.source_interaction_index, x.embedding_row_index) for x in u.short_atoms] == [(f"text {C_}", f"item{C_}", f"proto{C_}", "emerging", 8, 9)] + [
        (f"text {A}", f"item{A}", f"proto{A}", "stable", i, 7) for i in (7, 6, 5, 4)]
    (a, b), shorts = (x.atom_id for x in u.long_atoms), [x.atom_id for x in u.short_atoms]
    assert [(m.long_atom_id, m.short_atom_id, m.similarity, m.classification) for m in u.matches] == [(None, shorts[0], 0.0, "emerging"), *[(a, s, 1.0, "stable") for s in shorts[1:]], (b, None, 0.0, "fading")]
    assert (u.updated_at_ms, u.short_states, u.long_states) == (8000, "emerging,stable,stable,stable,stable", "stable,fading")
    assert (u.metadata.observed_semantic_count, u.metadata.pending_count, u.metadata.inactive_long_count, u.metadata.unprojected_long_count, u.metadata.similarity_matrix_shape) == (9, 1, 0, 0, [2, 5])
    assert (v.long_atoms, v.short_atoms, v.matches, v.long_states, v.updated_at_ms, v.new_drift, v.metadata.observed_semantic_count, v.metadata.similarity_matrix_shape) == ([], [], [], None, None, None, 0, [0, 0])
    event = {"interaction_index": 0, "item_id": f"item{A}", "occurred_at_ms": 0, "prototype_id": f"proto{A}"}
    identity = json.dumps({"recipe": "dynamic-hybrid-memory-v1", "seed_event": event, "user_id": "u"}, separators=(",", ":"), sort_keys=True) + "\n"
    assert a == "p3long-" + hashlib.sha256(identity.encode()).hexdigest()


def test_cosines_are_compared_in_float32(spark):
    near = 0.70000001  # the nearest float32 is below the threshold
    got = observe(spark, [(A, 0), ((near, (1 - near**2) ** 0.5), 1)])
    assert states(got, "track") == ["pending", "pending"]


def test_memory_views_agree_with_the_other_memory_queries(spark):
    sf, q = "/root/testdata/sf0.001", registry.queries()
    views = {(r.user_id, r.cutoff): r for r in q["memory_view"](spark, sf).collect()}
    tracks, drift = q["memory_tracks"](spark, sf).collect(), q["memory_drift"](spark, sf).collect()
    told = {f"item:{r.p_partkey}": r.text for r in q["semantic_text"](spark, sf).collect()}
    prints = {(r.user_id, r.split): r.fingerprint for r in q["history_fingerprint"](spark, sf).collect()}
    assert views.keys() == {(r.user_id, r.cutoff) for r in drift} and len(views) > 10
    for r in drift:
        v = views[r.user_id, r.cutoff]
        assert (v.new_drift, v.drop_drift, v.global_drift, v.metadata.observed_semantic_count) == (r.new_drift, r.drop_drift, r.global_drift, r.observed) and v.history_fingerprint == prints[r.user_id, r.cutoff]
        own = [t for t in tracks if (t.user_id, t.cutoff) == (r.user_id, r.cutoff)]
        live = sorted((t for t in own if t.place is not None), key=lambda t: t.place)
        assert [(a.atom_id, a.state, a.strength, a.persistence, a.support_count, a.embedding_row_index) for a in v.long_atoms] == [(t.atom_id, t.state, t.strength, t.persistence, t.supports, t.place) for t in live]
        assert [v.metadata[c] for c in ("inactive_long_count", "pending_count", "unprojected_long_count")] == [sum(t.state == s for t in own) for s in ("inactive", "pending", "unprojected")]
        assert all(a.text == told[a.item_id] and a.prototype_id and a.embedding_row_index == int(a.item_id[5:]) for a in v.short_atoms) and all(a.text in told.values() for a in v.long_atoms)
        assert len(v.matches) == len(v.short_atoms) + v.long_states.split(",").count("fading") if v.long_states else len(v.matches) == len(v.short_atoms)
