"""Queries on the states of decision runs: evidence and observation updates and their invariants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import failures, ranking as R, updates as U
from tidemark.session import cut, table
from tidemark.sources import driver_tables as T

BUDGET = 7
#: Rows of a delta table that goes with each task.
MOST_DELTAS = 100_000


def _told(spark, d):
    return U.tell(T.observation_rows(spark, d))


def _updates(spark, d):
    items, segments, _ = T.observation_results(spark, d)
    # read by several branches of a query
    return items, segments, cut(U.judged_of(_told(spark, d)), "judged")


def result_updates(spark, d):
    """What each result of the feed does to its run: applied, or the problem that it has."""
    return U.judged_of(_told(spark, d))


def evidence_state(spark, d):
    return U.evidence_of(_told(spark, d)).select("run_id", "item_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.size("evidence_ids").cast("bigint").alias("n"))


def observation_state(spark, d):
    return U.observations_of(_told(spark, d)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def state_requests(spark, d):
    items, segments, judged = _updates(spark, d)
    return U.state_requests(judged, items, segments, BUDGET)


def check_snapshot(spark, d):
    """What breaks the invariants of snapshots, each broken in its own tenth of the runs."""
    items, segments, judged = _updates(spark, d)
    tenth = F.col("run_id") % 10
    seen = cut(U.observation_state(judged, segments), "seen")
    evidence = judged.where("applied and evidence_id is not null").select("run_id", "evidence_id", "item_id", "segment_id")
    evidence = evidence.where(tenth != 0).withColumn("segment_id", F.when(tenth == 1, F.lit("seg:other")).otherwise(F.col("segment_id")))
    extra = items.where(tenth == 2).groupBy("run_id").agg(F.lit("ev:extra").alias("evidence_id"), F.min("item_id").alias("item_id"), F.lit("seg:none").alias("segment_id"))
    seen = seen.withColumn("attempts", F.when(tenth == 3, F.col("attempts") + 1).otherwise(F.col("attempts")))
    scored = cut(R.best_by_score(items.join(T.scenario(spark, d)[0], ["run_id", "item_id"]), "run_id", None), "scored")
    ranks = scored.select("run_id", "item_id", "rank", "score", (F.col("rank") + F.when(tenth == 4, 1).otherwise(0)).alias("initial_rank"), F.col("rank").alias("current_rank"))
    ranks = ranks.withColumn("score", F.when((tenth == 5) & (F.col("rank") == 3), F.col("score") + 2).otherwise(F.col("score")))
    margin = R.top_margin(scored.where("rank <= 2"), "run_id").select("run_id", F.when(tenth == 6, F.coalesce("margin", F.lit(0.0)) + 1).otherwise(F.col("margin")).alias("margin"))
    asked = U.state_requests(judged, items, segments, BUDGET).join(margin, "run_id").withColumn("remaining", F.col("remaining") + F.when(tenth == 7, 1).otherwise(0))
    return U.snapshot_violations(evidence.unionByName(extra), seen, ranks, asked, BUDGET)


def _scored(spark, d):
    """Deltas by evidence: numbers that end in 7 have none."""
    n = F.col("q") / 1000
    quantities = table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").alias("q")).distinct().where("q % 10 <> 7")
    deltas = cut(quantities.select(F.concat(F.lit("ev:"), "q").alias("evidence_id"), (F.lit(0.1) + n).alias("own"), (-n / 4).alias("other")), "deltas")
    return failures.with_scores(U.judged_of(_told(spark, d)), F.broadcast(deltas) if deltas.count() <= MOST_DELTAS else deltas)


def run_outcomes(spark, d):
    """How each run ended: completed, or failed by a component, with what was kept."""
    items = T.observation_rows(spark, d).where("item")
    return failures.outcomes(table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")), items, _scored(spark, d))


def evidence_scores(spark, d):
    """Scores by the delta table from all evidence up to a run's end."""
    initial = T.observation_results(spark, d)[0].join(T.scenario(spark, d)[0], ["run_id", "item_id"])
    return failures.scores(initial, cut(_scored(spark, d), "scored"))  # read twice.withColumn("score", F.round("score", 9))


_FEED = """res AS (
  SELECT DISTINCT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS step, 'item:' || l_partkey AS item_id, 'seg:' || l_suppkey AS segment_id,
         CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN l_returnflag <> 'R' THEN 'ev:' || CAST(l_quantity AS BIGINT) END AS evidence_id,
         CASE WHEN l_returnflag = 'R' AND l_discount > 0 THEN 'status ' || l_linestatus END AS reason FROM lineitem),
it AS (SELECT DISTINCT l_orderkey AS run_id, 'item:' || l_partkey AS item_id FROM lineitem WHERE l_tax < 0.08::DOUBLE),
sg AS (SELECT DISTINCT l_orderkey AS run_id, 'item:' || l_partkey AS item_id, 'seg:' || l_suppkey AS segment_id FROM lineitem WHERE l_tax < 0.07::DOUBLE),
own AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, item_id, segment_id, status, evidence_id NULLS FIRST, reason NULLS FIRST) AS o,
         CASE WHEN step < 1 THEN 'the step is not positive' WHEN (run_id, item_id) NOT IN (SELECT (run_id, item_id) FROM it) THEN 'the item is no candidate'
              WHEN (run_id, item_id, segment_id) NOT IN (SELECT (run_id, item_id, segment_id) FROM sg) THEN 'the segment is not in the catalog'
              WHEN status = 'failed' AND reason IS NULL THEN 'a failure without a reason' END AS own FROM res),
tell AS (
  SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN min(o) FILTER (own IS NULL) OVER (PARTITION BY run_id, step) < o THEN 'the step is taken'
                 WHEN min(o) FILTER (own IS NULL) OVER (PARTITION BY run_id, item_id, segment_id) < o THEN 'the segment was observed before'
                 WHEN evidence_id IS NOT NULL AND min(o) FILTER (own IS NULL) OVER (PARTITION BY run_id, evidence_id) < o THEN 'the evidence id is used already' END AS problem FROM own),
jd AS (SELECT *, coalesce(o < min(o) FILTER (problem IS NOT NULL) OVER (PARTITION BY run_id), true) AS applied FROM tell)"""
_OBS = """ob AS (
  SELECT sg.run_id, sg.item_id, sg.segment_id, coalesce(status, 'unobserved') AS status, CAST(CASE WHEN status IS NULL THEN 0 ELSE 1 END AS BIGINT) AS attempts,
         CASE WHEN status = 'succeeded' THEN evidence_id END AS evidence_id, CASE WHEN status = 'failed' THEN reason END AS failure_reason, step AS last_step
  FROM sg LEFT JOIN (SELECT * FROM jd WHERE applied) USING (run_id, item_id, segment_id))"""
_REQ = """ended AS (SELECT run_id, count(*) FILTER (applied) AS step, count(*) FILTER (applied AND status = 'succeeded') AS evidence, arg_min(problem, o) FILTER (problem IS NOT NULL) AS problem FROM jd GROUP BY run_id),
rq AS (
  SELECT run_id, coalesce(step, 0) AS step, 7 - coalesce(step, 0) AS remaining, candidates, coalesce(evidence, 0) AS evidence, coalesce(segments, 0) - coalesce(step, 0) AS unobserved,
         coalesce(problem, CASE WHEN step > 7 THEN 'more actions than the budget' END) AS problem
  FROM (SELECT run_id, count(*) AS candidates FROM it GROUP BY run_id) LEFT JOIN (SELECT run_id, count(*) AS segments FROM sg GROUP BY run_id) USING (run_id) LEFT JOIN ended USING (run_id))"""

_SCORED = """fl AS (
  SELECT *, CASE WHEN problem IS NOT NULL THEN CASE WHEN problem IN ('a failure without a reason') THEN 'perception' WHEN problem IN ('the item is no candidate', 'the evidence id is used already') THEN 'evidence_updater' ELSE 'observation_updater' END
                 WHEN evidence_id LIKE '%7' THEN 'score_updater' END AS role FROM jd),
sc AS (SELECT *, min(o) FILTER (role IS NOT NULL) OVER (PARTITION BY run_id) AS fin FROM fl),
kp AS (SELECT *, fin IS NULL OR o < fin OR (o = fin AND role = 'score_updater') AS kept FROM sc)"""

SQL: dict[str, str] = {
    "run_outcomes": f"""WITH {_FEED}, {_SCORED},
        e AS (SELECT run_id, max(CASE WHEN o = fin THEN role END) AS role, max(CASE WHEN o = fin THEN coalesce(problem, 'no delta for ' || evidence_id) END) AS message, max(CASE WHEN o = fin THEN step END) AS step,
                     count(*) FILTER (kept) AS actions, count(*) FILTER (kept AND evidence_id IS NOT NULL) AS evidence FROM kp GROUP BY run_id),
        c AS (SELECT o_orderkey AS run_id, o_orderkey NOT IN (SELECT run_id FROM it) AS bare FROM orders)
        SELECT run_id, CASE WHEN bare OR role IS NOT NULL THEN 'failed' ELSE 'completed' END AS outcome, CASE WHEN bare THEN 'initial_ranker' ELSE role END AS role, CASE WHEN bare THEN 'the run has no candidates' ELSE message END AS message,
               CASE WHEN NOT bare THEN step END AS step, CASE WHEN bare THEN 0 ELSE coalesce(actions, 0) END AS actions, CASE WHEN bare THEN 0 ELSE coalesce(evidence, 0) END AS evidence FROM c LEFT JOIN e USING (run_id)""",
    "evidence_scores": f"""WITH {_FEED}, {_SCORED},
        u AS (SELECT run_id, item_id, 0.1::DOUBLE + CAST(substr(evidence_id, 4) AS BIGINT) / 1000 AS own, -(CAST(substr(evidence_id, 4) AS BIGINT) / 1000) / 4 AS other FROM kp WHERE kept AND evidence_id IS NOT NULL AND evidence_id NOT LIKE '%7'),
        m AS (SELECT run_id, item_id, sum(own) AS own, sum(other) AS mine FROM u GROUP BY ALL), a AS (SELECT run_id, sum(other) AS others FROM u GROUP BY ALL),
        i AS (SELECT it.run_id, it.item_id, max(round(l_quantity / 50, 6)) AS score FROM it JOIN lineitem ON l_orderkey = it.run_id AND 'item:' || l_partkey = it.item_id GROUP BY ALL)
        SELECT run_id, item_id, round(score + coalesce(own, 0) + coalesce(others, 0) - coalesce(mine, 0), 9) AS score FROM i LEFT JOIN m USING (run_id, item_id) LEFT JOIN a USING (run_id)""",
    "result_updates": f"WITH {_FEED} SELECT run_id, step, item_id, segment_id, status, evidence_id, reason, problem, applied FROM jd",
    "evidence_state": f"""WITH {_FEED} SELECT run_id, item_id, coalesce(string_agg(evidence_id, ',' ORDER BY step), '') AS evidence_ids, count(evidence_id) AS n
        FROM it LEFT JOIN (SELECT * FROM jd WHERE applied) USING (run_id, item_id) GROUP BY run_id, item_id""",
    "observation_state": f"WITH {_FEED}, {_OBS} SELECT run_id, item_id, segment_id, status, attempts, coalesce(evidence_id, '') AS evidence_ids, failure_reason, last_step FROM ob",
    "state_requests": f"WITH {_FEED}, {_REQ} SELECT * FROM rq",
    "check_snapshot": f"""WITH {_FEED}, {_OBS}, {_REQ},
ev AS (SELECT run_id, evidence_id, item_id, segment_id FROM jd WHERE applied AND evidence_id IS NOT NULL),
cd AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, item_id) AS rank, count(*) OVER (PARTITION BY run_id) AS n FROM (
  SELECT it.run_id, it.item_id, max(round(l_quantity / 50, 6)) AS score FROM it JOIN lineitem ON l_orderkey = it.run_id AND 'item:' || l_partkey = it.item_id GROUP BY ALL))
SELECT run_id, evidence_id AS subject, 'an observation names unknown evidence' AS problem FROM ev WHERE run_id % 10 = 0
UNION ALL SELECT run_id, evidence_id, 'evidence of another segment' FROM ev WHERE run_id % 10 = 1
UNION ALL SELECT DISTINCT run_id, 'ev:extra', 'evidence that no observation names' FROM it WHERE run_id % 10 = 2
UNION ALL SELECT run_id, item_id || '/' || segment_id, 'an observation''s status and its parts disagree' FROM ob WHERE run_id % 10 = 3 AND status = 'unobserved'
UNION ALL SELECT DISTINCT run_id, 'initial_rank', 'ranks are not 1 to n' FROM it WHERE run_id % 10 = 4
UNION ALL SELECT run_id, item_id, 'a rank is not in order of score' FROM cd WHERE run_id % 10 = 5 AND rank = 2 AND n > 2
UNION ALL SELECT DISTINCT run_id, 'margin', 'the margin is not that of the two best' FROM it WHERE run_id % 10 = 6
UNION ALL SELECT DISTINCT run_id, 'remaining', 'remaining is not the budget less the steps' FROM it WHERE run_id % 10 = 7""",
}
