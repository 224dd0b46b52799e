"""Declared failures: a component that fails ends its own run, by role and message; the job and all other runs go on.

A component is a column that is null where it worked and a message where it did not. ``ends`` finds each run's first failure
in order of step and component; what lies behind it is skipped for that run, what lies before stays. A component that
fails after the step's own updates (the score updater) leaves these in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import sanitize_message
from tidemark.operators import updates as U

PERCEPTION, EVIDENCE, OBSERVATION, SCORES, RANKER = "perception", "evidence_updater", "observation_updater", "score_updater", "initial_ranker"
#: which component says which problem of a result
ROLES = {
    U.STATUS: PERCEPTION, U.NO_EVIDENCE: PERCEPTION, U.STRAY_EVIDENCE: PERCEPTION, U.NO_REASON: PERCEPTION, U.ITEM: EVIDENCE, U.USED: EVIDENCE,
    U.STEP: OBSERVATION, U.SEGMENT: OBSERVATION, U.TAKEN: OBSERVATION, U.AGAIN: OBSERVATION,
}


def role_of(problem: Column) -> Column:
    found = F.lit(None).cast("string")
    for p, role in ROLES.items():
        found = F.when(problem == p, role).otherwise(found)
    return found


def with_scores(judged: DataFrame, deltas: DataFrame) -> DataFrame:
    """Judged results with ``failed``: (role, message) of the component that fails at it, and ``applied`` up to each run's first failure.

    ``deltas`` (evidence_id, own, other): what evidence does to its item's score and to the others'. Evidence without
    deltas fails the score updater, behind the updates of its own step: its result stays applied.
    """
    met = judged.join(deltas.select("evidence_id", "own", "other"), "evidence_id", "left")
    no_delta = F.col("problem").isNull() & F.col("evidence_id").isNotNull() & F.col("own").isNull()
    message = F.when(F.col("problem").isNotNull(), F.col("problem")).when(no_delta, F.concat(F.lit("no delta for "), "evidence_id"))
    role = F.when(F.col("problem").isNotNull(), role_of(F.col("problem"))).when(no_delta, SCORES)
    told = met.withColumn("order", F.struct(*U.FIELDS)).withColumn("failed", F.when(role.isNotNull(), F.struct(role.alias("role"), sanitize_message(message).alias("message"))))
    # results come dealt by their runs: the first failure is found where they are
    out = told.withColumn("end", F.min(F.when(F.col("failed").isNotNull(), F.col("order"))).over(Window.partitionBy("run_id")))
    kept = F.col("end").isNull() | (F.col("order") < F.col("end")) | ((F.col("order") == F.col("end")) & (F.col("failed.role") == SCORES))
    return out.select("run_id", *U.FIELDS, "own", "other", kept.alias("applied"), F.when(F.col("order") == F.col("end"), F.col("failed")).alias("failed"))


def outcomes(runs: DataFrame, items: DataFrame, scored: DataFrame) -> DataFrame:
    """run_id, outcome, role, message, step, actions, evidence: each asked run once. A run without candidates fails its ranker."""
    n = items.select("run_id", F.lit(True).alias("candidates")).distinct()
    end = F.max(F.when(F.col("failed").isNotNull(), F.struct("failed.role", "failed.message", "step")))
    j = scored.groupBy("run_id").agg(end.alias("f"), F.count_if("applied").alias("actions"), F.count_if(F.expr("applied and evidence_id is not null")).alias("evidence"))
    met = runs.select("run_id").distinct().join(n, "run_id", "left").join(j, "run_id", "left")
    none = F.col("candidates").isNull()
    role = F.when(none, RANKER).otherwise(F.col("f.role"))
    return met.select(
        "run_id", F.when(role.isNull(), "completed").otherwise("failed").alias("outcome"), role.alias("role"), F.when(none, "the run has no candidates").otherwise(F.col("f.message")).alias("message"),
        F.when(~none, F.col("f.step")).alias("step"), F.when(none, 0).otherwise(F.coalesce("actions", F.lit(0))).cast("bigint").alias("actions"), F.when(none, 0).otherwise(F.coalesce("evidence", F.lit(0))).cast("bigint").alias("evidence"),
    )


def scores(initial: DataFrame, scored: DataFrame) -> DataFrame:
    """run_id, item_id, score: the initial score and the deltas of all evidence that was applied, not step by step; 12 digits.

    Evidence whose delta is missing (the one that ended its run) adds nothing: the partial state keeps the scores before it.
    """
    e = scored.where("applied and evidence_id is not null and own is not null")
    mine = e.groupBy("run_id", "item_id").agg(F.sum("own").alias("own"), F.sum("other").alias("mine"))
    every = e.groupBy("run_id").agg(F.sum("other").alias("others"))
    met = initial.join(mine, ["run_id", "item_id"], "left").join(every, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return met.select("run_id", "item_id", F.round(F.col("score") + zero("own") + zero("others") - zero("mine"), 12).alias("score"))
