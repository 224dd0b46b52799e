"""Evidence and observation updates: a feed of observation results folded into the states of decision runs.

A result says that at ``step`` of a run a segment of an item was looked at, and what came of it. Results may come in any
order and more than once; equal rows are one result. A run's results are taken by step (then by their other fields), and
each is judged by what it says, by the run's candidates and catalog, and against the sound results before it:

* the segment must still be unobserved, the step free, the evidence id new in the run;
* a run stops at its first problem: results before it are applied, what comes behind is judged but changes nothing.

Firsts are least values by key, in windows: a run of ordinary size is dealt once, and its results are judged where they
are; a hot run is dealt again for each key, so that no task sorts all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut

#: Rows (results, candidates and segments) of a run that one task may sort.
MOST = 100_000
#: Groups of runs in which large ones are looked for first.
BUCKETS = 65_536
FIELDS = ("step", "item_id", "segment_id", "status", "evidence_id", "reason")
#: problems in order of precedence
STEP, ITEM, SEGMENT, STATUS, NO_EVIDENCE, STRAY_EVIDENCE, NO_REASON, TAKEN, AGAIN, USED = (
    "the step is not positive", "the item is no candidate", "the segment is not in the catalog", "the status is no outcome", "a success without evidence",
    "a failure with evidence", "a failure without a reason", "the step is taken", "the segment was observed before", "the evidence id is used already",
)


def known_to(results: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """Results with ``is_item`` and ``is_segment``: whether the run has this candidate, and this segment of it."""
    i = items.select("run_id", "item_id").distinct().withColumn("is_item", F.lit(True))
    s = segments.select("run_id", "item_id", "segment_id").distinct().withColumn("is_segment", F.lit(True))
    met = results.join(i, ["run_id", "item_id"], "left").join(s, ["run_id", "item_id", "segment_id"], "left")
    return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_item", "is_segment")}).select("run_id", *FIELDS, "is_item", "is_segment")


def unsound() -> Column:
    """What is wrong with a result by itself, or null."""
    ok = F.col("status") == "succeeded"
    return (
        F.when(F.coalesce(F.col("step"), F.lit(0)) < 1, STEP).when(~F.col("is_item"), ITEM).when(~F.col("is_segment"), SEGMENT)
        .when(~F.coalesce(F.col("status").isin("succeeded", "failed"), F.lit(False)), STATUS).when(ok & F.col("evidence_id").isNull(), NO_EVIDENCE)
        .when(~ok & F.col("evidence_id").isNotNull(), STRAY_EVIDENCE).when(~ok & F.col("reason").isNull(), NO_REASON)
    )


def _told(rows: DataFrame, *deal: str, order: Column) -> DataFrame:
    """``rows`` dealt by ``deal``, with ``order`` (within the run, equal for equal results) and problem (null for what is no result).

    Results meet the run's candidates and catalog, and the sound results before them, in windows: those whose keys hold all
    of ``deal`` need no further shuffle. A result that stands twice is its own equal: it is not before itself.
    """
    met = rows.repartition(*deal).withColumn("order", order)
    has = lambda flag, *key: F.max(flag).over(Window.partitionBy(*key)) & F.expr(" and ".join(f"{c} is not null" for c in key))
    met = met.withColumn("is_segment", has("segment", "run_id", "item_id", "segment_id")).withColumn("is_item", has("item", "run_id", "item_id"))
    met = met.withColumn("own", unsound()).withColumn("sound", F.col("result") & F.col("own").isNull()).drop("is_item", "is_segment")

    def before(*key: str) -> Column:
        """Whether a sound result with the same key stands before."""
        return F.coalesce(F.min(F.when(F.col("sound"), F.col("order"))).over(Window.partitionBy("run_id", *key)) < F.col("order"), F.lit(False))

    met = met.withColumn("looked", before("item_id", "segment_id")).withColumn("stepped", before("step"))
    # results without evidence compete for none
    met = met.withColumn("used", before("evidence_id") & F.col("evidence_id").isNotNull())
    problem = F.coalesce("own", F.when(F.col("stepped"), TAKEN).when(F.col("looked"), AGAIN).when(F.col("used"), USED))
    return met.select("run_id", *FIELDS, "result", "item", "segment", "order", F.when(F.col("result"), problem).alias("problem"))


def rows_of(results: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of all three kinds: run_id, FIELDS and ``result``, ``item``, ``segment``: what a row says. A row may say several."""
    flags = lambda kind: [F.lit(k == kind).alias(k) for k in ("result", "item", "segment")]
    rows = results.select("run_id", *FIELDS, *flags("result")).unionByName(items.select("run_id", "item_id", *flags("item")), allowMissingColumns=True)
    return rows.unionByName(segments.select("run_id", "item_id", "segment_id", *flags("segment")), allowMissingColumns=True)


def _large(rows: DataFrame, most: int) -> DataFrame | None:
    """Runs of more than ``most`` rows, or None. Only runs in a bucket of so many rows are counted each."""
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).alias("_bucket")
    full = cut(rows.groupBy(bucket).count().where(F.col("count") > most).select("_bucket"), "buckets")  # BUCKETS rows at most
    if full.isEmpty():
        return None
    near = rows.select("run_id", bucket).join(F.broadcast(full), "_bucket", "left_semi")
    large = cut(near.groupBy("run_id").count().where(F.col("count") > most).select(F.col("run_id").alias("_run")), "large")
    return None if large.isEmpty() else large


def tell(rows: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` (as of rows_of) with problem and applied (false for what is no result): every run in one shuffle.

    Runs of more than ``most`` rows are dealt by their items, steps and evidence ids, all others whole. Rows may stand twice.
    """
    end = F.min(F.when(F.col("problem").isNotNull(), F.col("order")))
    applied = (F.col("result") & (F.col("end").isNull() | (F.col("order") < F.col("end")))).alias("applied")
    out = ("run_id", *FIELDS, "result", "item", "segment", "problem", applied)
    large = _large(rows, most)
    same = F.col("run_id").eqNullSafe(F.col("_run"))
    whole = rows if large is None else rows.join(large, same, "left_anti")
    rank = F.rank().over(Window.partitionBy("run_id").orderBy(*FIELDS))
    found = _told(whole, "run_id", order=rank).withColumn("end", end.over(Window.partitionBy("run_id"))).select(*out)
    if large is None:
        return found
    told = cut(_told(rows.join(large, same, "left_semi"), "run_id", "item_id", order=F.struct(*FIELDS)), "told")  # read twice
    ends = told.groupBy(F.col("run_id").alias("_run")).agg(end.alias("end"))
    return found.unionByName(told.join(ends, same, "left").select(*out))


def judged_of(told: DataFrame) -> DataFrame:
    """run_id, FIELDS, problem (or null) and applied, a row for each distinct result."""
    return told.where("result").select("run_id", *FIELDS, "problem", "applied").distinct()


def judge(results: DataFrame, items: DataFrame, segments: DataFrame, most: int = MOST) -> DataFrame:
    """run_id, FIELDS, problem (or null) and applied, a row for each distinct result."""
    return judged_of(tell(rows_of(results, items, segments), most))


def evidence_of(told: DataFrame) -> DataFrame:
    """Every candidate with its evidence ids by step (an item has one a segment at most), empty where there is none."""
    got = F.collect_set(F.when(F.expr("applied and evidence_id is not null"), F.struct("step", "evidence_id")))
    every = told.groupBy("run_id", "item_id").agg(F.max("item").alias("item"), F.array_sort(got).alias("e"))
    return every.where("item").select("run_id", "item_id", F.col("e.evidence_id").alias("evidence_ids"))


def evidence_state(judged: DataFrame, items: DataFrame) -> DataFrame:
    """The same from judged results and candidates."""
    rows = judged.select("run_id", "item_id", "step", "evidence_id", "applied", F.lit(False).alias("item"))
    return evidence_of(rows.unionByName(items.select("run_id", "item_id", F.lit(False).alias("applied"), F.lit(True).alias("item")), allowMissingColumns=True))


def observations_of(told: DataFrame) -> DataFrame:
    """Every segment with its status, attempts, evidence ids, failure reason and last step."""
    done = F.max(F.when(F.col("applied"), F.struct("status", "evidence_id", "reason", "step")))  # one a segment at most
    every = told.groupBy("run_id", "item_id", "segment_id").agg(F.max("segment").alias("segment"), done.alias("d")).where("segment")
    ok = F.col("d.status") == "succeeded"
    return every.select(
        "run_id", "item_id", "segment_id", F.coalesce("d.status", F.lit("unobserved")).alias("status"), F.when(F.col("d").isNull(), 0).otherwise(1).cast("bigint").alias("attempts"),
        F.when(ok, F.array("d.evidence_id")).otherwise(F.array().cast("array<string>")).alias("evidence_ids"), F.when(~ok, F.col("d.reason")).alias("failure_reason"), F.col("d.step").alias("last_step"),
    )


def observation_state(judged: DataFrame, segments: DataFrame) -> DataFrame:
    """The same from judged results and segments."""
    rows = judged.select("run_id", "item_id", "segment_id", "status", "evidence_id", "reason", "step", "applied", F.lit(False).alias("segment"))
    return observations_of(rows.unionByName(segments.select("run_id", "item_id", "segment_id", F.lit(False).alias("applied"), F.lit(True).alias("segment")), allowMissingColumns=True))


def state_requests(judged: DataFrame, items: DataFrame, segments: DataFrame, budget: int) -> DataFrame:
    """What the next state of each run is built from: actions taken and left, counts of its parts, and the problem it stopped at."""
    n = items.select("run_id", "item_id").distinct().groupBy("run_id").agg(F.count("*").alias("candidates"))
    s = segments.select("run_id", "item_id", "segment_id").distinct().groupBy("run_id").agg(F.count("*").alias("segments"))
    ended = F.min(F.when(F.col("problem").isNotNull(), F.struct(*FIELDS, "problem")))
    j = judged.groupBy("run_id").agg(F.count_if("applied").alias("actions"), F.count_if(F.expr("applied and status = 'succeeded'")).alias("evidence"), ended.alias("ended"))
    met = n.join(s, "run_id", "left").join(j, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    step = zero("actions")
    return met.select(
        "run_id", step.alias("step"), (F.lit(budget) - step).alias("remaining"), "candidates", zero("evidence").alias("evidence"), (zero("segments") - step).alias("unobserved"),
        F.coalesce("ended.problem", F.when(step > budget, F.lit("more actions than the budget"))).alias("problem"),
    )


def snapshot_violations(evidence: DataFrame, observations: DataFrame, candidates: DataFrame, requests: DataFrame, budget: int) -> DataFrame:
    """run_id, subject, problem: what breaks the invariants of saved snapshots.

    ``evidence`` (run_id, evidence_id, item_id, segment_id) and ``observations`` (as of observation_state) must name each other,
    both ways; ``candidates`` (run_id, item_id, initial_rank, current_rank, score) must be ranked 1 to n by both ranks, the
    current one in order of score; ``requests`` (run_id, step, remaining, margin) must add up to the budget, and the margin
    be that of the two best scores. Everything is an equi-join or an aggregate.
    """
    from tidemark.operators.constraints import observation_status

    def rows(df: DataFrame, *told: tuple[Column | str, Column | str, str]) -> DataFrame:
        """A row for each (condition, subject, problem) that holds; ``df`` is read once."""
        each = [F.when(F.expr(c) if isinstance(c, str) else c, F.struct(F.col(x).cast("string").alias("subject") if isinstance(x, str) else x.cast("string").alias("subject"), F.lit(p).alias("problem"))) for c, x, p in told]
        return df.select("run_id", F.explode(F.array(*each)).alias("t")).where("t is not null").select("run_id", "t.subject", "t.problem")

    named = observations.select("run_id", F.explode("evidence_ids").alias("evidence_id"), F.col("item_id").alias("o_item"), F.col("segment_id").alias("o_segment"))
    out = rows(
        named.join(evidence, ["run_id", "evidence_id"], "full_outer"), ("item_id is null", "evidence_id", "an observation names unknown evidence"),
        ("o_item is null", "evidence_id", "evidence that no observation names"), ("o_item <> item_id or o_segment <> segment_id", "evidence_id", "evidence of another segment"),
    )
    odd = observation_status(observations.select("run_id", "item_id", "segment_id", "status", "attempts", F.col("evidence_ids").alias("evidence"), F.col("failure_reason").alias("reason")))
    out = out.unionByName(rows(odd, ("true", F.concat_ws("/", "item_id", "segment_id"), "an observation's status and its parts disagree")))
    ranks = candidates.groupBy("run_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("initial_rank", "current_rank") for k, f in (("least", F.min), ("most", F.max), ("kinds", F.count_distinct))])
    out = out.unionByName(rows(ranks, *[(f"least_{c} <> 1 or most_{c} <> n or kinds_{c} <> n", F.lit(c), "ranks are not 1 to n") for c in ("initial_rank", "current_rank")]))
    # neighbours by rank meet by an equi-join on the rank, not in one sorted run
    after = candidates.select("run_id", (F.col("current_rank") - 1).alias("current_rank"), F.col("score").alias("next_score"))
    out = out.unionByName(rows(candidates.join(after, ["run_id", "current_rank"]).where("next_score > score"), ("true", "item_id", "a rank is not in order of score")))
    top = candidates.where("current_rank <= 2").groupBy("run_id").agg(F.count("*").alias("n"), (F.max(F.when(F.col("current_rank") == 1, F.col("score"))) - F.max(F.when(F.col("current_rank") == 2, F.col("score")))).alias("gap"))
    wrong_margin = ~F.round("gap", 12).eqNullSafe(F.col("margin"))
    return out.unionByName(rows(
        requests.join(top, "run_id", "left"), (F.col("remaining") != F.lit(budget) - F.col("step"), F.lit("remaining"), "remaining is not the budget less the steps"),
        (wrong_margin, F.lit("margin"), "the margin is not that of the two best"),
    ))
