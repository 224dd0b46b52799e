"""The bounded decision loop and its validator.

A run is one row with arrays (its candidates, its segments), built by one shuffle; the loop is bounded by the budget and
folds over it inside the row. Nothing is collected or written on the way, and runs are independent. The validator meets a run's
trace, candidates and segments in one row too: tables that are dealt by run_id are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as K
from tidemark.functions.scalar import let

GAIN, COST = 0.1, 0.01
_SEGMENT = "array<struct<item_id:string,segment_id:string,value:double,status:string,observed:string>>"


def runs(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """run_id with its candidates (item, initial) and segments, in canonical order."""
    c = candidates.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("item_id", F.col("score").alias("initial")))).alias("candidates"))
    s = segments.withColumn("observed", F.lit("unobserved")).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "segment_id", "value", "status", "observed"))).alias("segments"))
    return c.join(s, "run_id", "left").withColumn("segments", F.coalesce("segments", F.expr(f"cast(array() as {_SEGMENT})")))


def _same(a: Column, b: Column) -> Column:
    return a["item_id"].eqNullSafe(b["item_id"]) & a["segment_id"].eqNullSafe(b["segment_id"])


def _delta(gained: Column, item: Column) -> Column:
    """What the items of the evidence so far add to a candidate."""
    return F.aggregate(gained, F.lit(0.0), lambda a, i: a + F.when(i == item, GAIN).otherwise(-COST))


def _scored(gained: Column) -> Column:
    """Scores from the initial ones and all evidence so far (not step by step): rounded to 12 digits, best first, ties by item."""
    now = F.transform("candidates", lambda c: F.struct((-F.round(c["initial"] + _delta(gained, c["item_id"]), 12)).alias("m"), c["item_id"].alias("item_id")))
    return F.transform(F.sort_array(now), lambda x: F.struct(x["item_id"].alias("item_id"), (-x["m"]).alias("score")))


def _gap(ranked: Column) -> Column:
    return F.when(F.size(ranked) > 1, F.round(F.element_at(ranked, 1)["score"] - F.element_at(ranked, 2)["score"], 12))


def _step(state: Column, step: Column, ordered: Column, budget: int, margin: float | None, least: float | None) -> Column:
    picked = lambda s: F.exists(state["picks"], lambda p: _same(p, s))
    gained = F.transform(F.filter("segments", lambda s: (s["status"] == "succeeded") & picked(s)), lambda s: s["item_id"])

    def decided(ranked: Column, gap: Column, best: Column) -> Column:
        pre = F.when(step == budget, K.BUDGET).when(best.isNull(), K.NO_SEGMENTS)
        if margin is not None:
            pre = pre.when(gap >= margin, K.CERTAIN)
        post = F.when(best["value"] < least, K.TOO_LOW) if least is not None else F.lit(None).cast("string")

        def entered(pre: Column, reason: Column) -> Column:
            acts, goes_on = reason.isNull(), pre.isNull()
            row = F.struct(
                step.alias("decision_index"), acts.alias("acted"), reason.alias("reason"), gap.alias("margin"),
                F.when(goes_on, best["item_id"]).alias("item_id"), F.when(goes_on, best["segment_id"]).alias("segment_id"),
                F.when(goes_on, best["value"]).alias("value"), F.when(acts, best["status"]).alias("result"), ranked.alias("ranked"),
            )
            pick = F.when(acts, F.array(F.struct(best["item_id"].alias("item_id"), best["segment_id"].alias("segment_id")))).otherwise(F.expr(f"cast(array() as {_PICKS})"))
            return F.struct(F.concat(state["trace"], F.array(row)).alias("trace"), F.concat(state["picks"], pick).alias("picks"), reason.alias("stopped"))

        return let(pre, lambda p: let(F.coalesce(p, post), lambda r: entered(p, r)))

    best = F.get(F.filter(ordered, lambda s: ~picked(s)), F.lit(0))
    after = let(gained, lambda g: let(_scored(g), lambda ranked: let(_gap(ranked), lambda gap: let(best, lambda b: decided(ranked, gap, b)))))
    return F.when(state["stopped"].isNull(), after).otherwise(state)


_TRACE = "array<struct<decision_index:int,acted:boolean,reason:string,margin:double,item_id:string,segment_id:string,value:double,result:string,ranked:array<struct<item_id:string,score:double>>>>"
_PICKS = "array<struct<item_id:string,segment_id:string>>"


def play(run_rows: DataFrame, budget: int = K.MAX_ACTIONS, margin: float | None = K.MARGIN_THRESHOLD, least: float | None = K.MIN_VALUE) -> DataFrame:
    """run_id, candidates, segments, trace, stopped: the loop of at most budget + 1 entries."""
    # the best open segment does not depend on the scores: sorted once
    ordered = F.sort_array(F.transform("segments", lambda s: F.struct((-s["value"]).alias("m"), *(s[n].alias(n) for n in ("item_id", "segment_id", "value", "status")))))
    start = F.struct(F.expr(f"cast(array() as {_TRACE})").alias("trace"), F.expr(f"cast(array() as {_PICKS})").alias("picks"), F.lit(None).cast("string").alias("stopped"))
    # bound, not columns of their own: a column that a lambda names once would be computed for each of its elements
    fold = lambda ordered: F.aggregate(F.sequence(F.lit(0), F.lit(budget)), start, lambda state, step: _step(state, step, ordered, budget, margin, least))
    told = lambda picks, s: F.when(F.exists(picks, lambda p: _same(p, s)), s["status"]).otherwise(s["observed"])
    seen = lambda picks: F.transform("segments", lambda s: F.struct(*(s[n].alias(n) for n in ("item_id", "segment_id", "value", "status")), told(picks, s).alias("observed")))
    ended = lambda loop: F.struct(seen(loop["picks"]).alias("segments"), loop["trace"].alias("trace"), loop["stopped"].alias("stopped"))
    return run_rows.select("run_id", "candidates", let(let(ordered, fold), ended).alias("loop")).select("run_id", "candidates", "loop.*")


def _rows(df: DataFrame, listed: Column) -> DataFrame:
    """run_id and a row for each entry; the outer form, as a plain explode would have the list computed once more to see if it is empty."""
    return df.select("run_id", F.explode_outer(listed).alias("row")).where("row is not null")


def unobserved(played: DataFrame) -> DataFrame:
    """run_id, item_id, segment_id of the segments that no decision took."""
    return _rows(played, F.filter("segments", lambda s: s["observed"] == "unobserved")).select("run_id", "row.item_id", "row.segment_id")


def trace(played: DataFrame) -> DataFrame:
    """The trace, a row per decision."""
    return _rows(played, F.col("trace")).select("run_id", "row.*")


def results(played: DataFrame) -> DataFrame:
    """run_id, actions, stop reason, final top item and score."""
    last = F.element_at("trace", -1)
    return played.select(
        "run_id", F.expr("cast(size(filter(trace, t -> t.acted)) as bigint)").alias("actions"), F.coalesce("stopped", F.lit(K.SAFETY)).alias("stop_reason"),
        F.element_at(last["ranked"], 1)["item_id"].alias("top_item"), F.round(F.element_at(last["ranked"], 1)["score"], 6).alias("top_score"),
    )


def violations(steps: DataFrame, candidates: DataFrame, segments: DataFrame, budget: int = K.MAX_ACTIONS, margin: float | None = K.MARGIN_THRESHOLD, least: float | None = K.MIN_VALUE) -> DataFrame:
    """run_id, decision_index, problem: what a saved trace says against what its transitions must be. No component runs again.

    A run that meets neither candidates nor segments is judged as one without any.
    """
    told = steps.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("decision_index", "acted", "reason", "margin", "item_id", "segment_id", "value", "result", "ranked"))).alias("steps"))
    known = candidates.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("item_id", F.col("score").alias("initial")))).alias("candidates"))
    listed = segments.groupBy("run_id").agg(F.collect_list(F.struct("item_id", "segment_id", "value", "status")).alias("segments"))
    rows = told.join(known, "run_id", "left").join(listed, "run_id", "left")
    empty = lambda df, name: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    rows = rows.select("run_id", "steps", empty(known, "candidates"), empty(listed, "segments"))
    row = lambda x, problem: F.struct(x["decision_index"].alias("decision_index"), problem.alias("problem"))

    def own(x: Column, i: Column) -> Column:
        before, index, reason = F.get("steps", i - 1), x["decision_index"], x["reason"]
        order = F.when(F.coalesce(before["decision_index"], F.lit(-1)) + 1 != index, "decision indexes are not contiguous")
        after = F.when(before["reason"].isNotNull(), "a decision follows a stop")
        ends = F.when((i == F.size("steps") - 1) & reason.isNull(), "the run has no terminal decision").when(x["acted"] == reason.isNotNull(), "acted and stopped disagree")
        spent = F.when((reason == K.BUDGET) != (index == budget), "budget reason and budget disagree")
        margins = F.when(~x["margin"].eqNullSafe(_gap(x["ranked"])), "margin does not follow from the scores")
        sure = F.lit(None).cast("string") if margin is None else F.when((reason == K.CERTAIN) & (F.coalesce(x["margin"] < margin, F.lit(True))), "margin below its threshold")
        low = F.lit(None).cast("string") if least is None else F.when((reason == K.TOO_LOW) & (x["value"] >= least), "value not below its minimum").when(x["acted"] & (x["value"] < least), "an action below the minimum value")
        return F.transform(F.array_compact(F.array(order, after, ends, spent, margins, sure, low)), lambda problem: row(x, problem))

    at = lambda a, b: (a["item_id"] == b["item_id"]) & (a["segment_id"] == b["segment_id"])

    def beaten(x: Column, taken: Column) -> Column:
        """The selection: no segment still open then may come before the selected one."""
        place = lambda s: F.struct(s["item_id"].alias("item_id"), s["segment_id"].alias("segment_id"))
        better = lambda s: (s["value"] > x["value"]) | ((s["value"] == x["value"]) & (place(s) < place(x)))
        later = lambda s: ~F.exists(taken, lambda k: at(k, s)) | F.exists(taken, lambda k: at(k, s) & (k["decision_index"] >= x["decision_index"]))
        return x["item_id"].isNotNull() & F.exists("segments", lambda s: better(s) & later(s))

    def odd(x: Column) -> Column:
        own_ = F.transform(F.filter("segments", lambda s: at(s, x)), lambda s: s["status"])
        status = let(own_, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string"))))
        return F.transform(F.filter(status, lambda t: ~t.eqNullSafe(x["result"])), lambda _: row(x, F.lit("the result is not the segment's")))

    def drifts(x: Column, taken: Column) -> Column:
        """Scores: initial plus all evidence of earlier decisions."""
        gained = F.transform(F.filter(taken, lambda k: (k["result"] == "succeeded") & (k["decision_index"] < x["decision_index"])), lambda k: k["item_id"])
        far = lambda initial, r, g: initial.isNull() | (F.abs(initial + _delta(g, r["item_id"]) - r["score"]) > 1e-9)

        def by_place(ranked: Column, g: Column) -> Column:
            # a ranking of just the candidates meets them place by place, in the order of items
            pairs = F.zip_with(ranked, "candidates", lambda r, c: far(c["initial"], r, g))
            return F.exists(pairs, lambda wrong: wrong)

        def by_item(ranked: Column, g: Column) -> Column:
            of = lambda r: F.filter("candidates", lambda c: c["item_id"] == r["item_id"])
            return F.exists(ranked, lambda r: let(of(r), lambda cs: (F.size(cs) == 0) | F.exists(cs, lambda c: far(c["initial"], r, g))))

        items = lambda a: F.transform(a, lambda e: e["item_id"])
        judged = lambda ranked, g: F.when(items(ranked) == items(F.col("candidates")), by_place(ranked, g)).otherwise(by_item(ranked, g))
        return let(F.sort_array(x["ranked"]), lambda ranked: let(gained, lambda g: judged(ranked, g)))

    def problems(taken: Column) -> Column:
        wrong = F.transform(F.filter("steps", lambda x: beaten(x, taken)), lambda x: row(x, F.lit("a better segment was open")))
        drift = F.transform(F.filter("steps", lambda x: drifts(x, taken)), lambda x: row(x, F.lit("a score does not follow from the evidence")))
        return F.concat(F.flatten(F.transform("steps", own)), F.array_distinct(wrong), F.flatten(F.transform(taken, odd)), F.array_distinct(drift))

    found = let(F.filter("steps", lambda x: x["acted"]), problems)
    return _rows(rows, found).select("run_id", "row.decision_index", "row.problem")
