"""Evidence and observation updates as a stream: the state of a run is kept by its key, and equals the batch fold.

The state of a run is the log of its distinct results with what was last said of each. A micro-batch adds to the log, the
run is folded again, and only what changed is told, with a revision that grows; so results may come late, shuffled and
repeated, without a watermark, and the last revision of each result is what ``operators.updates.judge`` says of the whole
feed. A log is bounded by the run's distinct results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import updates as U

OUT = "run_id string, step long, item_id string, segment_id string, status string, evidence_id string, reason string, problem string, applied boolean, revision long"
_KEY = "step long, item_id string, segment_id string, status string, evidence_id string, reason string"


def fold(log: dict[tuple, str | None]) -> dict[tuple, tuple[str | None, bool]]:
    """(problem, applied) of each result of one run; ``log`` has the problem that a result has by itself."""
    first: dict[tuple, tuple] = {}
    # as columns are ordered: null before any value
    order = sorted(log, key=lambda r: [(x is not None, x) for x in r])
    for r in order:
        if log[r] is None:
            for key in _keys(r):
                first.setdefault(key, r)
    out, running = {}, True
    for r in order:
        problem = log[r]
        if problem is None:
            problem = next((p for key, p in zip(_keys(r), (U.TAKEN, U.AGAIN, U.USED), strict=False) if first[key] != r), None)
        running &= problem is None
        out[r] = (problem, running)
    return out


def _keys(r: tuple) -> list[tuple]:
    step, item, segment, _, evidence, _ = r
    return [("step", step), ("look", item, segment), *([("use", evidence)] if evidence is not None else [])]


class RunLog(StatefulProcessor):
    """Map state: a result -> (own problem, problem and applied as last told); value state: the revision."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getMapState("log", _KEY, "own string, problem string, applied boolean")
        self.revision = handle.getValueState("revision", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = {tuple(k): tuple(v) for k, v in self.log.iterator()}
        own = {r: v[0] for r, v in told.items()}
        for batch in rows:
            for r in batch[[*U.FIELDS, "own"]].itertuples(index=False):
                *fields, problem = (None if pd.isna(x) else x for x in r)
                fields[0] = None if fields[0] is None else int(fields[0])
                own.setdefault(tuple(fields), problem)
        now = fold(own)
        changed = {r: v for r, v in now.items() if r not in told or told[r][1:] != v}
        if not changed:
            return
        n = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        self.revision.update((n,))
        for r, v in changed.items():
            self.log.updateValue(r, (own[r], *v))
        yield pd.DataFrame([(key[0], *r, *v, n) for r, v in changed.items()], columns=[f.split()[0] for f in OUT.split(", ")]).astype({"step": "Int64"})

    def close(self) -> None:
        pass


def judge_stream(results: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """Changes of what is said of each result, for a streaming feed and saved tables of candidates and segments. Needs the RocksDB state store."""
    typed = results.select(F.col("run_id").cast("string").alias("run_id"), F.col("step").cast("long").alias("step"), *U.FIELDS[1:])
    keys = lambda df: df.withColumn("run_id", F.col("run_id").cast("string"))
    known = U.known_to(typed, keys(items), keys(segments)).withColumn("own", U.unsound()).select("run_id", *U.FIELDS, "own")
    return known.groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunLog(), outputStructType=OUT, outputMode="Update", timeMode="None")


def current(changes: DataFrame) -> DataFrame:
    """The last revision of each result: what ``judge`` gives for the whole feed."""
    last = changes.groupBy("run_id", *U.FIELDS).agg(F.max_by(F.struct("problem", "applied"), "revision").alias("x"))
    return last.select("run_id", *U.FIELDS, "x.problem", "x.applied")
