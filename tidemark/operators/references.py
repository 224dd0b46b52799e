"""References between artifacts: their closure, what contradicts in it, exact matches, and views bound to histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut, drop

UNKNOWN, CHANGED, CONTRADICTION, CYCLE = "an unknown artifact is named", "another checksum is named", "two versions are reached", "it reaches itself"


def closure(refs: DataFrame, most: int = 64) -> DataFrame:
    """(artifact, upstream, depth) of all that is reached, each pair once at its least depth, by joins until nothing is new.

    ``refs`` has artifact and upstream. A round meets only the pairs of the round before with the direct references, and is a
    written table. Depth beyond ``most`` is an error; a cycle ends by itself, as its pairs are known.
    """
    direct = cut(refs.select("artifact", "upstream").distinct(), "refs")
    known, fresh = cut(direct.withColumn("depth", F.lit(1)), "closure"), direct
    for depth in range(2, most + 2):
        further = fresh.select("artifact", F.col("upstream").alias("via")).join(direct.select(F.col("artifact").alias("via"), "upstream"), "via").select("artifact", "upstream").distinct()
        before, fresh = fresh, cut(further.join(known, ["artifact", "upstream"], "left_anti"), "fresh")
        if before is not direct:
            drop(before)
        if not fresh.take(1):
            drop(fresh)
            return known
        if depth > most:
            raise ValueError(f"references go deeper than {most}")
        older, known = known, cut(known.unionByName(fresh.withColumn("depth", F.lit(depth))), "closure")
        drop(older)
    return known


def contradictions(artifacts: DataFrame, refs: DataFrame, single: list[str] | None = None, most: int = 64) -> DataFrame:
    """(artifact, subject, problem): what is wrong with a set of manifests.

    ``artifacts``: artifact, kind, checksum; ``refs``: artifact, upstream, checksum (as the reference says; null: not said).
    All that an artifact reaches must agree on one artifact of each kind (of the kinds in ``single``, where given).

    Only artifacts that others name are followed; the rest, which may be nearly all, reach what their upstreams reach. So the
    references meet their upstreams once, with what is known of these and the least and greatest that they reach of each kind.
    """
    refs = cut(refs.select("artifact", "upstream", "checksum"), "named")
    named = cut(refs.select("upstream").where("upstream is not null").distinct(), "upstreams")
    inner = cut(refs.select("artifact", "upstream").join(named.select(F.col("upstream").alias("artifact")), "artifact", "left_semi"), "inner")
    reached = closure(inner, most)
    if (reached.agg(F.max("depth")).first()[0] or 0) >= most:
        closure(refs, most)  # an artifact that nobody names may go one deeper: an error, where one does
    cyclic = reached.where("artifact = upstream").select("artifact")
    kinds = artifacts.select(F.col("artifact").alias("upstream"), "kind")
    if single is not None:
        kinds = kinds.where(F.col("kind").isin(single))
    ends = named.select(F.col("upstream").alias("artifact"), "upstream").unionByName(reached.select("artifact", "upstream")).join(kinds, "upstream")
    # least and greatest tell whether there are two; no list of what is reached is gathered
    ends = ends.groupBy(F.col("artifact").alias("upstream"), "kind").agg(F.min("upstream").alias("a"), F.max("upstream").alias("b"))
    known = artifacts.select(F.col("artifact").alias("upstream"), F.lit(True).alias("_known"), F.col("checksum").alias("_own"))
    met = refs.join(known, "upstream", "left").join(ends, "upstream", "left")
    # problems travel as numbers, of the row that says them: one shuffle finds the kinds that meet and the rows that are said twice
    said = F.when(F.col("_known").isNull(), 0).when(F.col("checksum") != F.col("_own"), 1)
    entry = lambda subject, problem, a=F.lit(None).cast("string"), b=F.lit(None).cast("string"): F.struct(subject.alias("subject"), problem.alias("n"), a.alias("a"), b.alias("b"))
    both = F.filter(F.array(entry(F.col("upstream"), said), entry(F.col("kind"), F.lit(3), F.col("a"), F.col("b"))), lambda e: e["n"].isNotNull() & ((e["n"] != 3) | e["a"].isNotNull()))
    rows = met.select("artifact", F.explode(both).alias("e")).select("artifact", "e.*").unionByName(cyclic.select("artifact", entry(F.col("artifact"), F.lit(2)).alias("e")).select("artifact", "e.*"))
    found = rows.groupBy("artifact", "subject", "n").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("n <> 3 or a <> b")
    names = F.array(*(F.lit(x) for x in (UNKNOWN, CHANGED, CYCLE, CONTRADICTION)))
    return found.select("artifact", "subject", F.get(names, F.col("n")).alias("problem"))


def unmatched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, matches) of the rows of ``left`` that do not meet exactly one row of ``right``."""
    n = right.groupBy(*key).agg(F.count("*").alias("matches"))
    return left.select(*key).distinct().join(n, key, "left").select(*key, F.coalesce("matches", F.lit(0)).alias("matches")).where("matches <> 1")


def bind_views(asked: DataFrame, views: DataFrame) -> DataFrame:
    """Each asked (user_id, cutoff, fingerprint) with its view, or with ``refused``.

    A view is bound to one user and cutoff and to the fingerprint of the history that it was made of.
    """
    key = ["user_id", "cutoff"]
    found = views.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("fingerprint", "view")).alias("v"))
    met = asked.select(*key, "fingerprint").distinct().join(found, key, "left")
    refused = F.when(F.col("n").isNull(), "no view").when(F.col("n") > 1, "several views").when(~F.col("v.fingerprint").eqNullSafe(F.col("fingerprint")), "made of another history")
    return met.select(*key, refused.alias("refused"), F.when(refused.isNull(), F.col("v.view")).alias("view"))
