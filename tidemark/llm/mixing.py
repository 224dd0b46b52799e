"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

Weights multiply down the tree. Token budgets are handed down level by level: a node's budget is split among its
children by weight; a child that holds less (its tokens times the allowed epochs) takes all it has, and its shortage
goes to its siblings; only what a whole family lacks reaches the families beside it. All is integer arithmetic, so that
the split is exact and repeatable.

Each leaf then takes a token-prefix of its documents in a seeded random order: epoch 1, then epoch 2 in another order
and so on, as far as the budget reaches; the document that crosses the budget is left out and ends the prefix. A
document's place is a digest of seed, epoch and id, then the digest of its text. Cumulative counts are made by digits of
that place: sums of 4,096 bins a leaf and epoch tell the one bin that the budget ends in, and that bin is divided again
by its next three digits until it holds at most ``bin_rows`` documents; only those are put in order. So no leaf is ever
sorted in one task, however large, and no leaf or budget passes through the driver.

Defined results: a null text has no tokens and is never taken; null tree columns form a level value of their own (empty
string); documents that share an id, null ones too, are in the order of their texts' digests, and rows that agree in id
and text are taken one by one as far as the budget reaches, whichever they are; an empty table gives an empty mix; other
columns, whatever their names and types, are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut, drop

LEVELS = ("domain", "language", "source_name")
#: Digits of a place that one division looks at, and the digits that a place has.
DIGITS, LENGTH = 3, 64
#: Documents of one leaf that are put in order in one task.
BIN_ROWS = 50_000


def split(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """Budget by child from (name, weight, capacity): by weight, shortages to the siblings, never above a capacity.

    The rule in plain terms, which ``budget_table`` follows for any number of leaves; tests hold one against the other.
    """
    out = {}
    rest, weight = budget, sum(w for _, w, _ in children)
    for name, w, cap in sorted(children, key=lambda c: (c[2] / c[1] if c[1] else float("inf"), c[0])):
        # in order of fullness: whoever is short first leaves its share to those behind
        out[name] = min(cap, rest * w // weight if weight else 0)
        if out[name] == cap:
            rest, weight = rest - cap, weight - w
    return out


def budgets(leaves: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], int], total: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Token budget of each leaf. ``weights`` by path (a prefix of a leaf's path); 1 where none is given."""
    depth = len(next(iter(leaves), ()))
    capacity: dict[tuple[str, ...], int] = defaultdict(int)
    family: dict[tuple[str, ...], set[tuple[str, ...]]] = defaultdict(set)
    for leaf, tokens in leaves.items():
        for k in range(depth + 1):
            capacity[leaf[:k]] += tokens * epochs
            if k:
                family[leaf[: k - 1]].add(leaf[:k])
    given = {(): min(total, capacity[()])}
    for k in range(depth):
        for node in [n for n in given if len(n) == k]:
            kids = sorted(family[node])
            part = split(given[node], [(str(i), weights.get(c, 1), capacity[c]) for i, c in enumerate(kids)])
            given |= {c: part[str(i)] for i, c in enumerate(kids)}
    return {n: b for n, b in given.items() if len(n) == depth}


def token_count(text: Column) -> Column:
    """Words between white space, all of the text: the tokens that budgets count."""
    trimmed = F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t\n\r]+"))).cast("long")


def budget_table(leaves: DataFrame, names: list[str], weights: dict[tuple[str, ...], int], total: Column, epochs: int) -> DataFrame:
    """The tree columns and budget of each leaf from (tree columns, t): level by level, each family in one window over sums."""
    spark = leaves.sparkSession
    given = leaves.agg((F.sum("t") * epochs).cast("long").alias("all"), F.coalesce(total, F.lit(0)).cast("long").alias("total")).select(F.least("all", "total").alias("budget"))
    for k in range(1, len(names) + 1):
        path, family = names[:k], names[: k - 1]
        told = [(*n, int(w)) for n, w in weights.items() if len(n) == k]
        weight = spark.createDataFrame(told, ", ".join(f"`{n}` string" for n in path) + ", w long")
        kids = leaves.groupBy(*path).agg((F.sum("t") * epochs).cast("long").alias("cap")).join(F.broadcast(weight), path, "left").withColumn("w", F.coalesce("w", F.lit(1)))
        kids = kids.join(given.withColumnRenamed("budget", "pb"), family) if family else kids.crossJoin(F.broadcast(given.withColumnRenamed("budget", "pb")))  # one row
        kids = kids.withColumn("full", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
        whole = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
        before = whole.orderBy("full", names[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        kids = kids.withColumn("rest", F.col("pb") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        kids = kids.withColumn("share", F.expr("if(left_w > 0, rest * w div left_w, 0)"))
        # the first child, by fullness, that cannot use its share up sets the rate for all behind it
        kids = kids.withColumn("level", F.min(F.when(F.col("cap") > F.col("share"), F.struct("full", names[k - 1]))).over(whole)).withColumn("short", F.col("level").isNull() | (F.struct("full", names[k - 1]) < F.col("level")))
        kids = kids.withColumn("first_rest", F.max(F.when(~F.col("short"), F.col("rest"))).over(whole)).withColumn("first_w", F.max(F.when(~F.col("short"), F.col("left_w"))).over(whole))
        given = kids.select(*path, F.when(F.col("short"), F.col("cap")).otherwise(F.least("cap", F.expr("if(first_w > 0, first_rest * w div first_w, 0)"))).alias("budget"))
        given = cut(given, "budgets")
    return given


def _edges(sums: DataFrame, names: list[str]) -> DataFrame:
    """Of (tree columns, epoch, prefix, t, n, start, budget), the bin of each leaf that its budget ends in: before is what is taken until it."""
    order = Window.partitionBy(*names).orderBy("epoch", "prefix").rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("t").over(order), F.lit(0)))
    first = summed.where(F.col("before") + F.col("t") > F.col("budget")).groupBy(*names).agg(F.min(F.struct("epoch", "prefix", "before", "n", "budget")).alias("e"))
    return first.select(*names, "e.*")


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[tuple[str, ...], int],
    total_tokens: int | None = None,
    keep_share: float = 0.5,
    epochs: int = 2,
    seed: int = 17,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """doc_id, epoch, the tree columns, n_tokens and the leaf's budget: one row for each time a document is taken.

    ``total_tokens`` is the size of the mix; where it is None, ``keep_share`` of all tokens.
    """
    names = list(levels)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id"), F.md5(text).alias("tie"), token_count(text).alias("n_tokens"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()])
    sized = cut(sized.where("n_tokens > 0"), "mix")
    place = F.concat(F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.col("tie"))
    every = sized.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("place", place)
    summed = cut(every.groupBy(*names, "epoch", F.substring("place", 1, DIGITS).alias("prefix")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "bins")
    leaves = cut(summed.where("epoch = 1").groupBy(*names).agg(F.sum("t").alias("t")), "leaves")
    total = F.lit(total_tokens).cast("long") if total_tokens is not None else F.floor(F.sum("t") * F.lit(keep_share))
    given = budget_table(leaves, names, weights, total, epochs)
    edges = cut(_edges(summed.join(given, names).withColumn("start", F.lit(0).cast("long")), names), "edges")
    for depth in range(DIGITS, LENGTH, DIGITS):
        if (edges.agg(F.max("n").alias("n")).first().n or 0) <= bin_rows:
            break
        large = edges.where(F.col("n") > bin_rows).select(*names, "epoch", "budget", F.col("prefix").alias("inside"), F.col("before").alias("start"))
        # the bin says its epoch: documents meet it before they have rows for epochs
        parts = sized.join(large, names).withColumn("place", place).where(F.substring("place", 1, depth) == F.col("inside"))
        sums = parts.groupBy(*names, "epoch", "budget", "start", F.substring("place", 1, depth + DIGITS).alias("prefix")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        older, edges = edges, cut(edges.where(F.col("n") <= bin_rows).unionByName(_edges(sums, names)), "edges")
        drop(older)
    ends = edges.select(*names, F.col("epoch").alias("last"), "prefix", "before")
    taken = sized.join(given, names).join(ends, names, "left")
    columns = ["doc_id", "epoch", *names, "n_tokens", "budget"]
    upto = F.explode(F.sequence(F.lit(1), F.coalesce("last", F.lit(epochs))))
    inside = taken.withColumn("epoch", upto).withColumn("place", place).where("last is null or epoch < last or (epoch = last and place < prefix)").select(*columns)
    # in the last bin equal rows are one, with a count: as many are taken as fit
    last = taken.where("last is not null").withColumn("epoch", F.col("last")).withColumn("place", place).where("startswith(place, prefix)").groupBy(*columns, "place", "before").agg(F.count("*").alias("m"))
    order = Window.partitionBy(*names).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = last.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("n_tokens") * F.col("m")).over(order), F.lit(0)))
    fits = fits.withColumn("times", F.least(F.col("m"), F.expr("(budget - start) div n_tokens"))).where("start <= budget and times > 0")
    return inside.unionByName(fits.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*columns))
