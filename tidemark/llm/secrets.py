"""Secret scans in DataFrame functions alone, judged by corpus-wide ownership.

Base spans come from three fixed patterns. A position is recovered without a UDF: the text is split at the matches,
and the lengths of pieces and matches, taken in turn, add up to code-point offsets; in runs of ``RUN`` matches, then over
the runs, so that a text of very many matches costs little more for each. Candidate values (the base values,
and bare runs of credential characters that look generated) are hashed, reduced to distinct (value, repository, owner)
before the shuffle, and counted by distinct repositories and owners over the whole corpus:

* ``copied``: a value that ``copied_owners`` or more owners hold in as many repositories is an example that everybody
  pastes (many owners of one repository's name are forks of one leak);
* ``live``: any other base value, and a bare value that at most ``few_owners`` owners hold or that equals a base value.

Live bare values are added as spans of kind ``live``; base spans always stay.

Defined results: a null text is empty and has no spans; a null source counts as one owner of its own, and so does a
missing one; repeated rows are scanned each on their own and count once for ownership; an empty table gives no rows; other
columns, whatever their names and types, are ignored by ``judge`` and returned as they are by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut

#: Fixed patterns of the contract; letters of the keyword in either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Least length of what counts: group 2 of assign, the whole of access and hex.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words that a text with an assign match holds in lower case; a cheap test before the pattern.
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Bare candidates: runs of credential characters with a digit, a lower and an upper case letter.
BARE = r"[A-Za-z0-9+/_=-]{20,}"
COPIED_OWNERS = 5
FEW_OWNERS = 2
#: Matches whose offsets are added up at a time.
RUN = 128
KINDS = ("assign", "access", "hex", "live")

_SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _lit(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _spans(pattern: str, kind: int, value_group: int, least: int, possible: str) -> Column:
    """Spans of one kind: offsets by adding up the lengths of pieces and matches in turn; short values fall afterwards."""
    p = _lit(pattern)
    # z: (gap, match, value) in order; runs: (length, spans from the run's start); then each run moved to its place
    found = f"""
      filter(flatten(element_at(transform(array(
        zip_with(zip_with(slice(transform(split(text, '{p}', -1), x -> char_length(x)), 1, greatest(size(regexp_extract_all(text, '{p}', 0)), 1)),
                          regexp_extract_all(text, '{p}', 0), (gap, m) -> struct(gap as gap, char_length(m) as m)),
                 regexp_extract_all(text, '{p}', {value_group}), (x, v) -> struct(x.gap as gap, x.m as m, v as v))),
        z -> element_at(transform(array(transform(sequence(0, (size(z) - 1) div {RUN}), r -> aggregate(slice(z, r * {RUN} + 1, {RUN}),
            struct(0L as at, cast(array() as {_SPAN}) as out),
            (acc, x) -> if(x.m is null, acc, struct(
              acc.at + x.gap + x.m as at,
              concat(acc.out, array(struct(acc.at + x.gap as start, {kind} as kind, acc.at + x.gap + x.m as end, x.v as value))) as out))))),
          runs -> zip_with(runs, slice(aggregate(runs, array(0L), (o, r) -> concat(o, array(element_at(o, -1) + r.at))), 1, size(runs)),
            (r, o) -> transform(r.out, s -> struct(s.start + o as start, s.kind as kind, s.end + o as end, s.value as value)))), 1)), 1)),
        s -> char_length(s.value) >= {least})"""
    return F.expr(f"case when {possible} then {found} else cast(array() as {_SPAN}) end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, owner columns, base spans (sorted by start, then kind) and bare candidates; no text leaves the scan."""
    any_word = " or ".join(f"contains(low, '{w}')" for w in KEYWORDS)
    hex_least, bare = "[0-9a-f]{%d}" % LEAST["hex"], _lit(BARE)
    return (
        docs.withColumn("low", F.lower("text"))
        .withColumns(
            {
                "assign": _spans(ASSIGN, 0, 2, LEAST["assign"], any_word),
                "access": _spans(ACCESS, 1, 0, LEAST["access"], "contains(text, 'AKIA')"),
                "hex": _spans("[0-9a-f]{%d,}" % LEAST["hex"], 2, 0, LEAST["hex"], f"text rlike '{hex_least}'"),
                "bare": _spans(BARE, 3, 0, 20, f"text rlike '{bare}'"),
            }
        )
        .withColumn("base", F.expr("array_sort(concat(assign, access, hex))"))
        .withColumn(
            "bare",
            F.expr("filter(bare, b -> b.value rlike '[0-9]' and b.value rlike '[a-z]' and b.value rlike '[A-Z]' and not exists(base, s -> s.start < b.end and b.start < s.end))"),
        )
        .drop("low", "assign", "access", "hex", "text")
    )


def ownership(found: DataFrame) -> DataFrame:
    """value hash -> distinct repositories and owners, and whether a base pattern ever matched it."""
    one = found.select("repo", "owner", F.explode(F.concat("base", "bare")).alias("s")).select(
        F.sha2("s.value", 256).alias("hash"), "repo", "owner", (F.col("s.kind") < 3).alias("is_base")
    )
    # both counts go by (value, repository) and (value, owner) first: a hot value is one row of each before it is counted
    return one.groupBy("hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.max("is_base").alias("is_base"))


def _owned(docs: DataFrame, repo: Column | None, owner: Column | None) -> tuple[Column, Column]:
    """(repository, owner) of a row: (source, lang) and source where none is given, empty where there is no such column."""
    have = [F.col(c) for c in ("source", "lang") if c in docs.columns]
    repo = F.concat_ws("/", *have) if repo is None else repo
    owner = (F.col("source") if "source" in docs.columns else F.lit("")) if owner is None else owner
    return F.coalesce(repo.cast("string"), F.lit("")), F.coalesce(owner.cast("string"), F.lit(""))


def _verdicts(found: DataFrame, copied_owners: int, few_owners: int) -> DataFrame:
    """row -> told: the spans of ``found`` (row, repo, owner, base, bare) with their verdicts."""
    each = found.select("row", F.explode(F.concat("base", "bare")).alias("s")).withColumn("hash", F.sha2("s.value", 256))
    copied = (F.col("n_owners") >= copied_owners) & (F.col("n_repos") >= copied_owners)
    told = each.join(ownership(found), "hash").select(
        "row",
        "s",
        F.when(F.col("s.kind") < 3, F.when(copied, "copied").otherwise("live"))
        .otherwise(F.when((F.col("n_owners") <= few_owners) | (F.col("is_base") & ~copied), "live").otherwise("none"))
        .alias("verdict"),
    )
    return told.where("verdict <> 'none'").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "verdict"))).alias("told"))


_NONE = "cast(array() as array<struct<start:long,kind:int,end:long,verdict:string>>)"


def judge(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, copied_owners: int = COPIED_OWNERS, few_owners: int = FEW_OWNERS) -> DataFrame:
    """One row per document: doc_id, base, spans (base and live, sorted by start, then kind; each with its verdict).

    ``repo`` and ``owner`` default to (source, lang) and source.
    """
    repo, owner = _owned(docs, repo, owner)
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), repo.alias("repo"), owner.alias("owner"))
    found = cut(scan(own).withColumn("row", F.monotonically_increasing_id()), "secrets")
    return found.join(_verdicts(found, copied_owners, few_owners), "row", "left").select("doc_id", "base", F.coalesce("told", F.expr(_NONE)).alias("spans"))


def _joined(spans: str) -> str:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def digest(judged: DataFrame) -> DataFrame:
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)")
    return judged.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> s.verdict = 'live')) as long)").alias("n_live"),
        F.expr("cast(size(filter(spans, s -> s.verdict = 'copied')) as long)").alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", repo: Column | None = None, owner: Column | None = None, copied_owners: int = COPIED_OWNERS, few_owners: int = FEW_OWNERS) -> DataFrame:
    """``docs`` with each live span replaced by ``mark``; widely copied examples stay. Columns as before; n_chars, if there, follows the text.

    The scan is written once with the rows; only rows with a candidate span are shuffled.
    """
    repo, owner = _owned(docs, repo, owner)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), repo.alias("repo"), owner.alias("owner"))
    found = cut(scan(whole).withColumn("row", F.monotonically_increasing_id()), "secrets")
    held = found.where("size(base) + size(bare) > 0")
    live = _verdicts(held, copied_owners, few_owners).select("row", F.expr("filter(told, s -> s.verdict = 'live')").alias("live"))
    cutout = f"""
      element_at(transform(array(aggregate(live, struct(1L as at, cast(array() as array<string>) as out),
        (a, s) -> if(s.end + 1 <= a.at, a, struct(s.end + 1 as at,
           concat(a.out, array(substring(doc.text, cast(a.at as int), cast(greatest(s.start + 1 - a.at, 0) as int)), '{_lit(mark)}')) as out)))),
        a -> concat(array_join(a.out, ''), substring(doc.text, cast(a.at as int)))), 1)"""
    new = F.expr(f"case when live is null or size(live) = 0 then doc.text else {cutout} end")
    changed = held.join(live, "row", "left").withColumn("new", new)
    column = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in docs.columns:
        column["n_chars"] = F.when(F.col("new").eqNullSafe(F.col("doc.text")), F.col("doc.n_chars")).otherwise(F.char_length("new").cast(docs.schema["n_chars"].dataType))
    return found.where("size(base) + size(bare) = 0").select("doc.*").unionByName(changed.select(*[x.alias(c) for c, x in column.items()]))
