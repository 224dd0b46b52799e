"""Queries on stored artifacts: shards, releases, keyed stores and references, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from tidemark.functions import vector as V
from tidemark.operators import artifacts, references as X, stores
from tidemark.plans import queries as _core
from tidemark.plans.oracles import _LABEL, _LEAN, _POS, _S, _SEG, _SMALL, _UNIT, _w
from tidemark.session import cut, shared_dir, table
from tidemark.sources import datasets, driver_tables as T, lines, shards


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def vector_shards(spark, d):
    """Vectors as float32 shards, read back by their addresses; ``same``: bit for bit what was written."""
    root = _folder(spark, "vectors")
    given = _core._vectors(spark, d).select(F.concat(F.lit("vec:"), "vec_id").alias("key"), F.col("vector").cast("array<float>").alias("vector"))
    width = given.agg(F.max(F.size("vector"))).first()[0] or 1
    index, _ = shards.write_vectors(given, root, width)
    back = shards.read_floats(index, root, unit=True).join(given, "key")
    return back.select("key", "shard_no", F.col("row_index").cast("bigint").alias("row_index"), F.round(F.element_at("values", 1).cast("double"), 6).alias("first"), F.round(F.element_at("values", -1).cast("double"), 6).alias("last"), (F.col("values") == F.col("vector")).alias("same"))


def matrix_shards(spark, d):
    """Cosines of each user's last five items with all labels' centroids: matrices end to end, read back by offset."""
    root = _folder(spark, "matrices")
    vectors = _core._vectors(spark, d).select(F.concat(F.lit("item:"), "vec_id").alias("item_id"), "vector")
    labels = _core._centroids(spark, d).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("labels"))  # a fixed small set
    recent = _core.recent_five(spark, d).join(vectors, "item_id").crossJoin(labels)
    lines = recent.select("user_id", "age", F.transform("labels", lambda c: V.cosine(F.col("vector"), c["centroid"]).cast("float")).alias("line"))
    matrices = lines.groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("age", "line")))["line"].alias("matrix"))
    index, made = shards.write_matrices(matrices, root)
    wrong = shards.misplaced(index, made).agg(F.count("*").alias("misplaced"))
    back = shards.read_floats(index, root)
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return back.crossJoin(wrong).select(F.col("key").alias("user_id"), "global_offset", "n_rows", "n_cols", total.alias("total"), "misplaced")


def release_tables(spark, d):
    """A release of two tables, published twice; what is loaded by its version, counted."""
    root = _folder(spark, "releases")
    tables = {"segments": T.segments(spark, d), "categories": T.categories(spark, d)}
    version, created = artifacts.publish(spark, root, tables, {"recipe": "demo"})
    again = artifacts.publish(spark, root, tables, {"recipe": "demo"})
    loaded = artifacts.load(spark, root, version)
    rows = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.lit(created).alias("created"), F.lit(again == (version, False)).alias("reused")) for n, t in sorted(loaded.items())]
    return rows[0].unionByName(rows[1])


def store_lookup(spark, d):
    """The customers of urgent orders and some that nobody knows, resolved in a keyed store against a release's inventory.

    The inventory leaves out every hundredth customer, and has another checksum for every hundred-and-first.
    """
    path = _folder(spark, "store")
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    stores.write_store(customers, path, ["c_custkey"])
    named = customers.select(stores.identity_hash(c_custkey=F.col("c_custkey")).alias("identity"), "c_custkey")
    listed = stores.inventory(spark, path, "customers").join(named, "identity").where("c_custkey % 100 <> 0")
    listed = listed.withColumn("checksum", F.when(F.col("c_custkey") % 101 == 0, "sha256:0").otherwise(F.col("checksum")))
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    wanted = orders.unionByName(orders.where("c_custkey % 50 = 1").select((-F.col("c_custkey")).alias("c_custkey"))).select("c_custkey", stores.identity_hash(c_custkey=F.col("c_custkey")).alias("identity"))
    wanted = cut(wanted.distinct(), "wanted")
    got = stores.resolve(spark, path, "customers", wanted, listed)
    return got.join(wanted, "identity").select("c_custkey", stores.file_key("customers", F.col("identity")).alias("file_key"), "refused", F.col("record.c_name").alias("c_name"))


def reference_conflicts(spark, d):
    """Orders refer to their customer and suppliers, these to nations, nations to regions: who names what is not there or
    has changed, and which orders reach two regions. Customers of every fiftieth key are left out; every thirtieth supplier changed."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    o, c, s, n, li = (table(spark, d, t) for t in ("orders", "customer", "supplier", "nation", "lineitem"))
    mine = lambda df, kind, col: df.select(key(kind, col).alias("artifact"), F.lit(kind).alias("kind"), F.lit("v1").alias("checksum"))
    made = mine(o, "order", "o_orderkey").unionByName(mine(c.where("c_custkey % 50 <> 0"), "customer", "c_custkey")).unionByName(mine(n, "nation", "n_nationkey")).unionByName(mine(table(spark, d, "region"), "region", "r_regionkey"))
    made = made.unionByName(mine(s, "supplier", "s_suppkey").withColumn("checksum", F.when(F.element_at(F.split("artifact", ":"), 2).cast("bigint") % 30 == 0, "v2").otherwise("v1")))
    to = lambda df, a, x, b, y: df.select(key(a, x).alias("artifact"), key(b, y).alias("upstream"), F.lit("v1").alias("checksum"))
    # once each as numbers, where the orders are met
    supplied = li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_suppkey").distinct()
    refs = to(o, "order", "o_orderkey", "customer", "o_custkey").unionByName(to(supplied, "order", "l_orderkey", "supplier", "l_suppkey"))
    refs = refs.unionByName(to(c.where("c_custkey % 50 <> 0"), "customer", "c_custkey", "nation", "c_nationkey")).unionByName(to(s, "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(to(n, "nation", "n_nationkey", "region", "n_regionkey"))
    return X.contradictions(made, refs, single=["region"])


def view_binding(spark, d):
    """Views bound to users by the fingerprint of their history. Users of every seventh key have views of another history, of every eleventh none, of every thirteenth two."""
    number = F.substring("user_id", 6, 20).cast("bigint")
    h = _core.history_fingerprint(spark, d).select("user_id", F.col("split").alias("cutoff"), "fingerprint")
    views = h.where(number % 11 != 0).withColumn("fingerprint", F.when(number % 7 == 0, "other").otherwise(F.col("fingerprint"))).withColumn("copy", F.explode(F.when(number % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    bound = X.bind_views(h, views.select("user_id", "cutoff", "fingerprint", F.concat(F.lit("view of "), "user_id").alias("view")))
    return bound


def line_records(spark, d):
    """Events written as JSON lines in order of their ids, in files of 3,000, and read back with the number of each line."""
    path = _folder(spark, "lines")
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    made = lines.write_ordered(e, [F.col("event_id")], F.to_json(F.struct("event_id", "event_type", "value"), {"ignoreNullFields": "false"}), path, lines=3000)
    read = lines.json_records(spark, path, e.schema).withColumn("file", F.element_at(F.split("file", "/"), -1))
    return read.join(made.select("file", F.col("lines").alias("of")), "file").select("file", "ordinal", "of", "event_id", "event_type", "value")


def quoted_records(spark, d):
    """Page sources, with all their quotes and line breaks, as fields of CSV files, read back by record, in the order of each file."""
    path = _folder(spark, "quoted")
    p = table(spark, d, "pages").where("html is not null").select("page_id", "url", F.regexp_replace("html", "\r", "").alias("html"))
    p.repartitionByRange("page_id").sortWithinPartitions("page_id").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    got = lines.csv_records(spark, path, ("page_id", "url", "html")).withColumn("page_id", F.col("page_id").cast("bigint"))
    before = F.lag(F.struct("ordinal", "page_id")).over(Window.partitionBy("file").orderBy("ordinal"))
    got = got.withColumn("before", before)
    return got.select("page_id", F.sha2("url", 256).alias("url_sha256"), F.sha2("html", 256).alias("html_sha256"), F.coalesce((F.col("before.ordinal") + 1 == F.col("ordinal")) & (F.col("before.page_id") < F.col("page_id")), F.col("ordinal") == 2).alias("in_order"))


def dataset_violations(spark, d):
    """A source dataset written from the tables and loaded by its manifest: what breaks its rules. Items of every tenth key are
    left out, every twentieth event's time goes back, limits are set below the users' number."""
    root = _folder(spark, "dataset")
    e = T.small_events(spark, d)
    number = F.substring("item_id", 6, 20).cast("bigint")
    time = F.when(F.col("interaction_index") % 20 == 19, F.lit(0)).otherwise(F.col("occurred_at_ms"))
    events = e.select("user_id", "item_id", "interaction_index", time.alias("occurred_at_ms"), F.lit("view").alias("interaction_type"), "value", F.lit(None).cast("string").alias("metadata"))
    seg = T.segments(spark, d)
    items = e.select("item_id").unionByName(seg.select("item_id")).distinct().where(number % 10 != 0).withColumn("metadata", F.lit(None).cast("string"))
    locator = F.struct("kind", F.lit("media").alias("media_ref"), "duration_ms", "start_ms", "end_ms")
    segments = seg.select("item_id", "segment_id", "sequence_index", locator.alias("locator"), F.lit(None).cast("string").alias("metadata"))
    parts = {}
    for name, df, order in (("events", events, ["user_id", "interaction_index"]), ("items", items, ["item_id"]), ("segments", segments, ["item_id", "sequence_index", "segment_id"])):
        line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        parts[name] = lines.write_ordered(df, [F.col(c) for c in order], line, f"{root}/{name}")
    manifest = datasets.manifest_for("demo", "v1", parts, {n: n for n in parts}, root)
    loaded = datasets.load(spark, root, manifest)
    return datasets.violations(loaded, datasets.Limits(users=10)).groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("first"))


_CUS = "'customers/' || substr(h, 1, 2) || '/' || h || '.json'"

SQL: dict[str, str] = {
    "dataset_violations": _w(_SMALL, _SEG).rstrip() + """, e AS (SELECT *, CASE WHEN interaction_index % 20 = 19 THEN 0 ELSE occurred_at_ms END AS t FROM ev), g AS (SELECT item_id, segment_id, sequence_index FROM seg),
        i AS (SELECT DISTINCT item_id FROM (SELECT item_id FROM ev UNION ALL SELECT item_id FROM seg) WHERE CAST(substr(item_id, 6) AS BIGINT) % 10 <> 0),
        v AS (SELECT 'an event of an unknown item' AS rule, user_id || '/' || interaction_index AS subject FROM e WHERE item_id NOT IN (SELECT item_id FROM i)
              UNION ALL SELECT 'time goes back', user_id || '/' || interaction_index FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY interaction_index) AS b FROM e) WHERE t < b
              UNION ALL SELECT 'a segment of an unknown item', item_id || '/' || segment_id FROM g WHERE item_id NOT IN (SELECT item_id FROM i)
              UNION ALL SELECT 'segments are not 0 to n - 1', item_id FROM g GROUP BY item_id HAVING min(sequence_index) <> 0 OR max(sequence_index) <> count(*) - 1 OR count(DISTINCT sequence_index) <> count(*)
              UNION ALL SELECT 'a segment stands twice', item_id || '/' || segment_id FROM g GROUP BY item_id, segment_id HAVING count(*) > 1
              UNION ALL SELECT 'more than the limit', 'users/' || count(DISTINCT user_id) FROM e HAVING count(DISTINCT user_id) > 10)
        SELECT rule, count(*) AS n, min(subject) AS first FROM v GROUP BY rule""",
    "line_records": """SELECT 'part-' || lpad(CAST(n // 3000 AS VARCHAR), 8, '0') || '.txt' AS file, n % 3000 + 1 AS ordinal, least(3000, total - n // 3000 * 3000) AS of, event_id, event_type, value
        FROM (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS total FROM events)""",
    "quoted_records": "SELECT page_id, sha256(url) AS url_sha256, sha256(replace(html, chr(13), '')) AS html_sha256, true AS in_order FROM pages WHERE html IS NOT NULL",
    "vector_shards": _w(_UNIT) + """SELECT key, (row_number() OVER (ORDER BY key) - 1) // 4096 AS shard_no, (row_number() OVER (ORDER BY key) - 1) % 4096 AS row_index,
        round(CAST(CAST(v[1] AS FLOAT) AS DOUBLE), 6) AS first, round(CAST(CAST(v[-1] AS FLOAT) AS DOUBLE), 6) AS last, true AS same FROM (SELECT 'vec:' || vec_id AS key, v FROM u)""",
    "matrix_shards": _w(_SMALL, _LABEL, _POS, _UNIT) + """SELECT user_id, CAST(sum(n_rows * n_cols) OVER (ORDER BY user_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_rows * n_cols AS global_offset, n_rows, n_cols, total, CAST(0 AS BIGINT) AS misplaced
        FROM (SELECT user_id, count(DISTINCT n - pos) AS n_rows, count(DISTINCT cen.label) AS n_cols, round(sum(CAST(CAST(list_dot_product(v, c) AS FLOAT) AS DOUBLE)), 6) AS total
              FROM pos JOIN u ON item_id = 'item:' || vec_id CROSS JOIN cen WHERE n - pos < 5 GROUP BY user_id)""",
    "release_tables": "SELECT 'segments' AS name, count(*) AS n, true AS created, true AS reused FROM conversations UNION ALL SELECT 'categories', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation), true, true",
    "store_lookup": f"""WITH k AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), w AS (SELECT c_custkey FROM k UNION SELECT -c_custkey FROM k WHERE c_custkey % 50 = 1),
        x AS (SELECT *, sha256('{{"c_custkey":' || c_custkey || '}}' || chr(10)) AS h FROM w LEFT JOIN customer USING (c_custkey))
        SELECT c_custkey, {_CUS} AS file_key, CASE WHEN c_name IS NULL OR c_custkey % 100 = 0 THEN 'not in the inventory' WHEN c_custkey % 101 = 0 THEN 'changed since the release' END AS refused,
               CASE WHEN c_custkey % 100 <> 0 AND c_custkey % 101 <> 0 THEN c_name END AS c_name FROM x""",
    "reference_conflicts": """WITH oc AS (SELECT o_orderkey AS k, n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 50 <> 0
        UNION ALL SELECT o_orderkey, n_regionkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
        SELECT 'order:' || k AS artifact, 'region' AS subject, 'two versions are reached' AS problem FROM oc GROUP BY k HAVING min('region:' || r) <> max('region:' || r)
        UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'an unknown artifact is named' FROM orders WHERE o_custkey % 50 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'another checksum is named' FROM lineitem WHERE l_suppkey % 30 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_suppkey IN (SELECT s_suppkey FROM supplier)
        UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'an unknown artifact is named' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "view_binding": _w(*_S, _LEAN) + """SELECT DISTINCT user_id, split AS cutoff, CASE WHEN k % 11 = 0 THEN 'no view' WHEN k % 13 = 0 THEN 'several views' WHEN k % 7 = 0 THEN 'made of another history' END AS refused,
        CASE WHEN k % 11 <> 0 AND k % 13 <> 0 AND k % 7 <> 0 THEN 'view of ' || user_id END AS view FROM (SELECT *, CAST(substr(user_id, 6) AS BIGINT) AS k FROM hist)""",
}
