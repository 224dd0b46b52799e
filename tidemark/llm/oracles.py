"""DuckDB SQL of the corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM pat),
grams AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM d, lens)),
hit AS (SELECT doc_id, k, grams.n, item_id FROM grams JOIN pat USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_TOKENS = r"len(regexp_split_to_array(regexp_replace(coalesce(text, ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g'), '[ \t\n\r]+'))"
_PART = """
{name}_fill AS (
  SELECT *, {budget} AS parent_budget,
         {budget} - coalesce(sum(cap) OVER w, 0) AS rest,
         sum(wt) OVER (PARTITION BY {family}) - coalesce(sum(wt) OVER w, 0) AS left_wt
  FROM ({source})
  WINDOW w AS (PARTITION BY {family} ORDER BY cap / CAST(wt AS DOUBLE), {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_flag AS (
  SELECT *, min(CASE WHEN cap > rest * wt // left_wt THEN cap / CAST(wt AS DOUBLE) END) OVER (PARTITION BY {family}) AS level
  FROM {name}_fill),
{name} AS (
  SELECT *, CASE WHEN level IS NULL OR cap / CAST(wt AS DOUBLE) < level THEN cap
                 ELSE least(cap, first_rest * wt // first_wt) END AS budget
  FROM (SELECT *, max(CASE WHEN cap / CAST(wt AS DOUBLE) >= level THEN rest END) OVER (PARTITION BY {family}) AS first_rest,
               max(CASE WHEN cap / CAST(wt AS DOUBLE) >= level THEN left_wt END) OVER (PARTITION BY {family}) AS first_wt
        FROM {name}_flag))"""

OP4 = rf"""
WITH t AS (
  SELECT doc_id, 'domain' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4) AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS source_name,
         CASE WHEN regexp_replace(coalesce(text, ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') = '' THEN 0 ELSE {_TOKENS} END AS n_tokens
  FROM documents),
held AS (SELECT domain, language, source_name, sum(n_tokens) AS tokens FROM t WHERE n_tokens > 0 GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) AS total FROM held),
{_PART.format(name="l1", family="1", key="domain", budget="(SELECT total FROM total)", source="SELECT domain, CAST(sum(tokens) * 2 AS BIGINT) AS cap, CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS wt FROM held GROUP BY domain")},
{_PART.format(name="l2", family="domain", key="language", budget="pb", source="SELECT h.domain, h.language, CAST(sum(h.tokens) * 2 AS BIGINT) AS cap, CASE h.language WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS wt, any_value(l1.budget) AS pb FROM held h JOIN l1 USING (domain) GROUP BY h.domain, h.language")},
{_PART.format(name="l3", family="domain, language", key="source_name", budget="pb", source="SELECT h.domain, h.language, h.source_name, CAST(h.tokens * 2 AS BIGINT) AS cap, 1 AS wt, l2.budget AS pb FROM held h JOIN l2 USING (domain, language)")},
ranked AS (
  SELECT t.doc_id, e.epoch, t.domain, t.language, t.source_name, t.n_tokens, l3.budget,
         sum(t.n_tokens) OVER (PARTITION BY t.domain, t.language, t.source_name
           ORDER BY e.epoch, md5('17:' || e.epoch || ':' || coalesce(CAST(t.doc_id AS VARCHAR), '')), t.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM t CROSS JOIN (VALUES (1), (2)) e(epoch) JOIN l3 USING (domain, language, source_name) WHERE t.n_tokens > 0)
SELECT doc_id, CAST(epoch AS INT) AS epoch, domain, language, source_name, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(budget AS BIGINT) AS budget
FROM ranked WHERE upto <= budget
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(pattern: str, kind: int, group: int, least: int) -> str:
    return f"""
SELECT doc_id, {kind} AS kind, pos AS s, pos + length(m) AS e, v FROM (
  SELECT doc_id, m, v, sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY rid ORDER BY k ROWS UNBOUNDED PRECEDING) AS pos
  FROM (SELECT rid, doc_id, k, p[k] AS gap, ms[k] AS m, vs[k] AS v, ms[k - 1] AS before
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM
              (SELECT rid, doc_id, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS ms,
                      regexp_extract_all(text, '{pattern}', {group}) AS vs FROM d))))
WHERE length(v) >= {least}"""


OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS ({_found(_ASSIGN, 0, 2, 6)} UNION ALL {_found("AKIA[A-Z0-9]+", 1, 0, 20)} UNION ALL {_found("[0-9a-f]{24,}", 2, 0, 24)}),
bare AS (SELECT * FROM ({_found("[A-Za-z0-9+/_=-]{20,}", 3, 0, 20)}) x
         WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owned AS (SELECT v, count(DISTINCT owner) AS n_owners, bool_or(kind < 3) AS is_base FROM every JOIN d USING (doc_id) GROUP BY v),
told AS (SELECT doc_id, kind, s, e,
                CASE WHEN kind < 3 THEN CASE WHEN n_owners >= 5 THEN 'copied' ELSE 'live' END
                     WHEN n_owners <= 2 OR (is_base AND n_owners < 5) THEN 'live' END AS verdict
         FROM every JOIN owned USING (v)),
agg AS (SELECT doc_id,
          count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
          string_agg(['assign','access','hex','live'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
          string_agg(['assign','access','hex','live'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind) AS spans,
          count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied
        FROM told WHERE verdict IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN agg USING (doc_id)
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, k, md5(array_to_string(w[k:k + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
dup AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT rid, p FROM (SELECT rid, unnest(range(k, k + 35)) AS p FROM g WHERE h IN (SELECT h FROM dup)) GROUP BY rid, p),
word AS (SELECT rid, p, w[p] AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS c FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT doc_id, len({_WORDS}) AS n FROM documents),
st AS (SELECT count(*) AS n, sum(n) / CAST(count(*) AS DOUBLE) AS mean FROM len),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT q.doc_id AS query_id, d.doc_id,
        round(sum(q.tf * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len.n / st.mean))), 9) AS score
      FROM tf q JOIN tf d ON q.t = d.t AND q.doc_id <> d.doc_id JOIN df ON df.t = q.t JOIN len ON len.doc_id = d.doc_id CROSS JOIN st
      WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank, doc_id, round(score, 6) AS score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

OP12 = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents),
d AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(w[1:least(c1, c2)], '') AS x, array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS y, array_to_string(w[greatest(c1, c2) + 1:], '') AS z
  FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

SQL = {"op12_infill": OP12, "op8_bm25_topk": OP8, "op3_substring_dedup": OP3, "op2_decontaminate": OP2, "op4_mix_sources": OP4, "op5_secrets": OP5}
