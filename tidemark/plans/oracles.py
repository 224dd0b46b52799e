"""DuckDB SQL for the domain queries, written apart from the Spark plans."""

from tidemark import constants as K

# --- shared tables -------------------------------------------------------------------------------------------------

_SMALL = """ev AS (
  SELECT 'user:' || user_id AS user_id, 'item:' || json_extract_string(props, '$.k') AS item_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS interaction_index,
         epoch_us(ts) // 1000 AS occurred_at_ms, value, event_type = 'error' AS hate, event_type = 'purchase' AS action
  FROM events)"""
_LARGE = """ev AS (
  SELECT 'user:' || o_custkey AS user_id, 'item:' || l_partkey AS item_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS interaction_index,
         epoch_us(o_orderdate) // 1000 AS occurred_at_ms, l_quantity AS value, l_returnflag = 'R' AS hate, false AS action
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LABEL = """lab AS (
  SELECT *, CASE WHEN hate THEN 'explicit_negative_v1' WHEN value > 3 OR action THEN 'positive_v1' ELSE 'passive_nonpositive_v1' END AS label FROM ev)"""
_POS = """pos AS (
  SELECT user_id, item_id, interaction_index, occurred_at_ms, row_number() OVER (PARTITION BY user_id ORDER BY interaction_index) AS pos,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM lab WHERE label = 'positive_v1')"""
_PARTS = """parts AS (
  SELECT *, CASE WHEN pos = n THEN 'test' WHEN pos = n - 1 THEN 'validation' ELSE 'train' END AS split FROM pos WHERE n >= 5)"""
_VOCAB = """vocab AS (
  SELECT item_id, row_number() OVER (ORDER BY item_id) AS model_index FROM (SELECT DISTINCT item_id FROM parts WHERE split = 'train'))"""
_HELD = f"""cut AS (
  SELECT *, 'p3cutoff-' || sha256('{{"history_end_interaction_index_exclusive":' || interaction_index || ',"schema_version":"{K.CUTOFF_SCHEMA}","source_data_version":"demo","user_id":"' || user_id || '"}}' || chr(10)) AS cutoff_identity
  FROM parts WHERE split <> 'train'),
held AS (
  SELECT *, 'p3target-' || sha256('{{"cutoff_identity":"' || cutoff_identity || '","schema_version":"{K.TARGET_SCHEMA}","source_data_version":"demo","split":"' || split || '","target_interaction_index":' || interaction_index || ',"target_item_id":"' || item_id || '","user_id":"' || user_id || '"}}' || chr(10)) AS sample_id,
         item_id IN (SELECT item_id FROM vocab) AS warm
  FROM cut)"""
_SEEN = """seen AS (
  SELECT DISTINCT h.user_id, h.split, p.item_id FROM held h JOIN parts p ON p.user_id = h.user_id AND p.pos < h.pos)"""
_POP = """pop AS (
  SELECT *, row_number() OVER (ORDER BY c DESC, item_id) AS g FROM (
    SELECT v.item_id, v.model_index, count(p.item_id) AS c FROM vocab v LEFT JOIN parts p ON p.item_id = v.item_id AND p.split = 'train' GROUP BY v.item_id, v.model_index))"""
_CAND = """cand AS (
  SELECT h.user_id, h.split, h.item_id AS target, p.item_id, p.g,
         row_number() OVER (PARTITION BY h.user_id, h.split ORDER BY p.g) AS place, count(*) OVER (PARTITION BY h.user_id, h.split) AS candidates
  FROM held h CROSS JOIN pop p
  WHERE h.warm AND (p.item_id = h.item_id OR NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = h.user_id AND s.split = h.split AND s.item_id = p.item_id)))"""
_RANKED = """ranked AS (
  SELECT h.user_id, h.split, h.item_id, h.warm, c.place AS rank, coalesce(c.candidates, 0) AS candidates
  FROM held h LEFT JOIN cand c ON c.user_id = h.user_id AND c.split = h.split AND c.item_id = h.item_id)"""
_RAW = """raw AS (
  SELECT event_id * 4 + part + 2 AS ordinal, 'u' || user_id AS user_id, 'p' || k AS pid, 'a' || (k % 7) AS author_id,
         CASE WHEN part = 0 THEN 1 ELSE 2 END AS category_level, CASE WHEN part = 0 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey END AS category_id,
         'r' || n_regionkey AS root_id, epoch_us(ts) // 1000000 AS exposed_time, event_id % 3 + k AS author_fans_count, value AS watch_time,
         CAST(k + 1 AS DOUBLE) AS duration, event_type = 'purchase' AS cvm_like, event_type = 'click' AS click, event_type = 'error' AS hate,
         CASE WHEN k % 11 = 0 THEN NULL ELSE 'tag' || (k % 5) END AS tag_name,
         CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 AND event_id % 2 = 0 THEN 'second' ELSE 'title ' || k END AS title
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e JOIN nation ON k % 25 = n_nationkey
  CROSS JOIN (VALUES (0), (1), (2)) p(part) WHERE part < 2 OR event_id % 10 = 0)"""
_EXPO = """expo AS (
  SELECT user_id, pid, exposed_time, min(ordinal) AS first_ordinal, count(*) AS row_count,
         count(*) - count(DISTINCT (author_id, category_level, category_id, root_id, author_fans_count, watch_time, duration, cvm_like, click, hate, tag_name, title)) AS duplicate_rows,
         min_by(watch_time, ordinal) AS watch_time, min_by(duration, ordinal) AS duration, min_by(cvm_like, ordinal) AS cvm_like, min_by(hate, ordinal) AS hate
  FROM raw GROUP BY user_id, pid, exposed_time)"""
_PATHS = """path AS (
  SELECT 'r' || r_regionkey AS category_id, r_name AS path FROM region
  UNION ALL SELECT 'n' || n_nationkey, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_SEG = """seg AS (
  SELECT 'item:' || conv_id AS item_id, 'seg:' || turn AS segment_id, turn AS sequence_index,
         CASE WHEN turn % 2 = 0 THEN 0 ELSE turn * 1000 END AS start_ms,
         CASE WHEN turn % 2 = 0 THEN 0 ELSE turn * 1000 END + length(coalesce(text, '')) AS end_ms FROM conversations)"""
_ITEMS = "items AS (SELECT DISTINCT 'item:' || json_extract_string(props, '$.k') AS item_id FROM events)"
_SCENE = """c AS (
  SELECT l_orderkey AS run_id, l_partkey AS part, 'item:' || l_partkey AS item_id, round(max(l_quantity) / 50, 6) AS score FROM lineitem GROUP BY ALL),
s AS (
  SELECT run_id, item_id, 'segment_' || seg AS segment_id, ((part * 7 + seg * 13) % 100) / 100 AS value,
         CASE WHEN (part + seg) % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM c CROSS JOIN (VALUES (1), (2)) v(seg)),
cr AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, item_id) AS rank FROM c),
margin AS (
  SELECT a.run_id, round(a.score - b.score, 12) AS margin FROM cr a LEFT JOIN cr b ON b.run_id = a.run_id AND b.rank = 2 WHERE a.rank = 1),
bs AS (
  SELECT run_id, item_id, segment_id, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, item_id, segment_id) AS r FROM s) WHERE r = 1)"""
# the best open segment does not depend on the scores, so a run takes its segments in one fixed order until it stops
_LOOP = f"""taken AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, item_id, segment_id) AS k FROM s),
step AS (SELECT unnest(range(0, {K.MAX_ACTIONS + 1})) AS t),
now AS (
  SELECT c.run_id, t, c.item_id, round(c.score + sum(CASE WHEN taken.item_id IS NULL THEN 0 WHEN taken.item_id = c.item_id THEN 0.1::DOUBLE ELSE -0.01::DOUBLE END), 12) AS score
  FROM c CROSS JOIN step LEFT JOIN taken ON taken.run_id = c.run_id AND k <= t AND status = 'succeeded' GROUP BY c.run_id, t, c.item_id, c.score),
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, t ORDER BY score DESC, item_id) AS r FROM now),
lead AS (SELECT run_id, t, max(item_id) FILTER (r = 1) AS top_item, max(score) FILTER (r = 1) AS top, max(score) FILTER (r = 2) AS second FROM placed GROUP BY ALL),
may AS (
  SELECT lead.run_id, lead.t, top_item, top, round(top - second, 12) AS margin, item_id, segment_id, value, status,
         CASE WHEN lead.t = {K.MAX_ACTIONS} THEN '{K.BUDGET}' WHEN k IS NULL THEN '{K.NO_SEGMENTS}' WHEN top - second >= {K.MARGIN_THRESHOLD} - 5e-13 THEN '{K.CERTAIN}'
              WHEN value < {K.MIN_VALUE} THEN '{K.TOO_LOW}' END AS reason
  FROM lead LEFT JOIN taken ON taken.run_id = lead.run_id AND k = lead.t + 1),
stop AS (SELECT run_id, min(t) AS z FROM may WHERE reason IS NOT NULL GROUP BY run_id),
tr AS (SELECT may.*, z, reason IS NULL AS acted, reason IS NULL OR reason = '{K.TOO_LOW}' AS chose FROM may JOIN stop USING (run_id) WHERE t <= z)"""
_UNIT = """nrm AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n, embedding FROM embeddings),
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS v FROM nrm),
flat AS (SELECT vec_id, label, unnest(range(1, len(v) + 1)) AS i, v FROM u),
sums AS (SELECT label, i, sum((1 + vec_id % 3) * v[i]) AS x FROM flat GROUP BY ALL),
cen AS (SELECT label, list(x / n ORDER BY i) AS c FROM (SELECT label, i, x, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM sums) GROUP BY label)"""


def _w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_S = (_SMALL, _LABEL, _POS, _PARTS)
_L = (_LARGE, _LABEL, _POS, _PARTS)
_SH = (*_S, _VOCAB, _HELD)
_LH = (*_L, _VOCAB, _HELD)
_LEAN = "hist AS (SELECT h.user_id, h.split, h.item_id AS target_item, p.item_id, p.interaction_index, p.pos FROM parts h JOIN parts p ON p.user_id = h.user_id AND p.pos < h.pos WHERE h.split <> 'train')"
_TRAIN = f"""smp AS (
  SELECT 'p3train-' || sha256('{{"schema_version":"{K.TRAIN_SCHEMA}","source_data_version":"demo","target_interaction_index":' || interaction_index || ',"target_item_id":"' || item_id || '","user_id":"' || user_id || '"}}' || chr(10)) AS sample_id,
         user_id, item_id, interaction_index, pos - 1 AS history_length FROM parts WHERE split = 'train' AND pos > 1)"""


def _limbs(h: str, start: int, n: int, mod: str) -> str:
    x = "0"
    for i in range(n):
        x = f"(({x}) * 4294967296 + CAST(('0x' || substr({h}, {start + 8 * i}, 8)) AS BIGINT)) % {mod}"
    return x


def _walk(only: str, *key: str) -> str:
    own, walked = ", ".join(key), ", ".join(f"w.{k}" for k in key)
    return f"""v AS (SELECT count(*) AS nv FROM vocab),
own AS (SELECT user_id, split, item_id FROM seen UNION SELECT user_id, split, item_id FROM held),
dig AS (
  SELECT h.*, sha256('{{"recipe":"{K.CANDIDATE_RECIPE}","seed":{K.EVAL_SEED},"target_sample_id":"' || sample_id || '"}}' || chr(10)) AS h FROM held h WHERE warm{only}),
st AS (SELECT user_id, split, item_id, nv AS n, {_limbs('h', 1, 4, 'nv')} AS start, {_limbs('h', 33, 4, 'nv')} AS raw_step FROM dig CROSS JOIN v),
stp AS (SELECT *, list_filter(list_transform(range(0, 200), lambda j: CASE WHEN (raw_step + j) % n = 0 THEN 1 ELSE (raw_step + j) % n END), lambda x: gcd(x, n) = 1)[1] AS step FROM st),
walk AS (SELECT user_id, split, item_id AS target, o, (start + o * step) % n + 1 AS model_index FROM (SELECT *, unnest(range(0, n)) AS o FROM stp)),
neg AS (
  SELECT {own}, target, item_id FROM (
    SELECT {walked}, w.target, voc.item_id, row_number() OVER (PARTITION BY {walked} ORDER BY o) AS r
    FROM walk w JOIN vocab voc USING (model_index) WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.user_id = w.user_id AND x.split = w.split AND x.item_id = voc.item_id))
  WHERE r <= 100)"""


def _met(k: int, term: str) -> str:
    return f"round(sum(CASE WHEN warm THEN CASE WHEN rank <= {k} THEN {term} ELSE 0 END END) / sum(CASE WHEN warm THEN 1 END), 9)"


_METRICS = f"""SELECT split, count(*) AS targets, count(*) FILTER (warm) AS warm_targets, round(count(*) FILTER (warm) / CAST(count(*) AS DOUBLE), 9) AS coverage,
  {_met(10, '1 / log2(rank + 1)')} AS ndcg_10, {_met(10, '1.0::DOUBLE')} AS hr_10, {_met(20, '1 / log2(rank + 1)')} AS ndcg_20, {_met(20, '1.0::DOUBLE')} AS hr_20,
  {_met(10, '1.0::DOUBLE / rank')} AS mrr_10, {_met(100, '1.0::DOUBLE')} AS recall_100 FROM ranked GROUP BY split"""

SQL: dict[str, str] = {
    "label_interactions": _w(_SMALL, _LABEL) + "SELECT user_id, interaction_index, item_id, label FROM lab",
    "positive_events": _w(_SMALL, _LABEL) + "SELECT user_id, item_id, interaction_index, occurred_at_ms FROM lab WHERE label = 'positive_v1'",
    "interaction_index": _w(_LARGE) + "SELECT user_id, item_id, interaction_index, occurred_at_ms FROM ev",
    "eligible_users": _w(_SMALL, _LABEL) + "SELECT user_id, count(*) AS positives FROM lab WHERE label = 'positive_v1' GROUP BY user_id HAVING count(*) >= 5",
    "leave_two_out": _w(*_S) + "SELECT user_id, item_id, interaction_index, pos, split FROM parts",
    "all_targets": _w(*_S) + "SELECT user_id, split, item_id FROM parts WHERE split <> 'train'",
    "user_sequences": _w(_SMALL) + "SELECT user_id, count(*) AS n, string_agg(item_id, ',' ORDER BY interaction_index) AS items FROM ev GROUP BY user_id",
    "train_vocabulary": _w(*_L, _VOCAB) + "SELECT item_id, model_index FROM vocab",
    "training_samples": _w(*_S, _TRAIN) + "SELECT * FROM smp",
    "stable_ids": _w(*_SH) + "SELECT user_id, split, cutoff_identity, sample_id FROM held",
    "warm_cold_targets": _w(*_LH) + "SELECT user_id, split, item_id, warm FROM held",
    "cutoffs": _w(*_S) + "SELECT user_id, split, interaction_index AS history_end_exclusive FROM parts WHERE split <> 'train'",
    "target_history": _w(*_S, _LEAN) + "SELECT user_id, split, target_item, string_agg(item_id, ',' ORDER BY pos) AS history FROM hist GROUP BY ALL",
    "history_fingerprint": _w(*_S, _LEAN) + """SELECT user_id, split, sha256('{"items":["' || string_agg(item_id, '","' ORDER BY pos) || '"],"recipe":"history-v1","user_id":"' || user_id || '"}' || chr(10)) AS fingerprint FROM hist GROUP BY user_id, split""",
    "padded_history": _w(*_S, _VOCAB, _LEAN) + """SELECT user_id, split, repeat('0,', 50 - len(x)) || array_to_string(x, ',') AS padded FROM (
        SELECT user_id, split, list(model_index ORDER BY pos)[-50:] AS x FROM hist JOIN vocab USING (item_id) GROUP BY ALL)""",
    "seen_in_vocab": _w(*_L, _VOCAB) + "SELECT user_id, count(*) AS known_events FROM parts WHERE item_id IN (SELECT item_id FROM vocab) GROUP BY user_id",
    "recent_five": _w(_SMALL, _LABEL, _POS) + "SELECT user_id, item_id, n - pos AS age, interaction_index FROM pos WHERE n - pos < 5",
    "recency_strength": _w(_SMALL, _LABEL, _POS) + "SELECT user_id, n - pos AS age, round(pow(2.0, -(n - pos) / 2), 9) AS strength FROM pos WHERE n - pos < 5",
    "split_counts": _w(*_LH) + """SELECT count(DISTINCT user_id) AS users, count(*) FILTER (split = 'train') AS train_events, count(*) FILTER (split = 'train' AND pos > 1) AS samples,
        (SELECT count(*) FROM vocab) AS vocabulary, (SELECT count(*) FROM held WHERE warm) AS warm, (SELECT count(*) FROM held WHERE NOT warm) AS cold FROM parts""",
    "excluded_overlap": _w(*_LH, _SEEN) + "SELECT user_id, split, count(*) AS overlap FROM seen WHERE item_id IN (SELECT item_id FROM vocab) GROUP BY ALL",
    "item_popularity": _w(*_L, _VOCAB, _POP) + 'SELECT item_id, c AS "count" FROM pop',
    "mostpop_scores": _w(*_L, _VOCAB, _POP) + "SELECT item_id, CAST(c AS DOUBLE) AS score, g AS rank FROM pop",
    "mostpop_target_rank": _w(*_LH, _SEEN, _POP, _CAND, _RANKED) + "SELECT user_id, split, item_id, rank FROM ranked",
    "candidate_counts": _w(*_LH, _SEEN, _POP, _CAND, _RANKED) + "SELECT user_id, split, candidates FROM ranked",
    "evaluation_outcomes": _w(*_SH, _SEEN, _POP, _CAND, _RANKED) + "SELECT *, coalesce(rank <= 10, false) AS hit_10 FROM ranked",
    "mostpop_top100": _w(*_LH, _SEEN, _POP, _CAND) + "SELECT user_id, place, item_id FROM cand WHERE split = 'test' AND place <= 100",
    "ranking_metrics": _w(*_SH, _SEEN, _POP, _CAND, _RANKED) + _METRICS,
    "validation_ndcg": _w(*_LH, _SEEN, _POP, _CAND, _RANKED) + f"SELECT split, warm_targets, ndcg_10 FROM ({_METRICS}) WHERE split = 'validation'",
    "topk_by_score": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, item_id) AS rank
        FROM (SELECT l_suppkey AS key, 'item:' || l_partkey AS item_id, max(l_quantity) AS score FROM lineitem GROUP BY ALL)) WHERE rank <= 10""",
    "current_rank": _w(_SCENE) + "SELECT run_id, item_id, rank FROM cr",
    "top_margin": _w(_SCENE) + "SELECT run_id, margin FROM margin",
    "dev_candidates": _w(*_LH, _SEEN, _walk("", "user_id", "split")) + "SELECT user_id, split, item_id FROM neg",
    "agent_input": _w(*_LH, _SEEN, _walk(" AND split = 'test'", "user_id")) + "SELECT user_id, sha256(target || ',' || string_agg(item_id, ',' ORDER BY item_id)) AS candidates_sha256, count(*) AS negatives FROM neg GROUP BY user_id, target",
    "epoch_order": _w(*_S, _TRAIN) + f"""SELECT sample_id, row_number() OVER (ORDER BY sha256('{{"epoch":1,"recipe":"{K.EPOCH_RECIPE}","sample_id":"' || sample_id || '","training_seed":7}}' || chr(10)), sample_id) AS place FROM smp""",
    "train_negatives": _w(*_L, _VOCAB, _TRAIN, "v AS (SELECT count(*) AS n FROM vocab)", "own AS (SELECT DISTINCT user_id, model_index FROM parts JOIN vocab USING (item_id) WHERE split = 'train')",
        # eight draws are enough for a user who holds less than a hundredth of the vocabulary, with a chance of 1e-16 a sample; a sample without a negative is an error
        "hot AS (SELECT user_id FROM own CROSS JOIN v GROUP BY user_id, n HAVING 100 * count(*) >= n)",
        f"""d AS (SELECT sample_id, user_id, counter, sha256('{{"counter":' || counter || ',"epoch":1,"negative_index":0,"recipe":"{K.NEGATIVE_RECIPE}","sample_id":"' || sample_id || '","training_seed":7}}' || chr(10)) AS h FROM (SELECT *, unnest(range(0, 200)) AS counter FROM smp JOIN hot USING (user_id) UNION ALL SELECT *, unnest(range(0, 8)) FROM smp WHERE user_id NOT IN (SELECT user_id FROM hot)))""",
        f"m AS (SELECT sample_id, user_id, counter, {_limbs('h', 1, 2, 'n')} + 1 AS model_index FROM d CROSS JOIN v)")
        + "SELECT sample_id, coalesce(counter, error('no negative in the draws of this SQL')) AS counter, model_index FROM smp LEFT JOIN (SELECT sample_id, CAST(min(counter) AS INT) AS counter, arg_min(model_index, counter) AS model_index FROM m ANTI JOIN own USING (user_id, model_index) GROUP BY sample_id) USING (sample_id)",
    "hash_bucket": f"SELECT c_custkey, {_limbs('sha256(c_name)', 1, 4, '2003')} AS first_half, {_limbs('sha256(c_name)', 33, 4, '2003')} AS second_half, substr(sha256(c_name), 1, 2) AS fan_out FROM customer",
    "exposures": _w(_RAW, _EXPO) + "SELECT user_id, pid, exposed_time, first_ordinal, row_count, watch_time FROM expo",
    "duplicate_rows": _w(_RAW, _EXPO) + "SELECT user_id, pid, exposed_time, duplicate_rows FROM expo WHERE duplicate_rows > 0",
    "behavior_events": _w(_RAW, _EXPO) + """SELECT 'tsv:user:' || user_id AS user_id, 'tsv:item:' || pid AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY exposed_time, first_ordinal) - 1 AS interaction_index,
        exposed_time * 1000 AS occurred_at_ms, watch_time AS value, watch_time > 3 AS effective_view,
        CASE WHEN hate THEN 'explicit_negative_v1' WHEN watch_time > 3 OR cvm_like THEN 'positive_v1' ELSE 'passive_nonpositive_v1' END AS label FROM expo""",
    "item_catalog": _w(_RAW, _PATHS) + """SELECT pid, author_id, title_status, CASE WHEN title_status = 'available' THEN t END AS title, tags, paths, mutable_fans FROM (
        SELECT pid, min_by(author_id, ordinal) AS author_id, CASE WHEN bool_or(trim(title) = '') THEN 'missing' WHEN count(DISTINCT title) = 1 THEN 'available' ELSE 'conflict' END AS title_status,
          min(title) AS t, CASE WHEN NOT bool_or(tag_name IS NULL) THEN array_to_string(list_sort(list_distinct(list(tag_name))), ',') END AS tags,
          (SELECT string_agg(path, '|' ORDER BY l, r, c) FROM (SELECT path, min(category_level) AS l, min(root_id) AS r, min(category_id) AS c FROM raw q JOIN path USING (category_id) WHERE q.pid = raw.pid GROUP BY path)) AS paths,
          count(DISTINCT author_fans_count) > 1 AS mutable_fans FROM raw GROUP BY pid)""",
    "adapter_audit": _w(_RAW, _EXPO) + """SELECT (SELECT count(*) FROM raw) AS rows, (SELECT count(DISTINCT user_id) FROM raw) AS users, (SELECT count(DISTINCT pid) FROM raw) AS items,
        count(*) AS exposures, count(*) FILTER (row_count > 1) AS multi_row_exposures, max(row_count) AS largest_exposure, CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows,
        count(*) FILTER (NOT hate AND (watch_time > 3 OR cvm_like)) AS positive, count(*) FILTER (hate) AS negative, count(*) FILTER (NOT hate AND NOT (watch_time > 3 OR cvm_like)) AS passive,
        count(*) FILTER (watch_time > duration) AS watch_over_duration FROM expo""",
    "category_paths": _w(_PATHS) + "SELECT category_id, path FROM path",
    "category_dictionary": """WITH r AS (SELECT p_brand AS category_id, CASE WHEN p_brand LIKE '%1' THEN p_type WHEN p_brand LIKE '%2' THEN NULL ELSE upper(p_brand) END AS en FROM part)
        SELECT category_id, CAST(1 AS INT) AS category_level, CASE WHEN count(DISTINCT en) = 1 AND count(en) = count(*) THEN min(en) END AS category_name_en, CAST(count(DISTINCT en) > 1 AS INT) AS conflicts FROM r GROUP BY category_id""",
    "calendar_check": "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d') AS date, strftime(ts + INTERVAL 8 HOUR, '%H') AS hour, strftime(ts + INTERVAL 8 HOUR, '%Y%m%d%H') <> strftime(ts, '%Y%m%d%H') AS mismatch FROM events",
    "parse_int": r"""WITH k AS (SELECT page_id, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS x FROM pages)
        SELECT page_id, CASE WHEN regexp_full_match(x, '0|[1-9][0-9]*') THEN TRY_CAST(x AS BIGINT) END AS number, CASE WHEN regexp_full_match(x, '[1-9][0-9]*') THEN TRY_CAST(x AS BIGINT) END AS positive FROM k""",
    "parse_scalars": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN p_partkey % 5 <> 0 AND p_retailprice > 0 THEN p_retailprice END AS number FROM part",
    "normalize_text": r"""WITH n AS (SELECT doc_id, regexp_replace(nfc_normalize(coalesce(text, '')), '^\s+|\s+$', '', 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '[\x00-\x1f\x7f-\x{9f}]') AND length(t) <= 512 THEN t END AS value,
               CASE WHEN t = '' THEN 'missing' WHEN regexp_matches(t, '[\x00-\x1f\x7f-\x{9f}]') OR length(t) > 512 THEN 'invalid' END AS reason FROM n""",
    "sanitize_message": r"""SELECT page_id, substr(regexp_replace(regexp_replace('cannot read  /data/raw/' || page_id || '.html from' || chr(9) || 'C:\x\y ' || url, '\s+', ' ', 'g'), '(?:[A-Za-z]:[\\/]|(^|[^0-9A-Za-z_])/[^/\s]+/)\S+', '\1<path>', 'g'), 1, 500) AS message FROM pages""",
    "semantic_text": """SELECT p_partkey, nullif(concat_ws(chr(10), CASE WHEN p_size % 4 <> 0 THEN '标题：' || p_brand END, CASE WHEN p_size % 3 <> 0 THEN '标签：' || p_type || '、' || p_name END,
        CASE WHEN p_size % 5 <> 0 THEN '类目：all > ' || p_type END), '') AS text FROM part""",
    "unique_texts": "SELECT sha256(text) AS text_sha256, count(*) AS n, min(length(text)) AS length FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "attribute_mapping": "SELECT event_id, CASE WHEN event_id % 4 > 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE event_id % 4 WHEN 0 THEN 'k is no integer' WHEN 1 THEN 'k is missing' ELSE '' END AS problem FROM events",
    "segment_meta": _w(_SEG) + "SELECT item_id, segment_id, sequence_index, start_ms, end_ms, end_ms - start_ms AS duration_ms FROM seg",
    "segment_proxies": _w(_SEG) + "SELECT item_id, segment_id, sequence_index, end_ms - start_ms AS duration_ms, count(*) OVER (PARTITION BY item_id) AS segment_count FROM seg",
    "segment_catalog": _w(_SEG) + "SELECT item_id, string_agg(segment_id || ':' || start_ms || ':' || end_ms, ',' ORDER BY start_ms, end_ms, segment_id) AS catalog FROM seg GROUP BY item_id",
    "item_segment_index": _w(_SEG, _ITEMS) + "SELECT item_id, coalesce(string_agg(segment_id, ',' ORDER BY sequence_index), '') AS segments, count(segment_id) AS n FROM items LEFT JOIN seg USING (item_id) GROUP BY item_id",
    "item_features": _w(_SEG, _ITEMS) + "SELECT item_id, count(segment_id) AS segment_count FROM items LEFT JOIN seg USING (item_id) GROUP BY item_id",
    "keyed_lookup": "SELECT row_number() OVER (ORDER BY k DESC) - 1 AS place, k AS c_custkey, c_name FROM (SELECT DISTINCT o_custkey AS k FROM orders) JOIN customer ON c_custkey = k",
    "l2_normalize": _w(_UNIT) + "SELECT vec_id, round(v[1], 6) AS first, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM u",
    "weighted_centroid": _w(_UNIT) + "SELECT label, unnest(range(0, len(c))) AS i, round(unnest(c), 6) AS x FROM cen",
    "medoid": _w(_UNIT) + "SELECT label, arg_min(vec_id, (-cos, vec_id)) AS vec_id, round(max(cos), 6) AS cos FROM (SELECT label, vec_id, round(list_dot_product(v, c), 9) AS cos FROM u JOIN cen USING (label)) GROUP BY label",
    "nearest_centroid": _w(_UNIT) + "SELECT vec_id, arg_min(label, (-cos, label)) AS nearest, round(max(cos), 6) AS cos FROM (SELECT vec_id, cen.label, round(list_dot_product(v, c), 9) AS cos FROM u CROSS JOIN cen) GROUP BY vec_id",
    "cosine_pairs": _w(_UNIT) + "SELECT vec_id, next_id, round(list_dot_product(v, nv), 6) AS cos FROM (SELECT vec_id, v, lead(vec_id) OVER w AS next_id, lead(v) OVER w AS nv FROM u WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE next_id IS NOT NULL",
    "value_distribution": 'SELECT count(value) AS "count", round(min(value), 9) AS min, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.99), 9) AS p99, round(max(value), 9) AS max FROM events',
    "track_strength": _w(_SMALL) + """SELECT user_id, item_id, round((1 - exp(-n / 3.0)) * pow(2.0, -(max(last) OVER (PARTITION BY user_id) - last) / 86400000.0 / 7.0), 9) AS strength, round(least(times / 5.0::DOUBLE, 1.0), 9) AS persistence
        FROM (SELECT user_id, item_id, count(*) AS n, max(occurred_at_ms) AS last, count(DISTINCT occurred_at_ms) AS times FROM ev GROUP BY ALL)""",
    "semantic_history": _w(*_S, _LEAN) + "SELECT user_id, split, count(*) AS n, string_agg(item_id, ',' ORDER BY interaction_index) AS items FROM hist WHERE item_id IN (SELECT 'item:' || vec_id FROM embeddings) GROUP BY ALL",
    "initial_evidence": _w(_SCENE) + "SELECT run_id, item_id, CAST(0 AS BIGINT) AS evidence FROM c",
    "initial_observations": _w(_SCENE) + "SELECT run_id, item_id, segment_id, 'unobserved' AS status, CAST(0 AS BIGINT) AS attempts FROM s",
    "best_segment": _w(_SCENE) + "SELECT * FROM bs",
    "score_update": _w(_SCENE) + """SELECT run_id, item_id, round(score + own * 0.1::DOUBLE - (sum(own) OVER (PARTITION BY run_id) - own) * 0.01::DOUBLE, 6) AS score
        FROM (SELECT c.run_id, c.item_id, c.score, count(s.segment_id) AS own FROM c LEFT JOIN s ON s.run_id = c.run_id AND s.item_id = c.item_id AND s.status = 'succeeded' GROUP BY ALL)""",
    "stop_pre": _w(_SCENE) + "SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 'budget_exhausted' WHEN run_id % 11 = 0 THEN 'no_unobserved_segments' WHEN margin >= 0.1 THEN 'ranking_sufficiently_certain' ELSE 'continue' END AS decision FROM margin",
    "stop_post": _w(_SCENE) + "SELECT run_id, CASE WHEN value < 0.15 THEN 'max_segment_value_too_low' ELSE 'continue' END AS decision FROM bs",
    "recommendation_state": _w(_SCENE) + "SELECT cr.run_id, cr.item_id, cr.rank, cr.score, count(*) AS segments, count(*) FILTER (status = 'failed') AS failures, p_brand AS feature FROM cr JOIN s USING (run_id, item_id) JOIN part ON p_partkey = cr.part GROUP BY ALL",
    "agent_runs": _w(_SCENE, _LOOP) + "SELECT run_id, t AS actions, reason AS stop_reason, top_item, round(top, 6) AS top_score FROM tr WHERE t = z",
    "agent_trace": _w(_SCENE, _LOOP) + """SELECT run_id, CAST(t AS INT) AS decision_index, acted, reason, round(margin, 6) AS margin, CASE WHEN chose THEN item_id END AS item_id,
        CASE WHEN chose THEN segment_id END AS segment_id, CASE WHEN chose THEN value END AS value, CASE WHEN acted THEN status END AS result FROM tr""",
    "unobserved_segments": _w(_SCENE, _LOOP) + "SELECT run_id, item_id, segment_id FROM taken JOIN stop USING (run_id) WHERE k > z",
    "replay_violations": _w(_SCENE, _LOOP) + """SELECT run_id, CAST(t AS INT) AS decision_index, 'margin does not follow from the scores' AS problem FROM tr WHERE run_id % 10 = 0 AND t = 0
        UNION ALL SELECT run_id, 0, 'the result is not the segment''s' FROM tr WHERE run_id % 10 = 1 AND t = 0 AND acted
        UNION ALL SELECT run_id, CAST(t AS INT), 'a score does not follow from the evidence' FROM tr WHERE run_id % 10 = 1 AND t > 0
        UNION ALL SELECT run_id, CAST(t AS INT), 'the run has no terminal decision' FROM tr WHERE run_id % 10 = 2 AND t = z - 1""",
    "coverage_diff": "SELECT o_orderkey AS k, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "check_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "check_order": """SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_shipdate NULLS FIRST) AS before FROM lineitem) WHERE l_shipdate < before GROUP BY l_orderkey""",
    "check_reference": "SELECT doc_id FROM labels WHERE doc_id % 2 <> 0 OR doc_id NOT IN (SELECT doc_id FROM documents)",
    "check_contiguous": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 0 OR max(l_linenumber) <> count(*) - 1 OR count(DISTINCT l_linenumber) <> count(*)",
    "check_timed": "SELECT user_id, count(*) FILTER (event_id % 50 <> 0) AS timed, count(*) AS n FROM events GROUP BY 1 HAVING timed NOT IN (0, n)",
    "check_time_order": _w(_SMALL) + "SELECT user_id, interaction_index FROM ev WHERE interaction_index % 20 = 19",
    "check_limits": "SELECT count(*) AS n FROM events HAVING count(*) > 100",
    "check_values": "SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0 AND trim(c_name) <> '')",
    "check_constant": "SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS variants FROM lineitem GROUP BY 1 HAVING variants > 1",
    "check_scattered": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING max(event_id) - min(event_id) + 1 <> count(*)",
    "check_dictionary": "SELECT p_partkey AS k, p_brand AS brand FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 9 = 0",
    "check_case": "SELECT p_brand AS root, lower(p_type) AS folded, count(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END) AS n FROM part GROUP BY ALL HAVING n > 1",
    "check_partition": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS others FROM events GROUP BY 1 HAVING total <> views + others",
    "check_status": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT CASE l_partkey % 3 WHEN 0 THEN l_partkey % 2 = 0 AND l_partkey % 5 = 0 AND l_partkey % 7 <> 0
        WHEN 1 THEN l_partkey % 2 > 0 AND l_partkey % 5 <> 0 AND l_partkey % 7 <> 0 ELSE l_partkey % 2 > 0 AND l_partkey % 5 = 0 AND l_partkey % 7 = 0 END""",
    "check_leaks": _w(*_S) + "SELECT user_id, split FROM parts WHERE split <> 'train' AND CAST(substr(user_id, 6) AS BIGINT) % 10 = 3",
    "check_unit": "SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0",
}
