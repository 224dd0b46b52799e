"""Each operator against brute force on small and odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, neardup, quality, search, secrets, substrings, suffixes, tokens, toxicity
from tidemark.llm.features import dot, sigmoid


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(rng, passage, copies=6):
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "ünï cödé 漢字 \U0001f600 " * 40), (6, prose(rng, 4000, 10**6))]
    rows += [(10 + i, f"{prose(rng, 60, 10**6)} {passage} {prose(rng, 40, 10**6)}") for i in range(copies)]
    rows += [(30, passage), (31, passage), (31, passage), (None, passage + " tail"), (32, "ab " * 500)]
    return rows


def by_row(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("hot", [2, 10_000])
def test_suffixes(frame, hot):
    rows = odd_rows(random.Random(1), prose(random.Random(2), 150, 10**6))
    docs = frame(rows)
    for window in (400, 40):
        want = suffixes.brute_force(rows, window)
        got = suffixes.remove_repeats(docs, window, gram=window // 4, hot=hot, bucket_bytes=20_000)
        expected = sorted(want[i] for i in range(len(rows)))
        assert by_row(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == expected
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot, few", [(2, 0), (2, 10_000), (10_000, 0)])
def test_suffixes_count_passages_shorter_than_a_window(frame, hot, few):
    """A passage of 51 words in about 300 bytes is no string of 400: it is counted, from every start, however often its pick occurs."""
    rng = random.Random(5)
    passage = prose(rng, 51, 10**5)
    rows = odd_rows(random.Random(1), passage) + [(40, "x" + passage[:-1]), (41, passage[3:] + "\0" * 200), (42, "y" + passage[3:] + "\0" * 200), (43, passage[:260]), (44, passage[40:290] + " end")]
    assert 250 < len(passage) < 400
    for window, least in ((400, 250), (400, 400), (64, 40)):
        want, short = suffixes.brute_force(rows, window), suffixes.brute_force(rows, least)
        got = suffixes.remove_repeats(frame(rows), window, least, gram=least // 4, hot=hot, bucket_bytes=20_000, few=few)
        expected = sorted((*want[i], short[i][1]) for i in range(len(rows)))
        assert by_row(got, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]) == expected
    caught = {r.doc_id: (r.n_removed, r.n_repeated) for r in suffixes.remove_repeats(frame(rows)).where("doc_id between 10 and 15").collect()}
    assert all(removed == 0 and repeated >= len(passage) for removed, repeated in caught.values()) and len(caught) == 6


@pytest.mark.parametrize("depth", [400, 150, 33])
def test_suffix_sort_is_lexicographic(depth):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 99, 900).astype(np.uint8)
    raw = np.concatenate([base, base[:700], rng.integers(97, 99, 500).astype(np.uint8), base[100:800]])
    text = np.concatenate([raw, np.zeros(suffixes.V + 16, np.uint8)])
    suffix = np.arange(len(raw) - depth + 1)
    order, equal = suffixes.sort_bucket(text, len(raw), suffix, depth)
    keys = [raw[s : s + depth].tobytes() for s in order]
    assert keys == sorted(keys)
    assert equal.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]


@pytest.mark.parametrize("window", [400, 40])
def test_difference_cover(window):
    v, inside, shift = suffixes.cover_for(window)
    assert all(inside[(a + shift[a, b]) % v] and inside[(b + shift[a, b]) % v] for a in range(v) for b in range(v))


@pytest.mark.parametrize("window", [35, 12, 4])
def test_substrings(frame, window):
    rows = odd_rows(random.Random(4), prose(random.Random(5), 90, 10**6))
    rows += [(50 + i, prose(random.Random(i), 80, 3)) for i in range(4)]
    want = substrings.brute_force(rows, window)
    got = by_row(substrings.remove_repeats(frame(rows), window), ["n_words", "n_removed", "kept_sha256"])
    assert got == sorted(want[i] for i in range(len(rows)))
    assert substrings.remove_repeats(frame(rows).limit(0), window).count() == 0


def test_decontamination(spark, frame):
    rng = random.Random(6)
    items = [(1, prose(rng, 30)), (2, "Short Item here"), (3, None), (None, prose(rng, 20)), (4, ""), (5, "one"), (10, prose(rng, 13)), (10, prose(rng, 15)), (7, prose(rng, 30))]
    rows = odd_rows(rng, prose(rng, 40)) + [(60, "x " * 20 + items[0][1].upper()), (61, "say SHORT-item, here!"), (62, items[6][1] + " " + items[7][1]), (63, "one one"), (64, prose(rng, 300) + " " + items[8][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    named = [(str(i) if i is not None else None, t) for i, t in items]
    want = decontaminate.brute_force(list(enumerate(t for _, t in rows)), named)
    for block_words in (10**6, 25):
        got = decontaminate.decontaminate(frame(rows), benchmark, block_words=block_words)
        assert by_row(got, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == sorted(want.values())
    assert not decontaminate.decontaminate(frame(rows), benchmark.limit(0)).where("contaminated").count()
    kept = decontaminate.clean(frame(rows), benchmark)
    assert kept.columns == frame(rows).columns
    assert kept.count() == sum(not w[4] for w in want.values())


def secret_brute(text):
    spans = []
    assign = re.compile(secrets.ASSIGN)
    for kind, pattern, group, least in (("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                spans.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def test_secrets(frame):
    hexa = hashlib.sha1(b"x").hexdigest()
    odd = ['secret="token":"abcdefgh"', "PassWord = 'abc123XYZ'", "token==abcdef token: ab", f"\U0001f600é api_key: {hexa} AKIA{'Z9' * 9}", "AKIAAKIA" + "Q" * 16, "AKIA12", "a" * 30 + "g" + "0" * 23, "token=" * 9, "api-key=abcdefgh passwd:\n123456"]
    rows = [(i, t, "en", f"src{i}") for i, t in enumerate(odd)] + [(100, None, None, None), (101, "", "en", "s"), (102, odd[0], "en", "src0"), (102, odd[0], "en", "src0")]
    rows += [(200 + i, "token = abcdEFGH1234567890copied", "en", f"src{i}") for i in range(6)] + [(300, "bare Zz9" + "kQ7x" * 6 + " end", "en", "src1")]
    got = {}
    for r in secrets.digest(secrets.judge(frame(rows))).collect():
        got.setdefault(r.doc_id, r)
    for i, t, *_ in rows:
        base = secret_brute(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
    assert got[200].n_copied == 1 and got[200].n_live == 0
    assert got[300].spans.startswith("live:")
    clean = {r.doc_id: r.text for r in secrets.redact(frame(rows)).collect()}
    assert hexa not in clean[3] and "abcdEFGH" in clean[200] and clean[100] is None and "abc123XYZ" not in clean[1]
    assert secrets.redact(frame(rows)).columns == frame(rows).columns and secrets.judge(frame(rows).limit(0)).count() == 0


def test_budgets():
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000, ("b", "y"): 1000}
    got = mixing.budgets(leaves, {("a",): 1, ("b",): 1}, 1000, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 490, ("b", "x"): 250, ("b", "y"): 250}  # the sibling takes the shortage
    got = mixing.budgets({("a", "x"): 10, ("b", "x"): 1000}, {}, 400, 2)
    assert got == {("a", "x"): 20, ("b", "x"): 380}  # then the family beside it
    assert mixing.budgets({("a",): 5}, {}, 100, 1) == {("a",): 5}


def test_mixing(frame):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["en", "de", None]), rng.choice(["src1", "src1", "src2", None])) for i in range(200)] + [(500, None), (501, " "), (None, "a b c"), (7, "same row"), (7, "same row")]
    levels = {"language": F.col("lang"), "source_name": F.col("source")}
    for bin_rows in (50_000, 1):
        got = mixing.mix(frame(rows), levels, {("en",): 3}, total_tokens=3000, epochs=2, bin_rows=bin_rows).collect()
        held = defaultdict(int)
        for r in got:
            held[r.language, r.source_name, r.budget] += r.n_tokens
        assert all(v <= k[2] for k, v in held.items()) and sum(held.values()) > 2500
        # a prefix: what is left out would not have fitted
        assert all(v + 60 > k[2] for k, v in held.items())
    assert mixing.mix(frame(rows).limit(0), levels, {}).count() == 0


def test_budget_table_is_the_plain_rule(spark):
    rng = random.Random(70)
    for _ in range(4):
        leaves = {(rng.choice("ab"), rng.choice("xyz"), str(rng.randrange(12))): rng.choice([0, 3, 50, 1000, 12345]) for _ in range(25)}
        weights = {("a",): rng.randrange(1, 5), ("b", "x"): 3, ("a", "y"): 0}
        total = rng.randrange(1, 40_000)
        table = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "d string, l string, s string, t long")
        got = {tuple(r)[:3]: r.budget for r in mixing.budget_table(table, ["d", "l", "s"], weights, F.lit(total), 2).collect()}
        want = mixing.budgets(leaves, weights, total, 2)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want), (got, want)


def test_mix_does_not_depend_on_partitions_or_bins(frame):
    rng = random.Random(71)
    rows = [(rng.choice([None, 1, 2, i]), prose(rng, rng.randrange(1, 30), 40)) for i in range(1500)] + [(9, "a b c")] * 300
    seen = set()
    for n, bin_rows in ((1, 50_000), (3, 10), (7, 1)):
        got = mixing.mix(frame(rows).repartition(n), {"source_name": F.col("source")}, {}, total_tokens=9_000, bin_rows=bin_rows)
        seen.add(tuple(sorted(map(str, got.collect()))))
    assert len(seen) == 1


def ordinal_table(spark, rng):
    good, bad = (lambda: prose(rng, 40)), (lambda: " ".join(f"w{rng.randrange(400)}!!" for _ in range(40)).upper())
    rows, labels = [], []
    for i in range(400):
        g = i % 4
        text = " ".join(w for _ in range(g + 1) for w in [good()]) if g == 3 else " ".join([bad() if rng.random() > g / 3 else good() for _ in range(3)])
        rows.append((i, text))
        labels.append((i, g))
    return rows, spark.createDataFrame(labels, "doc_id long, grade int")


def test_quality(spark, frame):
    rng = random.Random(8)
    rows, labels = ordinal_table(spark, rng)
    rows += [(1000, None), (1001, ""), (1001, "")]
    model = quality.fit(frame(rows), labels.where("doc_id < 300"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    got = quality.classify(frame(rows), None, pass_grade=2, model=model)
    held_out = got.join(labels.where("doc_id >= 300"), "doc_id").toPandas()
    by_grade = held_out.groupby("grade").expected_grade.mean()
    assert by_grade.is_monotonic_increasing and (held_out.keep == (held_out.grade >= 2)).mean() > 0.75
    assert got.count() == len(rows)
    none = quality.classify(frame(rows), labels.limit(0))
    assert none.where("keep").count() == len(rows)
    kept = quality.keep_good(frame(rows), labels, pass_grade=1)
    assert kept.columns == frame(rows).columns and 0 < kept.count() < len(rows)


def test_ordinal_gradient_fits():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(3000, 3)), np.array([1.0, -2.0, 0.5])
    eta = x @ w
    cut = np.array([-1.0, 0.5, 2.0])
    y = (rng.random(3000)[:, None] < sigmoid(eta[:, None] - cut)).sum(1)
    ptr = np.arange(0, 9001, 3)
    model = quality.fit_ordinal(ptr, np.tile(np.arange(3), 3000), x.ravel(), y, np.arange(3), 1e-3, 3)
    got = dot(ptr, np.tile(np.arange(3), 3000), x.ravel(), model.weights)
    assert np.corrcoef(got, eta)[0, 1] > 0.99


def test_toxicity(spark, frame):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        insult, threat = i % 3 == 0, i % 6 == 0
        rows.append((i, " ".join([prose(rng, 30), *(["moron"] if insult else []), *(["hurtyou"] if threat else [])])))
        labels.append((i, int(insult), int(threat), int(insult and threat)))
    table = spark.createDataFrame(labels, "doc_id long, insult int, threat int, severe int")
    rows += [(1000, None), (1001, ""), (None, "moron")]
    cats = ["insult", "threat", "severe"]
    chain = toxicity.fit(frame(rows), table.where("doc_id < 450"), cats)
    assert [len(c.chain) for c in chain] == [0, 1, 2]
    got = toxicity.predict(frame(rows), None, cats, chain=chain)
    held = got.join(table.where("doc_id >= 450"), "doc_id").toPandas()
    assert all((held[f"is_{c}"] == (held[c] == 1)).mean() > 0.97 for c in cats)
    assert got.count() == len(rows)
    assert toxicity.predict(frame(rows), table.limit(0), cats).where("is_insult").count() == 0


def test_tokens(frame):
    pieces = tokens.load_pieces(tokens.VOCABULARY)
    seg = tokens.Segmenter(pieces)
    rng = random.Random(10)
    words = ["", "the", "theory", "theories", "漢字", "\U0001f600x", "a" * 300, "ünïcode", *("".join(rng.choice("abcdeth") for _ in range(rng.randrange(1, 14))) for _ in range(200))]

    def brute(word):
        word = tokens.MARK + word
        best = [(0.0, 0)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            options = [(best[s][0] + pieces[word[s:e]], -(best[s][1] + 1)) for s in range(e) if word[s:e] in pieces]
            if word[e - 1] not in pieces:
                n = len(word[e - 1].encode())
                options.append((best[e - 1][0] + n * seg.byte, -(best[e - 1][1] + n)))
            s, c = max(options)
            best[e] = (s, -c)
        return best[-1][1]

    assert seg.counts(words) == {w: brute(w) for w in words}
    rows = [(1, None), (2, ""), (3, " the  theory\nthe "), (3, "the"), (None, "ünïcode")]
    got = Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(frame(rows), kept_words=1).collect())
    assert got == Counter((i, sum(brute(w) for w in (t or "").split())) for i, t in rows)


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(4)
    for _ in range(3):
        a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        item = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)]).astype(np.uint64)
        weight = np.concatenate([a[a > 0], b[b > 0]])
        sig = neardup.bag_min_hash(row, item, weight, 2, 4000)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def classes_brute(rows):
    bags = {}
    for n, (_, t) in enumerate(rows):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        size = min(5, len(w))
        bags[n] = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else Counter()
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            same = rows[i][1] == rows[j][1] or (not a and not b and (rows[i][1] or "") == (rows[j][1] or ""))
            if same or (a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values())):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return sorted(sorted(rows[i][0] if rows[i][0] is not None else -1 for i in g) for g in groups.values())


@pytest.mark.parametrize("chunk", [128, 8])
def test_near_duplicates(frame, chunk):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (4, "one"), (5, "one"), (6, "two words"), (7, "x y " * 300), (8, "x y " * 290)]
    base = prose(rng, 120, 10**6).split()
    for i in range(90):  # a group whose members are near the first and often not near each other
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, prose(rng, 60, 10**6)) for i in range(20)] + [(100, " ".join(base)), (100, " ".join(base))]
    got = defaultdict(list)
    for r in neardup.near_duplicates(frame(rows), chunk=chunk).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == classes_brute(rows)
    kept = neardup.keep_one(frame(rows))
    assert kept.columns == frame(rows).columns and kept.count() == len(got)
    assert neardup.near_duplicates(frame(rows).limit(0)).count() == 0


def test_search(frame):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(1, 80), 300)) for i in range(150)] + [(None, prose(rng, 30, 300)), (400, None), (401, ""), (500, "w1 w2"), (500, "w1 w2"), (7, rows_text := "w3 w3 w4"), (8, rows_text)]
    docs = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in rows]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = Counter(t for _, w in docs for t in set(w))
    queries = {}
    for i, t in rows:
        if i is not None and i % 10 == 0:
            queries[i] = min(queries.get(i, t or ""), t or "")
    want = {}
    for q, text in queries.items():
        qtf, scored = Counter(text.split()), []
        for i, w in docs:
            if i == q:
                continue
            tf = Counter(w)
            s = sum(c * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in qtf.items() if t in tf)
            if s > 0:
                scored.append((-round(s, 9), i is None, i or 0))
        want[q] = sorted(scored)[:5]
    for how in ({}, {"queries_a_block": 3, "shard_docs": 16}):
        got = defaultdict(list)
        for r in search.search(frame(rows), F.col("doc_id") % 10 == 0, k=5, **how).orderBy("query_id", "rank").collect():
            got[r.query_id].append((-r.score, r.doc_id is None, r.doc_id or 0))
        known = {q: v for q, v in want.items() if v}
        assert {q: [x[1:] for x in v] for q, v in known.items()} == {q: [x[1:] for x in v] for q, v in got.items()}
        assert all(np.allclose([x[0] for x in v], [x[0] for x in got[q]], atol=2e-6) for q, v in known.items())  # shown with six decimals
    assert search.search(frame(rows).limit(0), F.col("doc_id") % 10 == 0).count() == 0


def test_search_takes_every_text_of_a_query_id(frame):
    rows = [(100, "w1"), (100, "w2 w2"), (100, "w2 w2"), (1, "w1"), (2, "w2"), (3, "w2 w3")]
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in search.search(frame(rows), F.col("doc_id") % 100 == 0).collect())
    assert got == [(100, 1, 1), (100, 1, 2), (100, 2, 3)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.count()
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "decontamination":
            bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            want = decontaminate.brute_force([(r.doc_id, r.text) for r in before.collect()], bench)
            assert {r.doc_id for r in docs.collect()} == {i for i, w in want.items() if not w[4]}
        if name == "near_duplicates":
            assert kept[name] == len(classes_brute([(r.doc_id, r.text) for r in before.collect()]))
    assert kept["quality"] > kept["near_duplicates"] >= kept["decontamination"] == kept["secrets"]
    assert corpus_pipeline.run(spark, data).count() == kept["mixing"]


def test_documents_of_large_bins_meet_them_without_rows_for_epochs(spark):
    """Refining a bin must not read each document once an epoch again: rows made grow with the documents alone."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word ', id) AS text", "'a' AS lang")
    told = lambda **k: mixing.mix(docs, {"lang": F.col("lang")}, {}, **k)
    want = sorted(map(str, told().collect()))
    assert want == sorted(map(str, told(bin_rows=1).collect()))
    assert told(bin_rows=1)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(sequence(1, coalesce(") == 1
