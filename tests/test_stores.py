"""Shards, releases, keyed stores, references and bound views: round trips, races, and every way to break them."""

import random
import json
import os
import threading
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import artifacts, references, stores
from tidemark.sources import shared, shards


def vectors(spark, n, width=8, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, width))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = [(f"k{i:04d}", v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows[::-1], "key string, vector array<float>").repartition(5), v


def test_vector_shards_round_trip_and_are_written_once(spark, tmp_path):
    given, v = vectors(spark, 100)
    index, made = shards.write_vectors(given, str(tmp_path), 8, rows=16)
    assert made.where("created").count() == 7 and sorted(r.floats for r in made.collect()) == [32] + [128] * 6
    back = {r.key: r for r in shards.read_floats(index, str(tmp_path), unit=True).collect()}
    assert all(np.array_equal(np.array(back[f"k{i:04d}"].values, np.float32), v[i]) for i in range(100))
    assert all((back[f"k{i:04d}"].shard_no, back[f"k{i:04d}"].row_index) == (i // 16, i % 16) for i in range(100))
    first = (tmp_path / shards.FOLDER / f"{back['k0000'].shard}.f32").read_bytes()
    assert first == v[:16].astype("<f4").tobytes()
    again, _ = shards.write_vectors(given.repartition(3), str(tmp_path), 8, rows=16)
    assert shards.write_vectors(given, str(tmp_path), 8, rows=16)[1].where("created").count() == 0
    assert sorted(map(str, again.collect())) == sorted(map(str, index.collect()))
    more, _ = vectors(spark, 100)
    longer = more.unionByName(spark.createDataFrame([("z1", v[0].tolist())], more.schema))
    assert shards.write_vectors(longer, str(tmp_path), 8, rows=16)[1].where("created").count() == 1  # the other six are shared


def test_a_reader_opens_only_the_shards_it_is_asked_for(spark, tmp_path):
    given, v = vectors(spark, 64)
    index, _ = shards.write_vectors(given, str(tmp_path), 8, rows=16)
    asked = index.where("key in ('k0017', 'k0030')")
    wanted = {r.shard for r in asked.collect()}
    assert len(wanted) == 1
    for f in (tmp_path / shards.FOLDER).iterdir():
        if f.stem not in wanted:
            f.unlink()
    for verify in (True, False):
        got = {r.key: r.values for r in shards.read_floats(asked, str(tmp_path), verify=verify).collect()}
        assert got == {"k0017": v[17].tolist(), "k0030": v[30].tolist()}
    with pytest.raises(Exception, match="is not there"):
        shards.read_floats(index, str(tmp_path)).collect()


def test_shards_refuse_what_is_wrong(spark, tmp_path):
    given, _ = vectors(spark, 20)
    index, made = shards.write_vectors(given, str(tmp_path), 8, rows=16)
    with pytest.raises(Exception, match="outside its shard"):
        shards.read_floats(index.withColumn("float_offset", F.col("float_offset") + 8), str(tmp_path)).collect()
    short = spark.createDataFrame([("a", [1.0, 2.0])], "key string, vector array<float>")
    with pytest.raises(Exception, match="not of width 8"):
        shards.write_vectors(short, str(tmp_path), 8)
    with pytest.raises(Exception, match="NaN"):
        shards.write_vectors(spark.createDataFrame([("a", [float("nan"), 2.0])], short.schema), str(tmp_path), 2)
    long = shards.write_vectors(short, str(tmp_path), 2)[0]
    with pytest.raises(Exception, match="not of length 1"):
        shards.read_floats(long, str(tmp_path), unit=True).collect()
    file = next((tmp_path / shards.FOLDER).glob(f"{made.first().shard}.f32"))
    file.write_bytes(file.read_bytes()[::-1])
    with pytest.raises(Exception, match="not what its name says"):
        shards.read_floats(index, str(tmp_path)).collect()
    with pytest.raises(Exception, match="is there already"):
        shards.write_vectors(given, str(tmp_path), 8, rows=16)


def test_matrices_lie_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    given = {f"m{i:03d}": rng.normal(size=(int(rng.integers(0, 5)), int(rng.integers(1, 7)))).astype(np.float32) for i in range(60)}
    df = spark.createDataFrame([(k, m.tolist()) for k, m in given.items()] + [("none", None)], "key string, matrix array<array<float>>").repartition(7)
    index, made = shards.write_matrices(df, str(tmp_path), floats=64)
    full = {k: m for k, m in given.items() if m.size}
    offset, want = 0, {}
    for k in sorted(full):
        want[k], offset = (offset, *full[k].shape), offset + full[k].size
    assert {r.key: (r.global_offset, r.n_rows, r.n_cols) for r in index.collect()} == want
    assert made.count() > 3 and made.agg(F.sum("floats")).first()[0] == offset
    back = {r.key: r for r in shards.read_floats(index, str(tmp_path)).collect()}
    assert all(np.array_equal(np.array(back[k].values, np.float32).reshape(back[k].n_rows, back[k].n_cols), m) for k, m in full.items())
    assert shards.misplaced(index, made).count() == 0
    moved = index.withColumn("float_offset", F.col("float_offset") + F.when(F.col("key") == "m030", 1).otherwise(0))
    assert {r.problem for r in shards.misplaced(moved, made).collect()} & {"a gap before it", "it ends outside its shard", "it overlaps the record before"}
    assert [r.problem for r in shards.misplaced(index.where("key <> 'm030'"), made).collect()]
    ragged = spark.createDataFrame([("a", [[1.0], [1.0, 2.0]])], "key string, matrix array<array<float>>")
    with pytest.raises(Exception, match="differ in length"):
        shards.write_matrices(ragged, str(tmp_path))


def test_one_of_many_creates_a_file(tmp_path):
    won, at = [], f"{tmp_path}/deep/pointer"
    gate = threading.Barrier(8)

    def go(n):
        gate.wait()
        if shared.create(at, f"by {n}".encode()):
            won.append(n)

    threads = [threading.Thread(target=go, args=(n,)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and shared.read(at) == f"by {won[0]}".encode() and shared.names(f"{tmp_path}/deep") == ["pointer"]
    assert os.listdir(tmp_path / "deep") == ["pointer"]
    shared.replace(at, b"new")
    assert shared.read(at) == b"new" and shared.put(at, b"new") is False and os.listdir(tmp_path / "deep") == ["pointer"]
    with pytest.raises(ValueError, match="is there already"):
        shared.put(at, b"other")


def test_two_publishers_one_creator(spark, tmp_path):
    tables = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")}
    root, out = str(tmp_path), {}
    # the second publishes whole while the first stands just before its commit
    out["first"] = artifacts.publish(spark, root, tables, {"r": 1}, before_commit=lambda: out.update(second=artifacts.publish(spark, root, tables, {"r": 1})))
    assert out["second"][1] is True and out["first"] == (out["second"][0], False)
    assert artifacts.orphans(root) == [] and sorted(map(tuple, artifacts.load(spark, root, out["first"][0])["t"].collect())) == [(1, "a"), (2, "b")]
    assert artifacts.publish(spark, root, tables, {"r": 1})[1] is False


def test_a_failure_before_the_pointer_leaves_orphans_only(spark, tmp_path):
    tables, root = {"t": spark.range(3)}, str(tmp_path)

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        artifacts.publish(spark, root, tables, {"r": 1}, before_commit=fail)
    assert len(artifacts.orphans(root)) == 1 and shared.names(f"{root}/releases") == []
    version, created = artifacts.publish(spark, root, tables, {"r": 1})
    assert created and len(artifacts.orphans(root)) == 1 and artifacts.load(spark, root, version)["t"].count() == 3
    with pytest.raises(ValueError, match="no release"):
        artifacts.load(spark, root, "v-0")
    (Path(artifacts.folder(root, version)) / "extra").mkdir()
    with pytest.raises(ValueError, match="not those of its manifest"):
        artifacts.load(spark, root, version)
    pointer = Path(artifacts.pointer(root, version))
    pointer.write_text(json.dumps(json.loads(pointer.read_text()) | {"identity": {"r": 2}}))
    with pytest.raises(ValueError, match="does not say this version"):
        artifacts.load(spark, root, version)


def test_lookups_read_their_own_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    records = spark.range(2000).select("id", F.concat(F.lit("name "), "id").alias("name"))
    stores.write_store(records, path, ["id"])
    assert 200 < len([f for f in os.listdir(path) if f.startswith("fan_out=")]) <= 256
    wanted = records.where("id in (5, 700, 1999)").select(stores.identity_hash(id=F.col("id")).alias("identity"))
    held = stores.narrowed(spark, path, wanted)
    folders = {r.f for r in held.select(F.regexp_extract(F.input_file_name(), "fan_out=(..)", 1).alias("f")).distinct().collect()}
    assert folders == {r.identity[:2] for r in wanted.collect()} and held.count() < 60
    assert "PartitionFilters: [" in held._jdf.queryExecution().toString() and "fan_out" in held._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:200]


def test_the_resolver_refuses(spark, tmp_path):
    path = str(tmp_path / "store")
    records = spark.range(50).select("id", F.concat(F.lit("name "), "id").alias("name"))
    stores.write_store(records, path, ["id"])
    of = lambda i: spark.createDataFrame([(x,) for x in i], "id long").select("id", stores.identity_hash(id=F.col("id")).alias("identity"))
    listed = stores.inventory(spark, path, "names").join(of([3]), "identity", "left_anti")
    listed = listed.join(of([4]).select("identity", F.lit(True).alias("x")), "identity", "left").select("store", "identity", F.when(F.col("x"), "sha256:0").otherwise(F.col("checksum")).alias("checksum"))
    ghost = of([99]).select(F.lit("names").alias("store"), "identity", F.lit("sha256:1").alias("checksum"))
    wanted = of([1, 1, 3, 4, 99, 77])
    got = {r.id: (r.refused, r.record and r.record["name"]) for r in stores.resolve(spark, path, "names", wanted, listed.unionByName(ghost)).join(wanted.distinct(), "identity").collect()}
    assert got == {1: (None, "name 1"), 3: ("not in the inventory", None), 4: ("changed since the release", None), 99: ("not in the store", None), 77: ("not in the inventory", None)}
    other = stores.resolve(spark, path, "other", of([1]), listed).collect()
    assert [r.refused for r in other] == ["not in the inventory"]


MANIFESTS = [("source1", "source", "s1"), ("source2", "source", "s2"), ("derived", "derived", "d"), ("semantics", "semantics", "m"), ("memory", "memory", "y"), ("evaluation", "evaluation", "e")]
REFS = [("derived", "source1", "s1"), ("semantics", "source1", "s1"), ("memory", "derived", "d"), ("memory", "semantics", "m"), ("evaluation", "memory", None)]


def broken(spark, refs):
    a = spark.createDataFrame(MANIFESTS, "artifact string, kind string, checksum string")
    return {tuple(r) for r in references.contradictions(a, spark.createDataFrame(refs, "artifact string, upstream string, checksum string")).collect()}


def test_manifests_broken_in_each_way(spark):
    assert broken(spark, REFS) == set()
    assert broken(spark, [*REFS, ("semantics", "gone", None)]) == {("semantics", "gone", references.UNKNOWN)}
    assert broken(spark, [("derived", "source1", "old"), *REFS[1:]]) == {("derived", "source1", references.CHANGED)}
    # semantics of another source than derived: all that stand on both contradict themselves
    assert broken(spark, [REFS[0], ("semantics", "source2", "s2"), *REFS[2:]]) == {("memory", "source", references.CONTRADICTION), ("evaluation", "source", references.CONTRADICTION)}
    circle = {("derived", "derived", references.CYCLE), ("memory", "memory", references.CYCLE)}
    assert broken(spark, [*REFS, ("derived", "memory", "y")]) == circle


def test_closure_has_the_least_depth_and_an_end(spark):
    chain = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(9)] + [("a0", "a3")], "artifact string, upstream string")
    got = {(r.artifact, r.upstream): r.depth for r in references.closure(chain).collect()}
    assert len(got) == 45 and got["a0", "a3"] == 1 and got["a0", "a9"] == 7 and got["a1", "a9"] == 8
    with pytest.raises(ValueError, match="deeper than 3"):
        references.closure(chain, most=3)


def test_views_are_bound_to_one_history(spark):
    asked = spark.createDataFrame([(u, "c", f"f{u}") for u in "abcd"], "user_id string, cutoff string, fingerprint string")
    views = spark.createDataFrame([("a", "c", "fa", "A"), ("b", "c", "old", "B"), ("c", "c", "fc", "C"), ("c", "c", "fc", "C2"), ("d", "other", "fd", "D")], "user_id string, cutoff string, fingerprint string, view string")
    assert {r.user_id: (r.refused, r.view) for r in references.bind_views(asked, views).collect()} == {"a": (None, "A"), "b": ("made of another history", None), "c": ("several views", None), "d": ("no view", None)}
    assert {(r.user_id, r.matches) for r in references.unmatched(asked, views, ["user_id", "cutoff"]).collect()} == {("c", 2), ("d", 0)}


def test_only_named_artifacts_are_followed(spark, monkeypatch):
    """artifacts that nobody names reach what their upstreams reach; what is found is as over the whole closure, cycles too."""
    rng = random.Random(5)
    a = [(f"a{i}", f"k{i % 3}", "v1" if i % 4 else "v2") for i in range(12)] + [(f"top{i}", "top", "v1") for i in range(40)]
    refs = [(f"a{i}", f"a{rng.randrange(14)}", "v1") for i in range(12) for _ in range(rng.randrange(2))] + [("a3", "a5", "v1"), ("a5", "a3", "v1")] + [(f"top{i}", f"a{rng.randrange(13)}", rng.choice(["v1", None])) for i in range(40) for _ in range(2)]
    reach = {x: {u for y, u, _ in refs if y == x} for x, _, _ in a}
    for _ in a:
        reach = {x: us.union(*(reach.get(u, set()) for u in us)) for x, us in reach.items()}
    kind, own = {x: k for x, k, _ in a}, {x: v for x, _, v in a}
    want = {(x, u, references.UNKNOWN) for x, u, _ in refs if u not in own} | {(x, u, references.CHANGED) for x, u, v in refs if u in own and v and v != own[u]}
    want |= {(x, x, references.CYCLE) for x, us in reach.items() if x in us}
    want |= {(x, k, references.CONTRADICTION) for x, us in reach.items() for k in set(kind.values()) if len({u for u in us if kind.get(u) == k}) > 1}
    followed, whole = [], references.closure
    monkeypatch.setattr(references, "closure", lambda r, most: followed.append({x.artifact for x in r.collect()}) or whole(r, most))
    got = references.contradictions(spark.createDataFrame(a, "artifact string, kind string, checksum string"), spark.createDataFrame(refs, "artifact string, upstream string, checksum string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {references.CYCLE, references.CONTRADICTION} <= {w[2] for w in want}
    assert len(followed) == 1 and not any(x.startswith("top") for x in followed[0])
