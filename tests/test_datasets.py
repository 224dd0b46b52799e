"""Source datasets: verified bytes, refused keys, and a row for each broken rule."""

import hashlib
import json
from pathlib import Path

import pytest

from tidemark.sources import datasets

EVENTS = [{"user_id": "u", "item_id": i, "interaction_index": n, "occurred_at_ms": 1000 + n} for n, i in enumerate(["a", "b", "a"])]
ITEMS = [{"item_id": "a", "metadata": "{}"}, {"item_id": "b"}]
SEGMENTS = [{"item_id": "a", "segment_id": "s0", "sequence_index": 0}, {"item_id": "a", "segment_id": "s1", "sequence_index": 1}]


def write(root, **changed):
    tables, files = {"events": EVENTS, "items": ITEMS, "segments": SEGMENTS} | changed, {}
    for name, rows in tables.items():
        data = "".join(json.dumps(r) + "\n" for r in rows).encode()
        (Path(root) / f"{name}.jsonl").write_bytes(data)
        files[name] = [{"key": f"{name}.jsonl", "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}]
    return {"dataset": "d", "version": "1", "files": files}


def found(spark, root, limits=datasets.Limits(), **changed):
    loaded = datasets.load(spark, str(root), json.dumps(write(root, **changed)))
    return {(r.rule, r.subject) for r in datasets.violations(loaded, limits).collect()}


def test_a_row_for_each_broken_rule(spark, tmp_path):
    assert found(spark, tmp_path) == set()
    assert found(spark, tmp_path, items=[*ITEMS, ITEMS[1]], segments=[*SEGMENTS, SEGMENTS[1], {"item_id": "z", "segment_id": "s", "sequence_index": 0}]) == {
        ("an item stands twice", "b"), ("segments are not 0 to n - 1", "a"), ("a segment stands twice", "a/s1"), ("a segment of an unknown item", "z/s"),
    }
    late = [EVENTS[0], EVENTS[1] | {"occurred_at_ms": 1}, EVENTS[2] | {"interaction_index": 3, "item_id": "q"}, {"user_id": "v", "item_id": "a", "interaction_index": 0, "occurred_at_ms": None}, {"user_id": "v", "item_id": "a", "interaction_index": 1, "occurred_at_ms": 5}]
    assert found(spark, tmp_path, datasets.Limits(users=1, events=4), events=late) == {
        ("time goes back", "u/1"), ("interactions are not 0 to n - 1", "u"), ("an event of an unknown item", "u/3"), ("a user is timed in part", "v"), ("more than the limit", "users/2"), ("more than the limit", "events/5"),
    }


def test_bytes_and_keys_are_verified_first(spark, tmp_path):
    said = write(tmp_path)
    load = lambda m: datasets.load(spark, str(tmp_path), json.dumps(m))
    assert {n: t.count() for n, t in load(said).items()} == {"events": 3, "items": 2, "segments": 2}
    (tmp_path / "items.jsonl").write_bytes((tmp_path / "items.jsonl").read_bytes().replace(b"a", b"c"))
    with pytest.raises(ValueError, match="sha256"):
        load(said)
    (tmp_path / "items.jsonl").unlink()
    with pytest.raises(ValueError, match="missing"):
        load(said)
    for key in ("../items.jsonl", "/etc/passwd", "a//b"):
        bad = write(tmp_path)
        bad["files"]["items"][0]["key"] = key
        with pytest.raises(ValueError, match="no files of their own"):
            load(bad)
    with pytest.raises(ValueError, match="has files for"):
        load({"dataset": "d", "version": "1", "files": {"events": []}})


def test_identities_are_those_of_whole_files(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"x" * (3 * datasets.BLOCK + 7))
    got = {r.name: (r.size_bytes, r.sha256) for r in datasets.identities(spark, str(tmp_path), ["x", "none"]).collect()}
    assert got == {"x": (3 * datasets.BLOCK + 7, hashlib.sha256(b"x" * (3 * datasets.BLOCK + 7)).hexdigest()), "none": (None, None)}
