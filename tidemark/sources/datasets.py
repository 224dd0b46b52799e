"""Source datasets by manifest: three line files of exact bytes, typed, held against the dataset's rules and limits.

A manifest names the dataset, and for each of ``events``, ``items`` and ``segments`` the files with size and SHA-256. Bytes are
verified in the tasks, in blocks, before a record is read; a key that leaves the dataset's folder is refused. What breaks
a rule comes out as rows (rule, subject), each rule a join or an aggregate.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.scalar import portable_path_problem
from tidemark.operators import constraints as C
from tidemark.sources import files, lines, shared

SCHEMAS = {"events": files.EVENT, "items": files.ITEM, "segments": files.SEGMENT}
BLOCK = 1 << 20


@dataclass(frozen=True)
class Limits:
    events: int = 10**12
    items: int = 10**10
    segments: int = 10**11
    users: int = 10**10


def identities(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """name, size_bytes, sha256 of files, a task each, read in blocks; files that are not there have neither."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                uri, sha, size = f"{root}/{name}", hashlib.sha256(), 0
                if shared.size(uri) is None:
                    out.append((name, None, None))
                    continue
                system, path = shared.at(uri)
                with system.open_input_stream(path) as f:
                    while data := f.read(BLOCK):
                        sha.update(data)
                        size += len(data)
                out.append((name, size, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["name", "size_bytes", "sha256"])

    named = spark.createDataFrame([(k,) for k in keys], "name string").repartition(max(1, len(keys)))
    return named.mapInArrow(one, "name string, size_bytes long, sha256 string")


def manifest_for(dataset: str, version: str, parts: dict[str, DataFrame], folders: dict[str, str], root: str) -> str:
    """The manifest of files that ``lines.write_ordered`` wrote: ``parts`` are its results by table, ``folders`` where they are under ``root``."""
    told = {t: sorted((f"{folders[t]}/{r.file}", shared.size(f"{root}/{folders[t]}/{r.file}"), r.sha256) for r in df.collect()) for t, df in parts.items()}
    return json.dumps({"dataset": dataset, "version": version, "files": {t: [dict(zip(("key", "size_bytes", "sha256"), x, strict=True)) for x in xs] for t, xs in told.items()}}, sort_keys=True)


def load(spark: SparkSession, root: str, manifest: str) -> dict[str, DataFrame]:
    """The three tables, with file and ordinal, after every byte was verified."""
    said = json.loads(manifest)
    if set(said["files"]) != set(SCHEMAS) or not all(said["files"].values()):
        raise ValueError(f"a dataset has files for {sorted(SCHEMAS)}")
    every = [f for fs in said["files"].values() for f in fs]
    odd = {f["key"]: p for f in every if (p := portable_path_problem(f["key"]))}
    if odd or len({f["key"] for f in every}) < len(every):
        raise ValueError(f"keys that are no files of their own in the dataset's folder: {odd or 'a key stands twice'}")
    wrong = files.unverified(identities(spark, root, [f["key"] for f in every]).where("sha256 is not null"), spark.createDataFrame([(f["key"], f["size_bytes"], f["sha256"]) for f in every], "name string, size_bytes long, sha256 string"))
    C.enforce(wrong, f"files of {said['dataset']} {said['version']}")
    return {t: lines.json_records(spark, [f"{root}/{f['key']}" for f in said["files"][t]], schema) for t, schema in SCHEMAS.items()}


def violations(tables: dict[str, DataFrame], limits: Limits = Limits()) -> DataFrame:
    """(rule, subject) of all that breaks a rule; no row means a valid dataset."""
    e, i, s = (tables[t] for t in ("events", "items", "segments"))
    of = lambda rule, df, *subject: df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *subject).alias("subject"))
    found = [
        of("an item stands twice", C.duplicates(i, ["item_id"]), "item_id"),
        of("an event of an unknown item", C.orphans(e, i, "item_id"), "user_id", F.col("interaction_index").cast("string")),
        of("interactions are not 0 to n - 1", C.not_contiguous(e, "user_id", "interaction_index"), "user_id"),
        of("a user is timed in part", C.partly_timed(e, "user_id", "occurred_at_ms"), "user_id"),
        of("time goes back", C.out_of_order(e, "occurred_at_ms", ["interaction_index", "item_id"], "user_id"), "user_id", F.col("interaction_index").cast("string")),
        of("a segment of an unknown item", C.orphans(s, i, "item_id"), "item_id", "segment_id"),
        of("segments are not 0 to n - 1", C.not_contiguous(s, "item_id", "sequence_index"), "item_id"),
        of("a segment stands twice", C.duplicates(s, ["item_id", "segment_id"]), "item_id", "segment_id"),
    ]
    users = e.select("user_id").distinct()
    for name, df, limit in (("events", e, limits.events), ("items", i, limits.items), ("segments", s, limits.segments), ("users", users, limits.users)):
        found.append(of("more than the limit", C.over_limit(df, limit), F.lit(name), F.col("n").cast("string")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
