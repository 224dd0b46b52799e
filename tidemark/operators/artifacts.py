"""Content-addressed releases: a version from what the rows say, attempts in folders of their own, and an exclusive pointer as the commit."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import shared


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order or files: counts and sums of row hashes in two halves."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    got = df.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b")).first()
    schema = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return hashlib.sha256(f"{schema}|{got.n}|{got.a}|{got.b}".encode()).hexdigest()


def version_of(identity: dict, prefix: str = "v-") -> str:
    """prefix + SHA-256 of the canonical JSON of sources, recipes and table digests."""
    text = json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n"
    return prefix + hashlib.sha256(text.encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def pointer(root: str, version: str) -> str:
    return f"{root}/releases/{version}.json"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], identity: dict, before_commit: Callable[[], None] | None = None) -> tuple[str, bool]:
    """(version, created). The commit is the release's pointer, a file that only one publisher can create.

    The version follows from the content. Tables go to a folder of this attempt alone, are read back and compared; then the
    pointer is created with a manifest that names this folder. Of any number of publishers of the same content one
    creates the release; the others delete what they wrote, verify the one that is there and use it. A failure before the pointer
    leaves folders that no pointer names (``orphans``) and that no reader sees. ``before_commit`` runs just before the pointer.
    """
    digests = {n: content_digest(df) for n, df in sorted(tables.items())}
    version = version_of({"identity": identity, "tables": digests})
    if shared.size(pointer(root, version)) is None:
        folder = f"bundles/{version}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{root}/{folder}/{name}")
            if content_digest(spark.read.parquet(f"{root}/{folder}/{name}")) != digests[name]:
                raise ValueError(f"{name} was not written as it was")
        if before_commit is not None:
            before_commit()
        manifest = json.dumps({"version": version, "identity": identity, "tables": digests, "folder": folder}, sort_keys=True)
        if shared.create(pointer(root, version), manifest.encode(), spark):
            return version, True
        fs, at = _fs(spark, f"{root}/{folder}")
        fs.delete(at, True)
    load(spark, root, version)  # another run was first; it must say the same
    return version, False


def manifest_of(root: str, version: str) -> dict:
    """The manifest of an exact version; its identity and table digests must give this version."""
    if shared.size(pointer(root, version)) is None:
        raise ValueError(f"there is no release {version}")
    manifest = json.loads(shared.read(pointer(root, version)))
    if manifest["version"] != version or version_of({"identity": manifest["identity"], "tables": manifest["tables"]}) != version:
        raise ValueError(f"the manifest of {version} does not say this version")
    return manifest


def folder(root: str, version: str) -> str:
    return f"{root}/{manifest_of(root, version)['folder']}"


def load(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    """The tables of an exact version, checked against the manifest: inventory, digests and the version itself."""
    manifest, base = manifest_of(root, version), folder(root, version)
    there = set(shared.names(base))
    if there != set(manifest["tables"]):
        raise ValueError(f"the tables of {version} are not those of its manifest: {sorted(there ^ set(manifest['tables']))}")
    out = {}
    for name, digest in manifest["tables"].items():
        out[name] = spark.read.parquet(f"{base}/{name}")
        if content_digest(out[name]) != digest:
            raise ValueError(f"{name} of {version} was changed")
    return out


def orphans(root: str) -> list[str]:
    """Folders of attempts that no pointer names: of publishers that failed, or that still write."""
    named = {json.loads(shared.read(f"{root}/releases/{n}"))["folder"].split("/")[1] for n in shared.names(f"{root}/releases")}
    return sorted(set(shared.names(f"{root}/bundles")) - named)
