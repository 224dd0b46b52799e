"""Session and workspace helpers shared by every query."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task is given where a query deals a table itself.
ROWS = 500_000


def local_session(cores: str = "8", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session as tests and bench use it; on a cluster the caller brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset on a local master, a temporary one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and losing executors loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that take ``ROWS`` rows each: what one task holds does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers where their path does not have it already."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    work = tempfile.mkdtemp(prefix="tidemark-ship-")
    atexit.register(shutil.rmtree, work, ignore_errors=True)
    shutil.copytree(Path(__file__).parent, f"{work}/tree/tidemark", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{work}/tidemark", "zip", f"{work}/tree"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
