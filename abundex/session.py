"""Session settings and the shared folder for data that must outlive a task."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning: coalesce small shuffles, split skewed join partitions even
# where the split costs one more exchange.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows may be whole texts: batches that a Python worker holds stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


# Contexts that have the code.
_SHIPPED: list = []
# Paths handed out in the shared folder.
_WRITTEN: list[str] = []


def build_session(name: str = "abundex", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the adaptive settings; ``settings`` override them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a session someone else created, and ship the package to it.

    The session keeps these settings: time zone, adaptive execution and split of skewed joins.
    """
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the workers the code, once per context: they need not see the folder it lies in."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="abundex-code-"), "abundex_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("abundex", "catalog"):
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _SHIPPED.append(context)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only in local mode, where it may be unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="abundex-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove the table written to ``path``."""
    context = spark.sparkContext
    if path in _WRITTEN:
        _WRITTEN.remove(path)
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def remove_written(spark: SparkSession) -> None:
    """Remove every table written for this context so far; frames that read them are done for."""
    while _WRITTEN:
        remove(spark, _WRITTEN[-1])
