"""Session and shared-folder helpers.  On a cluster the caller's own session is used as it is."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "corpuskit") -> SparkSession:
    """A session for tests and the bench; production jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _scratch_root() -> str:
    root = tempfile.mkdtemp(prefix="spark-corpuskit-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names the shared file system in that setting.  Only a local master, where driver and executors are one process, may do
    without it; anywhere else each executor would write to its own disk and a later read would miss the rest.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]-]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master!r})")
        root = _scratch_root()
    return f"{root.rstrip('/')}/corpuskit/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage ends there, and it survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
