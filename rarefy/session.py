"""Session helpers: local sessions for tests/bench, shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "rarefy") -> SparkSession:
    """A local session configured like the test/bench harness (UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared (HDFS/S3/...) folder and is used
    as is.  Only when it is unset on a single-process master (``local[...]``,
    as in tests) a scratch folder is created; anywhere else that raises, since
    executors would each write to a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    path = tempfile.mkdtemp(prefix="rarefy-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


# Folders of the open scratch scopes, innermost last, by application.
_SCOPES: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables.

    Inside a :func:`scratch_scope` it lies in the scope's folder.
    """
    scopes = _SCOPES.get(spark.sparkContext.applicationId)
    base = scopes[-1] if scopes else ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by ``materialise`` into scratch space."""
    path = getattr(df, "_scratch", None)
    if path:
        delete_folder(df.sparkSession, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Everything written to scratch space inside the block is deleted at its end.

    Results must be written elsewhere (or read) before the block ends.
    """
    folder = scratch_path(spark, f"run-{uuid.uuid4().hex}")
    scopes = _SCOPES.setdefault(spark.sparkContext.applicationId, [])
    scopes.append(folder)
    try:
        yield folder
    finally:
        scopes.remove(folder)
        delete_folder(spark, folder)
