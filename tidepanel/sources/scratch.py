"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a local folder on one machine and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return path or tempfile.gettempdir()


def written(df: DataFrame) -> DataFrame:
    """The frame as a written table, which cuts its lineage and is computed once."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a finished folder; where another session has been faster, its folder stays and this one goes."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)


def changed_at(spark: SparkSession, path: str) -> int | None:
    """When a file or folder was last written, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(at).getModificationTime() if files.exists(at) else None
