"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a new local folder where none is set (tests, local mode)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="proseplane-checkpoint-"))
        now = sc._jsc.sc().getCheckpointDir()
    return (path or now.get()).rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def present(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def drop(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder, in one step where the file system can; an error if the target is there or the step fails."""
    fs, at = _file_system(spark, source)
    _, to = _file_system(spark, target)
    fs.mkdirs(to.getParent())
    if fs.exists(to) or not fs.rename(at, to):
        raise OSError(f"could not move {source} to {target}")
