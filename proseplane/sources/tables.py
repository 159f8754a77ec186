"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Inputs of so many partitions or more stay as they are read.
FEW = 64


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores where its files give fewer than FEW partitions and than there are cores; else as it is.

    A file of one row group is one task, however large the cluster. Only inputs of a few splits (some 8 GB at the
    usual size) are moved, so larger ones never shuffle here, on a cluster of any size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))
