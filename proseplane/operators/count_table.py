"""Counts of a growing corpus: new documents add a delta, and the top k come from the deltas without recounting.

A delta keeps its most frequent keys apart from the rest and knows how often a key of the rest comes at most. So the
heads alone bound every key's count from both sides. Where the bounds leave only some keys open, those are looked up in
the rests; where they can't say which keys may be among the top k, heads and rests are added up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseplane.operators.lm import top
from proseplane.plans.scratch import move, present

HEAD = 50_000


class CountTable:
    """Deltas of (keys..., cnt) below a shared folder; a delta is moved among the others when it is whole."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def add(self, counts: DataFrame, head: int = HEAD) -> str:
        """Adds the counts of new documents, one row for each key, and returns the delta's name.

        The head holds all keys as frequent as the least frequent one in it, `head` keys at most.
        """
        name = uuid.uuid4().hex
        at = f"{self.folder}/writing/{name}"
        counts.select(*self.keys, F.col("cnt").cast("long").alias("cnt")).write.parquet(f"{at}/all")
        rows = self.spark.read.parquet(f"{at}/all")
        by = rows.groupBy("cnt").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)))  # a row for each distinct count
        least = by.where(F.col("upto") <= head).agg(F.min("cnt")).first()[0]
        is_head = F.col("cnt") >= F.lit(least) if least is not None else F.lit(False)
        rows.where(is_head).write.parquet(f"{at}/delta/head")
        rows.where(~is_head).write.parquet(f"{at}/delta/rest")
        figures = rows.agg(F.coalesce(F.max(F.when(~is_head, F.col("cnt"))), F.lit(0)).alias("most_in_rest"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
        figures.write.parquet(f"{at}/delta/figures")
        move(self.spark, f"{at}/delta", f"{self.folder}/deltas/{name}")
        return name

    def names(self) -> list[str]:
        if not present(self.spark, f"{self.folder}/deltas"):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(f.getPath().getName() for f in found)

    def _read(self, part: str, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/deltas/{n}/{part}" for n in names])

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum("cnt").alias("cnt"))

    def top(self, k: int) -> tuple[DataFrame, str]:
        """The k most frequent keys with their exact counts, ties by key, and how they were found.

        `heads`: no key was open; `looked up`: some were, and the rests settled them; `all`: everything was added up.
        """
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in self.keys) + ", cnt long"), "heads"
        figures = [self._read("figures", [n]).first()["most_in_rest"] for n in names]
        heads = self._read("head", names[:1]).withColumn("_bound", F.lit(figures[0]))
        for n, bound in zip(names[1:], figures[1:], strict=True):
            heads = heads.unionByName(self._read("head", [n]).withColumn("_bound", F.lit(bound)))
        unseen = sum(figures)
        # what a key may have besides: the bounds of the deltas in whose heads it is not
        known = heads.groupBy(*self.keys).agg(F.sum("cnt").alias("cnt"), (F.lit(unseen) - F.sum("_bound")).alias("more")).checkpoint()
        edge = top(known.select(*self.keys, "cnt"), k, self.keys).agg(F.min("cnt"), F.count("*")).first()
        if edge[1] < k or unseen >= edge[0]:
            if unseen == 0:
                return top(known.select(*self.keys, "cnt"), k, self.keys), "heads"
            return top(self._summed(self._read("head", names).unionByName(self._read("rest", names))), k, self.keys), "all"
        may = known.where(F.col("cnt") + F.col("more") >= edge[0])
        if may.where("more > 0").isEmpty():
            return top(may.select(*self.keys, "cnt"), k, self.keys), "heads"
        rest = self._read("rest", names).join(may.where("more > 0").select(*self.keys), self.keys, "left_semi")
        return top(self._summed(may.select(*self.keys, "cnt").unionByName(rest)), k, self.keys), "looked up"
