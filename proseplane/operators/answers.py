"""Answers of providers kept by content: a prompt that was answered once is not asked again, in this run or a later one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseplane.operators.dispatch import Limits, dispatched
from proseplane.operators.polish import Provider
from proseplane.plans.scratch import ensure_checkpoint_dir, move, present

SCHEMA = "provider string, key string, answer string, error string, asked_at timestamp"


def key_of(prompt: str | Column) -> Column:
    """The address of a prompt; null is the empty one."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.sha2(F.coalesce(prompt, F.lit("")), 256)


class AnswerStore:
    """Parts of answers below a folder that driver and executors share.

    A part is written beside the others and moved among them when it is whole, so a reader and a run after a lost one see
    whole parts only.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def parts(self) -> DataFrame:
        """(provider, key, answer, error, asked_at, part); one row for each asking."""
        if not present(self.spark, f"{self.folder}/parts"):
            return self.spark.createDataFrame([], SCHEMA + ", part string")
        return self.spark.read.schema(SCHEMA + ", part string").option("basePath", f"{self.folder}/parts").parquet(f"{self.folder}/parts")

    def known(self, provider: Provider) -> DataFrame:
        """(key, answer) of what the provider has answered; of two answers the first."""
        mine = self.parts().where((F.col("provider") == provider.identity) & F.col("answer").isNotNull())
        return mine.groupBy("key").agg(F.min_by("answer", F.struct("asked_at", "part")).alias("answer"))

    def ask(self, rows: DataFrame, prompt: str | Column, provider: Provider, limits: Limits = Limits(), passes: int = 1, into: str = "answered") -> DataFrame:
        """rows with the struct `into` (answer, error): known answers, and for the others what the provider says now.

        Equal prompts are one question. What is missing is asked in `passes` parts, each kept as soon as it is whole, so
        a run that is lost costs a pass at most. Errors are kept for the report only; those prompts are asked again
        by the next run. Repeated rows stay, a null prompt is the empty one, a column `into` is replaced.
        """
        ensure_checkpoint_dir(self.spark)
        prompt = F.col(prompt) if isinstance(prompt, str) else prompt
        named = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.coalesce(prompt, F.lit("")).alias("_prompt"))
        questions = named.groupBy(key_of("_prompt").alias("key")).agg(F.min("_prompt").alias("prompt"))
        missing = questions.join(self.known(provider).select("key"), "key", "left_anti").withColumn("pass", F.pmod(F.xxhash64("key"), F.lit(passes))).checkpoint()
        asked = []
        for k in range(passes):
            part = uuid.uuid4().hex
            said = missing.where(F.col("pass") == k).select("key", dispatched(provider, F.col("prompt"), limits).alias("a"))
            said = said.select(F.lit(provider.identity).alias("provider"), "key", F.col("a.answer").alias("answer"), F.col("a.error").alias("error"), F.current_timestamp().alias("asked_at"))
            said.write.parquet(f"{self.folder}/writing/{part}")
            move(self.spark, f"{self.folder}/writing/{part}", f"{self.folder}/parts/part={part}")
            asked.append(part)
        failed = self.parts().where(F.col("part").isin(asked) & F.col("error").isNotNull()).select("key", "error")
        done = named.withColumn("key", key_of("_prompt")).drop("_prompt").join(self.known(provider), "key", "left").join(failed, "key", "left")
        own = [F.col(f"_row.`{c}`") for c in rows.columns if c.lower() != into.lower()]
        return done.select(*own, F.struct("answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error")).alias(into))
