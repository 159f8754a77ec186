"""Scores of a heavy model, one per executor process, loaded when first needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def external_scores(text: Column, load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 16) -> Column:
    """Scores of a text column by the scorer that `load` makes on each worker; lower may mean machine-like.

    The scorer gets lists of at most `batch` texts. If it fails on a list, its texts are scored one by one,
    and one that fails alone gets null. Null texts get null.
    """

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = None
        for series in batches:
            out: list[float | None] = [None] * len(series)
            known = [i for i, t in enumerate(series) if isinstance(t, str)]
            for at in range(0, len(known), batch):
                part = known[at : at + batch]
                scorer = scorer or load()
                try:
                    found = list(scorer([series.iloc[i] for i in part]))
                except Exception:  # noqa: BLE001
                    found = [_alone(scorer, series.iloc[i]) for i in part]
                for i, x in zip(part, found, strict=True):
                    out[i] = x
            yield pd.Series(out, dtype="float64")

    return scores(text)


def _alone(scorer: Callable[[list[str]], list[float]], text: str) -> float | None:
    try:
        return float(scorer([text])[0])
    except Exception:  # noqa: BLE001
        return None


def scheduled_scores(docs: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], text: str = "text", into: str = "external", characters: int = 200_000, rows: int = 64, tasks: int | None = None, profile=None) -> DataFrame:
    """docs with the score of each text, which the scorer sees once however often it comes, in batches of like length.

    A batch is padded to its longest text, so texts are dealt by the power of two of their length and sorted by it;
    rows times longest stay under `characters`, and a longer text goes alone. A class of lengths is spread over all
    tasks. `profile` is a resource profile for the scoring stage (as for one accelerator a task). What fails in a
    batch is tried alone and is null if it fails again. Null texts get null; repeated rows stay, a column `into` is replaced.
    """
    import numpy as np

    spark = docs.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_t")).withColumn("_k", F.sha2("_t", 256))
    known = own.where(F.col("_t").isNotNull()).groupBy("_k").agg(F.min("_t").alias("_t")).withColumn("_n", F.length("_t"))
    size = F.floor(F.log2(F.greatest("_n", F.lit(1))))
    dealt = known.withColumn("_size", size).repartition(tasks, "_size", F.pmod(F.xxhash64("_k"), F.lit(tasks))).sortWithinPartitions("_n", "_k")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, keys, texts = None, [], []

        def done() -> pa.RecordBatch:
            try:
                found = [float(x) for x in scorer(texts)]
                if len(found) != len(texts):
                    raise ValueError("a score for each text")
            except Exception:  # noqa: BLE001
                found = [_alone(scorer, t) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.float64())], names=["_k", "_s"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scorer = scorer or load()
                if texts and ((len(texts) + 1) * len(t) > characters or len(texts) >= rows or int(np.log2(max(len(t), 1))) != int(np.log2(max(len(texts[0]), 1)))):
                    yield done()
                    keys, texts = [], []
                keys.append(k)
                texts.append(t)
        if texts:
            yield done()

    scores = dealt.select("_k", "_t").mapInArrow(scored, "_k string, _s double", profile=profile)
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() != into.lower()]
    return own.drop("_t").join(scores, "_k", "left").select(*kept, F.col("_s").alias(into))
