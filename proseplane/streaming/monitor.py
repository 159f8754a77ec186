"""Running levels of scored documents by source and window of event time, as state of a stream.

Each (source, shard) keeps a clock, the latest time it has seen in order of arrival, and the counts of its open
windows. A row more than `late` behind its clock is late: it is counted as such and changes no window. Windows that
no row can reach any more leave the state, so it stays as large as `late` is long. A source is dealt over shards, so
one that has a third of all rows is no hot key; the shards' counts are added up where the result is read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from proseplane.operators import rules

SHARDS = 8
WINDOW, LATE = 6 * 3600 * 10**6, 3 * 3600 * 10**6
OUT = "source string, shard long, window long, n long, total long, late long"
# the driver's worker that sets up the state doesn't see the session's Python files, so the processor goes as it is
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Levels(StatefulProcessor):
    """Of one (source, shard): rows (arrival, id, at, total) in, counts of the windows that they touch out."""

    def __init__(self, window: int, late: int) -> None:
        self.window, self.late = window, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", StructType([StructField("at", LongType())]))
        self.open = handle.getMapState("open", StructType([StructField("window", LongType())]), StructType([StructField("n", LongType()), StructField("total", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.clock.get()
        clock = known[0] if known else None
        touched: dict[int, list[int]] = {}
        late: dict[int, int] = {}
        for r in sorted(rows, key=lambda r: (r["arrival"], r["id"])):
            w = r["at"] // self.window
            if clock is not None and r["at"] < clock - self.late:
                late[w] = late.get(w, 0) + 1
                continue
            if w not in touched:
                had = self.open.getValue((w,)) if self.open.exists() and self.open.containsKey((w,)) else (0, 0)
                touched[w] = [had[0], had[1]]
            touched[w][0] += 1
            touched[w][1] += r["total"]
            clock = r["at"] if clock is None else max(clock, r["at"])
        if clock is not None:
            self.clock.update((clock,))
            for w, (n, total) in touched.items():
                self.open.updateValue((w,), (n, total))
            shut = [w for (w,) in list(self.open.keys()) if (w + 1) * self.window <= clock - self.late] if touched else []
            for w in shut:
                self.open.removeKey((w,))
        for w in sorted({*touched, *late}):
            n, total = touched.get(w, (0, 0))
            yield Row(source=key[0], shard=key[1], window=w, n=n, total=total, late=late.get(w, 0))

    def close(self) -> None:
        pass


def watched(stream: DataFrame, window: int = WINDOW, late: int = LATE) -> DataFrame:
    """Counts by (source, shard, window), again whenever they change, of a stream (arrival, id, source, shard, at, total).

    at counts microseconds; total is a whole number, so that sums are exact. Null sources are a source of their own
    (the empty text); null times are left out. Of several rows the one with the largest n is the latest; `late` adds up.
    """
    rows = stream.where("at is not null and total is not null").withColumn("source", F.coalesce("source", F.lit("")))
    return rows.groupBy("source", "shard").transformWithState(statefulProcessor=Levels(window, late), outputStructType=OUT, outputMode="Append", timeMode="None")


def follow(stream: DataFrame, path: str, checkpoint: str, window: int = WINDOW, late: int = LATE) -> None:
    """Reads what has arrived since the last call into path, each row once, and returns; state and place are in checkpoint."""
    spark = stream.sparkSession
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state with maps needs it
    try:
        watched(stream, window, late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.set(name, before)


def levels(counts: DataFrame, unit: float = 1e6) -> DataFrame:
    """(source, window, n, total, late, level) from what follow() wrote: the latest of each shard, added up."""
    each = counts.groupBy("source", "shard", "window").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"), F.sum("late").alias("late"))
    got = each.groupBy("source", "window").agg(*[F.sum(c).alias(c) for c in ("n", "total", "late")])
    return got.withColumn("level", F.when(F.col("n") > 0, rules.band_key(F.col("total") / (F.col("n") * unit))))
