"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseplane.sources import tables

#: Runs of characters other than the six ASCII blanks (\x20, \x09 to \x0D).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents of fewer partitions than there are cores are dealt over all cores."""
    return tables.documents(spark, sf_dir) if name == "documents" else tables.table(spark, sf_dir, name)


def id_bucket(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_of(text: str | Column) -> Column:
    """Number of words in a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new local one where none is set (tests, local mode)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="proseplane-checkpoint-"))
        now = sc._jsc.sc().getCheckpointDir()
    return path or now.get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and cuts its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[pa.Array]:
    """Consecutive slices of about `limit` bytes of text, of one row at least; null becomes empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def drawn(rows: DataFrame, key: str, most: int, seed: int = 23) -> DataFrame:
    """About `most` of the rows, or all where there are fewer, by a hash of the key: every run draws the same.

    Rows with one key are drawn together; distinct() then bounds them however often they repeat. Only the number
    of rows is counted for it, which reads no other column.
    """
    share = min(1.0, most / max(rows.count(), 1))
    return rows if share == 1 else rows.where(F.xxhash64(key, F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5) < F.lit(share))


def packed_rows(df: DataFrame, *more: Column) -> DataFrame:
    """The row of df as the struct `_row`, so that its columns can have any names, and further columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *more)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))  # a new array, which the rest changes in place
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        return h
