"""The probe corpus: English documents with the rules' phrases spliced in, so that every rule has hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.operators.cleanup import ordered_pairs
from proseplane.sources import tables

EXTRA = ("in my experience", "based on my experience", "i've found that", "trust me,x", "i can assure you", "for the past 10 years", "i firmly believe that")
APPEND_1 = " In 2024 Alice Smith met Bob Jones with 42 people, but it failed."
APPEND_2 = "\n```\nutilize() and leverage()\n```\nIt has `leverage()` too."
APPEND_4 = " It is one of the same old things here." * 12


def tells() -> list[str]:
    return [p for r in (*book.WORDS, *book.PHRASES) for p in r.patterns] + list(EXTRA)


def cleanup_tells() -> list[str]:
    return [old for _, old, _ in ordered_pairs()]


def probe(docs: DataFrame, phrases: list[str] | None = None, every: bool = False) -> DataFrame:
    """(doc_id, text, source, lang) of the English rows of docs, or of all, with phrases at places that doc_id fixes."""
    phrases = tells() if phrases is None else phrases
    table = F.array(*map(F.lit, phrases))
    d, n = F.col("doc_id"), len(phrases)
    pick = lambda i: F.concat(F.lit(" "), F.element_at(table, (i % n).cast("int") + 1), F.lit(" "))
    nl = F.lit("\n")
    t = F.when(d % 3 == 0, F.replace("text", nl, F.lit("\n\n"))).otherwise(F.col("text"))
    docs = (docs if every else docs.where("lang = 'en'")).withColumn("t", t)
    docs = docs.withColumn("t", F.replace(F.replace("t", F.lit(" the "), pick(d)), F.lit(" of "), pick(d * 7 + 3)))
    marks = F.when(d % 5 == 0, F.replace("t", nl, F.lit("\n- "))).when(d % 7 == 0, F.replace("t", nl, F.lit("\n## "))).when(d % 12 == 3, F.replace("t", F.lit("\n\n"), F.lit("\n\nFirst, "))).otherwise(F.col("t"))
    docs = docs.withColumn("t", marks)
    end = F.when(d % 6 == 1, F.lit(APPEND_1)).when(d % 6 == 2, F.lit(APPEND_2)).when(d % 6 == 4, F.lit(APPEND_4)).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat("t", end).alias("text"), "source", "lang")


def load(spark: SparkSession, sf_dir: str, cleanup: bool = False, every: bool = False) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return probe(tables.spread(rows if every else rows.where("lang = 'en'")), cleanup_tells() if cleanup else None, every)
