"""Release gates over before and after texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.operators.features import fleschkincaid

EXTERNAL_RISE, EXTERNAL_SHARE, MEANING, GRADES, CALIBRATION = 0.3, 0.80, 0.85, 2.0, 0.75


def readability_rows(docs: DataFrame, before: str, after: str, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select(key, *keep, fleschkincaid(before).alias("before_grade"), fleschkincaid(after).alias("after_grade"))
    return rows.withColumn("change", F.abs(F.col("after_grade") - F.col("before_grade")))


@dataclass(frozen=True)
class Gate:
    """A mean over the rows, and what it has to be."""

    name: str
    value: Column
    threshold: float
    passes: Callable[[Column], Column]


def readability(most: float = GRADES) -> Gate:
    """The mean change of grade is small enough."""
    return Gate("readability", F.col("change"), most, lambda m: m <= most)


def external(before: str, after: str, rise: float = EXTERNAL_RISE, share: float = EXTERNAL_SHARE) -> Gate:
    """The share of samples whose external score rose enough is large enough."""
    return Gate("external_score", (F.col(after) - F.col(before) >= rise).cast("double"), share, lambda m: m >= share)


def meaning(score: str, least: float = MEANING, name: str = "meaning") -> Gate:
    """The mean similarity is large enough."""
    return Gate(name, F.col(score), least, lambda m: m >= least)


def _row(name: str, metric, threshold: float, passes) -> list:
    return [F.lit(name).alias("name"), metric.alias("metric"), F.lit(threshold).alias("threshold"), F.when(metric.isNull(), F.lit("skipped")).when(passes(metric), F.lit("pass")).otherwise(F.lit("fail")).alias("status")]


def at_once(rows: DataFrame, *gates: Gate) -> DataFrame:
    """One row for each gate, from one pass over the rows; skipped without values."""
    means = rows.agg(*[F.avg(g.value).alias(f"m{k}") for k, g in enumerate(gates)])
    return means.select(F.inline(F.array(*[F.struct(*_row(g.name, F.col(f"m{k}"), g.threshold, g.passes)) for k, g in enumerate(gates)])))


def readability_gate(rows: DataFrame, most: float = GRADES) -> DataFrame:
    """One row: the mean change of grade and whether it is small enough; skipped without rows."""
    return at_once(rows, readability(most))


def external_gate(rows: DataFrame, before: str, after: str, rise: float = EXTERNAL_RISE, share: float = EXTERNAL_SHARE) -> DataFrame:
    """One row: the share of samples whose external score rose enough; skipped without scores."""
    return at_once(rows, external(before, after, rise, share))


def meaning_gate(rows: DataFrame, score: str, least: float = MEANING) -> DataFrame:
    """One row: the mean similarity and whether it is large enough; skipped without scores."""
    return at_once(rows, meaning(score, least))


def calibration_gate(auc: DataFrame, least: float = CALIBRATION) -> DataFrame:
    """One row: the `auc` of held-out rows, a frame of one row, and whether it is large enough; skipped without both classes."""
    return auc.agg(F.max("auc").alias("m")).select(*_row("calibration", F.col("m"), least, lambda m: m >= least))


def summary(*gates: DataFrame) -> DataFrame:
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def exit_code(report: DataFrame) -> int:
    """1 if a gate fails; skipped gates don't."""
    return int(not report.where(F.col("status") == "fail").isEmpty())


def markdown(report: DataFrame) -> str:
    """A table of the gates; they are few."""
    rows = sorted(report.collect())
    lines = ["| gate | status | metric | threshold |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {r['name']} | {r['status']} | {'-' if r['metric'] is None else format(r['metric'], '.4f')} | {r['threshold']} |" for r in rows]) + "\n"
