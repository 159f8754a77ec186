"""Readers of articles, answer corpora and bench samples, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book

BENCH = "struct<id:string,domain:string,scene:string,text:string>"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row for each text file; doc_id is its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_answers(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """(text, label) of a JSON-lines corpus with human_answers (label 0) and chatgpt_answers (label 1).

    Answers are stripped; shorter ones than `least` are left out. Blank and broken lines give nothing.
    """
    rows = spark.read.schema("human_answers array<string>, chatgpt_answers array<string>").json(path)

    def labelled(column: str, label: int) -> Column:
        return F.transform(F.coalesce(column, F.array()), lambda x: F.struct(x.alias("text"), F.lit(label).alias("label")))

    both = F.concat(labelled("human_answers", 0), labelled("chatgpt_answers", 1))
    each = rows.select(F.explode(both).alias("a")).select(F.regexp_replace("a.text", r"(?U)\A\s+|\s+\z", "").alias("text"), "a.label")
    return each.where(F.length("text") >= least)


def read_bench(spark: SparkSession, path: str, source: str = "bundled", domain: str | None = None, n: int | None = None) -> DataFrame:
    """Bench samples of one JSON file: those of the domain, then the first n by id."""
    if source == "raid":
        raise NotImplementedError("this source needs a download")
    if source != "bundled":
        raise ValueError(f"unknown source {source!r}")
    rows = spark.read.schema(f"samples array<{BENCH}>").json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*", F.lit(source).alias("source"))
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    return rows if n is None else rows.orderBy("id").limit(n)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_calibration(path: str) -> tuple[tuple, float] | None:
    """(calibration, intercept) for probability() of a JSON file; None if its arrays don't match or it is missing."""
    import json
    from pathlib import Path

    try:
        got = json.loads(Path(path).read_text())
        rows = tuple(zip(got["feature_order"], got["feature_mean"], got["feature_std"], got["coef"], strict=True))
        return rows, float(got["intercept"])
    except (OSError, ValueError, KeyError, TypeError):
        return None


def write_calibration(path: str, calibration, intercept: float) -> None:
    import json
    from pathlib import Path

    names = ("feature_order", "feature_mean", "feature_std", "coef")
    Path(path).write_text(json.dumps({n: [row[i] for row in calibration] for i, n in enumerate(names)} | {"intercept": intercept}, indent=1))


def _loaded(path: str) -> dict:
    import json
    from pathlib import Path

    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def read_rules(path: str) -> book.RuleSet:
    """Rules of a JSON file of buckets; names that begin with _ and entries that are no objects are skipped.

    A file that can't be read gives no rules, so that scoring goes on, and the version says so.
    """
    got = _loaded(path)
    if not got:
        return book.EMPTY
    named = lambda b: {k: v for k, v in (got.get(b) or {}).items() if not k.startswith("_") and isinstance(v, dict)}
    listed = lambda b: tuple(book.ListRule(k, int(v.get("weight", 1)), v.get("soft_threshold"), v.get("hard_threshold"), tuple(v["patterns"])) for k, v in named(b).items() if v.get("patterns"))
    gate = lambda b, k, *fields: tuple(named(b)[k].get(f, d) for f, d in fields) if k in named(b) else None
    short = gate("rhythm_rules", "short_sentence_ratio", ("weight", 4), ("min_text_length", 300), ("ai_threshold", 0.02))
    return book.RuleSet(
        str((got.get("_meta") or {}).get("version", "unknown")), listed("blacklist_words"), listed("blacklist_phrases"),
        tuple(book.RegexRule(k, int(v.get("weight", 1)), v.get("hard_threshold"), tuple(v["patterns"])) for k, v in named("fake_human").items() if v.get("patterns")),
        tuple(book.SignalRule(k, int(v.get("weight", 5)), int(v.get("min_threshold", 1)), int(v.get("min_text_length", 0)), bool(v.get("case_insensitive", True)), v["pattern"]) for k, v in named("soul_signals").items() if v.get("pattern")),
        gate("structural_rules", "heading_density", ("weight", 5), ("min_text_length", 500), ("threshold_per_1000_chars", 3.0)),
        gate("structural_rules", "list_density", ("weight", 5), ("min_text_length", 500), ("threshold_ratio", 0.5)),
        gate("rhythm_rules", "sentence_length_cv", ("weight", 10), ("min_sentences", 5), ("ai_threshold", 0.35)),
        (short[0], short[1], 5, short[2]) if short else None,
        gate("rhythm_rules", "paragraph_uniformity", ("weight", 6), ("min_paragraphs", 3), ("ai_threshold", 0.3)),
        gate("rhythm_rules", "para_opening_enumeration", ("weight", 5), ("hard_threshold", 2), ("pattern", "(?!)")),
    )


def read_replacements(path: str) -> dict[str, tuple]:
    """Buckets of replacement pairs of a JSON file, in its `_order`; {} if it can't be read."""
    got = _loaded(path).get("replacements") or {}
    order = got.get("_order") or [k for k in got if not k.startswith("_")]
    return {b: tuple(tuple(p) for p in got.get(b) or () if isinstance(p, list)) for b in order}


def read_environment(path: str) -> int:
    """Sets KEY=VALUE lines of a file that the environment lacks; their number, 0 without the file."""
    import os
    from pathlib import Path

    n = 0
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except OSError:
        return 0
    for line in lines:
        key, eq, value = line.strip().partition("=")
        if eq and key and not key.startswith("#") and key.strip() not in os.environ:
            os.environ[key.strip()] = value.strip().strip("\"'")
            n += 1
    return n
