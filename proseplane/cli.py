"""Command line: detect, clean, polish, judge, mine, train, gate, providers and the rules page, over paths.

Providers for polish and judge are named `module:function`; the function takes a prompt and returns text.

Exit codes: 0 done, 1 a gate failed, 2 bad input, 3 no provider, 130 interrupted.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from proseplane.operators import cleanup, features, gates, lm, mining, polish, rules
from proseplane.plans import rules_doc
from proseplane.sources import readers


def _docs(spark: SparkSession, path: str):
    return spark.read.parquet(path).select("doc_id", "text") if path.rstrip("/").endswith(".parquet") else readers.read_articles(spark, path)


def _provider(name: str | None) -> polish.Provider:
    if not name:
        return polish.resolve_provider()
    module, _, function = name.partition(":")
    try:
        return polish.Provider(name, "-", getattr(importlib.import_module(module), function))
    except (ImportError, AttributeError, ValueError) as e:
        raise polish.ConfigError(f"no provider {name!r}: {e}") from e


def detect(spark: SparkSession, docs, model_dir: str | None = None):
    """One JSON payload for each document."""
    scored = rules.scored(docs)
    model = lm.LanguageModel.load(spark, model_dir) if model_dir else None
    if model is None:
        scored = scored.withColumns({"ngram_probability": F.lit(0.0), "ngram_level": F.lit("UNAVAILABLE"), "available": F.lit(False)})
    else:
        shown = ("total", "rounded_total", "level", "violations", "text_length")
        scored = features.ngram_score(features.features(scored, model, keep=shown)).withColumn("available", F.lit(True))
    both = features.combined(F.col("total"), F.col("ngram_probability"), F.col("available"))
    shown = F.transform("violations", lambda v: F.struct(v["category"].alias("category"), v["rule"].alias("rule"), v["count"].alias("count"), v["sample"].alias("sample")))
    payload = F.struct(
        F.col("doc_id").alias("file"), F.col("text_length").alias("chars"), F.struct(F.col("rounded_total").alias("probability"), "level", shown.alias("violations")).alias("rule"),
        F.struct(F.col("ngram_probability").alias("probability"), F.col("ngram_level").alias("level"), "available").alias("ngram"),
        F.struct(F.round(both, 1).alias("probability"), rules.band_key(both).alias("level"), F.when(both >= 50, F.lit("BLOCK")).otherwise(F.lit("PASS")).alias("decision")).alias("combined"),
    )
    return scored.select("doc_id", F.to_json(payload).alias("payload"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="proseplane")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("rules")
    p.add_argument("output")
    p.add_argument("--check", action="store_true")
    sub.add_parser("providers")
    for name in ("detect", "clean", "mine", "train", "gate", "polish", "judge"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        if name in ("polish", "judge"):
            p.add_argument("--provider")
            p.add_argument("--writer")
            p.add_argument("--scene", default="analysis")
            p.add_argument("--strength")
            p.add_argument("--candidates", type=int, default=1)
            p.add_argument("--force", action="store_true")
            p.add_argument("--allow-self", action="store_true")
        if name == "detect":
            p.add_argument("--model")
        if name == "mine":
            p.add_argument("--least", type=int, default=200)
            p.add_argument("--words", type=int, default=1, help="1: single words, 2 or 3: phrases of so many")
    args = parser.parse_args(argv)
    if args.command == "rules":
        return rules_doc.write(args.output, args.check)
    if args.command == "providers":
        for name in polish.list_providers():
            print(name)
        if not polish.list_providers():
            print("none; name one as module:function", file=sys.stderr)
        return 0 if polish.list_providers() else 3
    if args.command in ("polish", "judge"):
        try:
            provider, writer = _provider(args.provider), _provider(args.writer) if args.writer else None
        except polish.ProviderError as e:
            print(e, file=sys.stderr)
            return 3
    spark = SparkSession.builder.appName(f"proseplane {args.command}").getOrCreate()
    try:
        if args.command == "mine":
            answers = readers.read_answers(spark, args.input, least=1)
            classes = answers.where("label = 1"), answers.where("label = 0")
            found = mining.word_ratios(*classes, least=args.least) if args.words == 1 else mining.phrase_ratios(*classes, args.words, least=args.least)
            readers.write_tsv(found.orderBy(F.desc("ratio"), found.columns[0]), args.output)
            return 0
        if args.command == "train":
            lm.LanguageModel.train(readers.read_answers(spark, args.input).where("label = 0")).save(args.output)
            return 0
        docs = _docs(spark, args.input)
        if args.command == "detect":
            readers.write_texts(detect(spark, docs, args.model), "payload", args.output)
        elif args.command == "polish":
            done = polish.one_pass(docs, provider, force=args.force, scene=args.scene, strength=args.strength, candidates=args.candidates)
            done.select("doc_id", "after", "status", "before_total", "after_total").write.mode("overwrite").parquet(args.output)
        elif args.command == "judge":
            reviewed = polish.review(docs, provider, writer, allow_self=args.allow_self)
            reviewed.select("doc_id", "review_report").write.mode("overwrite").parquet(args.output)
        elif args.command == "clean":
            docs.select("doc_id", cleanup.protected(F.col("text")).alias("text")).write.mode("overwrite").parquet(args.output)
        else:
            after = docs.select("doc_id", "text", cleanup.protected(F.col("text")).alias("after"))
            report = gates.summary(gates.readability_gate(gates.readability_rows(after, "text", "after"))).cache()
            readers.write_json(report, args.output)
            return gates.exit_code(report)
    except KeyboardInterrupt:
        return 130
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"no such input: {args.input}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
