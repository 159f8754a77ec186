"""Rewriting with a pluggable provider: one pass, review, and the iterative loop, over whole frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.operators import prompts, rules
from proseplane.operators.cleanup import protected
from proseplane.plans.scratch import ensure_checkpoint_dir

RULE_LIMIT, COMBINED_LIMIT = 25.0, 30.0
ROUNDS, TARGET = 3, 30


class ProviderError(RuntimeError):
    """Of a provider; subclasses say which kind."""


class NotConfigured(ProviderError):
    """No provider is active."""


class AuthError(ProviderError):
    pass


class ConfigError(ProviderError):
    pass


class ContextLimitError(ProviderError):
    pass


class RateLimitError(ProviderError):
    pass


class ProviderTimeout(ProviderError):
    pass


@dataclass(frozen=True)
class Provider:
    """Answers prompts on the executors. `call` must be picklable; one that loads a model should keep it."""

    name: str
    model: str
    call: Callable[[str], str]

    @property
    def identity(self) -> str:
        return f"{self.name}:{self.model}"


_PROVIDERS: dict[str, Provider] = {}
_ACTIVE: list[str] = []


def use_callable(call: Callable[[str], str], name: str = "callable", model: str = "-", activate: bool = True) -> Provider:
    """Registers a provider and makes it the active one."""
    _PROVIDERS[name] = Provider(name, model, call)
    if activate:
        use(name)
    return _PROVIDERS[name]


def use(name: str) -> Provider:
    if name not in _PROVIDERS:
        raise ConfigError(f"unknown provider {name!r}")
    _ACTIVE[:] = [name]
    return _PROVIDERS[name]


def resolve_provider(provider: Provider | str | None = None) -> Provider:
    """The given one, or the one of that name, or the active one."""
    if isinstance(provider, Provider):
        return provider
    if provider is not None:
        if provider not in _PROVIDERS:
            raise ConfigError(f"unknown provider {provider!r}")
        return _PROVIDERS[provider]
    if not _ACTIVE:
        raise NotConfigured("no provider is active")
    return _PROVIDERS[_ACTIVE[0]]


def list_providers() -> list[str]:
    return sorted(_PROVIDERS)


def clear() -> None:
    _PROVIDERS.clear()
    _ACTIVE.clear()


def answers(provider: Provider, prompt: Column) -> Column:
    """struct<answer, error>: a failing call gives an error and no answer, and spares the other rows."""

    @F.pandas_udf("answer string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch:
                try:
                    rows.append((provider.call(p), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return ask(prompt)


def one_pass(docs: DataFrame, provider: Provider | str | None = None, text: str = "text", combined: str | None = None, force: bool = False, scene: str = "analysis", strength: str | None = None, candidates: int = 1) -> DataFrame:
    """docs with after, before_total, after_total, status.

    Texts that score low already stay (`publishable`) unless forced. Others are cleaned and rewritten
    `candidates` times; of the clean-up and the candidates the lowest rule score wins, the earliest of equals.
    A provider that fails leaves the clean-up (`cleaned`).
    """
    writer = resolve_provider(provider)
    ensure_checkpoint_dir(docs.sparkSession)
    names = docs.columns
    scored = rules.scored(docs, text).withColumnRenamed("total", "before_total")
    low = F.col("before_total") < RULE_LIMIT
    if combined is not None:
        low = low & (F.col(combined) < COMBINED_LIMIT)
    rows = scored.withColumn("_low", F.lit(False) if force else low).withColumn("_clean", protected(F.coalesce(F.col(text), F.lit(""))))
    prompt = prompts.rewrite_prompt(F.col("_clean"), F.col("violations"), scene, strength)
    # written once: both branches below read it, and no provider is asked twice
    rows = rows.select(*names, "before_total", "_low", "_clean", prompt.alias("_prompt")).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    out = rows.where("_low").select(*names, F.col(text).alias("after"), "before_total", F.col("before_total").alias("after_total"), F.lit("publishable").alias("status"))
    todo = rows.where("not _low")
    for k in range(candidates):
        todo = todo.withColumn(f"_a{k}", answers(writer, F.concat("_prompt", F.lit("\n" * k))))
    options = [F.struct(F.lit(0).alias("k"), F.col("_clean").alias("t"))] + [F.struct(F.lit(k + 1).alias("k"), F.col(f"_a{k}.answer").alias("t")) for k in range(candidates)]
    each = todo.select(F.struct(*names).alias("_row"), "before_total", "_id", F.explode(F.filter(F.array(*options), lambda o: F.coalesce(o["t"], F.lit("")) != "")).alias("o"))
    judged = rules.scored(each.select("_row", "before_total", "_id", F.col("o.k").alias("_k"), F.col("o.t").alias("_t")), "_t")
    best = judged.groupBy("_id").agg(F.min_by(F.struct("_row", "before_total", "_k", "_t", "total"), F.struct("total", "_k")).alias("b"))
    done = best.select("b._row.*", F.col("b._t").alias("after"), F.col("b.before_total").alias("before_total"), F.col("b.total").alias("after_total"), F.when(F.col("b._k") == 0, F.lit("cleaned")).otherwise(F.lit("rewritten")).alias("status"))
    return out.unionByName(done)


def review(docs: DataFrame, judge: Provider | str | None = None, writer: Provider | str | None = None, text: str = "text", allow_self: bool = False) -> DataFrame:
    """docs with review (struct result, parse_error, raw), review_error and review_report; never raises for a row.

    The judge may not be the writer unless allowed: then every row has the error that says so.
    """
    j = resolve_provider(judge)
    w = resolve_provider(writer) if writer is not None else None
    if w is not None and w.identity == j.identity and not allow_self:
        rows = docs.withColumn("_a", F.struct(F.lit(None).cast("string").alias("answer"), F.lit("the judge is the writer").alias("error")))
    else:
        rows = docs.withColumn("_a", answers(j, prompts.review_prompt(F.coalesce(F.col(text), F.lit("")))))
    parsed = prompts.parsed_answer(F.col("_a.answer"))
    rows = rows.withColumns({"review": parsed, "review_error": F.col("_a.error")}).drop("_a")
    meta = F.concat(F.lit(f"\n\n---\n*judge: {j.identity} | writer: {w.identity if w else None} | article: "), F.format_number(F.length(F.coalesce(F.col(text), F.lit(""))), 0), F.lit(" chars*"))
    failed = F.col("review_error").isNotNull() | F.col("review.parse_error").isNotNull()
    return rows.withColumn("review_report", F.concat(prompts.report(F.col("review"), F.col("review_error")), F.when(failed, F.lit("")).otherwise(meta)))


def iterate(docs: DataFrame, writer: Provider | str | None = None, judge: Provider | str | None = None, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, target: int = TARGET) -> DataFrame:
    """One row for each document and round: key, round, text, ai_score, verdict, tells, error, stopped.

    A document goes on until its score is at most target (`target`), its judge fails (`judge_failed`) or the
    rounds end (`exhausted`). Each round is checkpointed, so later rounds ask no provider again.
    """
    w, j = resolve_provider(writer), resolve_provider(judge)
    ensure_checkpoint_dir(docs.sparkSession)
    now = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    done: DataFrame | None = None
    for r in range(1, rounds + 1):
        scored = rules.scored(now)
        wrote = scored.select(key, "text", answers(w, prompts.rewrite_prompt(protected(F.col("text")), F.col("violations"))).alias("_w"))
        wrote = wrote.select(key, F.coalesce(F.nullif(F.col("_w.answer"), F.lit("")), F.col("text")).alias("text"), F.col("_w.error").alias("_we"))
        asked = wrote.withColumn("_j", answers(j, prompts.loop_prompt(F.col("text"))))
        parsed = prompts.parsed_answer(F.col("_j.answer"), prompts.LOOP)
        asked = asked.withColumn("_p", parsed).withColumn("ai_score", F.col("_p.result.ai_score"))
        failed = F.coalesce(F.col("_j.error"), F.col("_p.parse_error"), F.when(F.col("ai_score").isNull(), F.lit("no score")))
        stop = F.when(failed.isNotNull(), F.lit("judge_failed")).when(F.col("ai_score") <= target, F.lit("target")).when(F.lit(r == rounds), F.lit("exhausted"))
        step = asked.select(key, F.lit(r).alias("round"), "text", "ai_score", F.col("_p.result.verdict").alias("verdict"), F.col("_p.result.tells").alias("tells"), F.coalesce(failed, F.col("_we")).alias("error"), stop.alias("stopped")).checkpoint()
        done = step if done is None else done.unionByName(step)
        now = step.where("stopped is null").select(key, "text")
        if r < rounds and now.isEmpty():
            break
    return done
