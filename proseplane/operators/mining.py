"""Words and phrases that one class of texts uses more than another, and statistics by class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseplane.functions import text as T
from proseplane.operators.lm import unigram_counts

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def word_ratios(target: DataFrame, other: DataFrame, text: str = "text", least: int = 200) -> DataFrame:
    """(token, target_count, other_count, target_pm, other_pm, ratio) of words with `least` hits in target.

    Rates are per million words of a class; the other's counts as 1 at least. Words of target alone have
    other_count 0; words of other alone don't appear.
    """
    t = unigram_counts(target, text).withColumnRenamed("cnt", "target_count")
    o = unigram_counts(other, text).withColumnRenamed("cnt", "other_count")
    total = lambda docs: max(docs.agg(F.sum(T.token_count(F.coalesce(F.col(text), F.lit(""))))).first()[0] or 0, 1)
    rows = t.where(F.col("target_count") >= least).join(o, "token", "left").withColumn("other_count", F.coalesce("other_count", F.lit(0)))
    pm = lambda c, n: F.col(c) * 1e6 / F.lit(n)
    rows = rows.withColumns({"target_pm": pm("target_count", total(target)), "other_pm": pm("other_count", total(other))})
    return rows.withColumn("ratio", F.col("target_pm") / F.greatest("other_pm", F.lit(1.0)))


def phrase_documents(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(phrase, df): in how many texts each n-gram of tokens occurs."""
    words = docs.select(T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    grams = F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " ")))
    rows = words.select(F.explode_outer(F.array_distinct(grams)).alias("phrase"))  # see rules.long_form
    return rows.where("phrase is not null").groupBy("phrase").agg(F.count("*").alias("df"))


def phrase_ratios(target: DataFrame, other: DataFrame, n: int, text: str = "text", least: int = 80) -> DataFrame:
    """(phrase, target_df, other_df, target_pct, other_pct, ratio) of n-grams in `least` texts of target.

    Percentages are of a class's non-empty texts; the other's counts as 0.05 at least.
    """
    t = phrase_documents(target, n, text).withColumnRenamed("df", "target_df").where(F.col("target_df") >= least)
    o = phrase_documents(other, n, text).withColumnRenamed("df", "other_df")
    size = lambda docs: max(docs.where(F.length(text) > 0).count(), 1)
    rows = t.join(o, "phrase", "left").withColumn("other_df", F.coalesce("other_df", F.lit(0)))
    pct = lambda c, k: F.col(c) * 100.0 / F.lit(k)
    rows = rows.withColumns({"target_pct": pct("target_df", size(target)), "other_pct": pct("other_df", size(other))})
    return rows.withColumn("ratio", F.col("target_pct") / F.greatest("other_pct", F.lit(0.05)))


def rhythm_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_cv, short_ratio and paragraph_cv; null under three sentences or paragraphs."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.transform(T.sentences(t), lambda s: T.token_count(s).cast("double")), lambda n: n > 0)
    lengths = F.transform(T.paragraphs(t), lambda p: F.length(p).cast("double"))
    docs = docs.withColumns({"_w": T.once(words), "_l": lengths})
    enough = F.size("_w") >= 3
    return docs.withColumns({
        "sentence_cv": F.when(enough, T.variation(F.col("_w"))),
        "short_ratio": F.when(enough, F.size(F.filter("_w", lambda n: n < 6)) / F.size("_w")),
        "paragraph_cv": F.when(F.size("_l") >= 3, T.variation(F.col("_l"))),
    }).drop("_w", "_l")


#: Parts of the line of values in which running sums are made; a task sees one part of it.
PARTS = 256


def running(rows: DataFrame, value: str, sums: list[str], by: list[str]) -> DataFrame:
    """rows with, for each name in sums, `<name>_before`: its sum over rows of the group with lesser values.

    The line is cut at approximate quantiles, windows run inside a part, and the parts' totals, a few hundred
    rows for each group, are added to them. So no task sees a whole group; the sums are exact for any cuts.
    Values are distinct within a group and not null.
    """
    cuts = rows.agg(F.percentile_approx(value, F.array(*[F.lit((i + 1) / PARTS) for i in range(PARTS - 1)]), F.lit(1000))).first()[0] or []
    cuts = sorted(set(cuts))
    rows = rows.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(value) > c)) if cuts else F.lit(0))
    line = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    parts = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{c}").over(parts), F.lit(0)).alias(f"_{c}") for c in sums])
    rows = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(line), F.lit(0)) for c in sums}).join(totals, [*by, "_part"])
    return rows.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in sums}).drop("_part", *[f"_{c}" for c in sums])


def percentiles(rows: DataFrame, by: str | list[str], value: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(by, n, p10, ...): the value at place int(p * n) of each class's sorted values, from 0; nulls left out.

    Values are counted first, so a class of any size costs one row for each distinct value. Places come from
    running counts over those. A null class is left out.
    """
    by = [by] if isinstance(by, str) else by
    counts = rows.dropna(subset=[*by, value]).groupBy(*by, value).agg(F.count("*").alias("c")).cache()
    sizes = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    counts = running(counts, value, ["c"], by).join(sizes, by)
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    picks = [F.min(F.when(F.col("c_before") + F.col("c") > place(p), F.col(value))).alias(f"p{round(p * 100)}") for p in at]
    return counts.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def first_by_hash(rows: DataFrame, label: str, key: str, limits: DataFrame, seed: str) -> DataFrame:
    """rows with `chosen`: of each label the `limit` first by md5 of key and seed; ties by key. limits: (label, limit).

    Rows are counted by the first four digits of the hash. The digits say of all rows but those of one group of
    65 536 whether they are in; only those are ranked, so a label of any size spreads over tasks.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))).withColumn("_d", F.substring("_h", 1, 4))
    counts = hashed.groupBy(F.col(label).alias("_l"), "_d").agg(F.count("*").alias("_c"))
    line = Window.partitionBy("_l").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(line), F.lit(0)))
    limits = limits.select(F.col(label).alias("_ll"), F.col("limit").alias("_limit"))
    counts = counts.join(limits, F.col("_l").eqNullSafe(F.col("_ll"))).select("_l", F.col("_d").alias("_dd"), "_c", (F.col("_limit") - F.col("_before")).alias("_left"))
    placed = hashed.join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_d") == F.col("_dd")))
    sure = placed.where((F.col("_left") >= F.col("_c")) | (F.col("_left") <= 0)).withColumn("chosen", F.col("_left") > 0)
    edge = placed.where((F.col("_left") < F.col("_c")) & (F.col("_left") > 0))
    edge = edge.withColumn("chosen", F.row_number().over(Window.partitionBy("_l").orderBy("_h", key)) <= F.col("_left"))
    return sure.unionByName(edge).drop("_h", "_d", "_l", "_dd", "_c", "_left")


def balanced_sample(rows: DataFrame, label: str, key: str, most: int, seed: str = "42") -> DataFrame:
    """As many rows of each label: of the rarest label's count and `most` the less, by md5 of key and seed."""
    sizes = rows.groupBy(label).count()
    least = sizes.agg(F.min("count")).first()[0] or 0
    return first_by_hash(rows, label, key, sizes.select(label, F.lit(min(least, most)).alias("limit")), seed).where("chosen").drop("chosen")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """rows with `train`: the first `share` of each label's rows by md5 of key and seed."""
    limits = rows.groupBy(label).count().select(label, F.floor(F.col("count") * F.lit(share)).alias("limit"))
    return first_by_hash(rows, label, key, limits, seed).withColumnRenamed("chosen", "train")


def standardised(rows: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """rows with each named column less its mean, over its population deviation (0: 1), and these figures."""
    got = rows.agg(*[F.avg(c).alias(f"{c}_m") for c in names], *[F.stddev_pop(c).alias(f"{c}_s") for c in names]).first()
    figures = {c: (got[f"{c}_m"] or 0.0, got[f"{c}_s"] or 1.0) for c in names}
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in figures.items()}), figures


def rank_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row (n_pos, n_neg, auc): the share of pairs in the right order, ties half; null without both classes.

    Equal scores meet first, so the running sums are over distinct scores, in parts.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("s"), (F.col(label) == 1).cast("long").alias("y"))
    each = running(known.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).cache(), "s", ["neg"], [])
    got = each.withColumn("won", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), F.sum("won").alias("won"))
    return got.select("n_pos", "n_neg", (F.col("won") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def logistic_sums(rows: DataFrame, names: list[str], label: str, weights: np.ndarray, figures: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The matrix X'WX and the gradient X'(y - p) at given weights (intercept first), from one pass over the rows.

    A task adds up the outer products of its rows and sends one number for each place; those meet by place, so the
    driver gets one small matrix however many rows and tasks there are. Rows with a null count for nothing.
    """
    means, spreads = (np.array([figures[c][k] for c in names], np.float64) for k in (0, 1))
    n = len(names) + 1

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n + 1))
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            x = np.column_stack([np.ones(batch.num_rows), *own[1:]])
            x[:, 1:] = (x[:, 1:] - means) / spreads
            p = 1 / (1 + np.exp(-(x @ weights)))
            total[:, :n] += (x * (p * (1 - p))[:, None]).T @ x
            total[:, n] += x.T @ (own[0] - p)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.reshape(-1))], names=["i", "j", "v"])

    known = rows.dropna(subset=[*names, label]).select(F.col(label).cast("double"), *[F.col(c).cast("double") for c in names])
    out = np.zeros((n, n + 1))
    for r in known.mapInArrow(added, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out[:, :n], out[:, n]


def train_logistic(rows: DataFrame, names: list[str], label: str, c: float = 1.0, steps: int = 25, close: float = 1e-10):
    """Standardises, fits an L2 logistic model of strength c, and returns (calibration, intercept) for probability().

    Iteratively reweighted least squares: each step is one pass over the rows and one small solve on the driver,
    until no weight moves by more than `close`. The intercept is not held back; rows with nulls are left out. Labels
    that are all alike, and an empty table, end after `steps` with what they have come to.
    """
    known = rows.dropna(subset=[*names, label])
    got = known.agg(*[F.avg(n).alias(f"{n}_m") for n in names], *[F.stddev_pop(n).alias(f"{n}_s") for n in names]).first()
    spread = lambda m, s: s if s and s > 1e-12 * max(abs(m), 1.0) else 1.0  # noqa: E731 - a constant's deviation may be a rounding error
    figures = {n: (got[f"{n}_m"] or 0.0, spread(got[f"{n}_m"] or 0.0, got[f"{n}_s"])) for n in names}
    held = np.diag([0.0] + [1.0 / c] * len(names))
    weights = np.zeros(len(names) + 1)
    for _ in range(steps):
        h, g = logistic_sums(known, names, label, weights, figures)
        move = np.linalg.lstsq(h + held, g - held @ weights, rcond=None)[0]
        weights = weights + move
        if np.abs(move).max(initial=0) <= close:
            break
    return tuple((name, *figures[name], float(w)) for name, w in zip(names, weights[1:], strict=True)), float(weights[0])
