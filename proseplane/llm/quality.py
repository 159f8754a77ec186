"""Quality classifier as a sparse ensemble of rules (RuleFit: Friedman and Popescu, 2008).

Statistics of a text are Spark column expressions. Boosted shallow trees are grown on a bounded sample of
labelled rows; every path from a root to a node becomes a conjunctive rule over statistics; a lasso
logistic regression keeps few of the rules; those become one Spark column expression again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.llm.common import drawn, words_of


@dataclass(frozen=True)
class Config:
    #: Bound of the labelled rows that trees and weights are fitted on.
    sample_rows: int = 12_000
    trees: int = 30
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    least_rows: int = 20
    l1: float = 0.002
    iterations: int = 400


@dataclass(frozen=True)
class Rule:
    """True where every condition holds: (statistic, is it at most, threshold)."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float


#: Names of the statistics, all shares of a text's words or characters but the first two.
STATISTICS = ("log_words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "marked_ends", "repeats", "capital_words", "stops", "short_words", "distinct")

#: What is counted in a text, each by one pass of an expression that does not go back.
_COUNTS = {
    "upper": r"\p{Lu}",
    "digits": r"\d",
    "symbols": r"[$%&*#@^~<>{}=_+\\/\[\]-]",
    "bangs": r"!",
    "bars": r"\|",
    "marked_ends": r"[^\p{L}\p{N}\s.,;:?'\")][^\p{L}\p{N}\s](?!\S)",
    "repeats": r"(?<!\S)(\S++)(?=\s++\1(?!\S))",
    "capital_words": r"\p{Lu}\p{Lu}++",
    "stops": r"[.?!…](?!\S)",
    "short_words": r"(?<!\S)\S{1,3}+(?!\S)",
}


def statistics(text: str) -> Column:
    """An array of doubles, one for each name in STATISTICS; 0 for null and empty texts, never null.

    The counts are bound by a lambda, so that they are made once wherever the optimiser moves the expression.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counts = [F.regexp_count(t, F.lit(p)).cast("double").alias(k) for k, p in _COUNTS.items()]
    bare = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]++", "")).cast("double").alias("bare")
    pieces = F.size(F.array_distinct(F.split(t, " "))).cast("double").alias("distinct")

    def shares(c: Column) -> Column:
        n, words = F.greatest(c["n"], F.lit(1.0)), F.greatest(c["words"], F.lit(1.0))
        of = {"upper": n, "digits": n, "symbols": n, "bangs": n}
        return F.array(F.log1p(c["words"]), c["bare"] / words, *[c[k] / of.get(k, words) for k in _COUNTS], c["distinct"] / words)

    once = F.struct(F.length(t).cast("double").alias("n"), words_of(t).cast("double").alias("words"), bare, pieces, *counts)
    return F.element_at(F.transform(F.array(once), shares), 1)


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple, config: Config, rules: list, out: np.ndarray) -> None:
    """Adds the node's path to rules and its value to out, and splits it while that gains."""
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    out[rows] = value
    if path:
        rules.append(path)
    if len(path) >= config.depth or len(rows) < 2 * config.least_rows:
        return
    best = (1e-6, -1, -1)
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        code = x[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(code, v, len(c) + 1))[:-1] for v in (g[rows], h[rows], None))
        gt, ht = g[rows].sum(), h[rows].sum()
        gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - base
        gain[(ns < config.least_rows) | (len(rows) - ns < config.least_rows)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    _, f, k = best
    if f < 0:
        return
    low = x[rows, f] <= k
    _grow(x, cuts, g, h, rows[low], (*path, (f, True, float(cuts[f][k]))), config, rules, out)
    _grow(x, cuts, g, h, rows[~low], (*path, (f, False, float(cuts[f][k]))), config, rules, out)


def _holds(x: np.ndarray, conditions: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, most, c in conditions:
        out &= (x[:, f] <= c) if most else (x[:, f] > c)
    return out


def learn(x: np.ndarray, y: np.ndarray, config: Config) -> Model:
    """Rules for rows of statistics x with labels y (0 or 1)."""
    if not len(y) or y.min() == y.max():
        return Model((), 4.0 if not len(y) or y[0] else -4.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, config.bins + 1)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    s = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: list[tuple] = []
    rng = np.random.default_rng(3)
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-s))
        out = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        _grow(codes, cuts, p - y, p * (1 - p), rows, (), config, paths, out)
        s += config.rate * out
    found: dict[bytes, tuple] = {}
    for path in dict.fromkeys(paths):
        own = _holds(x, path)
        if 0 < own.sum() < len(y):
            found.setdefault(np.packbits(own).tobytes(), path)
    rules = list(found.values())
    z = np.stack([_holds(x, r) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    w, b = lasso(z, y, config)
    return Model(tuple(Rule(r, float(v)) for r, v in zip(rules, w, strict=True) if v), b)


def lasso(z: np.ndarray, y: np.ndarray, config: Config) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute penalty on all weights but the bias, by accelerated proximal steps."""
    n, k = z.shape
    mean = z.mean(axis=0) if k else np.zeros(0)
    zc = z - mean
    step = 4.0 / max(float(np.linalg.norm(zc, 2) ** 2) / n if k else 0.0, 1.0)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w, b, 1.0
    for _ in range(config.iterations):
        r = 1 / (1 + np.exp(-np.clip(zc @ vw + vb, -30, 30))) - y
        nw = vw - step * (zc.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * config.l1, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b - mean @ w)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", config: Config = Config()) -> Model:
    """From docs joined with labels; null ids and labels are left out. Without both classes it is a constant.

    Equal texts with equal labels count once; the sample is drawn by hashes, so every run fits the same model.
    """
    labels = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_k"), F.col(label).cast("int").alias("_y"))
    chosen = drawn(labels.distinct(), "_k", config.sample_rows, 29)
    known = docs.select(F.col(doc_id).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k")  # about config.sample_rows ids
    rows = drawn(known, "_t", config.sample_rows, 29).select("_y", "_t").distinct()
    data = np.array(sorted((r[0], *r[1]) for r in rows.select("_y", statistics("_t")).collect()), np.float64).reshape(-1, len(STATISTICS) + 1)
    return learn(data[:, 1:], data[:, 0], config)


def compiled(model: Model, text: str) -> Column:
    """The model's probability of label 1 as one column expression over a text column."""
    def total(s: Column) -> Column:
        z = F.lit(model.bias)
        for rule in model.rules:
            holds = None
            for f, most, c in rule.conditions:
                x = F.element_at(s, f + 1)
                one = (x <= F.lit(c)) if most else (x > F.lit(c))
                holds = one if holds is None else holds & one
            z = z + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    return F.element_at(F.transform(F.array(statistics(text)), total), 1)  # the statistics are computed once


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability that each whole text is of quality; a column of that name is replaced.

    Null texts score as empty ones, equal texts alike, repeated rows stay, no rows give no rows. Texts are read whole,
    in time proportional to their length. A score just at a threshold is for the caller to place (op3_quality: of quality).
    """
    return docs.withColumn(into, compiled(model, text))
