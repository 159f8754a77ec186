"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL.

Texts become hashed counts of n-grams of lower-case letters (anything else is a blank). Document frequencies
come from all training texts; the weights are fitted on a bounded sample of labelled rows by
follow-the-regularised-leader with elastic-net penalties, and a temperature is fitted on a part held back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseplane.llm.common import packed_rows

UNKNOWN = "und"


@dataclass(frozen=True)
class Config:
    dims: int = 1 << 15
    orders: int = 3
    #: Bound of the labelled rows that weights are fitted on, shared evenly by the languages.
    sample_rows: int = 4_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    #: Part of the sample on which the temperature is fitted.
    calibration: float = 0.2


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    orders: int


_LETTERS: list[np.ndarray] = []


def _code_points(text: str) -> tuple[np.ndarray, bool]:
    """Lower-case letters with everything else as one blank each, and whether there is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _LETTERS[0][points]
    return np.where(letters, points, np.uint32(32)).astype(np.uint64), bool(letters.any())


def _counts(points: np.ndarray, dims: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of the hashed n-grams."""
    total = np.zeros(dims, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(points), 1 << 20):  # bounded memory for any length of text
            part = points[at : at + (1 << 20) + orders - 1]
            h = np.zeros(len(part), np.uint64)
            for n in range(orders):
                h = h[: len(part) - n] * np.uint64(0x9E3779B97F4A7C15) + part[n:] + np.uint64(n + 1)
                own = h[: (1 << 20)] if at + (1 << 20) < len(points) else h
                total += np.bincount(((own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    index = np.flatnonzero(total)
    return index, total[index]


def _weighted(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[index]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def document_frequencies(docs: DataFrame, text: str, config: Config) -> tuple[np.ndarray, int]:
    """Of every hashed n-gram over all rows of docs, and their number; tasks send sums, one row a dimension."""
    dims, orders = config.dims, config.orders

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                points, some = _code_points(t.as_py() or "")
                n += 1
                if some:
                    df[_counts(points, dims, orders)[0]] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["dim", "n"])

    rows = docs.select(text).mapInArrow(sums, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(dims)
    total = 0
    for dim, n in rows:
        if dim < 0:
            total = n
        else:
            df[dim] = n
    return df, total


def _sample(docs: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Distinct (t, y) by a hash of the text, the given share of each language's rows."""
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    u = (F.xxhash64("t", F.lit(17)) / F.lit(2.0**64)) + F.lit(0.5)
    return docs.where(u < F.element_at(share, F.col("y"))).distinct()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", config: Config = Config()) -> Model:
    """A model of the non-null languages of docs. Without labelled rows it knows no language.

    Equal texts of one language count once in the sample, which is drawn by hashes; null texts have no n-grams.
    """
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("y"))
    found = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(found))
    if not languages:
        return Model((), np.zeros(config.dims), np.zeros((config.dims, 0)), np.zeros(0), 1.0, config.orders)
    df, n = document_frequencies(docs, text, config)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = max(1, config.sample_rows // len(languages))
    rows = _sample(labelled, {k: min(1.0, each / c) for k, c in found.items()})
    dims, orders = config.dims, config.orders

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points, some = _code_points(t or "")
                if some:
                    index, counts = _counts(points, dims, orders)
                    out.append((y, index.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["y", "i", "c"])

    got = sorted(tuple(r) for r in rows.mapInArrow(vectors, "y string, i binary, c binary").collect())
    xs = [(np.frombuffer(bytes(i), np.int32), np.frombuffer(bytes(c), np.int32)) for _, i, c in got]
    xs = [(i, _weighted(i, c, idf)) for i, c in xs]
    ys = np.array([languages.index(y) for y, _, _ in got], np.int64)
    order = np.random.default_rng(5).permutation(len(ys))
    cut = int(len(ys) * (1 - config.calibration)) if len(ys) > 20 else len(ys)
    weights, bias = _ftrl(xs, ys, order[:cut], len(languages), config)
    held = order[cut:] if cut < len(ys) else order
    logits = np.array([x @ weights[i] + bias for i, x in (xs[j] for j in held)]).reshape(len(held), len(languages))
    return Model(languages, idf, weights.astype(np.float32), bias, temperature(logits, ys[held]), orders)


def _ftrl(xs: list, ys: np.ndarray, order: np.ndarray, k: int, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic-net penalties on every weight but the biases."""
    z, n = np.zeros((c.dims, k)), np.zeros((c.dims, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solve(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((c.beta + np.sqrt(n)) / c.alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(c.epochs):
        for j in rng.permutation(order):
            i, x = xs[j]
            w, b = solve(z[i], n[i], c.l1, c.l2), solve(zb, nb, 0.0, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[ys[j]] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / c.alpha * w
            n[i] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / c.alpha * b
            nb += p * p
    return solve(z, n, c.l1, c.l2), solve(zb, nb, 0.0, 0.0)


def temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature in [0.05, 20] of the least log loss, by golden section on its logarithm."""
    if not len(ys):
        return 1.0

    def loss(u: float) -> float:
        s = logits / math.exp(u)
        top = s.max(axis=1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(ys)), ys]))

    lo, hi, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def predict_one(model: Model, text: str | None) -> tuple[str, float]:
    """The likeliest language and its probability; (`und`, 0) without a letter or without languages."""
    if not text or not model.languages:
        return UNKNOWN, 0.0
    points, some = _code_points(text)
    if not some:
        return UNKNOWN, 0.0
    index, counts = _counts(points, len(model.idf), model.orders)
    s = (_weighted(index, counts, model.idf) @ model.weights[index] + model.bias) / model.temperature
    p = np.exp(s - s.max())
    best = int(p.argmax())
    return model.languages[best], float(p[best] / p.sum())


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) for each whole text; columns of these names are replaced.

    Null texts and texts without a letter get `und` and 0. Equal texts get equal results, repeated rows stay, no rows
    give no rows, texts are read whole. Of languages that are equally likely the first by code point is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [predict_one(shared.value, t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    found = packed_rows(docs, predict(F.col(text)).alias("_found"))
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return found.select(*own, F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))
