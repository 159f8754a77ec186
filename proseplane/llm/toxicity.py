"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017) in numpy.

The positives are confirmed toxic texts, the rest is a sample of all texts, toxic ones among them. The risk
prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)]) of a linear classifier on words and word
beginnings (their presence and their share of the text's words) is minimised by Adam; where the bracket is
negative its gradient is turned back. The prior is the share of toxic texts among all, which labels don't tell,
for who labels may look for toxic texts first. It is estimated from scores of texts that a classifier was not
fitted on: no share of the unlabelled texts above a score can be less than the prior times that of the positives
(the best bin estimate of Garg et al., 2021).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseplane.llm.common import drawn

#: Of texts with so many features or more that share their so many least ones, such as share COPY of all count once.
SKETCH_FROM, SKETCH, COPY = 64, 3, 0.8
#: A feature that a text has twice or more is told apart by shares of the text's words of 1 in so many.
SHARES = (256, 128, 64)
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Config:
    dims: int = 1 << 20
    #: Lengths of word beginnings that are features besides whole words.
    heads: tuple[int, ...] = (4, 5, 6)
    #: Bounds of the confirmed toxic texts and of the unlabelled texts that weights are fitted on.
    positives: int = 4_000
    unlabelled: int = 8_000
    #: A feature is kept if positives have it at so many times the rate of the unlabelled, and if chance gives so
    #: many hits among them with a probability of e to the minus `evidence` at most (Chernoff's bound).
    least_lift: float = 3.0
    evidence: float = 10.0
    #: Parts into which the sample is dealt to estimate the prior, and the prior for that.
    folds: int = 3
    first_prior: float = 0.1
    #: Least share of the positives above a score that the estimate looks at, and how many positives weigh as much
    #: as the first prior, which few of them can't correct.
    least_bin: float = 0.2
    few: int = 30
    steps: int = 600
    rate: float = 0.05
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float
    prior: float
    dims: int
    heads: tuple[int, ...]


def _hash(s: str, dims: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 7) % dims


def _of_word(word: str, dims: int, heads: tuple[int, ...]) -> tuple[int, ...]:
    return (_hash(f"={word}", dims), *(_hash(f"{n}{word[:n]}", dims) for n in heads if len(word) > n))


def _share(f, k: int, dims: int):
    return (f * 0x9E3779B1 + k * 0x85EBCA6B) % dims


def _with_shares(counts: dict[int, int], words: int, dims: int) -> set[int]:
    """Features and, where they come twice or more, the steps of their share of the words that they reach."""
    out = set(counts)
    for f, n in counts.items():
        if n > 1:
            for k, share in enumerate(SHARES, 1):
                if n * share < words:
                    break
                out.add(_share(f, k, dims))
    return out


def features(text: str | None, dims: int, heads: tuple[int, ...]) -> set[int]:
    words = Counter(_WORDS.findall((text or "").lower()))
    counts: Counter[int] = Counter()
    for w, n in words.items():
        for f in _of_word(w, dims, heads):
            counts[f] += n
    return _with_shares(counts, words.total(), dims)


def nonnegative_pu(pos: list[np.ndarray], unl: list[np.ndarray], dims: int, prior: float, config: Config) -> tuple[np.ndarray, float]:
    """Weights and bias for rows of feature numbers below dims."""

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (pi, pr), (ui, ur) = flat(pos), flat(unl)
    w, b = np.zeros(dims), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    sig = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    for step in range(1, config.steps + 1):
        sp = np.bincount(pr, w[pi], len(pos)) + b
        su = np.bincount(ur, w[ui], len(unl)) + b
        up, un = sig(sp), sig(su)  # the gradient of log(1 + e^s), the loss of calling a text clean
        clean = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        gp = -prior * (1 - up) / len(pos)
        back = -1.0 if clean < 0 else 1.0
        gp = (gp if back > 0 else 0) - back * prior * up / len(pos)
        gu = back * un / len(unl)
        g = np.append(np.bincount(pi, gp[pr], dims) + np.bincount(ui, gu[ur], dims) + config.l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _collected(rows: DataFrame, text: str, dims: int, heads: tuple[int, ...]) -> list[np.ndarray]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(sorted(features(t.as_py(), dims, heads)), np.int32).tobytes() for t in batch.column(1)], pa.binary())], names=["h", "f"])

    hashed = rows.select(F.xxhash64(text).alias("h"), text).distinct()
    return distinct(np.frombuffer(f, np.int32) for _, f in sorted((r[0], bytes(r[1])) for r in hashed.mapInArrow(sets, "h long, f binary").collect()))  # the bounded sample


def distinct(rows: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Sorted feature sets of distinct texts, without the near copies of long ones."""
    got: dict[tuple, list[np.ndarray]] = {}
    out: list[np.ndarray] = []
    for x in rows:
        if len(x) >= SKETCH_FROM:
            known = got.setdefault(tuple(x[:SKETCH]), [])

            def same(y: np.ndarray, x: np.ndarray = x) -> bool:
                both = len(np.intersect1d(x, y, assume_unique=True))
                return both >= COPY * (len(x) + len(y) - both)

            if any(map(same, known)):
                continue
            known.append(x)
        out.append(x)
    return out


def kept_features(pos: list[np.ndarray], unl: list[np.ndarray], config: Config) -> np.ndarray:
    in_pos = np.bincount(np.concatenate([*pos, np.zeros(0, np.int32)]), minlength=config.dims)
    in_unl = np.bincount(np.concatenate([*unl, np.zeros(0, np.int32)]), minlength=config.dims)
    chance = len(pos) * (in_unl + 1) / (len(unl) + 1)
    proof = in_pos * np.log(np.maximum(in_pos, 1e-9) / chance) - in_pos + chance
    return np.flatnonzero((in_pos >= config.least_lift * chance) & (proof >= config.evidence))


def learn(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, config: Config) -> tuple[dict[int, float], float]:
    """Weights by feature, and the bias."""
    keep = kept_features(pos, unl, config)
    number = np.full(config.dims, -1)
    number[keep] = np.arange(len(keep))
    chosen_rows = lambda rows: [x[x >= 0] for x in (number[r] for r in rows)]
    w, b = nonnegative_pu(chosen_rows(pos), chosen_rows(unl or [np.zeros(0, np.int32)]), len(keep), prior, config)
    return {int(f): float(x) for f, x in zip(keep, w, strict=True) if abs(x) > 1e-3}, b


def estimated_prior(pos: list[np.ndarray], unl: list[np.ndarray], config: Config) -> float:
    """The share of positives among the unlabelled, from scores of rows that the classifier was not fitted on."""
    scores: tuple[list[float], list[float]] = ([], [])
    for k in range(config.folds):
        rest = lambda rows: [x for i, x in enumerate(rows) if i % config.folds != k]  # noqa: E731, B023
        weights, _ = learn(rest(pos), rest(unl), config.first_prior, config) if len(pos) > 1 else ({}, 0.0)
        for rows, out in zip((pos, unl), scores, strict=True):
            out += [sum(weights.get(int(f), 0.0) for f in x) for x in rows[k :: config.folds]]
    p, u = np.sort(scores[0]), np.sort(scores[1])
    best = 1.0
    for t in np.unique(p):
        above = (len(p) - np.searchsorted(p, t)) / len(p)
        if above >= config.least_bin:
            best = min(best, (len(u) - np.searchsorted(u, t) + 1) / (len(u) + 1) / above)
    shrunk = (len(p) * best + config.few * config.first_prior) / (len(p) + config.few)
    return float(min(max(shrunk, 1e-3), 0.95))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", config: Config = Config()) -> Model:
    """From rows of docs and labels (by doc_id); rows with label 1 are the positives, all of docs the rest.

    Null ids and labels are left out; other labels tell nothing. Repeated and equal texts count once. Without
    positives, or with empty tables, every score is 0 or near it. Samples are drawn by hashes of ids and texts, so rows
    never tie for a place. Texts of SKETCH_FROM features and more that are near copies count once; shorter ones all count,
    as one word more or less is much of them. A text sends its distinct
    features, of which there are config.dims at most, however long it is.
    """
    chosen = drawn(labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_k")).distinct(), "_k", config.positives)
    known = docs.select(F.col(doc_id).alias("_k"), F.col(text).alias("_t"))
    confirmed = known.join(F.broadcast(chosen), "_k")  # about config.positives ids
    pos = _collected(drawn(confirmed, "_t", config.positives), "_t", config.dims, config.heads)
    if not pos:
        return Model({}, -20.0, 1e-3, config.dims, config.heads)
    unl = _collected(drawn(known, "_t", config.unlabelled), "_t", config.dims, config.heads)
    prior = estimated_prior(pos, unl, config)
    weights, b = learn(pos, unl, prior, config)
    return Model(weights, b, prior, config.dims, config.heads)


class Scorer:
    """Of texts by one model; keeps the weights of the words seen lately."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache: dict[str, tuple[int, ...]] = {}
        weighted = np.zeros(model.dims, bool)
        weighted[list(model.weights)] = True
        every = np.arange(model.dims, dtype=np.int64)
        weighted |= np.logical_or.reduce([weighted[_share(every, k, model.dims)] for k in range(1, len(SHARES) + 1)])
        self.wanted = frozenset(np.flatnonzero(weighted).tolist())  # features that weigh, or some share of which does

    def __call__(self, text: str | None) -> float:
        model, cache = self.model, self.cache
        words = Counter(_WORDS.findall((text or "").lower()))
        counts: Counter[int] = Counter()
        for w, n in words.items():
            known = cache.get(w)
            if known is None:
                if len(cache) > 200_000:
                    cache.clear()
                known = cache[w] = tuple(f for f in _of_word(w, model.dims, model.heads) if f in self.wanted)
            for f in known:
                counts[f] += n
        hit = _with_shares(counts, words.total(), model.dims)
        s = model.bias + sum(model.weights.get(f, 0.0) for f in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability that each whole text is toxic; null and empty texts get the bias's.

    Equal texts get equal scores, repeated rows stay, no rows give no rows; a column `into` of docs is replaced. A very
    long text takes memory for its distinct words. Who compares with a threshold has to say where a score just at it
    belongs; op2_toxicity counts it as toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array([scorer(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(into, scores(F.col(text)))
