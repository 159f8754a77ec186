"""Resampling documents towards the distribution of a target by importance weights (Xie et al., 2023).

Features are runs of words, hashed into buckets. Each task maps the distinct words that it meets to integers and
writes a document as those; a run is a tuple of integers. Of each distinct tuple the bytes are put together and hashed
once, and the counts of the tuples are joined back to the buckets, or the gains of the buckets to the documents.
A task's dictionary is bounded and starts anew when it is full, so nothing of the words is shuffled: only bucket
counts are, and for the draw ids and scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseplane.llm.common import cut, slices

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
#: Documents of fewer words are not drawn; of the others such a part.
LEAST_WORDS = 20
DRAWN = (10, 100)
#: Distinct words in a task's dictionary before it starts anew, some 150 bytes each.
KNOWN_WORDS = 1 << 19
#: Scores in one part of the line along which drawn documents are counted.
PART = 512
#: Lower case for A-Z; every other ASCII character but digits and a-z separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Words(dict):
    """Integers of distinct words, and the words by integer."""

    def __init__(self) -> None:
        self.of: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.of)
        self.of.append(word)
        return n


class Encoder:
    """Bucket numbers of the features of texts."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS) -> None:
        self.longest, self.buckets = longest, buckets
        self.words, self.single = Words(), np.zeros(0, np.int64)

    def _hashed(self, tuples: Iterator[tuple[int, ...]]) -> np.ndarray:
        of = self.words.of
        return np.array([zlib.crc32(b" ".join([of[i] for i in t])) % self.buckets for t in tuples], np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of words by text, and of all features their texts and buckets."""
        if len(self.words) > KNOWN_WORDS:
            self.words, self.single = Words(), np.zeros(0, np.int64)
        own = [t.as_buffer().to_pybytes().translate(_NORMAL).split() if t.is_valid else [] for t in texts.cast(pa.large_binary())]
        sizes = np.array([len(w) for w in own], np.int64)
        ids = np.fromiter((self.words[w] for ws in own for w in ws), np.int64, int(sizes.sum()))
        new = range(len(self.single), len(self.words))
        self.single = np.append(self.single, self._hashed((i,) for i in new))  # a word is hashed when it gets its integer
        row = np.repeat(np.arange(len(sizes)), sizes)
        rows, found = [row], [self.single[ids]]
        for n in range(2, self.longest + 1):
            inside = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
            runs = np.stack([ids[inside + k] for k in range(n)], axis=1)
            distinct, back = np.unique(runs, axis=0, return_inverse=True)
            rows.append(row[inside])
            found.append(self._hashed(map(tuple, distinct.tolist()))[back.reshape(-1)])
        return sizes, np.concatenate(rows), np.concatenate(found)


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket; a task sends one row for each bucket that it meets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = Encoder(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                n += np.bincount(encoder(part)[2], minlength=buckets)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(n[met], pa.int64())], names=["bucket", "n"])

    got = docs.select(F.col(text).cast("string")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


@dataclass(frozen=True)
class Model:
    #: Of each bucket floor(1000 * ln(share in the target / share in the documents)), both shares add-one smoothed.
    gains: tuple[int, ...]
    longest: int
    seed: int


def gains_of(own: np.ndarray, target: np.ndarray) -> tuple[int, ...]:
    b, s_all, t_all = len(own), int(own.sum()), int(target.sum())
    return tuple(math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(own.tolist(), target.tolist(), strict=True))


def fit(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> Model:
    """From the texts of all of docs and all of target; null texts have no features, repeated rows count again.

    Empty tables give equal gains, ties of which the seed decides.
    """
    return Model(gains_of(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets)), longest, seed)


_WEIGHED = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def weigh(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", into: str = "resampling") -> DataFrame:
    """docs with the struct `into`: n_words, n_features, weight, score of each row; narrow, whole texts.

    weight is the mean gain of a document's features, rounded down (0 without any); score adds Gumbel noise drawn by
    a hash of seed and id, so that the highest scores are a sample without replacement by weight. A null id counts
    as the empty text; rows with one id and one text have one score. A column `into` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.array(model.gains, np.int64))  # 8 bytes a bucket
    longest, buckets = model.longest, len(model.gains)

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(longest, buckets)
        for texts in batches:
            out = []
            for part in slices(texts):
                sizes, rows, found = encoder(part)
                n = np.bincount(rows, minlength=len(part)).astype(np.int64)
                total = np.bincount(rows, shared.value[found], len(part)).astype(np.int64)  # whole numbers below 2 ** 53
                out.append(np.stack([sizes, n, total // np.maximum(n, 1)]))
            n_words, n, weight = np.concatenate([np.zeros((3, 0), np.int64), *out], axis=1)
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n_words, n, weight)], fields=list(_WEIGHED))

    named = F.concat(F.lit(f"{model.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    w = F.col("_w")
    scored = docs.withColumns({"_w": weights(F.col(text).cast("string")), "_noise": noise})
    return scored.withColumn(into, F.struct(w["n_words"].alias("n_words"), w["n_features"].alias("n_features"), w["weight"].alias("weight"), (w["weight"] + F.col("_noise")).alias("score"))).drop("_w", "_noise")


def drawn_classes(scored: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = DRAWN) -> DataFrame:
    """Classes of equal rows of `scored` (doc_id, n_words, n_features, weight, score) with m, their number, and `first`.

    first is the rank of the first of them by falling score, ties to smaller ids; null where none of them is drawn.
    The number of rows by score gives the score at which the draw ends and the ranks at which scores begin: scores are
    thousandths of a logarithm, some 10^5 distinct numbers at most however many rows there are, counted in parts.
    Of one score only the drawn rows are sorted, less than one in 2 500 of all even where all weights are equal,
    and equal rows are one before that, so a hot id is no hot group.
    """
    key = ["doc_id", "n_words", "n_features", "weight", "score"]
    classes = cut(scored.groupBy(*key).agg(F.count("*").alias("m")))
    able = F.col("n_words") >= least_words
    by_score = classes.where(able).groupBy("score").agg(F.sum("m").alias("n")).withColumn("part", F.floor(F.col("score") / PART))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = by_score.groupBy("part").agg(F.sum("n").alias("n")).withColumn("above", before(Window.orderBy(F.col("part").desc()))).select("part", "above", F.col("n").alias("in_part"))
    base = by_score.join(F.broadcast(parts), "part").withColumn("base", F.col("above") + before(Window.partitionBy("part").orderBy(F.col("score").desc())))
    base = cut(base.select(F.col("score").alias("s"), "base", "above", "in_part", "part"))
    total = base.agg(F.max(F.col("above") + F.col("in_part"))).first()[0] or 0
    wanted = total * share[0] // share[1]
    base = base.where(F.col("base") < wanted)
    edge = base.agg(F.min("s")).first()[0]
    taken = able & (F.col("score") >= F.lit(edge)) if edge is not None else F.lit(False)
    ranks = classes.where(taken).join(F.broadcast(base.select("s", "base")), F.col("score") == F.col("s"))  # 10^5 rows of 16 bytes at most
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("m").over(inside), F.lit(0)) + 1
    ranked = ranks.withColumn("first", first).withColumn("first", F.when(F.col("first") <= wanted, F.col("first"))).withColumn("last", F.lit(wanted).cast("long"))
    rest = classes.where(~taken).withColumns({"first": F.lit(None).cast("long"), "last": F.lit(wanted).cast("long")})
    return ranked.select(*key, "m", "first", "last").unionByName(rest)


def ranked(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, share: tuple[int, int] = DRAWN) -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_features, weight, score, rank (1, 2, ... as drawn; else null).

    Of rows with equal id and score the last places of the draw go to any of them. No rows give no rows.
    """
    scored = weigh(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), model, text="_t")
    classes = drawn_classes(scored.select("doc_id", "resampling.*"), least_words, share)
    block = 4096  # no array longer than this, however often a row repeats
    rows = classes.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / block).cast("long"))))
    rows = rows.withColumn("r", F.explode(F.sequence(F.col("b") * block, F.least((F.col("b") + 1) * block, F.col("m")) - 1)))
    rank: Column = F.col("first") + F.col("r")
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= F.col("last"), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, share: tuple[int, int] = DRAWN, **options) -> DataFrame:
    """The drawn rows of docs, whole and with their columns: the highest scores of those with enough words.

    Rows that share id, text and so the score of the last place are drawn together, which can be more than asked for;
    all others are as `ranked` draws them. Texts stay where they are read: only the draw's last score and id go to them.
    """
    model = fit(docs, target, text, **options)
    scored = weigh(docs, model, doc_id, text, "_resampling")
    r = F.col("_resampling")
    classes = drawn_classes(scored.select(F.col(doc_id).alias("doc_id"), "_resampling.*"), least_words, share)
    last = classes.where("first is not null").orderBy("score", F.col("doc_id").desc_nulls_first()).select("score", "doc_id").first()
    if last is None:
        return docs.where("false")
    same = (r["score"] == last["score"]) & (F.col(doc_id).isNotNull() if last["doc_id"] is not None else F.lit(True)) & F.coalesce(F.col(doc_id) <= F.lit(last["doc_id"]), F.lit(True))
    return scored.where((r["n_words"] >= least_words) & ((r["score"] > last["score"]) | same)).drop("_resampling")
