"""Word bigram tables with add-one smoothing: training, top-k trimming and log-probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseplane.functions import text as T
from proseplane.functions.batches import of_texts
from proseplane.functions.segments import segmented

#: Rows that are kept of each table; so joins can broadcast them (some 40 MB at most).
UNIGRAMS = 100_000
BIGRAMS = 500_000
#: Tables of so many rows together at most are sent to the workers (16 bytes a row); larger ones are joined.
PACKED_ROWS = 2_000_000
#: Bytes of text whose pairs a worker adds up at a time.
PAIRED_BYTES = 4_000_000
#: Distinct pairs, about, that a worker holds before it sends them on.
HELD_PAIRS = 2_000_000
#: Rows of one count that one task ranks, where prefixes can tell more of them apart.
RANKED = 100_000


def unigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, cnt) over all texts."""
    rows = docs.select(F.explode_outer(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))  # see rules.long_form
    return rows.where("token is not null").groupBy("token").agg(F.count("*").alias("cnt"))


def pairs(words: Column) -> Column:
    """Array of (w1, w2) of words next to each other."""
    n = F.size(words)
    return F.when(n >= 2, F.transform(F.slice(words, 1, n - 1), lambda w, i: F.struct(w.alias("w1"), F.get(words, i + 1).alias("w2"))))


def bigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w1, w2, cnt) over all texts; pairs don't cross texts."""
    words = docs.select(T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rows = words.select(F.explode_outer(pairs(F.col("t"))).alias("p")).where("p is not null")
    return rows.groupBy("p.w1", "p.w2").agg(F.count("*").alias("cnt"))


def _added(parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of parts (words, w1, w2, n) as one part; w1 and w2 are places in the words, one behind the last for none."""
    coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    known, places = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    v, ends = len(known), np.cumsum([len(p[0]) for p in parts])
    own = [np.append(places[end - len(p[0]) : end], v) for p, end in zip(parts, ends, strict=True)]
    keys = np.concatenate([at[p[1]] * v + at[p[2]] for p, at in zip(parts, own, strict=True)])
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate([p[3] for p in parts])[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    w1, w2 = np.divmod(keys[first], max(v, 1))
    return known, w1, w2, np.add.reduceat(counts, first) if len(first) else counts


def _dealt(part: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray], groups: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of a part by a hash of both words, each group with the words that it holds."""
    known, w1, w2, n = part
    h = np.append(hashes(known), np.uint64(0))
    of = (_mixed(h[w1], h[w2]) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(ends)):
        rows = order[ends[g] : ends[g + 1]]
        words = np.unique(np.append(w2[rows], w1[rows][w1[rows] < len(known)]))
        place = lambda w: np.searchsorted(words, w)  # noqa: E731 - none stays behind the last
        yield int(g), known.take(pa.array(words)), place(w1[rows]), place(w2[rows]), n[rows]


def pair_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w1, w2, cnt) over all texts with null before a text's first word: the counts of words too, in one scan.

    A worker adds up pairs until it holds HELD_PAIRS distinct ones. They are shuffled by a hash of both words, as many
    groups as there are shuffle partitions; a row is what a worker has for a group: the words once, and arrays of places
    and counts. So the shuffle's rows go by tasks and not by pairs.
    """
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sent() -> Iterator[pa.RecordBatch]:
            for g, known, w1, w2, n in _dealt(_added(held), groups):
                words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), "\n")
                places = [pa.array([w.astype(np.int32).tobytes()], pa.binary()) for w in (w1, w2)]
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), words, *places, pa.array([n.astype(np.int64).tobytes()], pa.binary())], names=["g", "words", "w1", "w2", "n"])

        for batch in batches:
            for part in of_texts(batch.column(0), PAIRED_BYTES):
                parts = segmented(part)
                v = len(parts.known)
                first = np.append(True, parts.text_of[1:] != parts.text_of[:-1])[: len(parts.words)]
                before = np.where(first, v, np.append(v, parts.words[:-1])[: len(parts.words)])
                held.append(_added([(parts.known, before, parts.words, np.ones(len(before), np.int64))]))
                if len(held) > 1 and sum(len(p[1]) for p in held) > HELD_PAIRS:
                    held = [_added(held)]
                    if len(held[0][1]) > HELD_PAIRS // 2:
                        yield from sent()
                        held = []
        if held:
            yield from sent()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        more = 0
        for batch in batches:
            words = pc.split_pattern(batch.column("words"), "\n")
            for i in range(batch.num_rows):
                w1, w2 = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32).astype(np.int64) for c in ("w1", "w2"))
                held.append((words[i].values, w1, w2, np.frombuffer(batch.column("n")[i].as_buffer(), np.int64)))
                more += len(w1)
                if more > max(HELD_PAIRS, 2 * len(held[0][1])):
                    held, more = [_added(held)], 0
        if held:
            known, w1, w2, n = _added(held)
            most = HELD_PAIRS // 4 + 1
            for at in range(0, len(n), most):
                a, b, c = (x[at : at + most] for x in (w1, w2, n))
                yield pa.RecordBatch.from_arrays([known.take(pa.array(a, mask=a == len(known))), known.take(pa.array(b)), pa.array(c)], names=["w1", "w2", "cnt"])

    rows = docs.select(F.col(text)).mapInArrow(counted, "g int, words string, w1 binary, w2 binary, n binary")
    return rows.repartitionById(groups, "g").mapInArrow(met, "w1 string, w2 string, cnt long")


def first_rows(rows: DataFrame, order: list[str], k: int, n: int) -> DataFrame:
    """The first k of n rows by order, null first.

    A task ranks RANKED rows, or those that a prefix of four characters of the last column leaves: rows are counted by
    prefixes, ever longer ones, and only those of the prefix at the edge stay open.
    """
    sure, here = F.lit(False), F.lit(True)
    levels = [(c, size) for c in order for size in (2, 4, None)][:-1]
    line = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each prefix
    for c, size in levels:
        if n <= RANKED:
            break
        prefix = F.coalesce(F.col(c) if size is None else F.substring(c, 1, size), F.lit(""))
        counts = rows.where(here).groupBy(prefix.alias("_p")).agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(line), F.lit(0)))
        edge = counts.where(F.col("_above") < k).agg(F.max("_p"), F.max("_above"), F.max_by("_n", "_p")).first()
        sure, here = sure | here & (prefix < edge[0]), here & (prefix == edge[0])
        k, n = k - edge[1], edge[2]
        if not edge[0]:  # null and empty, which the columns that follow don't order
            break
    return rows.where(sure).unionByName(rows.where(here).orderBy(*order).limit(k))


def top(counts: DataFrame, k: int, order: list[str], hold: bool = True) -> DataFrame:
    """The k rows of the highest cnt, equal ones by order.

    A histogram of counts gives the least count that stays, so only rows of that very count are ranked. counts are
    cached, for they are read twice; with hold=False the caller has seen to that.
    """
    counts = counts.cache() if hold else counts
    line = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct count
    hist = counts.groupBy("cnt").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(line), F.lit(0)))
    last = hist.where(F.col("above") < k).agg(F.min("cnt"), F.max("above"), F.min_by("n", "cnt")).first()
    if last[0] is None:
        return counts.limit(0)
    if last[1] + last[2] <= k:
        return counts.where(F.col("cnt") >= last[0])
    edge = first_rows(counts.where(F.col("cnt") == last[0]), order, k - last[1], last[2])
    return counts.where(F.col("cnt") > last[0]).unionByName(edge)


def top_unigrams(docs: DataFrame, text: str = "text", k: int = UNIGRAMS) -> DataFrame:
    return top(unigram_counts(docs, text), k, ["token"])


def top_bigrams(docs: DataFrame, text: str = "text", k: int = BIGRAMS) -> DataFrame:
    return top(bigram_counts(docs, text), k, ["w1", "w2"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _counts(keys: np.ndarray, counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The counts beside sorted keys; 0 for what is not there."""
    if not len(keys):
        return np.zeros(len(of))
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, counts[at], 0.0)


@dataclass(frozen=True)
class Packed:
    """Both tables as sorted 64-bit hashes with their counts."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    total: int

    def log_probabilities(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each word but the first, given the one before it; words: places in h, hashes of distinct words. See LanguageModel.log_probabilities."""
        v = float(len(self.words))
        c = _counts(self.words, self.word_counts, h)[words]
        both = _counts(self.pairs, self.pair_counts, _mixed(h[words[:-1]], h[words[1:]]))
        known = c[:-1] > 0
        return np.log(np.where(known, both + 1, c[1:] + 1) / np.where(known, c[:-1] + v, self.total + v))


def hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of each word with the seed of Spark's xxhash64."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words.cast(pa.binary()).to_pylist()], np.uint64)


class LanguageModel:
    """Trimmed tables of a corpus and their totals after trimming."""

    def __init__(self, unigrams: DataFrame, bigrams: DataFrame) -> None:
        self.unigrams, self.bigrams = unigrams, bigrams
        n, v = unigrams.agg(F.sum("cnt"), F.count("*")).first()
        self.total, self.vocabulary = int(n or 0), int(v or 0)

    @property
    def available(self) -> bool:
        return self.vocabulary > 0

    @staticmethod
    def train(docs: DataFrame, text: str = "text", unigrams: int = UNIGRAMS, bigrams: int = BIGRAMS) -> LanguageModel:
        """Counts in one scan of docs, trims and keeps the trimmed tables in memory until release(); save() writes them."""
        both = pair_counts(docs, text).persist()
        words = both.groupBy(F.col("w2").alias("token")).agg(F.sum("cnt").alias("cnt")).persist()
        tables = top(words, unigrams, ["token"], hold=False).cache(), top(both.where("w1 is not null"), bigrams, ["w1", "w2"], hold=False).cache()
        for table in tables:
            table.count()  # filled, so that the counts below can go
        words.unpersist()
        both.unpersist()
        return LanguageModel(*tables)

    def release(self) -> None:
        """Lets go of the tables in memory; they are computed anew where they are used again."""
        self.unigrams.unpersist()
        self.bigrams.unpersist()

    def save(self, folder: str) -> None:
        self.unigrams.write.mode("overwrite").parquet(f"{folder}/unigrams")
        self.bigrams.write.mode("overwrite").parquet(f"{folder}/bigrams")

    @staticmethod
    def load(spark, folder: str) -> LanguageModel | None:
        """None where there are no tables."""
        try:
            return LanguageModel(spark.read.parquet(f"{folder}/unigrams"), spark.read.parquet(f"{folder}/bigrams"))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def fits(self) -> bool:
        """Whether the tables are small enough for the workers."""
        return self.vocabulary + self.bigrams.limit(PACKED_ROWS + 1).count() <= PACKED_ROWS

    def packed(self) -> Packed | None:
        """The tables for the workers; None where they are too large."""
        if not self.fits():
            return None

        def sorted_columns(rows: DataFrame) -> tuple[np.ndarray, ...]:
            got = rows.toArrow()
            h = [c.to_numpy().view(np.uint64) for c in got.columns[:-1]]
            key = h[0] if len(h) == 1 else _mixed(*h)
            order = np.argsort(key)
            return key[order], got.columns[-1].to_numpy()[order].astype(np.float64)

        uni = sorted_columns(self.unigrams.select(F.xxhash64("token").alias("h"), "cnt"))
        return Packed(*uni, *sorted_columns(self.bigrams.select(F.xxhash64("w1").alias("a"), F.xxhash64("w2").alias("b"), "cnt")), self.total)

    def log_probabilities(self, rows: DataFrame) -> DataFrame:
        """rows (..., w1, w2) with lp: add-one given w1, or add-one of w2 alone where w1 is unknown.

        For tables too large for packed(); the planner picks the joins by their sizes.
        """
        both, v, n = self.bigrams.select("w1", "w2", F.col("cnt").alias("_c12")), F.lit(float(self.vocabulary)), F.lit(float(self.total))
        first = self.unigrams.select(F.col("token").alias("w1"), F.col("cnt").alias("_c1"))
        second = self.unigrams.select(F.col("token").alias("w2"), F.col("cnt").alias("_c2"))
        joined = rows.join(both, ["w1", "w2"], "left").join(first, "w1", "left").join(second, "w2", "left")
        count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
        lp = F.when(count("_c1") > 0, F.log((count("_c12") + 1) / (count("_c1") + v))).otherwise(F.log((count("_c2") + 1) / (n + v)))
        return joined.withColumn("lp", lp).drop("_c12", "_c1", "_c2")


def mass_kept(counts: DataFrame, k: int) -> DataFrame:
    """One row: kept, total and share of the counts that the top k rows hold.

    How rows of one count are ordered changes nothing, so a histogram of counts, one pass over them, gives it all.
    """
    line = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct count
    hist = counts.groupBy("cnt").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(line), F.lit(0)))
    stay = F.greatest(F.least(F.col("n"), F.lit(k) - F.col("above")), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    got = hist.agg(zero(F.col("cnt") * stay).alias("kept"), zero(F.col("cnt") * F.col("n")).alias("total"))
    return got.withColumn("share", F.col("kept") / F.nullif(F.col("total"), F.lit(0)))
