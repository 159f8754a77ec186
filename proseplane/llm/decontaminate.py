"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is a trie of their word sequences closed under suffixes: one
state for each set of end positions. Training words are streamed through it; the state and the length of
the longest match say which windows of an item end at each word. Only runs of words whose trigrams are all
trigrams of items are streamed, for every window lies in such a run. Built, the automaton is a few flat arrays.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseplane.llm.common import cut, packed_rows

WINDOW = 13
#: Words of items in one automaton; longer benchmarks take several, one pass for each. A worker holds some 60 bytes for each
#: (measured with 400 000 words, 30 000 distinct ones), the driver some 450 while it builds it.
MAX_WORDS = 400_000
COVERAGE = 0.05

#: Lower case for A-Z; every other ASCII character but digits and a-z separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


#: Odd factors by which the word numbers of a gram make one number; two grams with one number only cost time.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """The numbers of all runs of `size` ids."""
    with np.errstate(over="ignore"):
        return sum((ids[i : len(ids) - size + 1 + i].astype(np.uint64) + np.uint64(1)) * _MIX[i] for i in range(size))


class SuffixAutomaton:
    """Of the word sequences of items; `hits` finds their windows in another sequence."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        items = [(k, w) for k, w in items if w]
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends: list[set[int] | None] = [None]  # of states of a window's length and more the items that they occur in
        number = {k: n for n, k in enumerate(dict.fromkeys(k for k, _ in items))}
        grams: list[np.ndarray] = []
        self.stride = min([window, *(len(w) for _, w in items)])
        self.gram = min(3, self.stride)
        for key, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last, path = 0, []
            for x in ids:
                last = self._extend(last, x, ends)
                path.append(last)
            for state in path:
                if self.length[state] >= window:
                    ends[state] = (ends[state] or set()) | {number[key]}
            grams.append(_grams(np.array(ids, np.int64), self.gram))
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]))
        whole: dict[int, set[tuple[str, int]]] = {}  # short items, where reading them ends
        for key, words in items:
            if len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][self.vocab[w]]
                whole.setdefault(state, set()).add((key, len(words)))
        self._freeze(ends, whole, list(number))

    def _freeze(self, ends: list, whole: dict[int, set[tuple[str, int]]], names: list[str]) -> None:
        """Transitions by state and word, and items of the states where windows are told apart, as flat arrays."""
        length, link, n = self.length, self.link, len(self.next)
        order = sorted(range(1, n), key=length.__getitem__)
        for state in reversed(order):
            if ends[state] and length[link[state]] >= self.window:
                ends[link[state]] = (ends[link[state]] or set()) | ends[state]
        self.names, self.item_at, self.item_of = names, array("i", [-1]) * n, array("i")
        self.item_ends = array("i", [0])
        for state in order:
            if ends[state] and length[link[state]] < self.window:  # longer states lead here by their links
                self.item_at[state] = len(self.item_ends) - 1
                self.item_of.extend(sorted(ends[state]))
                self.item_ends.append(len(self.item_of))
        self.short: dict[int, tuple[tuple[str, int], ...]] = {}
        for state in order if whole else ():
            inherited = self.short.get(link[state], ())
            if inherited or state in whole:
                self.short[state] = (*inherited, *sorted(whole[state])) if state in whole else inherited
        self.starts, self.words, self.to = array("i", [0]), array("i"), array("i")
        for state, own in enumerate(self.next):
            for x in sorted(own):
                self.words.append(x)
                self.to.append(own[x])
            self.next[state] = {}
            self.starts.append(len(self.words))
        del self.next

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(None)
        return len(self.next) - 1

    def _extend(self, last: int, x: int, ends: list) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, x, ends)
        state, p = self._new(self.length[last] + 1, ends), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x, ends)
        return state

    def _split(self, p: int, q: int, x: int, ends: list) -> int:
        clone = self._new(self.length[p] + 1, ends)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The disjoint spans [start, end) of words inside windows, and the items that have windows here."""
        g, n = self.gram, len(words)
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.vocab or n < self.stride:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        codes = _grams(ids, g)
        known = self.grams[np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)] == codes
        edges = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0))
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - first + g - 1 >= self.stride:
                self._stream(ids[first : end + g - 1].tolist(), first, spans, found)
        return spans, found

    def _stream(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        starts, words, targets, link, length, window = self.starts, self.words, self.to, self.link, self.length, self.window
        state = match = 0
        for i, x in enumerate(ids, at):
            while True:
                low, high = starts[state], starts[state + 1]
                k = bisect_left(words, x, low, high)
                if (k < high and words[k] == x) or not state:
                    break
                state = link[state]
                match = length[state]
            if k == high or words[k] != x:
                match = 0
                continue
            state, match = targets[k], match + 1
            size = 0
            if match >= window:
                size, s = window, state
                while length[link[s]] >= window:
                    s = link[s]
                row = self.item_at[s]
                found.update(self.names[n] for n in self.item_of[self.item_ends[row] : self.item_ends[row + 1]])
            for key, n in self.short.get(state, ()):
                if n <= match:
                    found.add(key)
                    size = max(size, n)
            if size:
                start = i + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def automata(benchmark: DataFrame, item_id: str, text: str, window: int, max_words: int) -> Iterator[SuffixAutomaton]:
    """Automata over the items in turn, of about max_words words each; the driver holds one at a time."""
    batch: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), text).toLocalIterator():
        words = normalised(row[1])
        batch.append((row[0], words))
        size += len(words)
        if size >= max_words:
            yield SuffixAutomaton(batch, window)
            batch, size = [], 0
    if batch:
        yield SuffixAutomaton(batch, window)


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with the column `contamination`: n_words, spans of hit words [first, last) and the items' ids, sorted.

    An automaton of at most about max_words words is broadcast (an item longer than that still gets its own);
    a longer benchmark takes one pass over docs for each further automaton, and each such pass checkpoints docs
    with their texts. Words outside runs of the items' trigrams are not streamed, for no window lies there.
    Null and wordless texts have no words and no hits; an empty benchmark hits nothing. Repeated
    items count by id; a null item id counts as the empty text. A column `contamination` of docs is replaced.
    """
    spark = docs.sparkSession
    out = docs.withColumn("contamination", F.struct(F.lit(-1).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items")))
    passes = 0
    for automaton in automata(benchmark, item_id, item_text, window, max_words):
        if passes:
            out = cut(out)
        passes += 1
        out = _pass(out, spark.sparkContext.broadcast(pickle.dumps(automaton, protocol=5)), text)
    if not passes:
        out = _pass(out, spark.sparkContext.broadcast(pickle.dumps(SuffixAutomaton([], window), protocol=5)), text)
    return out


def _pass(docs: DataFrame, shared, text: str) -> DataFrame:
    @F.arrow_udf(_FOUND)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = pickle.loads(shared.value)
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])
        for texts, befores in batches:
            rows = []
            for t, before in zip(texts, befores, strict=True):
                words = normalised(t.as_py())
                spans, found = automaton.hits(words)
                seen = before.as_py()
                spans = _merged([*spans, *((x["first"], x["last"]) for x in seen["spans"])])
                rows.append({"n_words": len(words), "spans": [{"first": s, "last": e} for s, e in spans], "items": sorted({*found, *seen["items"]}, key=lambda k: k.encode("utf-8", "surrogatepass"))})
            yield pa.array(rows, kind)

    # called non-deterministic, it is not repeated in a filter that is pushed below it
    return docs.withColumn("contamination", scan.asNondeterministic()(F.col(text), F.col("contamination")))


def judged(found: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Adds n_hit and contaminated: at least the given share of the words, and one word, is hit."""
    n_hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"]))
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= coverage * F.col("contamination.n_words")))


@F.arrow_udf(T.StringType())
def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        yield pa.array([_removed(t.as_py(), [(x["first"], x["last"]) for x in s.as_py() or []]) for t, s in zip(texts, spans, strict=True)], pa.string())


def _removed(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans or text is None:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(_NORMAL)
    bounds, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : bounds[first][0]])
        at = bounds[last - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs without the documents that are contaminated; the spans that others share with items are cut out.

    Columns are those of docs, with any names. Null texts stay null and empty ones empty; each of repeated rows is kept,
    cut or dropped alike; texts of any length are read whole. A document whose coverage is just the limit goes. An empty
    benchmark, or one of null texts, changes nothing; no rows give no rows.
    """
    found = judged(find_contamination(packed_rows(docs, F.col(text).alias("_text")), benchmark, "_text", window=window), coverage)
    kept = found.where(~F.col("contaminated"))
    clean = F.when(F.col("n_hit") > 0, _without(F.col("_text"), F.col("contamination.spans"))).otherwise(F.col("_text"))
    return kept.select(clean.alias("_text"), "_row").select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])
