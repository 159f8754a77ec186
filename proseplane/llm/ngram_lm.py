"""Interpolated modified Kneser-Ney language model of words (Chen and Goodman, 1999), of order 2 or 3.

Counts are made in Spark, level by level. Tasks count the n-grams of their texts by 64-bit word hashes and
deal them out by the hash of the first two words, packed, one row for each task and range. A range adds up
its n-grams, writes them, and sends on what the next lower level needs: of trigrams the word pairs with the
number of words that they follow, of pairs the statistics of single words. With more ranges than one pass
may deal to (FAN), dealing takes further passes, so rows grow with the input and not with its square. Packed
rows name the most frequent words by numbers that a first pass gives out, and all others by their hashes; this
is only how rows are written, no count depends on it.

A range is one file of the shared folder with sorted hash arrays: a directory of the leading bits, the next
24 bits of each hash (words: all 64), and numbers into a table of the distinct values. An n-gram that is not
there is taken for one that is with a probability of about one in a million. Scoring workers hash some GATHER
tokens of their task, sort them by range, and map each range's file into memory once for all of them; the MAPS
last used maps stay.
"""

from __future__ import annotations

import json
import mmap
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseplane.llm.common import cut, mix64, shared_dir, slices

ORDER = 3
#: Tokens that a task counts before it sends them on. The more, the fewer words are named in several rows.
FLUSH = 4_000_000
#: Bytes of text for which there is one range, so that a range's work fits in a task's memory.
RANGE_BYTES = 24_000_000
#: A task takes 2 ** SHARE ranges in turn and holds their rows packed, for fewer and larger rows.
SHARE = 2
#: Bits of the range number that one pass deals out, and bits of the number of ranges of single words at most.
FAN, WORD_FAN = 11, 10
#: Words that have numbers at most; they are sent to the workers, 8 bytes each.
NUMBERED = 1 << 20
#: Tokens that a scoring task looks up together (some 50 bytes each), so that it opens a file once for all of them.
GATHER = 4_000_000
#: Files that a scoring worker keeps mapped.
MAPS = 128
_BEFORE = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x5851F42D4C957F2D)
_END = np.uint64(0x14057B7EF767814F)
_RANGE = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Model:
    """Where the ranges are and what holds for the whole; `ranges` has the numbers of each level's files."""

    folder: str
    order: int
    bits: int
    word_bits: int
    train_tokens: int
    distinct: int
    pairs: int
    #: Of level 1 (numbers of words that a word follows) to the order (counts).
    discounts: tuple[tuple[float, float, float], ...]
    lower_rest: float
    ranges: dict[int, np.ndarray] = field(repr=False)


# ---- tokens -------------------------------------------------------------------------------------------------


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _xxh64(b: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 with seed 1 of runs of bytes, all runs of one length at once; b has 8 bytes behind the last run."""
    import xxhash

    eight, four = (np.ndarray(len(b) - k + 1, f"<u{k}", b, strides=(1,)) for k in (8, 4))  # what begins at each byte
    out = np.empty(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for n, rows in _by_range(np.minimum(size, 32), 6):
            i = at[rows]
            if n == 32:  # few in most texts, and of any length
                lines, known = b.tobytes(), {}
                words = [lines[x : x + k] for x, k in zip(i.tolist(), size[rows].tolist(), strict=True)]
                out[rows] = [known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w, 1)) for w in words]
                continue
            h = np.full(len(i), np.uint64(1 + n) + _P5)
            for k in range(0, n & ~7, 8):
                h ^= _turned(eight[i + k] * _P2, 31) * _P1
                h = _turned(h, 27) * _P1 + _P4
            if n & 4:
                h ^= four[i + (n & ~7)] * _P1
                h = _turned(h, 23) * _P2 + _P3
            for k in range(n & ~3, n):
                h ^= b[i + k] * _P5
                h = _turned(h, 11) * _P1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the last the end token's; the number of each token, with an end token after
    each text; and the texts' bounds."""
    import pandas as pd

    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    b, at = np.append(b, np.zeros(8, np.uint8)), at - at[0]
    word = ((b - np.uint8(9)) > 4) & (b != 32)
    word[at[-1] :] = False
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = at[1:-1]  # words end with their texts
    edges = edges[(edges > 0) & (edges < at[-1])]
    first[edges], last[edges - 1] = word[edges], word[edges - 1]
    b += ((b - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    own, known = pd.factorize(_xxh64(b, start, stop - start))
    before = np.searchsorted(start, at)  # words before each text
    bounds = before + np.arange(len(at))
    code = np.full(int(bounds[-1]), len(known), np.uint32)
    code[np.arange(len(start)) + np.repeat(np.arange(len(texts)), np.diff(before))] = own
    return np.append(known, _END), code, bounds


def _after(x: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """What stands before each token; `first` before a text's first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = first
    return out


def gram_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of an n-gram from the hash of all but its last word and that word's."""
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b))


def range_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Range numbers by a hash (of the first two words, or of a single one), independent of its own bits."""
    return (mix64(h ^ _RANGE) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _by_range(part: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each range number that there is."""
    if not bits or not len(part):
        if len(part):
            yield 0, np.arange(len(part))
        return
    order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")  # 16 bits are sorted by radix
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(part)), strict=True):
        yield int(part[order[a]]), order[a:b]


# ---- packed rows --------------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first as differences, bytes of one rank together, all compressed."""
    import zstandard

    out = [np.int64([len(columns[0]), len(columns)]).tobytes()]
    squeeze = zstandard.ZstdCompressor(level=1)
    for k, c in enumerate(columns):
        c = np.ascontiguousarray(c)
        data = (np.diff(c, prepend=c.dtype.type(0)) if k == 0 else c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes()
        small = squeeze.compress(data)
        out.append(np.dtype(c.dtype).str.encode().ljust(8) + np.int64([len(small)]).tobytes() + small)
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    n, k = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for i in range(k):
        kind = np.dtype(blob[at : at + 8].decode().strip())
        size = int(np.frombuffer(blob, np.int64, 1, at + 8)[0])
        raw = zstandard.ZstdDecompressor().decompress(blob[at + 16 : at + 16 + size], max_output_size=int(n) * kind.itemsize + 1)
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(np.cumsum(c, dtype=kind) if i == 0 else c)
        at += 16 + size
    return out


def _narrow(c: np.ndarray) -> np.ndarray:
    top = int(c.max()) if len(c) else 0
    return c.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts key, and where its runs of equal keys begin in that order."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _mapped(at: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """An array of n numbers with `to` at the places `at`."""
    out = np.zeros(n, np.uint32)
    out[at] = to
    return out


def _used(codes: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Which of n numbers codes hold, how often, and codes as places among these."""
    flat = np.concatenate(codes)
    if 8 * len(flat) <= n:
        used, times = np.unique(flat, return_counts=True)
        return used, times, [np.searchsorted(used, c) for c in codes]
    times = np.bincount(flat, minlength=n)
    used = np.flatnonzero(times)
    places = _mapped(used, np.arange(len(used)), n)
    return used, times[used], [places[c] for c in codes]


class Names:
    """Numbers of frequent words: their hashes by number."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes

    @cached_property
    def _line(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.hashes)
        return self.hashes[order], order

    def of(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 where they have none."""
        line, order = self._line
        if not len(line):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(line, words), len(line) - 1)
        return np.where(line[at] == words, order[at], -1)


_NO_NAMES = Names(np.zeros(0, np.uint64))


@dataclass
class Grams:
    """Distinct n-grams: numbers of words for each place, and values (their sums where n-grams meet)."""

    words: np.ndarray
    codes: list[np.ndarray]
    values: list[np.ndarray]

    def distinct(self) -> Grams:
        """Equal n-grams added up; sorted by the numbers of their words, the first foremost."""
        k = len(self.codes)
        width = max(1, len(self.words).bit_length())
        if k * width > 64:  # over two million words of trigrams
            order = np.lexsort(self.codes[::-1])
            codes = [c[order] for c in self.codes]
            new = np.logical_or.reduce([np.diff(c, prepend=c[:1] + np.uint32(1)) != 0 for c in codes]) if len(order) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            return Grams(self.words, [c[first] for c in codes], [np.add.reduceat(v[order], first) if len(first) else v for v in self.values])
        key = np.zeros(len(self.codes[0]), np.uint64)
        for c in self.codes:
            key = (key << np.uint64(width)) | c.astype(np.uint64)
        line = np.sort(key)  # much faster than an order of rows; what is over 1 in the few other rows is added then
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(line)))
        line = line[first]
        values = []
        for v in self.values:
            more = np.flatnonzero(v != 1)
            at = np.searchsorted(line, key[more])
            values.append(times + (np.bincount(at, v[more] - 1, len(line)).astype(np.int64) if len(more) else 0))
        mask = np.uint64((1 << width) - 1)
        return Grams(self.words, [((line >> np.uint64(width * (k - 1 - i))) & mask).astype(np.uint32) for i in range(k)], values)

    def of(self, rows: np.ndarray) -> Grams:
        return Grams(self.words, [c[rows] for c in self.codes], [v[rows] for v in self.values])

    def head(self) -> np.ndarray:
        """The hash of the first two words."""
        return gram_hash(self.words[self.codes[0]], self.words[self.codes[1]])

    @staticmethod
    def together(parts: list[Grams]) -> Grams:
        words, at = np.unique(np.concatenate([p.words for p in parts]), return_inverse=True)
        starts = np.cumsum([0, *(len(p.words) for p in parts)])
        maps = [at[s:e].astype(np.uint32) for s, e in zip(starts, starts[1:], strict=False)]
        codes = [np.concatenate([m[p.codes[i]] for m, p in zip(maps, parts, strict=True)]) for i in range(len(parts[0].codes))]
        return Grams(words, codes, [np.concatenate([p.values[i] for p in parts]) for i in range(len(parts[0].values))])

    def packed(self, names: Names = _NO_NAMES, section: np.ndarray | None = None, sections: int = 1) -> bytes:
        """Rows of each section, sorted by the numbers of words; those without a name get the numbers after, frequent
        ones first, and stand in a dictionary. Of more than one section, `section` has each row's."""
        used, n, places = _used(self.codes, len(self.words))
        number = names.of(self.words[used])
        rest = np.flatnonzero(number < 0)
        rest = rest[np.argsort(64 - np.frexp(n[rest])[1].astype(np.uint16), kind="stable")]
        number[rest] = np.arange(len(names.hashes), len(names.hashes) + len(rest))
        codes = [number[p].astype(np.uint32) for p in places]
        widths = [max(1, int(c.max()).bit_length()) for c in codes]
        if sum(widths) <= 64:
            line = np.zeros(len(codes[0]), np.uint64)
            for c, w in zip(codes, widths, strict=True):
                line = (line << np.uint64(w)) | c.astype(np.uint64)
            by = np.argsort(line)
        else:
            by = np.lexsort(codes[::-1])
        parts = [by]
        if sections > 1:
            section = section[by]
            parts = [by[section == i] for i in range(sections)]
        blobs = [_pack(self.words[used[rest]]), *(_pack(*(_narrow(c[p]) for c in codes + self.values)) for p in parts)]
        return np.int64([len(codes), len(parts), *map(len, blobs)]).tobytes() + b"".join(blobs)

    @staticmethod
    def unpacked(blob: bytes, names: Names = _NO_NAMES, sections: range | None = None) -> Grams:
        """The rows of some sections, or of all."""
        k, n = np.frombuffer(blob, np.int64, 2)
        ends = np.cumsum(np.append(8 * (n + 3), np.frombuffer(blob, np.int64, n + 1, 16)))
        lots = [_unpack(blob[ends[1 + i] : ends[2 + i]]) for i in (range(n) if sections is None else sections)]
        columns = lots[0] if len(lots) == 1 else [np.concatenate(c) for c in zip(*lots, strict=True)]
        rest, named = _unpack(blob[ends[0] : ends[1]])[0], len(names.hashes)
        used, _, codes = _used(columns[:k], named + len(rest))
        cut_at = int(np.searchsorted(used, named))
        words = np.concatenate([names.hashes[used[:cut_at]], rest[used[cut_at:].astype(np.int64) - named]])
        return Grams(words, [c.astype(np.uint32) for c in codes], [c.astype(np.int64) for c in columns[k:]])


# ---- dealing ------------------------------------------------------------------------------------------------

_ROW = "slot long, level int, blob binary"
_TOTALS = 0


def _row(slot: int, level: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([level], pa.int32()), pa.array([blob], pa.binary())], names=["slot", "level", "blob"])


def _slots(spark, n: int) -> list[int]:
    """A number for each of n ranges, of which hash partitioning sends one to each of n partitions."""
    if n == 1 or n > 1 << 14:
        return list(range(n))
    rows = spark.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in rows}
    return [found.get(p, 64 * n + p) for p in range(n)]


class _Deal:
    """2 ** bits groups of ranges of one level, of which `now` bits are dealt out so far."""

    def __init__(self, bits: int, now: int, slots: list[int] | None, shared: Broadcast | None = None) -> None:
        self.bits, self.now, self.slots, self.shared = bits, now, slots, shared

    @property
    def names(self) -> Names:
        return self.shared.value if self.shared is not None else _NO_NAMES

    def slot(self, part: int) -> int:
        part >>= self.bits - self.now
        return self.slots[part] if self.slots is not None and self.now == self.bits else part

    def __call__(self, grams: Grams, level: int) -> Iterator[pa.RecordBatch]:
        """One row for each range that has n-grams; what is dealt to the end has a section for each range of a task."""
        part = range_of(grams.head(), self.bits + SHARE)
        sections = 1 << SHARE if self.now == self.bits else 1
        for p, rows in _by_range(part >> (self.bits + SHARE - self.now), self.now):
            yield _row(self.slot(p << (self.bits - self.now)), level, grams.of(rows).packed(self.names, part[rows] & (sections - 1), sections))


def _dealt(rows: DataFrame, bits: int, slots: list[int], shared: Broadcast) -> DataFrame:
    """rows dealt by the first FAN bits, grouped by range: further passes merge them and deal on."""
    now = min(bits, FAN)
    while now < bits:
        to = min(bits, now + FAN)
        salt = F.pmod(F.xxhash64("blob"), F.lit(1 << (to - now)))  # so many tasks share what has one number so far
        rows = rows.repartition(1 << to, F.col("slot"), salt).sortWithinPartitions("slot").mapInArrow(_dealing_on(_Deal(bits, to, slots, shared)), _ROW)
        now = to
    return rows.repartition(1 << bits, "slot").groupBy("slot")


def _dealing_on(deal: _Deal):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Grams] = []
        size, slot = 0, None
        level = 0
        for batch in batches:
            for s, k, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k == _TOTALS:
                    yield _row(deal.slot(int(_unpack(blob)[0][1])), k, blob)
                    continue
                if held and (s != slot or size >= FLUSH):
                    yield from deal(Grams.together(held).distinct(), level)
                    held, size = [], 0
                held.append(Grams.unpacked(blob, deal.names))
                size, slot, level = size + len(held[-1].codes[0]), s, k
        if held:
            yield from deal(Grams.together(held).distinct(), level)

    return dealt


# ---- numbers of words ---------------------------------------------------------------------------------------


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that stand more than once in a task's texts, with their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def emptied() -> pa.RecordBatch:
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["word", "n"])

    for batch in batches:
        for texts in slices(batch.column(0)):
            words, own, _ = hashed(texts)
            held.append((words, np.bincount(own, minlength=len(words))))
            if sum(len(w) for w, _ in held) >= FLUSH:
                yield emptied()
    if held:
        yield emptied()


def _names(texts: DataFrame) -> Names:
    """Numbers for the marks and the most frequent words of all texts, by classes of counts, NUMBERED at most."""
    sums = texts.mapInArrow(_repeated, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(sums.withColumn("size", F.floor(8 * F.log2("n"))))
    least, room = None, NUMBERED
    for r in sorted(words.groupBy("size").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    marks = np.array([_BEFORE, _START, _END], np.uint64)
    if least is None:
        return Names(marks)
    found = words.where(F.col("size") >= least).select("word", "n").toArrow()
    word, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.lexsort([word, -n])
    return Names(np.concatenate([marks, word[order][~np.isin(word[order], marks)]]))


# ---- counting -----------------------------------------------------------------------------------------------


def counted_grams(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], order: int) -> Grams:
    """The n-grams of lots of texts, as hashed() gives them, with counts; of pairs also as raw counts."""
    words, at = np.unique(np.concatenate([*(w for w, _, _ in held), [_START, _BEFORE]]), return_inverse=True)
    at = at.astype(np.uint32)
    ends = np.cumsum([0, *(len(w) for w, _, _ in held)])
    offsets = np.cumsum([0, *(len(c) for _, c, _ in held)])
    codes = [np.concatenate([at[e:][c] for e, (_, c, _) in zip(ends, held, strict=False)])]
    starts = np.concatenate([b[:-1] + o for o, (_, _, b) in zip(offsets, held, strict=False)])
    for k in range(1, order):
        codes.insert(0, _after(codes[0], starts, at[-2] if k == 1 else at[-1]))
    ones = np.ones(len(codes[0]), np.int64)
    return Grams(words, codes, [ones] if order > 2 else [ones, ones]).distinct()


def _counter(order: int, deal: _Deal):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                held.append(hashed(texts))
                size += len(held[-1][1])
                if size >= FLUSH:
                    grams, held, size = counted_grams(held, order), [], 0
                    yield from deal(grams, order)
        if held:
            yield from deal(counted_grams(held, order), order)

    return counted


def _totals(slot: int, level: int, part: int, group: int, n: np.ndarray) -> pa.RecordBatch:
    """A level's numbers of n-grams with counts 1 to 4 in one range of a group."""
    return _row(slot, _TOTALS, _pack(np.array([part, group, level, *((n == i).sum() for i in range(1, 5))], np.int64)))


def _of_contexts(g: Grams, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of sorted n-grams the first rows of their contexts; total, and numbers of n-grams of count 1, 2 and more."""
    new = np.logical_or.reduce([np.diff(c.astype(np.int64), prepend=-1) != 0 for c in g.codes[:-1]])
    first = np.flatnonzero(new)
    return first, [np.add.reduceat(c.astype(np.int64), first) for c in (n, n == 1, n == 2, n > 2)]


def _reducer(level: int, folder: str, parts: dict[int, int], bits: int, lower: _Deal):
    """Adds up the n-grams of a group of the 2 ** bits ranges, writes their files, sends on what the next level needs."""

    def merged(lots: list[Grams]) -> Grams:
        return Grams.together(lots).distinct()

    def reduced(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = parts[key[0].as_py()]
        share = bits - (len(parts).bit_length() - 1)
        blobs: list[bytes] = []
        for batch in batches:
            for k, blob in zip(batch.column(batch.schema.get_field_index("level")).to_pylist(), batch.column(batch.schema.get_field_index("blob")), strict=True):
                if k == _TOTALS:
                    yield _row(lower.slot(int(_unpack(blob.as_py())[0][1]) & ((1 << lower.bits) - 1)), k, blob.as_py())
                else:
                    blobs.append(blob.as_py())
        here = lower.slot(group & ((1 << lower.bits) - 1))
        sums = None
        each = 1 << (SHARE - share)
        for own in range(1 << share):
            part = (group << share) + own
            now: list[Grams] = []
            waiting: list[Grams] = []
            for blob in blobs:
                waiting.append(Grams.unpacked(blob, lower.names, range(own * each, (own + 1) * each)))
                if sum(len(x.codes[0]) for x in waiting) > max(500_000, len(now[0].codes[0]) // 2 if now else 0):
                    now, waiting = [merged([*now, *waiting])], []
            grams = merged([*now, *waiting]) if waiting else now[0] if now else None
            del now, waiting
            if grams is None or not len(grams.codes[0]):
                continue
            if level > 2:
                yield from _trigrams(grams, folder, part, group, here, lower)
            else:
                sums = _added([*([sums] if sums else []), _pairs(grams, folder, part)])
                yield _totals(here, 2, part, group, grams.values[0])
        if sums:
            for p, rows in _by_range(range_of(sums[0], lower.bits), lower.bits):
                yield _row(lower.slot(p), 1, _pack(*(_narrow(x[rows]) if i else x[rows] for i, x in enumerate(sums))))

    return reduced


def _added(lots: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of the columns for each distinct word, which come first."""
    word = np.concatenate([x[0] for x in lots])
    order, first = _runs(word)
    return [word[order[first]], *(np.add.reduceat(np.concatenate([x[i].astype(np.int64) for x in lots])[order], first) for i in range(1, 7))]


def _trigrams(g: Grams, folder: str, part: int, group: int, here: int, lower: _Deal) -> Iterator[pa.RecordBatch]:
    (a, b, c), n = g.codes, g.values[0]
    head = g.head()
    first, contexts = _of_contexts(g, n)
    _write(folder, 3, part, _section(gram_hash(head, g.words[c]), [n]), _section(head[first], contexts))
    del head, contexts
    begins = g.words[a] == _BEFORE  # the start mark follows nothing, so pairs that begin with it keep their counts
    yield _totals(here, 3, part, group, n[~begins])
    yield from lower(Grams(g.words, [b, c], [np.where(begins, n, 1), n]).distinct(), 2)


def _pairs(g: Grams, folder: str, part: int) -> list[np.ndarray]:
    """Words with their statistics as contexts, the numbers of words that they follow, and counts."""
    (b, c), (n, raw) = g.codes, g.values
    _write(folder, 2, part, _section(g.head(), [n]))
    first, contexts = _of_contexts(g, n)
    columns = np.zeros((6, len(g.words)), np.int64)
    columns[:4, b[first]] = contexts
    columns[4] = np.bincount(c, minlength=len(g.words))
    columns[5] = np.bincount(c, raw, len(g.words)).astype(np.int64)
    return [g.words, *columns]


_SUMS = ["level", "part", "c1", "c2", "c3", "c4", "tokens", "distinct", "ahead"]


def _word_reducer(folder: str, parts: dict[int, int]):
    """Adds up a range's words and writes its file; returns totals of this and of the other levels."""

    def reduced(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[np.ndarray] | None = None
        rows: list[list[int]] = []

        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            for k, blob in zip(batch.column(batch.schema.get_field_index("level")).to_pylist(), batch.column(batch.schema.get_field_index("blob")), strict=True):
                got = _unpack(blob.as_py())
                if k == _TOTALS:
                    part, _, level, *c = (int(x) for x in got[0])
                    rows.append([level, part, *c, 0, 0, 0])
                    continue
                waiting.append(got)
                if sum(len(x[0]) for x in waiting) > max(500_000, len(now[0]) // 2 if now else 0):
                    now, waiting = _added([*([now] if now else []), *waiting]), []
        if waiting:
            now = _added([*([now] if now else []), *waiting])
        if now is not None:
            part = parts[key[0].as_py()]
            _write(folder, 1, part, _section(now[0], now[1:], whole=True))
            ahead, count = now[5:]
            rows.append([1, part, *(int((ahead == i).sum()) for i in range(1, 5)), int(count.sum()), int((count > 0).sum()), int(ahead.sum())])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=_SUMS)

    return reduced


def discounts(c: list[float]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from the numbers of keys with counts 1 to 4; kept within sensible bounds."""
    n1, n2, n3, n4 = c
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True))


def train(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """The model of all texts of docs (null: empty). Its files lie in the shared folder until forget().

    Repeated rows count as often as they stand there. An empty docs gives the model that knows no token. Other
    columns are ignored. A range that a lost executor wrote stays valid, for files are put in place whole and a
    repeated task writes the same bytes. All n-grams that begin with the same two words meet in one task, after
    each task has added up its own.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/ngram-lm-{uuid.uuid4().hex}"
    size = docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / RANGE_BYTES)))))
    word_bits = min(WORD_FAN, max(0, bits - 2))
    groups = max(0, bits - SHARE)
    slots, word_slots = _slots(spark, 1 << groups), _slots(spark, 1 << word_bits)
    texts = docs.select(F.col(text).alias("t"))
    shared = spark.sparkContext.broadcast(_names(texts))
    first = _Deal(groups, min(groups, FAN), slots, shared)
    parts = {s: p for p, s in enumerate(slots)}
    rows = texts.mapInArrow(_counter(order, first), _ROW)
    for level in range(order, 1, -1):
        lower = first if level > 2 else _Deal(word_bits, word_bits, word_slots, shared)
        rows = _dealt(rows, groups, slots, shared).applyInArrow(_reducer(level, folder, parts, bits, lower), _ROW)
    words = rows.repartition(1 << word_bits, "slot").groupBy("slot")
    sums = cut(words.applyInArrow(_word_reducer(folder, {s: p for p, s in enumerate(word_slots)}), ", ".join(f"{x} long" for x in _SUMS)))
    of = {r["level"]: r for r in sums.groupBy("level").agg(*[F.sum(x).alias(x) for x in _SUMS[2:]]).collect()}
    get = lambda level, x: int(of[level][x]) if level in of else 0
    d = tuple(discounts([get(k, f"c{i}") for i in range(1, 5)]) for k in range(1, order + 1))
    there = {k: np.array(sorted(r[0] for r in sums.where(F.col("level") == k).select("part").collect()), np.int64) for k in range(1, order + 1)}
    shared.destroy()
    pairs, distinct = get(1, "ahead"), get(1, "distinct")
    rest = (d[0][0] * get(1, "c1") + d[0][1] * get(1, "c2") + d[0][2] * (distinct - get(1, "c1") - get(1, "c2"))) / pairs if pairs else 1.0
    return Model(folder, order, bits, word_bits, get(1, "tokens"), distinct, pairs, d, rest, there)


# ---- files --------------------------------------------------------------------------------------------------


def _section(key: np.ndarray, columns: list[np.ndarray], whole: bool = False) -> list[np.ndarray]:
    """Sorted hashes (a directory of the leading bits, then the next 24 bits or all) and the values beside."""
    import pandas as pd

    bits = max(0, len(key).bit_length() - 4)
    kind = np.zeros(len(key), np.uint64)
    for i, c in enumerate(columns):
        kind = gram_hash(kind, c.astype(np.uint64) + np.uint64(i))
    code = pd.factorize(kind)[0]
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
    table = np.stack([c[first].astype(np.int64) for c in columns], axis=1) if len(key) else np.zeros((0, len(columns)), np.int64)
    often = np.argsort(-np.bincount(code, minlength=len(first)), kind="stable")  # frequent values get small numbers
    table, code = table[often], _mapped(often, np.arange(len(often)), len(often))[code]
    width = np.uint64(len(first).bit_length())
    if not whole and bits + 24 + int(width) <= 64:  # the code takes the place of bits that are not kept
        line = np.sort((key >> width << width) | code.astype(np.uint64))
        key, code = line, line & ((np.uint64(1) << width) - np.uint64(1))
    else:
        order = np.argsort(key)
        key, code = key[order], code[order]
    lead = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    directory = np.concatenate([[0], np.cumsum(np.bincount(lead, minlength=1 << bits))]).astype(np.uint32)
    low = (key << np.uint64(bits)) >> np.uint64(40)
    keys = [key, np.zeros(0, np.uint8)] if whole else [(low >> np.uint64(8)).astype(np.uint16), low.astype(np.uint8)]
    large = np.flatnonzero(code >= 255)  # numbers beyond a byte, by their places
    return [directory, *keys, np.minimum(code, 255).astype(np.uint8), large.astype(np.uint32), _narrow(code[large]), table.ravel()]


#: Arrays of a section.
_ARRAYS = 7


#: Hashes that are looked up at once, so that what each step of a search makes stays in the processor's cache.
BLOCK = 1 << 13


def _find(section: list[np.ndarray], h: np.ndarray, columns: int) -> np.ndarray:
    """Rows of values of the hashes; 0 where they are not there."""
    out = np.zeros((len(h), columns), np.int64)
    if len(section[1]):
        for at in range(0, len(h), BLOCK):
            _look_up(section, h[at : at + BLOCK], out[at : at + BLOCK])
    return out


def _look_up(section: list[np.ndarray], h: np.ndarray, out: np.ndarray) -> None:
    directory, keys, ends, code, large, codes, table = section
    bits = (len(directory) - 1).bit_length() - 1
    lead = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    if whole := keys.dtype == np.uint64:
        want = h
    else:
        low = (h << np.uint64(bits)) >> np.uint64(40)
        want, end = (low >> np.uint64(8)).astype(np.uint16), low.astype(np.uint8)
    first, stop = directory.take(lead).astype(np.int64), directory.take(lead + 1).astype(np.int64)
    most = int((stop - first).max())
    at = first - 1  # the last place of a smaller key
    for k in range(most.bit_length() - 1, -1, -1):
        to = at + (1 << k)
        at += ((keys.take(to, mode="clip") < want) & (to < stop)).astype(np.int64) << k
    at += 1
    rows = np.flatnonzero(at < stop)
    at = at[rows]
    while len(rows):  # over keys of one beginning, mostly one
        same = keys.take(at) == want[rows]
        rows, at = rows[same], at[same]
        hit = np.ones(len(rows), bool) if whole else ends.take(at) == end[rows]
        place = at[hit]
        found = code.take(place).astype(np.int64)
        if len(large):
            more = np.flatnonzero(found == 255)
            found[more] = codes[np.searchsorted(large, place[more])]
        out[rows[hit]] = table.reshape(-1, out.shape[1]).take(found, axis=0)
        rows, at = rows[~hit], at[~hit] + 1
        left = at < stop[rows]
        rows, at = rows[left], at[left]


def _local(folder: str) -> str | None:
    """The path of a folder that this machine can open, or None."""
    at = urlparse(folder)
    return at.path if at.scheme in ("", "file") else None


def _write(folder: str, level: int, part: int, *sections: list[np.ndarray]) -> None:
    """Writes a range: a line that says what follows, then the arrays; puts the file in place whole."""
    arrays = [a for s in sections for a in s]
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    data = [head, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)]
    name, path = f"{level}-{part}", _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        draft = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(draft, "wb") as f:
            f.writelines(data)
        os.replace(draft, f"{path}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        for d in data:
            f.write(d)
    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{root}/{name}")
    store.move(draft, f"{root}/{name}")


class Files:
    """Ranges of a model, mapped into memory; the MAPS last used stay so. A missing file is an error."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.mapped: OrderedDict[tuple[int, int], list[np.ndarray]] = OrderedDict()
        self.copies: str | None = None

    def of(self, level: int, part: int) -> list[np.ndarray]:
        key = (level, part)
        if key in self.mapped:
            self.mapped.move_to_end(key)
            return self.mapped[key]
        while len(self.mapped) >= MAPS:
            (k, p), _ = self.mapped.popitem(last=False)
            if self.copies:
                os.unlink(f"{self.copies}/{k}-{p}")
        self.mapped[key] = self._map(f"{level}-{part}")
        return self.mapped[key]

    def _map(self, name: str) -> list[np.ndarray]:
        path = _local(self.model.folder)
        if path is None:  # a store that only clients reach: a copy for as long as the range is mapped
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.model.folder)
            self.copies = path = self.copies or tempfile.mkdtemp(prefix="ngram-lm-")
            with store.open_input_stream(f"{root}/{name}") as source, open(f"{path}/{name}", "wb") as target:
                shutil.copyfileobj(source, target, 1 << 22)
        with open(f"{path}/{name}", "rb") as f:
            try:
                whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            except TypeError:  # before Python 3.13 a map keeps a descriptor
                whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = whole.find(b"\n") + 1
        out = []
        for kind, n in json.loads(whole[:at]):
            out.append(np.frombuffer(whole, kind, n, at))
            at += -(-out[-1].nbytes // 8) * 8
        return out

    def close(self) -> None:
        self.mapped.clear()
        if self.copies:
            shutil.rmtree(self.copies, ignore_errors=True)
            self.copies = None

    def visits(self, level: int, part: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """The rows of each range that has a file, and its arrays; range by range, so each file is opened once."""
        there = self.model.ranges[level]
        for p, rows in _by_range(part, self.model.word_bits if level == 1 else self.model.bits):
            at = int(np.searchsorted(there, p))
            if at < len(there) and there[at] == p:  # else no n-gram fell in that range
                yield rows, self.of(level, p)

    def words(self, h: np.ndarray) -> np.ndarray:
        """The six values beside each word's hash; 0 where it is not known."""
        out = np.zeros((len(h), 6), np.int64)
        for rows, arrays in self.visits(1, range_of(h, self.model.word_bits)):
            out[rows] = _find(arrays[:_ARRAYS], h[rows], 6)
        return out


def forget(spark, model: Model) -> None:
    """Deletes the model's files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(model.folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---- scoring ------------------------------------------------------------------------------------------------


def _left(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0)


def _shares(context: np.ndarray, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Totals of contexts (total, numbers of counts 1, 2, more), and the shares that they leave to the lower order.

    A context that is not known leaves all.
    """
    total = np.maximum(context[:, 0], 1).astype(np.float64)
    return total, np.where(context[:, 0] > 0, (context[:, 1:4] @ np.array(d)) / total, 1.0)


class Scorer:
    """Of texts by one model: add() them, then score() all that were added, which opens each range's file once."""

    def __init__(self, model: Model) -> None:
        self.model, self.files = model, Files(model)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, texts: pa.Array) -> None:
        words, own, bounds = hashed(texts)
        self.waiting.append((np.append(words, _START), own, bounds))
        self.tokens += len(own)

    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words of all that waits; each token's and the one's before it by number; bounds."""
        held, (self.waiting, self.tokens) = self.waiting, ([], 0)
        words, number = np.unique(np.concatenate([w for w, _, _ in held]), return_inverse=True)
        places = np.split(number.astype(np.int32), np.cumsum([len(w) for w, _, _ in held])[:-1])
        own = np.concatenate([p[o] for p, (_, o, _) in zip(places, held, strict=True)])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, _, b in held]))]).astype(np.int64)
        return words, own, _after(own, bounds[:-1], places[0][-1]), bounds

    def score(self) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of the texts added since the last call (some at least), in order."""
        m = self.model
        words, own, before, bounds = self._joined()
        starts = bounds[:-1]
        stats = self.files.words(words)
        ahead, count = stats[:, 4], stats[:, 5]
        unigram = _left(ahead, m.discounts[0]) / max(m.pairs, 1) + m.lower_rest / (m.distinct + 1)
        base = np.log10((count + 0.5) / (m.train_tokens + 0.5 * (m.distinct + 1)))
        total, share = _shares(stats, m.discounts[1])
        pair, p = gram_hash(words[before], words[own]), share[before] * unigram[own]
        ranges = range_of(pair, m.bits)
        for rows, arrays in self.files.visits(2, ranges):
            p[rows] += _left(_find(arrays[:_ARRAYS], pair[rows], 1)[:, 0], m.discounts[1]) / total[before[rows]]
        if m.order > 2:
            later = np.ones(len(own), bool)
            later[starts] = False
            later = np.flatnonzero(later)  # a text's first word has the start mark alone before it
            for at, arrays in self.files.visits(3, ranges[later - 1]):
                rows = later[at]
                context = pair[rows - 1]
                total, share = _shares(_find(arrays[_ARRAYS : 2 * _ARRAYS], context, 4), m.discounts[2])
                p[rows] = _left(_find(arrays[:_ARRAYS], gram_hash(context, words[own[rows]]), 1)[:, 0], m.discounts[2]) / total + share * p[rows]
        return {"n_tokens": np.diff(bounds), "n_known": _sums((count > 0).astype(np.int64)[own], starts), "base_score": _sums(base[own], starts), "score": _sums(np.log10(p), starts)}

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        self.add(texts)
        return self.score()

    def close(self) -> None:
        self.files.close()


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of what is between each start and the next."""
    return np.add.reduceat(x, starts) if len(x) else x


def perplexity(lm: Column) -> Column:
    """Of the struct that score() adds; infinite beyond the range of doubles."""
    return F.pow(F.lit(10.0), -lm["score"] / lm["n_tokens"])


_RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "lm", gather: int = GATHER) -> DataFrame:
    """docs with the struct `into` of each whole text: n_tokens, n_known, base_score, score (log10 probability).

    A text is its words and an end token; null and blank texts are the end token alone. perplexity is
    10 ** (-score / n_tokens). base_score is that of the add-a-half unigram model of the same counts. The
    probabilities after any words sum to 1 over the known tokens and one unknown token. Equal texts get equal
    scores, repeated rows stay, no rows give no rows, and a column `into` of docs is replaced. A range file that
    can't be read is an error, not a zero count. A task opens a file once for each `gather` of its tokens, whatever the
    number of ranges; a text longer than that is looked up whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        names = [f.name for f in _RESULT]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]

        def done() -> pa.Array:
            got = scorer.score()
            return pa.StructArray.from_arrays([pa.array(got[n], k) for n, k in zip(names, kinds, strict=True)], names)

        try:
            for batch in batches:
                for part in slices(batch):
                    scorer.add(part)
                    if scorer.tokens >= gather:
                        yield done()
            if scorer.waiting:
                yield done()
        finally:
            scorer.close()

    return docs.withColumn(into, scores(F.col(text)))
