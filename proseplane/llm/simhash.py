"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in three bits or
fewer have one segment in which they differ in at most one bit, so they agree in one of its 32 variants
with a deleted bit. Every distinct fingerprint is indexed under its 64 variants, variants meet by equality,
and each meeting is verified on all 64 bits. A bucket gives a spanning forest of its links, never its pairs,
so that groups of any size cost one row for each member; the forests are joined by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseplane.llm.common import cut, packed_rows
from proseplane.llm.components import connected_components

BITS = 64
SEGMENT = 32
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The SimHash of one text: a majority vote of the bits of its shingles' XXH64, 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        sizes = list(map(len, words))
        starts = list(accumulate((n + 1 for n in sizes), initial=0))
        ends = [s - 1 for s in starts[SHINGLE:]]
        hashes = [xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends, strict=False)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for any length of text
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, fp) sorted by sig: edges of a spanning forest of each bucket's links."""
    left_sig, left_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        sig = np.concatenate([left_sig, batch.column(0).to_numpy()])
        fp = np.concatenate([left_fp, batch.column(1).to_numpy().view(np.uint64)])
        if not len(sig):
            continue
        last = int(np.searchsorted(sig, sig[-1], "left"))  # its bucket may go on in the next batch
        yield from _bucket_edges(sig[:last], fp[:last])
        left_sig, left_fp = sig[last:], fp[last:]
    yield from _bucket_edges(left_sig, left_fp)


def _bucket_edges(sig: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(sig) < 2:
        return
    bounds = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]])
    sizes = np.diff(bounds)
    us, vs = [], []
    pairs = bounds[:-1][sizes == 2]
    near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= _RADIUS
    us.append(fp[pairs[near]])
    vs.append(fp[pairs[near] + 1])
    for at, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
        own = np.unique(fp[at : at + n])
        if len(own) <= LARGE:
            _forest(own, us, vs)
            continue
        # the bits of the other segment differ in three places at most, so one of its four bytes is the same
        other = np.uint64(SEGMENT * (1 - (int(sig[at]) >> SEGMENT) // SEGMENT))
        for k in range(4):
            byte = ((own >> (other + np.uint64(8 * k))) & np.uint64(255)).astype(np.uint8)
            by = np.argsort(byte, kind="stable")
            for part in np.split(own[by], np.flatnonzero(np.diff(byte[by])) + 1):
                _forest(part, us, vs)
    u, v = np.concatenate(us), np.concatenate(vs)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def _forest(rest: np.ndarray, us: list[np.ndarray], vs: list[np.ndarray]) -> None:
    """Links of distinct fingerprints: each leaves `rest` as soon as a link reaches it."""
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(rest ^ x) <= _RADIUS
            if hit.any():
                found = rest[hit]
                us.append(np.full(len(found), x, np.uint64))
                vs.append(found)
                queue.extend(found)
                rest = rest[~hit]


_RADIUS = 3
#: Buckets of more fingerprints are split by bytes of the other segment.
LARGE = 1_024


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """docs with the fingerprint of each whole text as a signed long; null and blank texts give 0.

    Texts are read whole, equal texts get equal fingerprints, repeated rows stay, no rows give no rows. A bit that is 1
    in just half of the shingles' hashes is 0. A column `into` of docs is replaced.
    """
    return docs.withColumn(into, _fingerprints(F.col(text)))


def link_fingerprints(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints which a chain of links connects; fps: distinct."""
    mask = (1 << SEGMENT) - 1
    variants = fps.select(F.col(fp).alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("k")).select(
        "fp", "k", F.expr(f"shiftrightunsigned(fp, cast({SEGMENT} * (k div {SEGMENT}) as int)) & {mask}L").alias("seg"), F.expr(f"cast(k % {SEGMENT} as int)").alias("i")
    )
    sig = F.expr(f"shiftleft(cast(k as bigint), {SEGMENT}) | (seg & (shiftleft(1L, i) - 1)) | shiftleft(shiftright(seg, i + 1), i)")
    met = variants.select(sig.alias("sig"), "fp").repartition("sig").sortWithinPartitions("sig")
    return met.mapInArrow(_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its id, fingerprint (signed long fp), root (the class) and component_id.

    component_id is the smallest id in the class of fingerprints linked at three differing bits or fewer.
    Null and blank texts have fingerprint 0 and link like any other. Rows with a null id get the smallest
    known id of their class, or null. Repeated rows stay repeated. No rows give no rows. Other columns of
    docs are ignored. An id column that is called fp, root or component_id is returned as doc_id.
    """
    name = "doc_id" if doc_id.lower() in ("fp", "root", "component_id") else doc_id
    marked = cut(fingerprints(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text").drop("_text"))
    classes = cut(marked.groupBy("fp").agg(F.min("_id").alias("first_id")))
    edges = cut(link_fingerprints(classes.select("fp")))
    roots = connected_components(edges)
    classes = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classes.select("fp", "root").join(firsts, "root")
    return marked.join(classes, "fp").select(F.col("_id").alias(name), "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class the one with the least id; where that id repeats, of the least hash.

    A class of null ids alone keeps one row. Columns are those of docs, with any names.
    """
    named = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found = cut(near_duplicates(named, "_id", "_text").select("_id", F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("_id").eqNullSafe(F.col("component_id")).alias("_stays")))
    ids = found.groupBy("_id").agg(F.count("*").alias("_n"), F.max("_stays").alias("_any"))
    once = ids.where("_n = 1 and _any and _id is not null").select("_id")
    own = packed_rows(docs, F.col(doc_id).alias("_own_id"), F.col(text).alias("_text"))
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    kept = own.join(once, F.col("_own_id") == F.col("_id"), "left_semi").select(columns)
    several = ids.where("_any and (_n > 1 or _id is null)").select("_id")
    if several.isEmpty():
        return kept
    # rows that share an id are told apart by their fingerprints; of a class one stays
    stay = found.where("_stays").select(F.col("_id").alias("_stay_id"), F.col("_fp").alias("_stay_fp"), "_root").distinct()
    rows = fingerprints(own.join(several, F.col("_own_id").eqNullSafe(F.col("_id")), "left_semi"), "_text", "_own_fp")
    one = rows.join(stay, F.col("_own_id").eqNullSafe(F.col("_stay_id")) & (F.col("_own_fp") == F.col("_stay_fp"))).groupBy("_root").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return kept.unionByName(one.select(columns))
