"""Arrow batches in parts, so that what a worker holds goes by a part's size and not by a batch's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and tokens, that a worker turns into Python or numpy values at a time.
BYTES, TOKENS = 1_000_000, 250_000


def parts(rows: pa.Array, ends: np.ndarray, most: int) -> Iterator[pa.Array]:
    """Consecutive slices of rows of a size of about `most`, of one row at least; ends: the running sizes."""
    at = 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield rows.slice(at, to - at)
        at = to


def of_texts(texts: pa.Array, most: int = BYTES) -> Iterator[pa.Array]:
    """Slices of about `most` bytes; null texts stay."""
    yield from parts(texts, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), most)


def of_sentences(docs: pa.Array, most: int = TOKENS) -> Iterator[pa.Array]:
    """Slices of about `most` tokens of lists of sentences of tokens, copied, so that they begin at offset 0."""
    if not len(docs):
        return
    sentences = np.append(0, np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64)))
    tokens = np.append(0, np.cumsum(pc.list_value_length(docs.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = 0
    for part in parts(docs, tokens[sentences[1:]], most):
        yield docs.take(pa.array(np.arange(at, at + len(part))))
        at += len(part)
