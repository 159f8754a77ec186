"""Words, sentences and paragraphs of Arrow batches of texts, as arrays.

One pass over a batch's bytes finds what text.tokens, text.sentences and text.paragraphs find by their patterns: a run
of blanks parts sentences if it holds a line's end, or stands between [.!?] and an opening character, and paragraphs
if it holds two line's ends. So every part of a text that has a paragraph is made of whole sentences, and words never
cross either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from proseplane.functions import text as T

LETTER, BLANK, LINE, END, OPEN, COMMA, MARK, EDGE = (1 << k for k in range(8))
#: Kinds of the characters below 0x4000; no other is a blank or a mark.
_KINDS = np.zeros(0x4000, np.uint8)
for _kind, _characters in (
    (LETTER, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (BLANK, T.BLANKS), (LINE, "\n"), (END, ".!?"),
    (OPEN, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\"'(["), (COMMA, ","), (MARK, ";:—–()"),
):
    for _c in _characters:
        _KINDS[ord(_c)] |= _kind
_BYTES = np.where(np.arange(256) < 128, _KINDS[:256], 0).astype(np.uint8)


@dataclass(frozen=True)
class Segments:
    """Of some texts: `words` gives each word's place in `known`, the distinct words; the others what a thing is part of."""

    texts: int
    known: pa.StringArray
    words: np.ndarray
    text_of: np.ndarray
    sentence_of: np.ndarray
    paragraph_of: np.ndarray
    text_of_sentence: np.ndarray
    text_of_paragraph: np.ndarray
    commas: np.ndarray
    marks: np.ndarray


def _kinds(b: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; all bytes of a longer blank are blanks, the first of a longer mark is one."""
    kinds = _BYTES[b]
    if not len(b) or b.max() < 0xC2:
        return kinds
    for size, low, high in ((2, 0xC2, 0xC2), (3, 0xE1, 0xE3)):
        at = np.flatnonzero((b >= low) & (b <= high))
        at = at[at + size <= len(b)]
        code = b[at].astype(np.int64) & (0xFF >> (size + 1))
        for k in range(1, size):
            code = code << 6 | (b[at + k] & 0x3F)
        kind = _KINDS[code]
        kinds[at[kind == MARK]] = MARK
        for k in range(size):
            kinds[at[kind == BLANK] + k] = BLANK
    return kinds


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end, of an array that begins and ends outside of them."""
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return turns[::2], turns[1::2]


def segmented(texts: pa.Array) -> Segments:
    """Null texts are empty. The two characters \\n are a line's end to words and sentences."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n, at = len(texts), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    lines = np.flatnonzero((b[:-1] == 92) & (b[1:] == 110))
    lines = lines[~np.isin(lines + 1, at)]
    if len(lines):
        b = b.copy()
        b[lines] = 10
        b, at = np.delete(b, lines + 1), at - np.searchsorted(lines + 1, at)
    kinds, b = np.insert(_kinds(b), at, EDGE), np.insert(b, at, 0)  # an edge before each text and behind the last
    edges = at + np.arange(n + 1)
    owner = lambda places: np.searchsorted(edges, places, "right") - 1
    each = lambda kind: np.bincount(owner(np.flatnonzero(kinds & kind)), minlength=n)

    letter = (kinds & LETTER) != 0
    start, end = _runs(letter)
    linked = (start[1:] == end[:-1] + 1) & (b[end[:-1]] == 39)  # by one apostrophe; of a chain, every second run goes with the one before
    order = np.arange(len(start))
    first = (order - np.maximum.accumulate(np.where(np.append(False, linked)[: len(start)], 0, order))) % 2 == 0
    end = np.where(np.append(linked, False)[: len(start)], np.append(end[1:], 0)[: len(start)], end)
    start, end = start[first], end[first]
    turn = np.zeros(len(b) + 1, np.int8)
    turn[start], turn[end] = 1, -1
    sizes = np.append(0, np.cumsum(end - start)).astype(np.int32)
    letters = np.where(letter, b | 0x20, b)[np.cumsum(turn[:-1], dtype=np.int8).view(bool)]
    coded = pa.StringArray.from_buffers(len(start), pa.py_buffer(sizes), pa.py_buffer(letters)).dictionary_encode()
    text_of = owner(start)

    from_, to = _runs((kinds & BLANK) != 0)
    ends = np.flatnonzero(kinds & LINE)
    held = np.searchsorted(ends, to) - np.searchsorted(ends, from_)
    before, behind = kinds[from_ - 1], kinds[to]
    filled = np.diff(edges) > 1
    filled[owner(from_[(before & EDGE != 0) & (behind & EDGE != 0)])] = False
    within = (before | behind) & EDGE == 0

    def parts(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each word, and the text of each part."""
        owners = owner(breaks)
        return np.searchsorted(breaks, start) + np.cumsum(filled)[text_of] - 1, np.repeat(np.arange(n), filled + np.bincount(owners, minlength=n))

    sentence_of, text_of_sentence = parts(from_[within & ((held > 0) | ((before & END != 0) & (behind & OPEN != 0)))])
    paragraph_of, text_of_paragraph = parts(from_[within & (held > 1)])
    return Segments(n, coded.dictionary, coded.indices.to_numpy().astype(np.int64), text_of, sentence_of, paragraph_of, text_of_sentence, text_of_paragraph, each(COMMA), each(MARK))
