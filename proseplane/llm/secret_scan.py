"""Secrets in texts and in what texts encode: a worklist of decoded layers, each scanned by the same patterns.

A text is the first layer. A layer gives further ones: its percent escapes undone, its Unicode escapes undone, each
base64 run decoded, each compressed stream unpacked. Layers come off the worklist until none is left; one that was
seen at its place before is not looked at again, so a stream that unpacks to itself ends too. Layers are read as
Latin-1, byte by byte, for all that the patterns ask for is ASCII. Of each character of a layer the place in the text
that it comes from is known, so that what is found in any layer is a span of the text.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseplane.llm.common import packed_rows

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_VALUE = 8

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
#: Runs that may be base64, in lines of one length where they are wrapped.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/]{64}\r?\n)+|(?:[A-Za-z0-9+/]{76}\r?\n)+)?[A-Za-z0-9+/_-]{16,}")
_MAGIC = re.compile("\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_PLAIN64 = {ord("-"): "+", ord("_"): "/", ord("\r"): None, ord("\n"): None}


@dataclass(frozen=True)
class Config:
    #: Characters that the layers of one text may have in all: so many times its own, and so many besides. Beyond
    #: them its layers stay as far as they came, and the row says so (`complete` is false).
    times: int = 32
    besides: int = 1 << 26


@dataclass(frozen=True)
class Layer:
    chars: str
    #: Of each character where its part of the text begins and ends; None: the text itself.
    begins: np.ndarray | None
    ends: np.ndarray | None
    #: How it was reached, as in url>base64.
    via: tuple[str, ...]

    def span(self, begin: int, end: int) -> tuple[int, int]:
        if self.begins is None or self.ends is None:
            return begin, end
        return int(self.begins[begin:end].min()), int(self.ends[begin:end].max())

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        if self.begins is None or self.ends is None:
            at = np.arange(len(self.chars) + 1)
            return at[:-1], at[1:]
        return self.begins, self.ends


def matches(chars: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of the leftmost non-overlapping matches of each kind that are long enough."""
    for m in _ASSIGN.finditer(chars):
        if m.end(1) - m.start(1) >= LEAST_VALUE:
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(chars):
            yield kind, m.start(), m.end()


def _replaced(layer: Layer, pattern: re.Pattern, decoded, via: str) -> Layer | None:
    """The layer with each match's parts decoded: decoded(match) gives (character, begin, end in the layer)."""
    if not pattern.search(layer.chars):
        return None
    begins, ends = layer.places()
    chars, b, e, at = [], [], [], 0
    for m in pattern.finditer(layer.chars):
        chars.append(layer.chars[at : m.start()])
        b.append(begins[at : m.start()])
        e.append(ends[at : m.start()])
        one = decoded(m)
        chars += [c for c, _, _ in one]
        b.append(np.array([begins[i] for _, i, _ in one], np.int64))
        e.append(np.array([ends[j - 1] for _, _, j in one], np.int64))
        at = m.end()
    chars.append(layer.chars[at:])
    return Layer("".join(chars), np.concatenate([*b, begins[at:]]), np.concatenate([*e, ends[at:]]), (*layer.via, via))


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    return [(chr(int(m[0][k + 1 : k + 3], 16)), m.start() + k, m.start() + k + 3) for k in range(0, len(m[0]), 3)]


def _escaped(m: re.Match) -> list[tuple[str, int, int]]:
    code = int(next(g for g in m.groups() if g), 16)
    return [(chr(code) if code < 0x110000 else "\ufffd", m.start(), m.end())]


def _base64(layer: Layer) -> Iterator[Layer]:
    """The bytes of each run that may be base64, from each of the four places where its groups of four may begin."""
    places = None
    for m in _BASE64.finditer(layer.chars):
        own = m[0].translate(_PLAIN64)
        kept = np.flatnonzero(np.frombuffer(m[0].encode("latin-1"), np.uint8) > 13) + m.start() if len(own) < len(m[0]) else None
        begins, ends = places = places or layer.places()
        for shift in range(4):
            body = own[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            try:
                data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            except binascii.Error:
                continue
            if not data:
                continue
            at = np.arange(len(data))
            first, last = shift + at // 3 * 4 + at % 3, shift + at // 3 * 4 + at % 3 + 1  # byte k of three is in characters k and k + 1
            first, last = (kept[first], kept[last]) if kept is not None else (first + m.start(), last + m.start())
            yield Layer(data.decode("latin-1"), begins[first], ends[last], (*layer.via, "base64"))


def _reader(magic: str) -> tuple[str, object]:
    """Name and decompressor of a stream, by its first character."""
    if magic == "\x1f":
        return "gzip", zlib.decompressobj(31)
    if magic == "x":
        return "zlib", zlib.decompressobj(15)
    return ("bz2", bz2.BZ2Decompressor()) if magic == "B" else ("xz", lzma.LZMADecompressor(memlimit=1 << 28))


def _unpacked(layer: Layer, most: int) -> Iterator[tuple[Layer, bool]]:
    """Each compressed stream of a decoded layer, and whether it has at most so many bytes; a broken one as far as it can be read.

    A text as it stands holds no compressed bytes, so only what was decoded from it is looked at.
    """
    places = None
    for m in _MAGIC.finditer(layer.chars if layer.via else ""):
        name, opened = _reader(m[0][0])
        out, size, at = [], 0, m.start()
        try:
            while at < len(layer.chars) and not opened.eof and size <= most:
                data = layer.chars[at : at + 4096].encode("latin-1", "replace")
                at += len(data)
                while data is not None and not opened.eof and size <= most:
                    piece = opened.decompress(data, most - size + 1)
                    out.append(piece)
                    size += len(piece)
                    # what is left of the input, or in the decompressor, when the output was as long as asked for
                    data = getattr(opened, "unconsumed_tail", None) or (None if getattr(opened, "needs_input", True) else b"")
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            pass
        text = b"".join(out)[:most].decode("latin-1")
        if text:
            begins, ends = places = places or layer.places()
            end = at - len(opened.unused_data if opened.eof else b"")
            yield Layer(text, np.full(len(text), begins[m.start()]), np.full(len(text), ends[end - 1]), (*layer.via, name)), size <= most


def find_secrets(text: str | None, config: Config = Config()) -> tuple[list[tuple[str, int, int, str]], bool]:
    """(kind, begin, end, via) of a text's secrets by place, and whether every layer was read; via is empty in the text itself.

    A span that several layers show comes once, by the first of them; so what is in the text as it stands comes as that.
    """
    text = text or ""
    found: dict[tuple[str, int, int], str] = {}
    todo, seen = deque([Layer(text, None, None, ())]), set()
    left, complete = config.times * len(text) + config.besides, True
    while todo:
        layer = todo.popleft()
        key = (hash(layer.chars), len(layer.chars), *(layer.span(0, len(layer.chars)) if layer.chars else (0, 0)))
        if key in seen:
            continue
        seen.add(key)
        if layer.via:
            left -= len(layer.chars)
            if left < 0:
                complete = False
                break
        for kind, begin, end in matches(layer.chars):
            found.setdefault((kind, *layer.span(begin, end)), ">".join(layer.via))
        todo += [x for x in (_replaced(layer, _PERCENT, _percent, "url"), _replaced(layer, _UNICODE, _escaped, "unicode")) if x]
        todo += _base64(layer)
        for inner, whole in _unpacked(layer, max(left, 0)):
            todo.append(inner)
            complete &= whole
    rows = [(kind, begin, end, via) for (kind, begin, end), via in found.items()]
    return sorted(rows, key=lambda r: (r[1], KINDS.index(r[0]), r[2])), complete


_ENTRY = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("via", pa.string())])
_FOUND = pa.struct([("secrets", pa.list_(_ENTRY)), ("complete", pa.bool_())])


def scan(docs: DataFrame, text: str = "text", config: Config = Config()) -> DataFrame:
    """docs with `secrets`, an array of (kind, begin, end, via) by place, and `complete`.

    Places count code points, the end is exclusive; via is empty for what the text shows as it stands, else names
    the decodings, as in url>base64>gzip. complete is false where a text's layers outgrow the bound of the config,
    as in an archive bomb: what its text itself shows is whole even then. Null and empty texts have none, equal texts
    have equal ones, repeated rows stay, no rows give no rows; columns of these names are replaced. A text is one
    row of one task, whatever its length, and takes memory for its layers one at a time and those that wait.
    """

    @F.arrow_udf("struct<secrets:array<struct<kind:string,begin:bigint,end:bigint,via:string>>,complete:boolean>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                secrets, complete = find_secrets(t.as_py(), config)
                rows.append({"secrets": [dict(zip(("kind", "begin", "end", "via"), s, strict=True)) for s in secrets], "complete": complete})
            yield pa.array(rows, _FOUND)

    scanned = packed_rows(docs, found(F.col(text)).alias("_found"))
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("secrets", "complete")]
    return scanned.select(*own, "_found.secrets", "_found.complete")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Scanned docs with every span of the text replaced by the mark; spans that overlap or touch become one."""
    joined = F.aggregate(
        "secrets", F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["begin"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["begin"].alias("begin"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(s["begin"], s["end"])))),
    )
    kept = F.aggregate(
        joined, F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["t"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["begin"] - a["at"]).cast("int")), F.lit(mark)).alias("t"), s["end"].alias("at")),
        lambda a: F.concat(a["t"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))),
    )
    return docs.withColumn(text, F.when(F.size("secrets") > 0, kept).otherwise(F.col(text)))
