"""Segmentation of prose as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, and only \n ends a line.
FLAGS = "(?Ud)"
BLANK = r"[\s\x1c-\x1f]"
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
SENTENCE_BREAK = rf"(?<=[.!?]){BLANK}+(?=[A-Z\"'(\[])|\n+"
#: The characters that BLANK matches under FLAGS.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PARAGRAPH_BREAK = rf"\n{BLANK}*\n+"


def stripped(s: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(s, F.lit(BLANKS))


def is_blank(s: Column) -> Column:
    return ~F.rlike(F.coalesce(s, F.lit("")), F.lit(rf"{FLAGS}[^\s\x1c-\x1f]"))


def without_code(s: Column) -> Column:
    """Without fenced blocks, then without inline code."""
    return F.regexp_replace(F.regexp_replace(s, r"(?s)```.*?```", ""), r"`[^`\n]+`", "")


def normalised(s: Column) -> Column:
    r"""With the two characters \n read as a line break."""
    return F.replace(s, F.lit("\\n"), F.lit("\n"))


def tokens(s: Column) -> Column:
    """Lower-case words of ASCII letters; one apostrophe may join two parts."""
    return F.transform(F.regexp_extract_all(normalised(s), F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))


def token_count(s: Column) -> Column:
    return F.regexp_count(normalised(s), F.lit(TOKEN))


def _parts(s: Column, at: str) -> Column:
    return F.filter(F.transform(F.split(normalised(s), f"{FLAGS}(?={BLANK})(?:{at})", -1), stripped), lambda x: x != "")  # a break begins with a blank, which few places do


def sentences(s: Column) -> Column:
    return _parts(s, SENTENCE_BREAK)


def paragraphs(s: Column) -> Column:
    return _parts(s, PARAGRAPH_BREAK)


def lower_folded(s: Column) -> Column:
    """Lower case with the letters folded that match i and s in any case."""
    for a, b in (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.lower(s)


def once(c: Column) -> Column:
    """c, marked as non-deterministic, so that it is evaluated where it stands.

    The optimiser would else write it out again in every filter that is pushed below it. Filters on other
    columns stop there too: filter documents before scoring them.
    """
    return F.when(F.rand(0) >= 0, c)


def mean(values: Column) -> Column:
    """Of an array of numbers; null if it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def variation(values: Column) -> Column:
    """Population standard deviation over mean; 0 for under two values or mean 0."""

    def spread(v: Column, m: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v))

    def of(v: Column) -> Column:
        bound = F.transform(F.array(mean(v)), lambda m: F.when(m != 0, spread(v, m) / m))
        return F.when(F.size(v) >= 2, F.coalesce(F.element_at(bound, 1), F.lit(0.0))).otherwise(F.lit(0.0))

    return F.when(values.isNotNull(), F.element_at(F.transform(F.array(values), of), 1)).otherwise(F.lit(0.0))


def word_pattern(words: tuple[str, ...], strict: bool = False) -> str:
    """Words as alternatives, the longest first.

    The guards against word characters stand before the first alternative and behind the last only, as the
    scores need them; strict puts them around all.
    """
    ordered = sorted(map(re.escape, words), key=len, reverse=True)
    return _guarded(ordered, strict)


def phrase_pattern(phrases: tuple[str, ...], strict: bool = False) -> str:
    """Phrases as alternatives, the longest first, with any blanks between words; guarded like words."""
    ordered = sorted(phrases, key=len, reverse=True)
    return _guarded([f"{BLANK}+".join(map(re.escape, p.split(" "))) for p in ordered], strict)


def _guarded(ordered: list[str], strict: bool) -> str:
    if not ordered:
        return r"(?!)"
    body = "|".join(ordered)
    return rf"(?<![\w'])(?:{body})(?![\w'])" if strict else rf"(?<![\w']){body}(?![\w'])"


def holds_any(s: Column, texts: list[str]) -> Column:
    """Whether s holds one of the texts; much quicker than a pattern of them."""
    return F.exists(F.array(*map(F.lit, texts)), lambda x: F.contains(s, x)) if texts else F.lit(False)


def fixed_part(pattern: str) -> str:
    """The longest run of plain characters that every match of a regular expression holds, in any case; empty if none is sure."""
    if re.search(r"\\[^\WbBdDsSwWAzZ]|\(\?[a-zA-Z]*x", pattern):  # characters by number or class, quotations, free spacing
        return ""
    alone = re.sub(r"\[[^\]]*\]|\\.", lambda m: "\0" if m[0][0] == "[" or m[0][1].isalnum() else "\1", pattern)
    while (inner := re.sub(r"\([^()]*\)", "\0", alone)) != alone:
        alone = inner
    if "|" in alone:
        return ""
    return max(re.split("[\0\1.^$]", re.sub(r".(?:[*?]|\{[^}]*\})", "\0", alone.replace("+", "\0"))), key=len)


def first_letters(patterns: tuple[str, ...]) -> str:
    """A look-ahead for any pattern's first letter, which spares most places the alternatives."""
    return "(?=[" + "".join(sorted({p[0] for p in patterns})) + "])"
