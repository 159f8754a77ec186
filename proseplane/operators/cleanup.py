"""Deterministic plain-English clean-up and what it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.functions.batches import of_texts


def ordered_pairs(buckets: dict[str, tuple[tuple[str, str], ...]] = book.REPLACEMENTS) -> list[tuple[str, str, str]]:
    """(bucket, old, new) in the order of their use; malformed pairs and empty keys are left out."""
    out = []
    for bucket, pairs in buckets.items():
        good = [p for p in pairs if len(p) == 2 and all(isinstance(x, str) for x in p) and p[0]]
        out += [(bucket, a, b) for a, b in sorted(good, key=lambda p: -len(p[0]))]
    return out


def cleaned(text: Column, buckets: dict = book.REPLACEMENTS) -> Column:
    """Every pair replaced in turn, each seeing what the ones before it left; a text is searched for a key before it is replaced, which is quicker."""
    pairs = ordered_pairs(buckets)
    if not pairs:
        return text
    table = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for _, a, b in pairs])
    return F.aggregate(table, text, lambda c, p: F.when(F.contains(c, p["old"]), F.replace(c, p["old"], p["new"])).otherwise(c))


class OnePass:
    """The pairs replaced in turn, but looked for once: only the surroundings of the keys found are worked on.

    Far from every key nothing can change. Keys near one another, with the longest key's length around them, are
    replaced in turn by themselves; as long as that margin stays as it was, no key, old or new, can reach over it. Where it
    does not, the whole text is replaced in turn.
    """

    def __init__(self, buckets: dict = book.REPLACEMENTS) -> None:
        import ahocorasick

        self.pairs = [(a, b) for _, a, b in ordered_pairs(buckets)]
        self.longest = max((len(a) for a, _ in self.pairs), default=0)
        self.automaton = ahocorasick.Automaton()
        for a, _ in self.pairs:
            self.automaton.add_word(a, len(a))
        if self.pairs:
            self.automaton.make_automaton()

    def in_turn(self, text: str) -> str:
        for a, b in self.pairs:
            text = text.replace(a, b)
        return text

    def _apart(self, part: str, left: int, right: int) -> str | None:
        """In turn, within margins; None if a margin changes."""
        head, tail = part[:left], part[len(part) - right :]
        for a, b in self.pairs:
            if a in part:
                part = part.replace(a, b)
                if len(part) < left + right or not (part.startswith(head) and part.endswith(tail)):
                    return None
        return part

    def __call__(self, text: str) -> str:
        spans: list[list[int]] = []
        for last, size in self.automaton.iter(text) if self.pairs else ():
            begin, end = last + 1 - size, last + 1
            while spans and begin - spans[-1][1] <= 2 * self.longest:
                begin, end = min(begin, spans[-1][0]), max(end, spans[-1][1])
                spans.pop()
            spans.append([begin, end])
        out, at = [], 0
        for begin, end in spans:
            low, high = max(begin - self.longest, 0), min(end + self.longest, len(text))
            new = self._apart(text[low:high], begin - low if low else 0, high - end if high < len(text) else 0)
            if new is None:
                return self.in_turn(text)
            out += [text[at:low], new]
            at = high
        return "".join([*out, text[at:]])


def cleaned_once(text: str | Column, buckets: dict = book.REPLACEMENTS) -> Column:
    """cleaned(), by one pass over each text; null stays null."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = OnePass(buckets)
        for texts in batches:
            for part in of_texts(texts):
                yield pa.array([None if t is None else one(t) for t in part.to_pylist()], pa.string())

    return clean(F.col(text) if isinstance(text, str) else text)


def protected(text: Column, buckets: dict = book.REPLACEMENTS) -> Column:
    """cleaned, except in fenced blocks, inline code and web addresses, which stay as they are."""
    span = r"(?s)```.*?```|`[^`\n]+`|https?://[^\s)]+"
    between = F.split(text, span, -1)
    spans = F.regexp_extract_all(text, F.lit(span), F.lit(0))
    parts = F.transform(between, lambda x, i: F.concat(cleaned(x, buckets), F.coalesce(F.get(spans, i), F.lit(""))))
    return F.array_join(parts, "")


def dimension(spark, buckets: dict = book.REPLACEMENTS) -> DataFrame:
    """(ord, bucket, old, new) of the pairs in order."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(ordered_pairs(buckets))], "ord int, bucket string, old string, new string")


def leftovers(docs: DataFrame, text: str, key: str = "doc_id", buckets: dict = book.REPLACEMENTS, none: str | None = None) -> DataFrame:
    """(key, old): the keys that a text still contains; with `none` a row of that for each text, null ones too, that contains none."""
    olds = F.filter(F.array(F.lit(None).cast("string"), *[F.lit(a) for _, a, _ in ordered_pairs(buckets)]), lambda a: F.contains(F.col(text), a))
    rows = docs.select(key, F.explode_outer(olds).alias("old"))
    return rows.where("old is not null") if none is None else rows.withColumn("old", F.coalesce("old", F.lit(none)))
