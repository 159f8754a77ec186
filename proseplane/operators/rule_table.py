"""Style rules as rows of a table: other rules or languages need other rows, not another plan.

The rows go to the workers below a checked size. There one Aho-Corasick automaton of all literals of a profile reads
a text once, for all its word and phrase rules; which alternative of a rule counts at a place, and what guards it,
is settled among the few literals found. Pretence patterns are tried only where a literal that they begin with was
found. Measures of structure and rhythm come from the scan as columns, their bounds from the table. A document's
profile is a column too, so one plan scores a corpus of many languages, each by its own rules.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.functions import text as T
from proseplane.operators import rules

#: A table may have so many characters of patterns in all, some 100 bytes of an automaton each.
MOST_CHARACTERS = 4_000_000
SCHEMA = "profile string, position int, category string, rule string, kind string, weight int, soft int, hard int, patterns array<string>, ignore_case boolean, measure string, above boolean, bound double, least_length int, least_count int"
_FIELDS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
_ENTRY = pa.struct([("category", pa.string()), ("rule", pa.string()), ("weight", pa.int32()), ("count", pa.int32()), ("sample", pa.string()), ("threshold", pa.int32()), ("score", pa.float64())])


def rows_of(ruleset: book.RuleSet = book.DEFAULT, profile: str = "en") -> list[tuple]:
    """The rules of a set as rows of a table, in their order."""
    out: list[dict] = []
    add = lambda category, rule, kind, weight, **more: out.append({"category": category, "rule": rule, "kind": kind, "weight": weight, **more})
    for category, kind, group in (("blacklist_words", "words", ruleset.words), ("blacklist_phrases", "phrases", ruleset.phrases)):
        for r in group:
            add(category, r.name, kind, r.weight, soft=r.soft, hard=r.hard, patterns=list(r.patterns))
    for name, measure in (("heading_density", "headings"), ("list_density", "items")):
        if gate := getattr(ruleset, name):
            add("structural_rules", name, "measure", gate[0], measure=measure, above=True, bound=float(gate[2]), least_length=gate[1])
    if gate := ruleset.sentence_length_cv:
        add("rhythm_rules", "sentence_length_cv", "measure", gate[0], measure="sentence_cv", above=False, bound=float(gate[2]), least_count=gate[1])
    if gate := ruleset.short_sentence_ratio:
        add("rhythm_rules", "short_sentence_ratio", "measure", gate[0], measure="short", above=False, bound=float(gate[3]), least_length=gate[1], least_count=gate[2])
    if gate := ruleset.paragraph_uniformity:
        add("rhythm_rules", "paragraph_uniformity", "measure", gate[0], measure="paragraph_cv", above=False, bound=float(gate[2]), least_count=gate[1])
    if gate := ruleset.para_opening_enumeration:
        add("rhythm_rules", "para_opening_enumeration", "openers", gate[0], hard=gate[1], patterns=[gate[2]])
    for r in ruleset.pretence:
        add("fake_human", r.name, "regexes", r.weight, hard=r.hard, patterns=list(r.patterns))
    for r in ruleset.signals:
        add("soul_signals", r.name, "signals", r.weight, hard=r.least, least_length=r.min_length, patterns=[r.pattern], ignore_case=r.ignore_case)
    return [tuple({"profile": profile, "position": k, **row}.get(f) for f in _FIELDS) for k, row in enumerate(out)]


def as_table(spark: SparkSession, profiles: dict[str, book.RuleSet]) -> DataFrame:
    """Rules of several profiles as one table; write it as Parquet to keep it."""
    return spark.createDataFrame([row for profile, ruleset in profiles.items() for row in rows_of(ruleset, profile)], SCHEMA)


def _word(c: str) -> bool:
    return c.isalnum() or c in "_'"


def _folded(text: str) -> str:
    """Lower case, of the same length, with the letters folded that match i and s in any case."""
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


def anchor(pattern: str) -> str | None:
    """A literal that every match of a pattern begins with, three letters at least; None if it is not plain to see."""
    p = pattern.removeprefix(r"\b")
    depth = 0
    for k, c in enumerate(p):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0 and p[k - 1] != "\\":
            return None
    m = re.match(r"[A-Za-z]+", p)
    if not m:
        return None
    literal = m[0][:-1] if m.end() < len(p) and p[m.end()] in "?*{" else m[0]
    return literal.lower() if len(literal) >= 3 else None


class Matcher:
    """The rules of one profile, ready to read texts."""

    def __init__(self, rows: list[dict], strict: bool = False) -> None:
        import ahocorasick

        self.rows = sorted(rows, key=lambda r: r["position"])
        found: dict[str, list[tuple]] = {}
        self.regexes: dict[int, list[tuple[re.Pattern, bool]]] = {}
        self.lists: list[int] = []
        for i, r in enumerate(self.rows):
            if r["kind"] in ("words", "phrases"):
                phrases = r["kind"] == "phrases"
                ordered = sorted(r["patterns"], key=len if phrases else lambda p: len(re.escape(p)), reverse=True)
                self.lists.append(i)
                for k, p in enumerate(ordered):
                    guards = (strict or k == 0, strict or k == len(ordered) - 1)
                    found.setdefault(_folded(p), []).append((i, k, *guards, not phrases and " " in p))
            elif r["patterns"]:
                flags = re.IGNORECASE if r["ignore_case"] is not False else 0
                self.regexes[i] = []
                for k, p in enumerate(r["patterns"]):
                    begin = anchor(p) if r["kind"] == "regexes" else None
                    self.regexes[i].append((re.compile(p, flags), begin is None))
                    if begin is not None:
                        found.setdefault(begin, []).append((i, k))
        self.automaton = ahocorasick.Automaton()
        for literal, entries in found.items():
            self.automaton.add_word(literal, (len(literal), entries))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def _literals(self, body: str) -> tuple[dict[int, tuple[int, str]], set[tuple[int, int]]]:
        """Count and first hit of each list rule that has any, and the patterns whose anchors are there."""
        if not self.any:
            return {}, set()
        low = _folded(body)
        gaps = [(m.start(), m.end()) for m in _GAPS.finditer(low)]
        read = _GAPS.sub(" ", low) if gaps else low
        met: dict[int, list[tuple]] = {}
        anchors: set[tuple[int, int]] = set()
        for last, (size, entries) in self.automaton.iter(read):
            for e in entries:
                if len(e) == 2:
                    anchors.add(e)
                else:
                    met.setdefault(e[0], []).append((last + 1 - size, e[1], last + 1, *e[2:]))
        if not met:
            return {}, anchors
        # where blanks were drawn together, places behind them are so much further on in the text
        places, shifts, moved = [], [], 0
        for a, b in gaps:
            moved += b - a - 1
            places.append(b - moved)
            shifts.append(moved)
        there = lambda at: at + (shifts[k - 1] if (k := bisect_right(places, at)) else 0)
        out = {}
        for i, hits in met.items():
            n, upto, first = 0, 0, None
            for begin, _, end, left, right, exact in sorted(hits):
                if begin < upto or (left and begin and _word(read[begin - 1])) or (right and end < len(read) and _word(read[end])):
                    continue
                a, b = there(begin), there(end - 1) + 1
                if exact and low[a:b] != read[begin:end]:
                    continue
                n, upto, first = n + 1, end, first or (a, b)
            if first:
                out[i] = (n, body[first[0] : first[1]])
        return out, anchors

    def violations(self, body: str, measures: dict[str, tuple[float | None, int, int]], has_notes: bool = False) -> list[dict]:
        """In the order of the table; measures: (value, size for the gate, count shown) by name."""
        lists, anchors = self._literals(body)
        out = []

        def fired(r: dict, count: int, sample: str | None, threshold: int | None, score: float) -> None:
            out.append({"category": r["category"], "rule": r["rule"], "weight": r["weight"], "count": count, "sample": sample, "threshold": threshold, "score": float(score)})

        for i, r in enumerate(self.rows):
            kind, w = r["kind"], r["weight"]
            if kind in ("words", "phrases"):
                if i in lists:
                    n, sample = lists[i]
                    fired(r, n, sample, r["soft"] if r["hard"] is None else r["hard"], _ladder(n, w, r["soft"], r["hard"]))
            elif kind == "measure":
                value, size, shown = measures[r["measure"]]
                enough = len(body) >= (r["least_length"] or 0) and size >= (r["least_count"] or 0)
                if enough and value is not None and (value > r["bound"] if r["above"] else value < r["bound"]):
                    fired(r, shown, _sample(r, value, shown, size), int(r["bound"]) if r["measure"] == "headings" else int(r["bound"] * 100), w)
            elif kind == "openers":
                n = sum(1 for p in _paragraphs(body) if self.regexes[i][0][0].match(p))
                if n > r["hard"]:
                    fired(r, n, book.SAMPLES["para_opening_enumeration"].format(top=r["hard"]) % n, r["hard"], (n - r["hard"]) * w)
            elif kind == "regexes" and not has_notes:
                n, sample = 0, None
                for k, (pattern, always) in enumerate(self.regexes[i]):
                    if always or (i, k) in anchors:
                        hits = [m[0] for m in pattern.finditer(body)]
                        n += len(hits)
                        sample = sample or (hits[0] if hits else None)
                if n:
                    fired(r, n, sample, r["hard"], _ladder(n, w, None, r["hard"]))
            elif kind == "signals" and len(body) >= (r["least_length"] or 0):
                n = sum(1 for _ in islice(self.regexes[i][0][0].finditer(body), r["hard"]))
                if n < r["hard"]:
                    fired(r, n, book.SAMPLES["signals"].format(least=r["hard"]) % n, r["hard"], (r["hard"] - n) * w)
        return out


_GAPS = re.compile(r"\s{2,}|[^\S ]")
_BREAK = re.compile(r"\n\s*\n+")


def _paragraphs(body: str) -> list[str]:
    return [p for p in (x.strip() for x in _BREAK.split(body.replace("\\n", "\n"))) if p]


def _ladder(n: int, weight: int, soft: int | None, hard: int | None) -> float:
    low = soft is not None and n <= soft and (hard is None or n <= hard)
    return n * weight * (0.5 if low else 1.0)


def _sample(r: dict, value: float, shown: int, size: int) -> str | None:
    form = book.SAMPLES.get(r["rule"])
    if form is None:
        return None
    given = {"headings": (shown, value), "items": (shown, size, value * 100), "short": (value * 100,)}.get(r["measure"], (value,))
    return form.format(top=r["bound"]) % given


@lru_cache(maxsize=8)
def _matchers(key: str, strict: bool) -> dict[str, Matcher]:
    import json

    by: dict[str, list[dict]] = {}
    for row in json.loads(key):
        by.setdefault(row[0], []).append(dict(zip(_FIELDS, row, strict=True)))
    return {profile: Matcher(rows, strict) for profile, rows in by.items()}


def _measures() -> Column:
    """(value, size for the gate, count shown) of each measure, from the columns of rules.prepared."""
    one = lambda name, value, size, shown: F.struct(value.cast("double").alias("value"), size.cast("int").alias("size"), shown.cast("int").alias("shown")).alias(name)
    words, lengths = F.col("p_words"), F.col("p_lengths")
    short = F.when(F.size(words) > 0, F.size(F.filter(words, lambda n: n < 6)) / F.size(words))
    return F.struct(
        one("headings", F.col("p_headings") * 1000 / F.greatest("p_length", F.lit(1)), F.col("p_headings"), F.col("p_headings")),
        one("items", F.when(F.col("p_lines") > 0, F.col("p_items") / F.col("p_lines")), F.col("p_lines"), F.col("p_items")),
        one("sentence_cv", T.variation(words), F.size(words), F.lit(1)), one("short", short, F.size(words), F.lit(1)),
        one("paragraph_cv", T.variation(lengths), F.size(lengths), F.lit(1)),
    )


def violations_by_table(docs: DataFrame, table: DataFrame, text: str = "text", profile: str | Column = "en", has_notes: Column | None = None, strip_code: bool = True, strict: bool = False) -> DataFrame:
    """docs with `violations` by the rules that the table has for each row's profile; a name, or a column.

    Blank and null texts, and profiles without rows, have none. Rows of the table with one position are in any order.
    Raises ValueError for a table of more than MOST_CHARACTERS. Equal texts have equal violations, repeated rows stay.
    """
    import json

    size = table.agg(F.sum(F.aggregate(F.coalesce("patterns", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, p: a + F.length(p) + 100) + 200)).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"the rules have {size} characters, more than {MOST_CHARACTERS}")
    rows = sorted((tuple(r) for r in table.select(*_FIELDS).collect()), key=lambda r: (r[0] or "", r[1]))  # under the bound
    shared = docs.sparkSession.sparkContext.broadcast(json.dumps(rows))

    @F.arrow_udf("array<" + rules.VIOLATION + ">")
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        by = _matchers(shared.value, strict)
        for profiles, bodies, measures, notes in batches:
            out = []
            for p, body, m, n in zip(profiles.to_pylist(), bodies, measures, notes.to_pylist(), strict=True):
                body = body.as_py()
                matcher = by.get(p)
                if matcher is None or not (body or "").strip():
                    out.append([])
                else:
                    out.append(matcher.violations(body, {k: tuple(v.values()) for k, v in m.as_py().items()}, bool(n)))
            yield pa.array(out, pa.list_(_ENTRY))

    # of a profile only its measures, no rule, is in the plan
    # measures are a column of their own, which the mark keeps out of the arguments: the planner does not see a function that has lambdas there
    ready = rules.prepared(docs, text, strip_code, book.EMPTY).withColumn("p_measures", F.when(F.monotonically_increasing_id() >= 0, _measures()))
    which = F.lit(profile) if isinstance(profile, str) else profile
    notes = F.lit(False) if has_notes is None else F.coalesce(has_notes, F.lit(False))
    return ready.withColumn("violations", found(which, F.when(F.col("p_blank"), F.lit("")).otherwise(F.col("p_body")), F.col("p_measures"), notes))


def scored_by_table(docs: DataFrame, table: DataFrame, text: str = "text", profile: str | Column = "en", has_notes: Column | None = None, strip_code: bool = True, strict: bool = False) -> DataFrame:
    """docs with total, level, violations, n_violations and text_length as rules.scored gives them, by a table's rules."""
    kept = [c for c in docs.columns if c not in ("total", "level", "violations", "n_violations", "text_length")]
    got = violations_by_table(docs, table, text, profile, has_notes, strip_code, strict)
    raw = F.aggregate("violations", F.lit(0.0), lambda a, v: a + v["score"])
    got = got.withColumn("total", F.least(F.lit(100.0), raw / F.greatest(F.lit(1.0), F.col("p_length") / rules.UNIT)))
    return got.select(*[F.col(f"`{c}`") for c in kept], "total", rules.band_key(F.col("total")).alias("level"), "violations", F.size("violations").alias("n_violations"), F.when(F.col("p_blank"), F.lit(0)).otherwise(F.col("p_length")).alias("text_length"))
