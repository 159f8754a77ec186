"""Rewrite and review prompts as column expressions, and the review's answers."""

from __future__ import annotations

import enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseplane.functions.rulebook import REPORT

MOST_VIOLATIONS, MOST_SAMPLE = 30, 60


class Strength(str, enum.Enum):
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"


def strength_of(strength: Strength | str | None = None, aggressive: bool | None = None) -> Strength:
    """An explicit strength wins; else aggressive means high; else medium. Unknown names raise ValueError."""
    if strength is not None:
        return Strength(strength)
    return Strength.HIGH if aggressive else Strength.MEDIUM


SECTIONS = {
    "core": "## Core\nKeep every fact, number, name and quotation. Say plain things plainly. Vary sentence length. Cut what carries no meaning.",
    "never": "## Never\nNo talk about the text itself, no summary of what was just said, no claims of experience that the author did not give.",
    "limits": "## Limits\nAt most one list for each thousand words, three headings for each thousand characters, one linking phrase for each paragraph.",
    "words": "## Words\nReplace stock words and stock phrases from the findings with everyday ones, or delete them.",
    "openings": "## Openings\nNo two paragraphs in a row may open with the same kind of phrase; do not number arguments.",
    "voice": "## Voice\nPrefer concrete people, places, dates and figures that the article holds; let a sentence disagree where the article does.",
    "claims": "## Claims\nState each claim with what it predicts and what would refute it, if the article says so.",
    "check": "## Check\nBefore answering, read the result aloud and compare it with the original for lost facts.",
}
SCENES = {
    "analysis": ("core", "never", "limits", "words", "openings", "voice", "claims", "check"),
    "essay": ("core", "never", "limits", "words", "openings", "voice", "check"),
    "academic": ("core", "never", "limits", "words", "check"),
    "blog": ("core", "never", "words", "openings", "voice", "check"),
}
LOW = ("core", "words", "check")
_RULE = "\n\n---\n\n"
NOTHING_FOUND = "(the rules found nothing; look at the rhythm and the structure of the sentences)"


def scene_rules(scene: str = "analysis", compact: bool = False) -> str:
    """The sections of a scene; an unknown one is read as analysis."""
    head = "" if compact else "# Writing rules" + _RULE
    return head + _RULE.join(SECTIONS[s] for s in SCENES.get(scene, SCENES["analysis"])) + "\n"


def findings(violations: Column) -> Column:
    """A line for each of the first 30 violations, with 60 characters of its sample."""
    lines = F.transform(F.slice(violations, 1, MOST_VIOLATIONS), lambda v: F.concat(F.lit("- "), v["category"], F.lit("."), v["rule"], F.lit(": hit "), v["count"].cast("string"), F.lit('x | sample: "'), F.substring(F.coalesce(v["sample"], F.lit("")), 1, MOST_SAMPLE), F.lit('"')))
    return F.when(F.size(violations) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NOTHING_FOUND))


def rewrite_head(scene: str = "analysis", strength: Strength | str | None = None, aggressive: bool | None = None) -> str:
    """What a rewrite prompt says before its findings."""
    s = strength_of(strength, aggressive)
    if s is Strength.HIGH:
        head = "# Task: rewrite the article from sentence structure up, keeping its facts\n\n"
    else:
        rules = _RULE.join(SECTIONS[x] for x in LOW) + "\n" if s is Strength.LOW else scene_rules(scene, compact=True)
        head = "# Task: edit the article into plain prose\n\n" + rules + "\n"
    return head + "## Findings\n"


BEFORE_ARTICLE, AFTER_ARTICLE = "\n\n## Article\n", "\n\nReturn the article alone.\n"


def rewrite_prompt(article: Column, violations: Column, scene: str = "analysis", strength: Strength | str | None = None, aggressive: bool | None = None) -> Column:
    """The article is joined in as it is, so braces and marks in it mean nothing."""
    return F.concat(F.lit(rewrite_head(scene, strength, aggressive)), findings(violations), F.lit(BEFORE_ARTICLE), article, F.lit(AFTER_ARTICLE))


def review_prompt(article: Column) -> Column:
    return F.concat(F.lit("# Task: final review of an article\n\nAnswer with one JSON object with the fields " + ", ".join(REVIEW_FIELDS) + ".\n\n## Article\n"), article, F.lit("\n"))


_LOOP_HEAD = '# Task: estimate how machine-like an article reads\n\nAnswer with one JSON object: {"ai_score": 0 to 100, "tells": [strings], "verdict": "human", "mixed" or "ai"}.\n\n## Article\n'
#: Characters of a loop prompt besides the article's.
LOOP_LENGTH = len(_LOOP_HEAD) + 1


def loop_prompt(article: Column) -> Column:
    return F.concat(F.lit(_LOOP_HEAD), article, F.lit("\n"))


REVIEW_FIELDS = ("publishable", "worst_ai_sections", "unsupported_claims", "template_smell", "fake_human_details", "best_theses", "rewrite_brief")
REVIEW = "publishable boolean, worst_ai_sections array<struct<para:string,reason:string>>, unsupported_claims array<struct<claim:string,missing_evidence:string>>, template_smell array<string>, fake_human_details array<string>, best_theses array<string>, rewrite_brief string"
LOOP = "ai_score int, tells array<string>, verdict string"


def parsed_answer(answer: Column, schema: str = REVIEW) -> Column:
    """struct<result, parse_error, raw>: the JSON object in an answer, within fences or prose or not.

    An empty answer gives a result of nulls and no error. An answer without an object, or with a broken one,
    gives parse_error and at most 500 characters of it.
    """
    a = F.coalesce(answer, F.lit(""))
    bare = F.regexp_replace(a, r"(?U)\A\s+|\s+\z", "")
    found = F.when(F.startswith(bare, F.lit("[")), F.lit("")).otherwise(F.regexp_extract(a, r"(?s)\{.*\}", 0))
    valid = F.get_json_object(found, "$").isNotNull() & (found != "")
    error = F.when(bare == "", F.lit(None)).when(valid, F.lit(None)).when(found == "", F.lit(REPORT["no_json"])).otherwise(F.lit("bad json"))
    result = F.from_json(F.when(valid, found).otherwise(F.lit("{}")), schema)
    return F.struct(F.when(error.isNull(), result).alias("result"), error.cast("string").alias("parse_error"), F.when(error.isNotNull(), F.substring(a, 1, 500)).alias("raw"))


def report(parsed: Column, error: Column | None = None) -> Column:
    """A review as Markdown: verdict, then each section that has entries."""
    r = parsed["result"]

    def section(title: str, items: Column, line, warn: str = "") -> Column:
        n = F.size(items)
        return F.when(n > 0, F.concat(F.lit(f"### {title} ("), n.cast("string"), F.lit(f"){warn}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), line(x))), "\n"), F.lit("\n")))

    quoted = lambda a, middle, b: lambda x: F.concat(F.lit("“"), F.coalesce(x[a], F.lit("?")), F.lit(middle), F.coalesce(x[b], F.lit("?")))
    verdict = F.concat(F.lit(REPORT["verdict"]), F.when(F.coalesce(r["publishable"], F.lit(False)), F.lit(REPORT["publishable"])).otherwise(F.lit(REPORT["revise"])), F.lit("\n"))
    brief = F.when(F.coalesce(r["rewrite_brief"], F.lit("")) != "", F.concat(F.lit(REPORT["rewrite_brief"]), r["rewrite_brief"]))
    whole = F.concat_ws(
        "\n", verdict, section(REPORT["best_theses"], r["best_theses"], lambda x: x), section(REPORT["worst_ai_sections"], r["worst_ai_sections"], quoted("para", "…” — ", "reason")),
        section(REPORT["unsupported_claims"], r["unsupported_claims"], quoted("claim", "” missing: ", "missing_evidence")), section(REPORT["template_smell"], r["template_smell"], lambda x: x),
        section(REPORT["fake_human_details"], r["fake_human_details"], lambda x: x, REPORT["risk"]), brief,
    )
    failed = F.concat(F.lit(REPORT["parse_error"]), parsed["parse_error"], F.lit("\n\nraw:\n"), F.coalesce(parsed["raw"], F.lit("")))
    out = F.when(parsed["parse_error"].isNotNull(), failed).otherwise(whole)
    return out if error is None else F.when(error.isNotNull(), F.concat(F.lit(REPORT["error"]), error)).otherwise(out)
