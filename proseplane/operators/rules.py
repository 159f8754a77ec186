"""The style rules: hits, violations and scores of documents, each document in one row from end to end."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.functions import text as T

HEADING = r"(?md)(?=[\n#])(?:^|\n)#{1,6}[\s\x1c-\x1f]+[^\s\x1c-\x1f]"
LIST_ITEM = r"(?U)\A[\s\x1c-\x1f]*(?:[-*•][\s\x1c-\x1f]+|\d+[.)][\s\x1c-\x1f]+)"
#: Characters that make one unit of text; longer texts have their sums divided.
UNIT = 3000.0
VIOLATION = "struct<category:string,rule:string,weight:int,count:int,sample:string,threshold:int,score:double>"


def ladder(count: Column, weight: int, soft: int | None, hard: int | None) -> Column:
    """count * weight, halved up to the soft threshold unless the hard one is passed."""
    full = (count * F.lit(weight)).cast("double")
    if soft is None:
        return full
    low = count <= soft if hard is None else (count <= soft) & (count <= hard)
    return F.when(low, full * 0.5).otherwise(full)


def _pattern(rule: book.ListRule, phrases: bool, strict: bool) -> str:
    return (T.phrase_pattern if phrases else T.word_pattern)(rule.patterns, strict)


def list_hits(rule: book.ListRule, lowered: Column, phrases: bool, strict: bool = False) -> Column:
    """Hits of a word or phrase rule in lower_folded text."""
    return F.regexp_count(lowered, F.lit(f"{T.FLAGS}{T.first_letters(rule.patterns)}(?:{_pattern(rule, phrases, strict)})"))


def first_hit(rule: book.ListRule, body: Column, phrases: bool, strict: bool = False) -> Column:
    return F.regexp_extract(body, "(?iuUd)" + _pattern(rule, phrases, strict), 0)


def regex_hits(rule: book.RegexRule, body: Column, lowered: Column | None = None) -> Column:
    """Hits of each pattern by itself, added up; with the text lower_folded, only where that holds what all hits hold."""
    total = F.lit(0)
    for p in rule.patterns:
        hits, part = F.regexp_count(body, F.lit("(?iuUd)" + p)), T.fixed_part(p)
        if lowered is not None and part.isascii() and part.strip():
            hits = F.when(F.contains(lowered, F.lit(part.lower())), hits).otherwise(F.lit(0))
        total = total + hits
    return total


def signal_hits(rule: book.SignalRule, body: Column) -> Column:
    begins = f"(?=[{rule.begins}])(?:{rule.pattern})" if rule.begins else rule.pattern
    return F.regexp_count(body, F.lit(("(?iuUd)" if rule.ignore_case else T.FLAGS) + begins))


def prepared(docs: DataFrame, text: str = "text", strip_code: bool = True, rules: book.RuleSet = book.DEFAULT) -> DataFrame:
    """docs with the columns that the rules share: body, lowered, length, sentence and paragraph measures.

    Null texts are empty. Columns of these names, all beginning with `p_`, are replaced.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    _, least_sentences, _ = rules.sentence_length_cv or book.SENTENCE_LENGTH_CV
    _, short_length, short_sentences, _ = rules.short_sentence_ratio or book.SHORT_SENTENCE_RATIO
    _, least_paragraphs, _ = rules.paragraph_uniformity or book.PARAGRAPH_UNIFORMITY
    opener = (rules.para_opening_enumeration or book.PARA_OPENING_ENUMERATION)[2]
    docs = docs.withColumn("p_body", T.without_code(raw) if strip_code else raw).withColumn("p_blank", T.is_blank(raw))
    docs = docs.withColumns({"p_lower": T.lower_folded(F.col("p_body")), "p_length": F.length("p_body"), "p_sentences": T.sentences(F.col("p_body")), "p_paragraphs": T.paragraphs(F.col("p_body"))})
    words = F.filter(F.transform("p_sentences", lambda s: T.token_count(s)), lambda n: n > 0)
    lines = F.filter(F.split("p_body", "\n", -1), lambda x: ~T.is_blank(x))
    docs = docs.withColumns({
        "p_words": F.transform(words, lambda n: n.cast("double")),
        "p_lengths": F.transform("p_paragraphs", lambda s: F.length(s).cast("double")),
        "p_openers": F.size(F.filter("p_paragraphs", lambda s: F.rlike(s, F.lit("(?iuUd)" + opener)))),
        "p_headings": F.regexp_count("p_body", F.lit(HEADING)),
        "p_lines": F.size(lines),
        "p_items": F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(LIST_ITEM)))),
    })
    sentence_cv = F.when(F.size("p_words") >= least_sentences, T.variation(F.col("p_words")))
    short = F.size(F.filter("p_words", lambda n: n < 6)) / F.size("p_words")
    short = F.when((F.size("p_words") >= short_sentences) & (F.col("p_length") >= short_length), short)
    paragraph_cv = F.when(F.size("p_lengths") >= least_paragraphs, T.variation(F.col("p_lengths")))
    return docs.withColumns({"p_sentence_cv": sentence_cv, "p_short": short, "p_paragraph_cv": paragraph_cv})


def _violation(category: str, rule: str, weight: int, count: Column, sample: Column, threshold: int, score: Column, fires: Column) -> Column:
    row = F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), F.lit(weight).alias("weight"), count.cast("int").alias("count"), sample.alias("sample"), F.lit(threshold).alias("threshold"), score.cast("double").alias("score"))
    return F.when(fires, row.cast(VIOLATION))


def _begins(phrases: bool, rule: book.ListRule, lowered: Column) -> Column:
    """Whether a text may have hits of a rule: it holds one of its words, or all words of one of its phrases."""
    if not phrases:
        return T.holds_any(lowered, list(rule.patterns))
    words = F.array(*[F.array(*[F.lit(w) for w in sorted(p.split(" "), key=len, reverse=True)]) for p in rule.patterns])
    return F.exists(words, lambda p: F.forall(p, lambda w: F.contains(lowered, w))) if rule.patterns else F.lit(False)


def _listed(docs: DataFrame, strict: bool, rules: book.RuleSet) -> tuple[DataFrame, list[Column]]:
    """The expressions of word and phrase rules read only texts that hold their words."""
    counts, out = {}, []
    for category, group in (("blacklist_words", rules.words), ("blacklist_phrases", rules.phrases)):
        for r in group:
            n = f"n_{r.name}"
            phrases = category == "blacklist_phrases"
            lowered = F.col("p_lower")
            counts[n] = F.when(_begins(phrases, r, lowered), list_hits(r, lowered, phrases, strict)).otherwise(F.lit(0))
            sample = first_hit(r, F.col("p_body"), phrases, strict)
            out.append(_violation(category, r.name, r.weight, F.col(n), sample, r.hard, ladder(F.col(n), r.weight, r.soft, r.hard), F.col(n) > 0))
    return docs.withColumns(counts), out


def _structural(rules: book.RuleSet) -> list[Column]:
    out = []
    if rules.heading_density:
        w, least, top = rules.heading_density
        per_1k = F.col("p_headings") * 1000 / F.greatest("p_length", F.lit(1))
        out.append(_violation("structural_rules", "heading_density", w, F.col("p_headings"), F.format_string(book.SAMPLES["heading_density"].format(top=top), "p_headings", per_1k), int(top), F.lit(w), (F.col("p_length") >= least) & (per_1k > top)))
    if rules.list_density:
        w, least, top = rules.list_density
        share = F.col("p_items") / F.nullif("p_lines", F.lit(0))
        out.append(_violation("structural_rules", "list_density", w, F.col("p_items"), F.format_string(book.SAMPLES["list_density"].format(top=top), "p_items", "p_lines", share * 100), int(top * 100), F.lit(w), (F.col("p_length") >= least) & (share > top)))
    return out


def _rhythm(rules: book.RuleSet) -> list[Column]:
    out = []
    if rules.sentence_length_cv:
        w, _, top = rules.sentence_length_cv
        cv = F.col("p_sentence_cv")
        out.append(_violation("rhythm_rules", "sentence_length_cv", w, F.lit(1), F.format_string(book.SAMPLES["sentence_length_cv"].format(top=top), cv), int(top * 100), F.lit(w), cv < top))
    if rules.short_sentence_ratio:
        w, _, _, top = rules.short_sentence_ratio
        short = F.col("p_short")
        out.append(_violation("rhythm_rules", "short_sentence_ratio", w, F.lit(1), F.format_string(book.SAMPLES["short_sentence_ratio"].format(top=top), short * 100), int(top * 100), F.lit(w), short < top))
    if rules.paragraph_uniformity:
        w, _, top = rules.paragraph_uniformity
        cv = F.col("p_paragraph_cv")
        out.append(_violation("rhythm_rules", "paragraph_uniformity", w, F.lit(1), F.format_string(book.SAMPLES["paragraph_uniformity"].format(top=top), cv), int(top * 100), F.lit(w), cv < top))
    if rules.para_opening_enumeration:
        w, free, _ = rules.para_opening_enumeration
        n = F.col("p_openers")
        out.append(_violation("rhythm_rules", "para_opening_enumeration", w, n, F.format_string(book.SAMPLES["para_opening_enumeration"].format(top=free), n), free, (n - free) * w, n > free))
    return out


def _pretence(docs: DataFrame, has_notes: Column, rules: book.RuleSet) -> tuple[DataFrame, list[Column]]:
    counts, out = {}, []
    for r in rules.pretence:
        n = f"n_{r.name}"
        counts[n] = F.when(has_notes, F.lit(0)).otherwise(regex_hits(r, F.col("p_body"), F.col("p_lower")))
        samples = [F.nullif(F.regexp_extract("p_body", "(?iuUd)" + p, 0), F.lit("")) for p in r.patterns]
        out.append(_violation("fake_human", r.name, r.weight, F.col(n), F.coalesce(*samples), r.hard, ladder(F.col(n), r.weight, None, r.hard), F.col(n) > 0))
    return docs.withColumns(counts), out


def _signals(docs: DataFrame, rules: book.RuleSet) -> tuple[DataFrame, list[Column]]:
    counts, out = {}, []
    for r in rules.signals:
        n = f"n_{r.name}"
        counts[n] = signal_hits(r, F.col("p_body"))
        out.append(_violation("soul_signals", r.name, r.weight, F.col(n), F.format_string(book.SAMPLES["signals"].format(least=r.least), F.col(n)), r.least, (r.least - F.col(n)) * r.weight, (F.col("p_length") >= r.min_length) & (F.col(n) < r.least)))
    return docs.withColumns(counts), out


def band_key(score: Column) -> Column:
    out = F.lit(book.BANDS[-1][1])
    for least, key, _ in reversed(book.BANDS[:-1]):
        out = F.when(score >= least, F.lit(key)).otherwise(out)
    return out


def band_label(score: Column) -> Column:
    out = F.lit(book.BANDS[-1][2])
    for least, _, label in reversed(book.BANDS[:-1]):
        out = F.when(score >= least, F.lit(label)).otherwise(out)
    return out


def violations(docs: DataFrame, text: str = "text", has_notes: Column | None = None, strip_code: bool = True, strict: bool = False, ruleset: book.RuleSet = book.DEFAULT) -> DataFrame:
    """docs with `violations` (in the order of the rulebook) and the columns of prepared and the rules' counts.

    Blank and null texts have none. One narrow stage, whatever the number of rules.
    """
    docs = prepared(docs, text, strip_code, ruleset)
    docs, listed = _listed(docs, strict, ruleset)
    docs, pretence = _pretence(docs, F.lit(False) if has_notes is None else F.coalesce(has_notes, F.lit(False)), ruleset)
    docs, signals = _signals(docs, ruleset)
    none = F.lit(None).cast(VIOLATION)
    found = F.filter(F.array(none, *listed, *_structural(ruleset), *_rhythm(ruleset), *pretence, *signals), lambda v: v.isNotNull())
    return docs.withColumn("violations", T.once(F.when(F.col("p_blank"), F.array().cast(f"array<{VIOLATION}>")).otherwise(found)))


def scored(docs: DataFrame, text: str = "text", has_notes: Column | None = None, strip_code: bool = True, strict: bool = False, ruleset: book.RuleSet = book.DEFAULT) -> DataFrame:
    """docs with total (0 to 100, unrounded), rounded_total, level, violations, text_length and stats columns.

    Bands go by the unrounded total. stats: n_violations, sentence_cv, short_sentence_ratio, paragraph_cv,
    para_opener_count; null where a text is too short for them. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in _RESULTS]
    found = violations(docs, text, has_notes, strip_code, strict, ruleset)
    raw = F.aggregate("violations", F.lit(0.0), lambda a, v: a + v["score"])
    found = found.withColumn("total", F.least(F.lit(100.0), raw / F.greatest(F.lit(1.0), F.col("p_length") / UNIT)))
    present = lambda c: F.when(~F.col("p_blank"), c)
    return found.select(
        *[F.col(f"`{c}`") for c in kept], "total", F.round("total", 1).alias("rounded_total"), band_key(F.col("total")).alias("level"), "violations",
        F.when(F.col("p_blank"), F.lit(0)).otherwise(F.col("p_length")).alias("text_length"), F.size("violations").alias("n_violations"), present(F.col("p_sentence_cv")).alias("sentence_cv"),
        present(F.col("p_short")).alias("short_sentence_ratio"), present(F.col("p_paragraph_cv")).alias("paragraph_cv"), F.when(F.size("p_paragraphs") > 0, F.col("p_openers")).alias("para_opener_count"),
    )


_RESULTS = {"total", "rounded_total", "level", "violations", "text_length", "n_violations", "sentence_cv", "short_sentence_ratio", "paragraph_cv", "para_opener_count"}


def long_form(scored_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each violation.

    The outer form of explode keeps the optimiser from testing the array below it, which would score twice.
    """
    return scored_docs.select(key, F.posexplode_outer("violations").alias("position", "v")).where("v is not null").select(key, "position", "v.*")


def by_severity(v: Column) -> Column:
    """Violations by falling score; equal ones stay in their order."""
    ranked = F.transform(v, lambda x, i: F.struct((-x["score"]).alias("s"), i.alias("i"), x.alias("v")))
    return F.transform(F.array_sort(ranked), lambda x: x["v"])
