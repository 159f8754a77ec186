"""Rules as rows: equal to CPython's re and to the column expressions, and open to change."""

import re
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseplane.functions import profiles
from proseplane.functions import rulebook as book
from proseplane.functions import text as T
from proseplane.operators import rule_table, rules

MATCHER = rule_table.Matcher([dict(zip(rule_table._FIELDS, r, strict=True)) for r in rule_table.rows_of()])
PIECES = [p for r in (*book.WORDS, *book.PHRASES) for p in r.patterns[:4]] + ["x", "'", "_", "é", "  ", "\n", ",", "\u2003", "It's important to note that i", "ſ", "BODY'S", "In My Experience", "trust me, "]


def plain(body):
    """Counts and first hits of the list and pretence rules by re."""
    out = {}
    for group, pattern in ((book.WORDS, T.word_pattern), (book.PHRASES, T.phrase_pattern)):
        for r in group:
            hits = [m[0] for m in re.finditer(pattern(r.patterns).replace(T.BLANK, r"\s"), body, re.IGNORECASE)]
            if hits:
                out[r.name] = (len(hits), hits[0])
    for r in book.PRETENCE:
        each = [[m[0] for m in re.finditer(p, body, re.IGNORECASE)] for p in r.patterns]
        if any(each):
            out[r.name] = (sum(map(len, each)), next(e[0] for e in each if e))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.sampled_from(["", " ", "  ", "\n"]))
def test_literals_equal_re(pieces, between):
    body = between.join(pieces)
    measures = dict.fromkeys(("headings", "items", "sentence_cv", "short", "paragraph_cv"), (None, 0, 0))
    got = {v["rule"]: (v["count"], v["sample"]) for v in MATCHER.violations(body, measures) if v["category"] in ("blacklist_words", "blacklist_phrases", "fake_human")}
    assert got == plain(body)


TEXTS = [
    "We utilize synergy to leverage it. " * 30, None, " ", "## a\n" * 200, "- one\n- two\n" * 80, "First, a b c.\n\nSecond, a b c.\n\nThird, a b c.\n\nFinally, a b c.\n\nA b c.", "In my experience, trust me, it is. I firmly believe that so.",
    "one two three four five six seven. " * 40, "`utilize` ```leverage``` ok but 2024 Alice Smith. " * 20, "it is important to\nnote   that " * 5,
]


@pytest.mark.parametrize("strict", [False, True])
def test_equals_the_column_expressions(spark, texts, strict):
    table = rule_table.as_table(spark, {"en": book.DEFAULT})
    docs = texts(*TEXTS, *TEXTS)
    names = ["doc_id", "total", "level", "violations", "n_violations", "text_length"]
    got = rule_table.scored_by_table(docs, table, strict=strict).select(names).collect()
    want = rules.scored(docs, strict=strict).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    notes = rule_table.scored_by_table(docs, table, has_notes=F.lit(True)).select("doc_id", "total").collect()
    assert sorted(map(tuple, notes)) == sorted(map(tuple, rules.scored(docs, has_notes=F.lit(True)).select("doc_id", "total").collect()))


def test_another_table_has_other_hits_by_the_same_plan(spark, texts, tmp_path):
    table = rule_table.as_table(spark, {"en": book.RuleSet(words=(book.ListRule("mine", 7, None, None, ("zebra", "Zoo keeper")),), phrases=(), pretence=(), signals=())})
    table.write.parquet(str(tmp_path / "rules"))
    docs = texts("a zebra, a zoo keeper and ZEBRA in the zoo\nkeeper", "We utilize")
    plan = lambda df: re.sub(r"#\d+|\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    mine = rule_table.violations_by_table(docs, spark.read.parquet(str(tmp_path / "rules"))).select("violations")
    usual = rule_table.violations_by_table(docs, rule_table.as_table(spark, {"en": book.DEFAULT})).select("violations")
    assert plan(mine) == plan(usual)
    assert [[(v["rule"], v["count"], v["score"], v["sample"]) for v in r["violations"]] for r in mine.collect()] == [[("mine", 3, 21.0, "zebra")], []]
    assert rule_table.violations_by_table(docs, table, profile="fr").where("size(violations) > 0").isEmpty()
    assert rule_table.violations_by_table(docs.where("false"), table.where("false")).isEmpty()


def test_a_table_has_a_bound(spark, texts, monkeypatch):
    monkeypatch.setattr(rule_table, "MOST_CHARACTERS", 1000)
    with pytest.raises(ValueError, match="characters"):
        rule_table.violations_by_table(texts("a"), rule_table.as_table(spark, {"en": book.DEFAULT}))


def test_profiles_by_row(spark):
    french = book.RuleSet(words=(book.ListRule("mots", 2, None, None, ("notamment",)),), phrases=(), pretence=(), signals=())
    profiles.register(profiles.Profile("fr", french, lambda a, v, scene, strength: F.concat(F.lit("Réécris : "), a)))
    try:
        docs = spark.createDataFrame([(1, "we utilize it, notamment", "en"), (2, "we utilize it, notamment", "fr"), (3, "we utilize it, notamment", "xx"), (4, "notamment", None)], "doc_id long, text string, lang string")
        got = rule_table.scored_by_table(docs, rule_table.as_table(spark, profiles.rule_sets()), profile=profiles.key_of("lang"))
        assert {r["doc_id"]: [v["rule"] for v in r["violations"]] for r in got.collect()} == {1: ["corporate_filler"], 2: ["mots"], 3: [], 4: []}
        asked = {r["doc_id"]: r["p"] for r in got.select("doc_id", profiles.rewrite_prompt(F.col("text"), F.col("violations"), "lang").alias("p")).collect()}
        assert asked[2] == "Réécris : we utilize it, notamment" and "corporate_filler" in asked[1] and asked[3].startswith("# Task")
        assert profiles.profile_of("zz").language == profiles.OTHER and profiles.languages() == ["en", "fr"]
    finally:
        profiles.reset()
    assert profiles.languages() == ["en"] and replace(profiles.profile_of("en"), builder=None).rules == book.DEFAULT
