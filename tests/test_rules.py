import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.functions import text as T
from proseplane.operators import rules


def score(texts, *ts, **options):
    return {r["doc_id"]: r for r in rules.scored(texts(*ts), **options).collect()}


def fired(row):
    return {v["rule"]: v for v in row["violations"]}


def test_sizes_of_the_rulebook():
    assert len(book.WORDS) == 7 and len(book.PHRASES) == 9 and len(book.PRETENCE) == 2 and len(book.SIGNALS) == 2
    assert sum(len(r.patterns) for r in (*book.WORDS, *book.PHRASES)) == 167
    assert sum(map(len, book.REPLACEMENTS.values())) == 102 and len(book.TRANSITIONS) == 35


@pytest.mark.parametrize(("n", "w", "soft", "hard", "want"), [(3, 5, None, None, 15), (2, 4, 3, 10, 4), (5, 4, 3, 10, 20), (12, 4, 3, 10, 48), (1, 8, 0, 1, 8), (3, 15, 0, 0, 45)])
def test_ladder(spark, n, w, soft, hard, want):
    assert spark.range(1).select(rules.ladder(F.lit(n), w, soft, hard)).first()[0] == want


def test_guards_stand_at_the_ends_only(texts):
    row = score(texts, "somebody'softener", "we optimized it", "It's important to note that it is", "it is important to\nnote")
    assert fired(row[0])["abstract_possessives"]["count"] == 1
    assert not re.findall(T.word_pattern(("body's",)), "somebody'softener")
    assert fired(row[1])["corporate_filler"]["count"] == 1
    assert "ai_safety_disclaimer" in fired(row[2])
    assert "meta_hedge" in fired(row[3])
    strict = score(texts, "we optimized it", "somebody'softener", "a body's", strict=True)
    assert not fired(strict[0]) and not fired(strict[1]) and fired(strict[2])


def test_blank_null_and_clean_texts(texts):
    row = score(texts, "", None, " \n ", "The cat sat here. It slept.")
    assert all(r["total"] == 0 and r["violations"] == [] and r["level"] == "LOW" for r in row.values())
    assert row[0]["text_length"] == 0


def test_code_is_not_read(texts):
    row = score(texts, "See ```\nutilize leverage\n``` and `leverage()` and that is all.", "utilize leverage")
    assert "corporate_filler" not in fired(row[0]) and fired(row[1])["corporate_filler"]["count"] == 2
    assert "corporate_filler" in fired(score(texts, "`utilize` here", strip_code=False)[0])


def test_length_evens_out(texts):
    row = score(texts, "We utilize synergy to leverage it. " * 21, "We utilize synergy to leverage it. " * 84)
    assert row[1]["total"] <= 1.25 * row[0]["total"]


def test_structure_and_rhythm(texts):
    heads = "".join(f"## Part {i}\nSome words here.\n\n" for i in range(9)) + "x" * 400
    items = "- one thing to say\n" * 40
    even = " ".join(["The small dog ran over the green hill today."] * 8)
    paras = "\n\n".join(["Some plain words stand in this paragraph here."] * 4)
    openers = "\n\n".join(f"{w} we go on." for w in ("First,", "Second,", "Third,", "Finally,", "Moreover,"))
    row = score(texts, heads, items, even, paras, openers)
    assert "heading_density" in fired(row[0]) and "list_density" in fired(row[1]) and "sentence_length_cv" in fired(row[2])
    assert "paragraph_uniformity" in fired(row[3]) and fired(row[4])["para_opening_enumeration"]["score"] == 15


def test_notes_silence_pretence_and_signals_weigh_what_is_missing(spark, texts):
    t = "In my experience this works. " + "plain words go on and on here. " * 12
    docs = texts(t, t).withColumn("notes", F.col("doc_id") == 1)
    row = {r["doc_id"]: r for r in rules.scored(docs, has_notes=F.col("notes")).collect()}
    assert "vague_personal_experience" in fired(row[0]) and "vague_personal_experience" not in fired(row[1])
    assert fired(row[0])["concrete_specifics"]["score"] == 10 and fired(row[0])["contrarian_hinge"]["score"] == 5


def test_bands(spark):
    got = spark.createDataFrame([(x,) for x in (0.0, 24.96, 25.0, 50.0, 75.0, 100.0)], "x double").select(rules.band_key(F.col("x"))).collect()
    assert [r[0] for r in got] == ["LOW", "LOW", "MEDIUM", "HIGH", "VERY_HIGH", "VERY_HIGH"]


def test_clashing_names_are_replaced(texts):
    docs = texts("We utilize it.").withColumn("total", F.lit("x")).withColumn("p_body", F.lit(1)).withColumn("extra", F.lit(7))
    row = rules.scored(docs).first()
    assert row["extra"] == 7 and row["total"] >= 0


def test_severity_is_stable(texts):
    got = rules.scored(texts("As an AI language model, we utilize it. In conclusion, done.")).select(rules.by_severity(F.col("violations")).alias("v")).first()["v"]
    assert [v["score"] for v in got] == sorted((v["score"] for v in got), reverse=True)


PIECES = [*(p for r in (*book.WORDS, *book.PHRASES) for p in r.patterns), "x", "é", "'", " ", "  ", ",", "ed", "-", "\n", "A", "_", "9", "ſ", "K"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map(lambda p: " ".join(p[:7]) + "".join(p[7:])).map(lambda s: s.upper() if len(s) % 3 == 0 and "ı" not in s else s), min_size=30, max_size=30))
def test_counts_equal_python(spark, samples):
    docs = spark.createDataFrame([(s,) for s in samples], "t string").withColumn("low", T.lower_folded(F.col("t")))
    every = [(r, k) for k, group in ((False, book.WORDS), (True, book.PHRASES)) for r in group]
    got = docs.select("t", *[rules.list_hits(r, F.col("low"), k).alias(r.name) for r, k in every]).collect()
    for row in got:
        for r, k in every:
            pattern = (T.phrase_pattern if k else T.word_pattern)(r.patterns)
            assert row[r.name] == len(re.findall(pattern, row["t"], re.IGNORECASE)), (row["t"], r.name)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, "in my experience", "I’ve found that", "trust me,", "for the past 9 years", "Studies", "İ", "\u2028"]), max_size=14).map(lambda p: " ".join(p[:7]) + "".join(p[7:])), min_size=30, max_size=30))
def test_gated_counts_equal_python(spark, samples):
    got = rules.violations(spark.createDataFrame([(s,) for s in samples], "text string"), strip_code=False).collect()
    for row in got:
        for category, group, pattern in (("blacklist_words", book.WORDS, T.word_pattern), ("blacklist_phrases", book.PHRASES, T.phrase_pattern)):
            for r in group:
                assert row[f"n_{r.name}"] == len(re.findall(pattern(r.patterns), row["text"], re.IGNORECASE)), (row["text"], r.name)
        for r in book.PRETENCE:
            assert row[f"n_{r.name}"] == sum(len(re.findall(p, row["text"], re.IGNORECASE)) for p in r.patterns), (row["text"], r.name)
