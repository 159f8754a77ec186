"""Words, sentences and paragraphs of Arrow batches are those of the patterns, and features take them from one pass."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.functions import text as T
from proseplane.functions.segments import segmented
from proseplane.operators import features, lm, mining
from proseplane.plans import catalogue

BITS = [
    "a", "B", "it's", "a'b'c'd", "'x'", "\n", "\\n", " ", "\t", ".", "!", "? ", "(", "[", '"', "é", " ", "\xa0", "\x85", "\x1c", "—", ",", ";", "　", "᠎", "​", "😀",
    "\\", "n", "\r\n", "\x00", "ſ", "Ünder", "1", ".  A", "\n \n", "_",
]


def odd_texts(n):
    rng = random.Random(3)
    return ["", None, " ", "\n", "a", "\n a \n", "\\", "n", *("".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n))]


def nested(parts, of, text_of):
    """Of each text its parts, of each part its words."""
    own, out = [[] for _ in text_of], [[] for _ in range(parts.texts)]
    known = parts.known.to_pylist()
    for word, part in zip(parts.words, of, strict=True):
        own[part].append(known[word])
    for words, text in zip(own, text_of, strict=True):
        out[text].append(words)
    return out


def test_segments_are_those_of_the_patterns(texts):
    rows = odd_texts(800)
    t = F.coalesce(F.col("text"), F.lit(""))
    counts = [F.regexp_count(t, F.lit(p)) for p in (",", "[;:—–()]")]
    want = texts(*rows).select("doc_id", T.tokens(t), F.transform(T.sentences(t), T.tokens), F.transform(T.paragraphs(t), T.tokens), *counts).orderBy("doc_id").collect()
    parts = segmented(pa.array(["x, y. Z", *rows]).slice(1))
    sentences, paragraphs = nested(parts, parts.sentence_of, parts.text_of_sentence), nested(parts, parts.paragraph_of, parts.text_of_paragraph)
    for i, r in enumerate(want):
        assert tuple(r)[1:] == (sum(sentences[i], []), sentences[i], paragraphs[i], parts.commas[i], parts.marks[i]), repr(rows[i])
    assert segmented(pa.array([], pa.string())).texts == 0


def test_transitions_are_those_of_the_plain_pattern(texts):
    rng, fold = random.Random(1), {"i": "İ", "s": "ſ", "k": "K"}
    case = lambda w: "".join(rng.choice([c, c.upper(), fold.get(c, c)]) for c in w)
    rows = ["".join(case(rng.choice((*book.TRANSITIONS, "x", "thus-far", "overalls"))) + rng.choice([" ", "", "_", "1", "é", "'", "\n", "z", "Q", "́"]) for _ in range(8)) for _ in range(1000)]
    plain = r"(?iuUd)\b(?:" + "|".join(map(re.escape, book.TRANSITIONS)) + r")\b"
    got = texts(*rows).select(F.regexp_count("text", F.lit(plain)).alias("a"), F.regexp_count("text", F.lit(features.TRANSITION)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(r["a"] for r in got) > 500


def test_features_equal_the_column_expressions(texts):
    rng = random.Random(7)
    rows = [*odd_texts(100), *("".join(rng.choice(["one ", "two, ", "tree. ", "Four", " ", "\n", "\n\n"]) for _ in range(400)) for _ in range(30))]
    docs = texts(*rows)
    t = F.coalesce(F.col("text"), F.lit(""))
    arrays = docs.select("doc_id", T.once(T.tokens(t)).alias("t"), F.transform(T.sentences(t), T.tokens).alias("s"), F.filter(F.transform(T.paragraphs(t), T.tokens), lambda p: F.size(p) >= 8).alias("p"))
    lengths, h = F.transform("s", lambda s: F.size(s).cast("double")), F.transform("p", features.entropy)
    some = (F.size("s") >= 3) & (F.size("t") > 0)
    two = F.size("p") >= 2
    plain = arrays.select(
        "doc_id", F.size("t").alias("word_count"), features.mattr(F.col("t")).alias("word_mattr"), F.when(some, T.variation(lengths)).otherwise(0.0).alias("sentence_cv"),
        F.when(two, T.variation(h)).otherwise(0.0).alias("entropy_cv"), F.when(two, T.mean(h)).otherwise(0.0).alias("mean_entropy"),
    ).orderBy("doc_id").collect()
    for want, got in zip(plain, features.text_features(docs).orderBy("doc_id").collect(), strict=True):
        assert {c: got[c] for c in want.asDict()} == pytest.approx(want.asDict(), abs=1e-12) and got["word_mattr"] == want["word_mattr"]


def test_features_take_one_arrow_pass_and_no_folds(texts):
    model = lm.LanguageModel.train(texts("the cat sat on the mat", "a dog"))
    plan = features.features(texts("a b", "c"), model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan and "transform(" not in plan and "Exchange" not in plan


def test_pairs_are_added_up_where_they_are_read(texts):
    plan = lm.pair_counts(texts("a b", "c"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "regexp_extract_all" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_gate_ranks_the_held_out_rows_alone(spark, monkeypatch):
    asked, ranked = [], mining.rank_auc
    monkeypatch.setattr(mining, "rank_auc", lambda rows, *names: asked.append(rows.where("train").count()) or ranked(rows, *names))
    assert catalogue.lr_gate(spark, "/root/testdata/sf0.001").count() == 1 and asked == [0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_calibration_keeps_no_table_of_the_model(spark):
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    assert catalogue.lr_steps(spark, "/root/testdata/sf0.001").count() == 13 and kept() <= before
