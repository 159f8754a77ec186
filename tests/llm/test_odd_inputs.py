"""Null, empty, very long and repeated texts, empty tables and clashing columns, operator by operator."""

import tracemalloc

import pytest

from proseplane.llm import decontaminate, language_id, media, quality, simhash, toxicity

LONG = "plain words about rivers and hills " * 60_000  # 2 million characters
ODD = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "a short line"), (5, "\u0000 \U0001f600 ... 123")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="module")
def labelled(spark):
    bad, good = "vile {0} hateful {0} slurs", "the quiet {0} garden has old trees. It is {0} and green."
    docs = spark.createDataFrame([(k, (bad if k % 2 else good).format(f"word{k}"), "de" if k % 2 else "en") for k in range(120)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(120)], "doc_id long, toxic int, quality int")
    return docs, labels


def scorers(labelled):
    docs, labels = labelled
    bad, good, langs = toxicity.fit(docs, labels), quality.fit(docs, labels), language_id.fit(docs)
    return [lambda d: toxicity.score(d, bad), lambda d: quality.score(d, good), lambda d: language_id.identify(d, langs)]


def test_scores_of_odd_texts(spark, odd, labelled):
    for f in scorers(labelled):
        got = f(odd).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        twice = [r["score"] for r in got if r["doc_id"] == 3]
        assert twice[0] == twice[1]
        assert f(odd.where("false")).count() == 0
        clash = f(odd.selectExpr("doc_id", "text", "'mine' as score", "'yours' as _k"))
        assert {type(r["score"]) for r in clash.collect()} == {float} and {r["_k"] for r in clash.collect()} == {"yours"}


def test_null_scores_as_empty(spark, odd, labelled):
    tox, qual, lang = scorers(labelled)
    for f in (tox, qual):
        at = {r["doc_id"]: r["score"] for r in f(odd).collect()}
        assert at[1] == at[2]
    at = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang(odd).collect()}
    assert at[1] == at[2] == at[5] == (language_id.UNKNOWN, 0.0)


def test_equally_likely_languages(spark):
    docs = spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string")
    assert language_id.identify(docs.select("text").distinct(), language_id.fit(docs)).first()["lang_pred"] in ("a", "b")
    tied = language_id.Model(("a", "b"), *_even())
    assert language_id.predict_one(tied, "words") == ("a", 0.5)


def _even():
    import numpy as np

    dims = language_id.Config().dims
    return np.ones(dims), np.zeros((dims, 2), np.float32), np.zeros(2), 1.0, language_id.Config().orders


def test_decontamination_of_odd_rows(spark, odd):
    item = " ".join(f"item{k}" for k in range(13))
    docs = odd.unionByName(spark.createDataFrame([(7, item), (7, item), (8, "x " * 300 + item)], odd.schema))
    bench = spark.createDataFrame([("q", item), ("n", None), ("e", "")], "item_id string, text string")
    got = {}
    for r in decontaminate.decontaminate(docs, bench).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert 7 not in got and got[1] == [None] and got[2] == [""] and got[3] == [LONG, LONG] and got[None] == ["a short line"]
    assert len(got[8]) == 1 and "item" not in got[8][0] and got[8][0].count("x") == 300
    for none in (bench.where("false"), bench.where("item_id = 'n'")):
        assert sorted(map(repr, decontaminate.decontaminate(docs, none).collect())) == sorted(map(repr, docs.collect()))
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0


def test_coverage_at_the_limit(spark):
    item = " ".join(f"item{k}" for k in range(13))
    docs = spark.createDataFrame([(1, item + " x" * 247), (2, item + " x" * 248)], "doc_id long, text string")  # 13 of 260, of 261
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


def test_fingerprints_of_odd_rows(spark, odd):
    got = simhash.fingerprints(odd.selectExpr("doc_id", "text", "'mine' as fp")).collect()
    signed = lambda t: simhash.fingerprint(t) - (1 << 64 if simhash.fingerprint(t) >> 63 else 0)
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in got) == sorted((k or 0, signed(t)) for k, t in ODD)
    assert simhash.fingerprints(odd.where("false")).count() == 0


@pytest.mark.parametrize("data", [b"P5 100000 100000 255\n1234", b"P6 4294967296 4294967296 255\n", b"P4 9999999999 1\nx", b"P1 70000 70000\n1 0", b"P3 70000 70000 255\n1 2 3", b"P2 0 0 255\n", b"BM" + bytes(12) + b"\x28\0\0\0\xff\xff\xff\x7f\xff\xff\xff\x7f\1\0\x18\0" + bytes(24)])
def test_headers_that_claim_more_than_the_bytes(data):
    tracemalloc.start()
    found = media.features(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["error"] and peak < 1_000_000 and not any(v for k, v in found.items() if k != "error")
