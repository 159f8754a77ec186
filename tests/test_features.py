import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from proseplane.functions import text as T
from proseplane.operators import features, lm, mining


def first(docs, c):
    return [r[0] for r in docs.select(c).collect()]


def test_segmentation(texts):
    docs = texts("Don't stop, It's 5pm\\nnow. Go on! \"Yes,\" he said. é end", "", None)
    assert first(docs, T.tokens(F.col("text")))[0] == ["don't", "stop", "it's", "pm", "now", "go", "on", "yes", "he", "said", "end"]
    assert len(first(docs, T.sentences(F.col("text")))[0]) == 4
    assert first(texts("a\n \n\nb\n\n\n", "x"), T.paragraphs(F.col("text"))) == [["a", "b"], ["x"]]


def naive_mattr(words, w=50):
    return sum(len(set(words[i : i + w])) / w for i in range(len(words) - w + 1)) / (len(words) - w + 1) if len(words) >= w else 0.0


def test_mattr_and_entropy_equal_the_plain_way(spark):
    rng = random.Random(4)
    rows = [[rng.choice("abcdefghijklmnop") for _ in range(n)] for n in (0, 1, 49, 50, 51, 60, 200)]
    docs = spark.createDataFrame([(r,) for r in rows], "w array<string>")
    for got, want in zip(first(docs, features.mattr(F.col("w"))), map(naive_mattr, rows), strict=True):
        assert got == pytest.approx(want, abs=1e-12)
    for got, words in zip(first(docs, features.entropy(F.col("w"))), rows, strict=True):
        want = -sum(words.count(c) / len(words) * math.log2(words.count(c) / len(words)) for c in set(words)) if words else 0.0
        assert got == pytest.approx(want, abs=1e-9)


def test_densities_and_short_texts(texts):
    row = features.text_features(texts("one, two, three, four, five, six, seven, eight, nine, ten", "", "Hi.")).orderBy("doc_id").collect()
    assert row[0]["comma_density"] == 90.0 and row[1]["word_count"] == 0 and row[2]["sentence_cv"] == 0.0


def log_prob(w1, w2, uni, bi, n, v):
    return math.log((bi.get((w1, w2), 0) + 1) / (uni[w1] + v)) if uni.get(w1) else math.log((uni.get(w2, 0) + 1) / (n + v))


def test_language_model_features_equal_the_plain_way(spark, texts):
    corpus = texts("the cat sat on the mat. The dog ran.", "the cat ran on the dog", None)
    model = lm.LanguageModel.train(corpus)
    uni = {r["token"]: r["cnt"] for r in model.unigrams.collect()}
    bi = {(r["w1"], r["w2"]): r["cnt"] for r in model.bigrams.collect()}
    assert uni["the"] == 5 and bi[("the", "cat")] == 2 and model.total == sum(uni.values()) and model.vocabulary == len(uni)
    t = "The cat sat there. A dog ran on the mat! Zebras ran far away. Then nothing."
    got = features.features(texts(t, "too few words"), model).orderBy("doc_id").collect()
    lp = lambda words: [log_prob(a, b, uni, bi, model.total, model.vocabulary) for a, b in zip(words, words[1:], strict=False)]
    words = "the cat sat there a dog ran on the mat zebras ran far away then nothing".split()
    a = statistics.mean(lp(words))
    each = [statistics.mean(lp(s.split())) for s in ("the cat sat there", "a dog ran on the mat", "zebras ran far away")]
    assert got[0]["avg_log_prob"] == pytest.approx(a) and got[0]["perplexity"] == pytest.approx(math.exp(-a))
    assert got[0]["burstiness"] == pytest.approx(abs(statistics.pstdev(each) / statistics.mean(each)))
    assert got[1]["perplexity"] == 0 and got[1]["burstiness"] == 0


def test_model_saves_loads_and_may_be_missing(spark, texts, tmp_path):
    lm.LanguageModel.train(texts("a b c a b")).save(str(tmp_path / "m"))
    assert lm.LanguageModel.load(spark, str(tmp_path / "m")).total == 5
    assert lm.LanguageModel.load(spark, str(tmp_path / "none")) is None
    assert not lm.LanguageModel.train(texts()).available


def test_ngram_score_of_short_texts(spark, texts):
    model = lm.LanguageModel.train(texts("a b c"))
    row = features.ngram_score(features.features(texts("ten words " * 5, "word other thing " * 20), model)).orderBy("doc_id").collect()
    assert row[0]["ngram_probability"] == 0 and "too short" in row[0]["ngram_level"]
    assert 0 <= row[1]["ngram_probability"] <= 100 and "too short" not in row[1]["ngram_level"]


def test_grade(texts):
    easy, hard, none = first(texts("The cat sat. The dog ran.", "Institutional considerations necessitate comprehensive organizational transformation.", "..."), features.fleschkincaid("text"))
    assert easy < 3 < 12 < hard and none == 0


def test_ratios_keep_words_of_the_target_alone(texts):
    got = {r["token"]: r for r in mining.word_ratios(texts("x x x y", "x"), texts("y y z"), least=1).collect()}
    assert set(got) == {"x", "y"} and got["x"]["other_count"] == 0 and got["y"]["ratio"] == pytest.approx(0.2e6 / (2e6 / 3))
    phrases = {r["phrase"]: r["target_df"] for r in mining.phrase_ratios(texts("a b a b", "a b c"), texts("q"), 2, least=1).collect()}
    assert phrases == {"a b": 2, "b a": 1, "b c": 1}


def test_percentiles_auc_and_samples(spark):
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(23)] + [("b", None), ("b", 1.0)], "k string, v double")
    got = {r["k"]: r for r in mining.percentiles(rows, "k", "v").collect()}
    line = sorted(float(i % 7) for i in range(23))
    assert [got["a"][f"p{p}"] for p in (10, 25, 50, 75, 90)] == [line[min(22, int(p / 100 * 23))] for p in (10, 25, 50, 75, 90)]
    assert got["b"]["n"] == 1
    pairs = [(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1), (0.2, 0)]
    auc = mining.rank_auc(spark.createDataFrame(pairs, "s double, y int"), "s", "y").first()
    want = sum((a > b) + 0.5 * (a == b) for a, y in pairs if y for b, z in pairs if not z) / 6
    assert auc["auc"] == pytest.approx(want)
    assert mining.rank_auc(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first()["auc"] is None
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "doc_id long, y int")
    assert sorted(r["count"] for r in mining.balanced_sample(labels, "y", "doc_id", 30).groupBy("y").count().collect()) == [20, 20]


def test_running_sums_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(mining, "PARTS", 7)
    rows = [(k, float(v), rng.randint(0, 5)) for k in "ab" for v in rng.sample(range(1000), 200)]
    got = mining.running(spark.createDataFrame(rows, "k string, v double, c long"), "v", ["c"], ["k"]).collect()
    for r in got:
        assert r["c_before"] == sum(c for k, v, c in rows if k == r["k"] and v < r["v"])
    assert len(got) == 400


def test_chosen_by_hash(spark):
    import hashlib

    rows = [(i, i % 3) for i in range(3000)] + [(7, 1)] * 4
    got = mining.stratified_split(spark.createDataFrame(rows, "doc_id long, y int"), "y", "doc_id", 0.3)
    for y in range(3):
        own = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i, k in rows if k == y)
        assert sorted(r["doc_id"] for r in got.where(f"train and y = {y}").collect()) == sorted(i for _, i in own[: int(len(own) * 0.3)])
    assert got.count() == len(rows)


def test_top_counts(spark):
    rows = [("a", 5), ("b", 3), ("c", 3), ("d", 3), ("e", 1)]
    counts = spark.createDataFrame(rows, "token string, cnt long")
    for k in range(7):
        assert sorted(r["token"] for r in lm.top(counts, k, ["token"]).collect()) == sorted("abcde"[:k])
    assert lm.top(counts.where("false"), 3, ["token"]).count() == 0


def test_training_separates(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.gauss(y, 1), rng.gauss(0, 1), y) for y in (0, 1) for _ in range(200)], "a double, b double, y int")
    calibration, intercept = mining.train_logistic(rows, ["a", "b"], "y")
    assert calibration[0][3] > 5 * abs(calibration[1][3]) > 0
    assert [c[0] for c in calibration] == ["a", "b"] and math.isfinite(intercept)


def test_joined_and_packed_models_agree(spark, texts, monkeypatch):
    docs = texts("The cat sat there. A dog ran on the mat! Zebras ran far away. Then nothing.", "", None, "a b", "one two three. four five six. seven eight nine ten.\n\neleven")
    model = lm.LanguageModel.train(texts("the cat sat on the mat. The dog ran.", "one two four five"))
    packed = features.features(docs, model).orderBy("doc_id").collect()
    monkeypatch.setattr(lm, "PACKED_ROWS", 0)
    assert model.packed() is None
    for a, b in zip(packed, features.features(docs, model).orderBy("doc_id").collect(), strict=True):
        assert set(a.asDict()) == set(b.asDict()) and all(a[c] == pytest.approx(b[c]) for c in a.asDict())


def test_mattr_is_added_up_window_by_window(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(n)]) for k, n in enumerate([0, 1, 49, 50, 51, *[65] * 20, 129, 400])]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k long, t array<string>").select("k", features.mattr(F.col("t")).alias("m")).collect()}
    for k, t in rows:
        total = 0.0
        for i in range(len(t) - 49):
            total += len(set(t[i : i + 50])) / 50.0
        assert got[k] == (total / (len(t) - 49) if len(t) >= 50 else 0.0)  # to the last bit
