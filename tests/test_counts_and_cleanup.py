"""Mergeable counts, the clean-up in one pass, scheduled scorers, the logistic fit and the windowed monitor."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseplane import cli
from proseplane.operators import cleanup, count_table, external, lm, mining
from proseplane.streaming import monitor


@pytest.mark.parametrize(("head", "how"), [(1, {"all"}), (25, {"looked up"}), (10**6, {"heads"})])
def test_merged_counts_equal_recounted(spark, tmp_path, head, how):
    rng = random.Random(5)
    table, total = count_table.CountTable(spark, str(tmp_path / f"t{head}"), ["w"]), Counter()
    assert table.top(3)[0].count() == 0
    ways = set()
    for part in range(3):
        own = Counter(f"w{min(int(rng.expovariate(0.05)), 60 + part * 5)}" for _ in range(4000))
        total += own
        table.add(spark.createDataFrame(list(own.items()), "w string, cnt long"), head)
        for k in (20, 500) if part == 2 else ():
            got, by = table.top(k)
            assert [tuple(r) for r in sorted(got.collect(), key=lambda r: (-r["cnt"], r["w"]))] == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]
            ways.add(by)
    assert how <= ways and (head < 10**6 or ways == {"heads"})
    table.add(spark.createDataFrame([], "w string, cnt long"), head)
    assert table.top(5)[0].count() == 5


KEYS = [a for _, a, _ in cleanup.ordered_pairs()]
ONE = cleanup.OnePass()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(KEYS), st.sampled_from(KEYS).flatmap(lambda k: st.integers(1, len(k)).map(lambda n: k[:n])), st.sampled_from([" ", "x", "in order ", "z" * 50, "é"])), max_size=20).map("".join))
def test_one_pass_equals_replacing_in_turn(text):
    assert ONE(text) == ONE.in_turn(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=4), st.text("abc", max_size=4)), max_size=6), st.text("abcx", max_size=60))
def test_one_pass_equals_replacing_in_turn_for_any_pairs(pairs, text):
    one = cleanup.OnePass({"b": tuple(pairs)})
    assert one(text) == one.in_turn(text)


def test_cleaned_once_is_cleaned(spark, texts):
    docs = texts(None, "", "nothing", "We utilize it in order to " * 50, "in order to" + "x" * 5000 + "utilize")
    a = docs.select(cleanup.cleaned(docs["text"]).alias("t"))
    assert [r["t"] for r in a.collect()] == [r["t"] for r in docs.select(cleanup.cleaned_once("text").alias("t")).collect()]


def test_scheduled_scorer_sees_each_text_once_in_even_batches(spark, tmp_path):
    log = str(tmp_path / "batches")
    rows = [(k, "x" * (k % 7) ** 3, 0) for k in range(120)] + [(200, None, 0), (201, "y" * 5000, 0), (202, "fails", 0), (203, "z" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, external long")

    def load(log=log):
        def score(texts):
            with open(log, "a") as f:
                f.write(",".join(t[:1] + str(len(t)) for t in texts) + "\n")
            if "fails" in texts:
                raise RuntimeError("no")
            return [float(len(t)) for t in texts]

        return score

    got = {r["doc_id"]: r["external"] for r in external.scheduled_scores(docs, load, characters=6000, rows=4).collect()}
    assert got == {k: None if t is None or t == "fails" else float(len(t)) for k, t, _ in rows}
    batches = [[(x[:1], int(x.lstrip("xyzf") or 0)) for x in line.split(",")] for line in open(log).read().splitlines()]
    seen = Counter(x for b in batches for x in b if x[0] != "f")
    assert all(n <= 2 for n in seen.values()) and len([b for b in batches if ("y", 5000) in b]) == 1
    assert all(max(n for _, n in b) < 2 * max(min(n for _, n in b), 1) and len(b) <= 4 and len(b) * max(n for _, n in b) <= 6000 for b in batches)
    assert external.scheduled_scores(docs.where("false"), load).count() == 0


def test_logistic_fit_is_where_the_gradient_ends(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=500) > 1).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(k), 7.0) for r, k in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1, 7.0)], "a double, b double, c double, y int, same double").repartition(5)
    calibration, b0 = mining.train_logistic(rows, ["a", "b", "c", "same"], "y", c=2.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.array([c[3] for c in calibration])
    assert w[3] == pytest.approx(0, abs=1e-9) and calibration[3][2] == 1.0
    p = 1 / (1 + np.exp(-(b0 + z @ w[:3])))
    assert np.allclose(z.T @ (y - p), w[:3] / 2.0, atol=1e-6) and abs((y - p).sum()) < 1e-6
    one = mining.train_logistic(rows, ["a", "b"], "y", steps=1)[0]
    assert [c[0] for c in one] == ["a", "b"] and mining.train_logistic(rows.where("false"), ["a"], "y") == ((("a", 0.0, 1.0, 0.0),), 0.0)


def plain_monitor(rows, window, late):
    clock, n, total, lates = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for arrival, i, source, shard, at, x in sorted(rows, key=lambda r: (r[0], r[1])):
        k, w = (source or "", shard), (source or "", at // window)
        if k in clock and at < clock[k] - late:
            lates[w] += 1
        else:
            n[w] += 1
            total[w] += x
            clock[k] = max(clock.get(k, at), at)
    return {(*w, n[w], total[w], lates[w]) for w in {*n, *lates}}


def test_monitor_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, k, rng.choice(["a", None]), k % 2, max(0, k * 10 - rng.choice([0, 0, 0, 5, 400])), rng.randrange(100)) for k in range(400)]
    schema = "arrival long, id long, source string, shard long, at long, total long"
    for at in range(0, 400, 200):
        spark.createDataFrame(rows[at : at + 200] + ([(at + 199, 999 + at, "a", 0, None, 1)] if at else []), schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        monitor.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), window=500, late=120)
    monitor.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), window=500, late=120)  # nothing new
    got = monitor.levels(spark.read.parquet(str(tmp_path / "out")), unit=1.0)
    assert {tuple(r)[:5] for r in got.collect()} == plain_monitor(rows, 500, 120)
    assert {r["level"] for r in got.collect()} <= {"LOW", "MEDIUM", "HIGH", "VERY_HIGH", None}


def test_words_and_pairs_of_one_scan(spark):
    docs = spark.createDataFrame([("a b a b",), ("a",), ("",), (None,), ("don't a",), ("a b a b",)], "text string")
    both = lm.pair_counts(docs)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(both.groupBy("w2").agg(F.sum("cnt"))) == rows(lm.unigram_counts(docs))
    assert rows(both.where("w1 is not null")) == rows(lm.bigram_counts(docs))
    model = lm.LanguageModel.train(docs, unigrams=2, bigrams=2)
    assert rows(model.unigrams) == rows(lm.top_unigrams(docs, k=2)) and rows(model.bigrams) == rows(lm.top_bigrams(docs, k=2))
    model.release()
    assert model.unigrams.count() == 2 and not lm.LanguageModel.train(docs.limit(0)).available


def test_a_payload_takes_one_scan_and_no_exchange(spark, tmp_path):
    path, model = str(tmp_path / "docs.parquet"), str(tmp_path / "model")
    docs = spark.createDataFrame([(1, "Moreover, we delve into it. " * 20), (2, None), (2, "a b c"), (None, "")], "doc_id long, text string")
    docs.write.parquet(path)
    lm.LanguageModel.train(docs).save(model)
    found = cli.detect(spark, spark.read.parquet(path), model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan and found.count() == 4


def test_pairs_are_shuffled_by_groups_whatever_a_worker_holds(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b's", "the", "cat", "dog", "x" * 40, "Zoo."]) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",), ("one",)], "text string").repartition(3)
    rows = lambda d: sorted(map(tuple, d.collect()))
    for held, size in ((2_000_000, 4_000_000), (10, 100), (1, 1)):
        monkeypatch.setattr(lm, "HELD_PAIRS", held, raising=False)
        monkeypatch.setattr(lm, "PAIRED_BYTES", size)
        both = lm.pair_counts(docs)
        assert "HashAggregate" not in both._jdf.queryExecution().executedPlan().toString()  # no row for each pair before the shuffle
        assert rows(both.where("w1 is not null")) == rows(lm.bigram_counts(docs)) and rows(both.groupBy("w2").agg(F.sum("cnt"))) == rows(lm.unigram_counts(docs))


def test_rows_of_the_last_count_are_ranked_in_small_parts(spark, monkeypatch):
    """One task ranked all rows of that count before."""
    rng = random.Random(6)
    words = ["", None, "a", "ab", "abc", "abcd", "abcde", "abcdf", "abd", "b", "\u00e9t\u00e9", "zebra", "zebras"]
    pairs = [(a, b, 9 if rng.random() < 0.1 else 1) for a in words for b in words]
    counts = spark.createDataFrame(pairs, "w1 string, w2 string, cnt long").coalesce(2)
    key = lambda r: (-r[2], *((w is not None, (w or "").encode()) for w in r[:2]))
    want, ranked, order = sorted(pairs, key=key), [], type(counts).orderBy
    monkeypatch.setattr(lm, "RANKED", 5, raising=False)
    monkeypatch.setattr(type(counts), "orderBy", lambda self, *c: ranked.append(self.count()) or order(self, *c))
    for k in (1, 20, 40, 77, 100, 131, 150, 168, 169, 200):
        assert sorted(map(tuple, lm.top(counts, k, ["w1", "w2"], hold=False).collect()), key=key) == want[:k]
    assert max(ranked) <= 2 * len(words)  # null and empty words stay together
