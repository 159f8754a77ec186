import pytest
from pyspark.sql import functions as F

from proseplane import cli
from proseplane.functions import rulebook as book
from proseplane.operators import cleanup, external, gates, polish, prompts, rules
from proseplane.plans.catalogue import ANSWERS
from proseplane.sources import readers
from proseplane.streaming import scoring


def python_cleaned(t):
    for _, a, b in cleanup.ordered_pairs():
        t = t.replace(a, b)
    return t


def test_cleanup_equals_sequential_replacement(texts):
    ts = ["In conclusion, we utilize it in order to facilitate.", "disregarding insufficient", "It's important to note that I delve into the tapestry of", ""]
    assert [r[0] for r in texts(*ts).orderBy("doc_id").select(cleanup.cleaned(F.col("text"))).collect()] == [python_cleaned(t) for t in ts]
    assert python_cleaned("disregarding insufficient") == "disabout inenough"


def test_cleanup_is_idempotent_and_spares_code(texts):
    t = "Moreover, we utilize `utilize()` and https://x.org/utilize in order to leverage it."
    once = texts(t).select(cleanup.protected(F.col("text")).alias("t")).first()["t"]
    assert once == "we use `utilize()` and https://x.org/utilize to use it."
    assert texts(once).select(cleanup.protected(F.col("text"))).first()[0] == once


def test_pairs_are_ordered_and_malformed_ones_dropped():
    assert len(cleanup.ordered_pairs()) == 102
    assert cleanup.ordered_pairs({"b": (("a", "x"), ("abc", "y"), ("bad",), ("", "z"))}) == [("b", "abc", "y"), ("b", "a", "x")]
    assert list(book.REPLACEMENTS)[0] == "safety_disclaimer"


def test_strength():
    assert prompts.strength_of() is prompts.Strength.MEDIUM and prompts.strength_of(None, True) is prompts.Strength.HIGH
    assert prompts.strength_of("low", True) is prompts.Strength.LOW
    with pytest.raises(ValueError):
        prompts.strength_of("huge")


def test_prompts(texts):
    docs = rules.scored(texts("We utilize {VIOLATIONS} and synergy here.", "Plain."))
    medium, none = (r[0] for r in docs.orderBy("doc_id").select(prompts.rewrite_prompt(F.col("text"), F.col("violations"))).collect())
    assert "{VIOLATIONS} and synergy" in medium and "blacklist_words.corporate_filler: hit 2x" in medium and prompts.NOTHING_FOUND in none
    low = docs.select(prompts.rewrite_prompt(F.col("text"), F.col("violations"), strength="low")).first()[0]
    assert prompts.SECTIONS["voice"] in medium and prompts.SECTIONS["voice"] not in low
    assert prompts.scene_rules("nowhere") == prompts.scene_rules("analysis") and prompts.SECTIONS["claims"] not in prompts.scene_rules("blog")


def test_answers_and_reports(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "id long, a string").withColumn("p", prompts.parsed_answer(F.col("a"))).withColumn("r", prompts.report(F.col("p"))).orderBy("id").collect()
    assert [r["p"]["parse_error"] is not None for r in rows] == [False, False, False, True, True, True, False, True]
    assert rows[0]["p"]["result"]["publishable"] is True and rows[1]["p"]["result"]["best_theses"] == ["x"] and len(rows[7]["p"]["raw"]) == 500
    assert "publishable" in rows[0]["r"] and "### Strongest judgements (1)\n- x" in rows[1]["r"] and "JSON parse failure" in rows[3]["r"]


BAD = "As an AI language model, we utilize synergy to leverage groundbreaking paradigms. In conclusion, it is transformative. " * 3


def test_one_pass_keeps_the_best(texts):
    got = {r["doc_id"]: r for r in polish.one_pass(texts(BAD, "Cats sleep.", None), polish.Provider("p", "m", lambda p: "Cats sleep all day.")).collect()}
    assert got[0]["status"] == "rewritten" and got[0]["after"] == "Cats sleep all day." and got[0]["after_total"] < got[0]["before_total"]
    assert got[1]["status"] == "publishable" and got[1]["after"] == "Cats sleep." and len(got) == 3

    def broken(prompt):
        raise polish.RateLimitError("later")

    assert polish.one_pass(texts(BAD), polish.Provider("p", "m", broken)).first()["status"] == "cleaned"


def test_review_never_raises(texts):
    judge = polish.Provider("j", "1", lambda p: '{"publishable": true, "best_theses": ["a"]}')
    row = polish.review(texts("Text."), judge, polish.Provider("w", "1", str)).first()
    assert row["review"]["result"]["publishable"] and "judge: j:1 | writer: w:1" in row["review_report"]
    assert "judge is the writer" in polish.review(texts("Text."), judge, judge).first()["review_report"]
    assert polish.review(texts("Text."), judge, judge, allow_self=True).first()["review_error"] is None


def test_iteration_stops(texts):
    judge = polish.Provider("j", "1", lambda p: "no idea" if "bad" in p else '{"ai_score": %d, "verdict": "ai", "tells": ["x"]}' % (90 if "long" in p else 10))
    writer = polish.Provider("w", "1", lambda p: p.split("## Article\n", 1)[1].split("\n\nReturn")[0])
    got = polish.iterate(texts("short one", "long one", "bad one"), writer, judge, rounds=2).collect()
    assert {(r["doc_id"], r["round"], r["stopped"]) for r in got} == {(0, 1, "target"), (1, 1, None), (1, 2, "exhausted"), (2, 1, "judge_failed")} and len(got) == 4


def test_providers():
    polish.clear()
    with pytest.raises(polish.NotConfigured):
        polish.resolve_provider()
    polish.use_callable(str, "a")
    polish.use_callable(str, "b", activate=False)
    assert polish.list_providers() == ["a", "b"] and polish.resolve_provider().name == "a" and polish.use("b").name == "b"
    with pytest.raises(polish.ConfigError):
        polish.resolve_provider("c")
    polish.clear()


def test_gates(spark, texts):
    docs = texts("The cat sat on the mat.").withColumn("after", F.lit("The cat sat on a mat."))
    report = gates.summary(gates.readability_gate(gates.readability_rows(docs, "text", "after")), gates.meaning_gate(spark.createDataFrame([], "s double"), "s"), gates.external_gate(spark.createDataFrame([(0.1, 0.2)], "a double, b double"), "a", "b"))
    assert {r["name"]: r["status"] for r in report.collect()} == {"readability": "pass", "meaning": "skipped", "external_score": "fail"}
    assert gates.exit_code(report) == 1 and "| meaning | skipped | - |" in gates.markdown(report)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"human_answers": [" %s ", "short"], "chatgpt_answers": ["%s"]}\n\n{"human_answers": null}\nbroken\n' % ("h" * 60, "c" * 50))
    assert sorted(tuple(r) for r in readers.read_answers(spark, str(tmp_path / "a.jsonl")).collect()) == [("c" * 50, 1), ("h" * 60, 0)]
    (tmp_path / "b.json").write_text('{"samples": [{"id": "2", "domain": "blog", "scene": "blog", "text": "x"},\n {"id": "1", "domain": "news", "scene": "essay", "text": "y"}]}')
    assert [r["id"] for r in readers.read_bench(spark, str(tmp_path / "b.json"), n=1).collect()] == ["1"]
    assert readers.read_bench(spark, str(tmp_path / "b.json"), domain="blog").count() == 1
    with pytest.raises(ValueError):
        readers.read_bench(spark, "x", source="?")
    with pytest.raises(NotImplementedError):
        readers.read_bench(spark, "x", source="raid")
    (tmp_path / "c.json").write_text('{"feature_order": ["a"], "feature_mean": [1, 2], "feature_std": [1], "coef": [1], "intercept": 0}')
    assert readers.read_calibration(str(tmp_path / "c.json")) is None
    readers.write_calibration(str(tmp_path / "d.json"), book.CALIBRATION, book.INTERCEPT)
    assert readers.read_calibration(str(tmp_path / "d.json")) == (book.CALIBRATION, book.INTERCEPT)


def test_command_line(spark, tmp_path, texts):
    (tmp_path / "in.md").write_text("In conclusion, we utilize it.")
    assert cli.main(["detect", str(tmp_path / "in.md"), str(tmp_path / "out")]) == 0
    payload = spark.read.json(str(tmp_path / "out")).first()
    assert payload["chars"] == 29 and payload["combined"]["decision"] in ("PASS", "BLOCK") and payload["ngram"]["available"] is False
    assert cli.main(["clean", str(tmp_path / "in.md"), str(tmp_path / "clean")]) == 0
    assert spark.read.parquet(str(tmp_path / "clean")).first()["text"] == "we use it."
    assert cli.main(["detect", str(tmp_path / "no.md"), str(tmp_path / "out2")]) == 2


def test_command_line_with_providers(spark, tmp_path):
    (tmp_path / "in.md").write_text(BAD)
    assert cli.main(["polish", str(tmp_path / "in.md"), str(tmp_path / "out")]) == 3
    assert cli.main(["polish", str(tmp_path / "in.md"), str(tmp_path / "out"), "--provider", "no.such:thing"]) == 3
    assert cli.main(["polish", str(tmp_path / "in.md"), str(tmp_path / "out"), "--provider", "json:dumps", "--force"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first()["status"] in ("cleaned", "rewritten")
    assert cli.main(["judge", str(tmp_path / "in.md"), str(tmp_path / "j"), "--provider", "textwrap:dedent"]) == 0
    assert "JSON parse failure" in spark.read.parquet(str(tmp_path / "j")).first()["review_report"]
    page = str(tmp_path / "rules.md")
    assert cli.main(["rules", page, "--check"]) == 1 and cli.main(["rules", page]) == 0 and cli.main(["rules", page, "--check"]) == 0


def test_rule_files(spark, tmp_path, texts):
    (tmp_path / "r.json").write_text('{"_meta": {"version": "9"}, "blacklist_words": {"_desc": "x", "mine": {"weight": 2, "patterns": ["zorp", "zorping"]}, "odd": 3}, "soul_signals": {"s": {"min_threshold": 1, "pattern": "q"}}, "rhythm_rules": {"short_sentence_ratio": {"weight": 1, "min_sentences": 2}}}')
    own = readers.read_rules(str(tmp_path / "r.json"))
    got = rules.scored(texts("We zorp and utilize zorping."), ruleset=own).first()
    assert {(v["rule"], v["count"], v["score"]) for v in got["violations"]} == {("mine", 2, 4.0), ("s", 0, 5.0)} and own.version == "9" and own.short_sentence_ratio == (1, 300, 5, 0.02)
    none = readers.read_rules(str(tmp_path / "missing.json"))
    assert none.version == "0.0.0-unloadable" and rules.scored(texts(BAD), ruleset=none).first()["total"] == 0
    (tmp_path / "p.json").write_text('{"replacements": {"_order": ["a"], "a": [["x", "y"], ["bad"], "worse"]}}')
    assert cleanup.ordered_pairs(readers.read_replacements(str(tmp_path / "p.json"))) == [("a", "x", "y")]
    assert readers.read_replacements(str(tmp_path / "none.json")) == {}


def test_environment_file(tmp_path, monkeypatch):
    import os

    monkeypatch.setenv("PROSE_A", "kept")
    monkeypatch.delenv("PROSE_B", raising=False)
    (tmp_path / "env").write_text("# note\nPROSE_A=1\nPROSE_B='two'\nnothing\n")
    assert readers.read_environment(str(tmp_path / "env")) == 1 and os.environ["PROSE_A"] == "kept" and os.environ.pop("PROSE_B") == "two"
    assert readers.read_environment(str(tmp_path / "none")) == 0


def test_external_scores(texts):
    def load():
        def scorer(ts):
            if any("bad" in t for t in ts):
                raise ValueError
            return [float(len(t)) for t in ts]

        return scorer

    assert [r[0] for r in texts("ab", "bad", None, "abcd").orderBy("doc_id").select(external.external_scores(F.col("text"), load)).collect()] == [2.0, None, None, 4.0]


def test_stream_equals_batch(spark, tmp_path, texts):
    docs = texts(BAD, "Cats sleep.", "")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    scoring.score_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["doc_id"]: r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["doc_id"]: r["total"] for r in rules.scored(docs).collect()}


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:00:01", "Cats sleep."), ("2026-01-01 00:02:00", BAD)], "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = scoring.windowed_levels(stream).writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from levels").first()[0] == 2
