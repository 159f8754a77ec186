import pyarrow as pa
from pyspark.sql import functions as F

from proseplane.functions import rulebook as book
from proseplane.functions import text as T
from proseplane.functions.batches import of_sentences, of_texts
from proseplane.operators import cleanup, gates, rules
from proseplane.plans import catalogue


def test_parts_are_small_and_whole():
    texts = pa.array(["a" * 5, None, "b" * 40, "", "c" * 5, "d" * 5])
    got = list(of_texts(texts, 12))
    assert [x for p in got for x in p.to_pylist()] == texts.to_pylist() and [len(p) for p in got] == [2, 1, 3]
    docs = pa.array([[["a", "b"], ["c"]], [], [["d"] * 9], [["e"], []]])
    got = list(of_sentences(docs, 4))
    assert [x for p in got for x in p.to_pylist()] == docs.to_pylist() and len(got) == 3 and all(p.offset == 0 for p in got)
    assert not list(of_texts(texts.slice(0, 0))) and not list(of_sentences(docs.slice(0, 0)))


def test_frail_provider_keeps_no_prompts():
    from proseplane.operators import dispatch

    provider = catalogue._frail()
    ask = dispatch.Dispatcher(provider, dispatch.Limits(retries={k: (8, 0.0) for k in dispatch.Limits().retries}), sleep=lambda s: None)
    first = [ask("x" * n) for n in range(1_000)]
    seen = next(c.cell_contents for c in provider.call.__closure__ if isinstance(c.cell_contents, dict))
    assert not seen and [ask("x" * n) for n in range(1_000)] == first and {r.calls for r in first} >= {1, 2, 3}


def test_fixed_parts_are_in_every_match():
    assert T.fixed_part(r"\bin my (?:personal )?experience\b") == "experience" and T.fixed_part(r"\bfor the past \d+ years\b(?!.*\bx\b)") == "for the past "
    assert T.fixed_part("colou?r") == "colo" and T.fixed_part("a|bcd") == "" and T.fixed_part(r"\x41bc") == "" and T.fixed_part(r"ab[cd|]+e.g*hi") == "ab"


def test_one_rule_alone_gives_what_all_give(spark, texts):
    docs = texts("In my experience, trust me, it is a landscape.\n\n- a\n- b\n" * 20, "", "Plain words. " * 60, "within order to delve.  Trust me  , yet, 1999 " * 9)
    every = {(r["doc_id"], *r[2:]) for r in rules.long_form(rules.scored(docs)).collect()}
    names = {r[2] for r in every}
    assert names and {(r["doc_id"], *r[2:]) for n in names for r in rules.long_form(rules.scored(docs, ruleset=book.only(n))).collect()} == every


def test_leftovers_and_none_in_one_scan(spark, texts):
    old = cleanup.ordered_pairs()[0][1]
    got = cleanup.leftovers(texts(f"x {old} y", "z", None), "text", none="none")
    assert {(0, old), (1, "none"), (2, "none")} <= {tuple(r) for r in got.collect()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_gates_at_once(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.5, None), (5.0, 0.1, 0.2, None)], "change double, a double, b double, none double")
    got = gates.at_once(rows, gates.readability(), gates.external("a", "b"), gates.meaning("none")).collect()
    assert [(r["name"], r["metric"], r["status"]) for r in got] == [("readability", 3.0, "fail"), ("external_score", 0.5, "fail"), ("meaning", None, "skipped")]


def test_mass_from_one_pass_without_a_cache(spark):
    from proseplane.operators import lm

    counts = spark.createDataFrame([("a", 5), ("b", 2), ("c", 2), ("d", 2), ("e", 1)], "w string, cnt long")
    got = lm.mass_kept(counts, 3)
    assert "InMemory" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(9, 12, 0.75)] and [tuple(r) for r in lm.mass_kept(counts.where("false"), 3).collect()] == [(0, 0, None)]
