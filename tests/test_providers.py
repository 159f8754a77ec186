"""Pacing, retries and splits of calls, and the store of answers."""

import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseplane.operators import answers, dispatch, prompts
from proseplane.operators.polish import AuthError, ContextLimitError, Provider, ProviderTimeout, RateLimitError


def dispatcher(call, sleeps=None, **limits):
    waits = [] if sleeps is None else sleeps
    return dispatch.Dispatcher(Provider("p", "1", call), dispatch.Limits(**limits), sleep=waits.append)


def failing(times, error):
    calls = []

    def call(prompt):
        calls.append(prompt)
        if len(calls) <= times:
            raise error
        return f"<{prompt}>"

    return call, calls


@pytest.mark.parametrize(("times", "error", "calls", "ok"), [(0, AuthError("x"), 1, True), (1, AuthError("no"), 1, False), (2, RateLimitError("slow"), 3, True), (6, RateLimitError("slow"), 6, False), (2, ProviderTimeout("t"), 3, True), (3, ProviderTimeout("t"), 3, False), (1, KeyError("k"), 1, False)])
def test_each_kind_of_error(times, error, calls, ok):
    call, seen = failing(times, error)
    got = dispatcher(call)("ask")
    assert (got.calls, got.answer, len(seen)) == (calls, "<ask>" if ok else None, calls)
    assert got.error is None if ok else got.error.startswith(type(error).__name__)


def test_waits_grow_and_obey_the_error():
    slow = RateLimitError("slow")
    slow.retry_after = 9
    sleeps: list[float] = []
    dispatcher(failing(1, slow)[0], sleeps)("a")
    assert sleeps == [9]
    sleeps.clear()
    dispatcher(failing(5, RateLimitError("slow"))[0], sleeps, longest_wait=5.0)("a")
    assert all(0.5 * 2**k <= w <= min(2**k, 5) or w == 5 for k, w in enumerate(sleeps)) and len(sleeps) == 5


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(1, 60))
def test_pieces_join_to_the_text(text, most):
    got = dispatch.pieces(text, most)
    assert "".join(got) == text and all(len(p) <= most for p in got)


def test_long_prompts_are_split_with_their_frame(spark):
    article = "One two three four.\n\n" * 60
    prompt = spark.range(1).select(prompts.rewrite_prompt(F.lit(article), F.expr("cast(array() as array<struct<category:string,rule:string,weight:int,count:int,sample:string,threshold:int,score:double>>)"), strength="low")).first()[0]

    def rewrite(p):
        assert p.startswith("# Task") and p.rstrip().endswith("Return the article alone.")
        return p.split("## Article\n", 1)[1].rsplit("\n\nReturn", 1)[0]

    got = dispatcher(rewrite, context=len(prompt) - len(article) + 300)(prompt)
    assert got.answer == article and got.parts > 3 and got.error is None

    def refusing(p):
        if len(p) > len(prompt) - len(article) + 300:
            raise ContextLimitError("too long")
        return rewrite(p)

    halved = dispatcher(refusing)(prompt)
    assert halved.answer == article and halved.calls > halved.parts > 3
    never = dispatcher(failing(10**6, ContextLimitError("too long"))[0])("abc " * 10)
    assert never.answer is None and never.error.startswith("ContextLimitError")


def test_a_bucket_is_shared_and_paced(tmp_path):
    now = [100.0]
    waits: list[float] = []

    def sleep(s):
        waits.append(s)
        now[0] += s

    one, two = (dispatch.Bucket("p", 2.0, 3, str(tmp_path), now=lambda: now[0], sleep=sleep) for _ in range(2))
    for k in range(9):
        (one, two)[k % 2].take()
    assert waits == [0.5] * 6
    now[0] += 10
    assert [one.take() for _ in range(3)] == [0.0] * 3 and one.take() == 0.5
    real = dispatch.Bucket("q", 200.0, 1, str(tmp_path))
    import time

    began = time.time()
    workers = [threading.Thread(target=lambda: [real.take() for _ in range(10)]) for _ in range(4)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert time.time() - began >= 39 / 200 * 0.95


def test_a_rerun_asks_only_what_is_missing(spark, tmp_path):
    log = tmp_path / "log"

    def call(prompt, log=str(log)):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise AuthError("no")
        return prompt.upper()

    store, provider = answers.AnswerStore(spark, str(tmp_path / "store")), Provider("up", "1", call)
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "a", 0), (4, None, 0), (5, "bad", 0), (5, "bad", 0)], "id long, prompt string, answered int")
    got = {(r["id"], r["answered"]["answer"], r["answered"]["error"]) for r in store.ask(rows, "prompt", provider, passes=3).collect()}
    assert got == {(1, "A", None), (2, "B", None), (3, "A", None), (4, "", None), (5, None, "AuthError: no")}
    assert sorted(log.read_text().splitlines()) == ["", "a", "b", "bad"]
    more = rows.unionByName(spark.createDataFrame([(6, "c", 0)], rows.schema))
    assert store.ask(more, "prompt", provider).count() == 7
    assert sorted(log.read_text().splitlines()) == ["", "a", "b", "bad", "bad", "c"]  # answers are kept, errors asked again
    other = Provider("up", "2", lambda p: "x")
    assert {r["answered"]["answer"] for r in store.ask(rows.where("id = 1"), "prompt", other).collect()} == {"x"}
    assert store.ask(rows.where("false"), "prompt", provider).count() == 0


def test_a_lost_run_keeps_its_whole_passes(spark, tmp_path, monkeypatch):
    asked: list[str] = []
    store = answers.AnswerStore(spark, str(tmp_path / "store"))
    provider = Provider("up", "1", str.upper)
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "id long, prompt string")
    moved = []

    def dies(spark, source, target, real=answers.move):
        if len(moved) == 2:
            raise RuntimeError("lost")
        moved.append(target)
        real(spark, source, target)

    monkeypatch.setattr(answers, "move", dies)
    with pytest.raises(RuntimeError, match="lost"):
        store.ask(rows, "prompt", provider, passes=4)
    monkeypatch.undo()
    kept = store.known(provider).count()
    assert 0 < kept < 40 and not asked
    done = store.ask(rows, "prompt", provider)
    assert sorted(r["answered"]["answer"] for r in done.collect()) == sorted(f"P{k}" for k in range(40))
    assert store.parts().count() == 40 and store.parts().select("key").distinct().count() == 40


def test_command_line_lists_providers_and_mines_phrases(spark, tmp_path, capsys):
    import json

    from proseplane import cli
    from proseplane.operators import polish

    polish.clear()
    assert cli.main(["providers"]) == 3
    polish.use_callable(str.upper, "upper")
    try:
        assert cli.main(["providers"]) == 0 and capsys.readouterr().out == "upper\n"
    finally:
        polish.clear()
    answers_ = tmp_path / "answers.jsonl"
    answers_.write_text("\n".join(json.dumps({"human_answers": [f"we walk home {k}"], "chatgpt_answers": [f"as an assistant i walk {k}"]}) for k in range(6)))
    assert cli.main(["mine", str(answers_), str(tmp_path / "phrases"), "--words", "2", "--least", "2"]) == 0
    assert "as an" in "".join(p.read_text() for p in (tmp_path / "phrases").glob("*") if p.is_file())
