"""Trained operators: held-out accuracy, their parts against plain versions, and odd inputs."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseplane.llm import language_id, licenses, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
HAVE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
ODD = [(None, "null id", "en", None, None), (70001, None, "en", "s", 1), (70002, "", None, "s", 1), (70003, "12 !! ...", "en", "s", 1), (70004, "word " * 40000, "en", "s", 1), (70004, "word " * 40000, "en", "s", 1)]


def crc(k):
    return zlib.crc32(("" if k is None else str(k)).encode())


@pytest.fixture
def odd_tables(spark, tmp_path):
    """The small tables with odd rows and clashing columns added; and empty ones."""

    def write(empty=False):
        for name, rows, schema in (("documents", ODD, DOC), ("labels", [(None, 1, 1), (70001, None, None), (70002, 0, 1), (70004, 1, 0), (70004, 1, 0)], LABEL)):
            t = spark.read.parquet(f"{SF}/{name}.parquet").select(*[f.split()[0] for f in schema.split(", ")])
            t = t.where("false") if empty else t.unionByName(spark.createDataFrame(rows, schema))
            t.withColumn("score", F.lit("x")).withColumn("held_out", F.lit(3)).withColumn("label", F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@HAVE
@pytest.mark.parametrize(("query", "n", "held", "at"), [("op2_toxicity", 4, 2, 0.3), ("op3_quality", 3, 1, 0.5)])
def test_scores_of_odd_tables(spark, odd_tables, query, n, held, at):
    run = queries.queries()[query]
    sf = odd_tables()
    got = run(spark, sf).collect()
    assert len(got) == 1000 + len(ODD)
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % n == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at)
    assert run(spark, odd_tables(empty=True)).count() == 0


def auc(scores, labels):
    pos, neg = ([s for s, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@HAVE
def test_quality_of_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert auc([r["score"] for r in rows], [labels[r["doc_id"]] for r in rows]) > 0.95
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def toxic_corpus(spark, n=3000):
    rng = random.Random(12)
    vocab, bad = [f"w{i}" for i in range(400)], ["grumpfel", "grumpfling", "snark", "vileword", "meanie"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = rng.choices(vocab, k=rng.randint(20, 200))
        if toxic:
            for b in rng.choices(bad, k=rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), b)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs, labels, truth = toxic_corpus(spark)
    train = labels.where("doc_id < 2000")
    got = toxicity.score(docs.where("doc_id >= 2000"), toxicity.fit(docs.where("doc_id < 2000"), train)).collect()
    y, p = [truth[r["doc_id"]] for r in got], [r["score"] >= 0.3 for r in got]
    hit = sum(a and b for a, b in zip(y, p, strict=True))
    assert hit / sum(y) > 0.9 and hit / sum(p) > 0.9


@pytest.mark.parametrize("share", [0.05, 0.15, 0.5, 0.9])
def test_labels_may_hold_any_share_of_toxic_texts(spark, share):
    """Of 3 000 texts 15 % are toxic, whatever share of the 300 labelled ones is."""
    docs, labels, truth = toxic_corpus(spark)
    ids = {y: [k for k, v in truth.items() if v == y] for y in (0, 1)}
    n = round(300 * share)
    labels = spark.createDataFrame([(k, 1) for k in ids[1][:n]] + [(k, 0) for k in ids[0][: 300 - n]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model)
    p = {r["doc_id"]: scorer(r["text"]) >= 0.3 for r in docs.collect()}
    assert scorer("") < 0.3 and scorer("w1 w2 w3") < 0.3 and 0.05 < model.prior < 0.3
    assert np.mean([p[k] for k in ids[0]]) < 0.02
    if n > 50:  # a few positives can't show all the words
        hit = sum(p[k] for k in ids[1])
        assert hit / len(ids[1]) > 0.9 and hit / sum(p.values()) > 0.9


@HAVE
def test_toxicity_of_held_out_rows(spark):
    """Some 7 % of the rows marked toxic hold nothing that tells them from clean ones."""
    sf = SF.replace("sf0.01", "sf0.1")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    hit = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert hit / sum(r["predicted"] for r in rows) > 0.9 and hit / sum(labels[r["doc_id"]] for r in rows) > 0.8
    assert auc([r["score"] for r in rows], [labels[r["doc_id"]] for r in rows]) > 0.9


def captured(monkeypatch, module):
    """The models that the module's fit gives from now on."""
    models, fit = [], module.fit
    monkeypatch.setattr(module, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    return models


@HAVE
def test_toxicity_query_row_by_row(spark, odd_tables, monkeypatch):
    """Every score against a plain sum over the features of the whole text, without the scorer's cache and choice of features."""
    models, sf = captured(monkeypatch, toxicity), odd_tables()
    texts = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=str)
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in queries.op2_toxicity(spark, sf).collect()), key=str)
    (m,) = models

    def plain(text):
        words = toxicity._WORDS.findall((text or "").lower())
        n = {}
        for w in words:
            for f in [toxicity._hash(f"={w}", m.dims)] + [toxicity._hash(f"{k}{w[:k]}", m.dims) for k in m.heads if len(w) > k]:
                n[f] = n.get(f, 0) + 1
        steps = {toxicity._share(f, k, m.dims) for f, c in n.items() if c > 1 for k, x in enumerate(toxicity.SHARES, 1) if c * x >= len(words)}
        s = m.bias + math.fsum(m.weights.get(f, 0.0) for f in set(n) | steps)
        return 1 / (1 + math.exp(-min(max(s, -30), 30)))

    want = {k: {} for k, _ in texts}
    for k, t in texts:
        want[k][t] = plain(t)
    assert [k for k, _, _ in got] == [k for k, _ in texts] and len(m.weights) > 5
    for k, score, predicted in got:
        assert any(score == pytest.approx(x, abs=1e-9) for x in want[k].values()) and predicted == (score >= 0.3)


def test_near_copies_count_once():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(1000, 1 << 20, 200))
    near = np.unique(np.append(a[:-5], rng.integers(1 << 19, 1 << 20, 5)))
    other = np.unique(np.append(a[:3], rng.integers(1 << 10, 1 << 20, 200)))  # shares the least ones alone
    assert len(toxicity.distinct([a, a, near])) == 1 and len(toxicity.distinct([a, other])) == 2
    assert len(toxicity.distinct([a[:5], a[:5]])) == 2  # short sets are of distinct texts


def test_risk_never_rewards_negative_loss():
    """Where positives and unlabelled are the same, the bracket holds the scores near the prior's."""
    rows = [np.array([i % 3]) for i in range(60)]
    w, b = toxicity.nonnegative_pu(rows, rows, 3, 0.2, toxicity.Config(steps=200))
    p = 1 / (1 + np.exp(-(w + b)))
    assert np.isfinite(w).all() and (p > 0.02).all() and (p < 0.9).all()


def test_toxicity_without_positives(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())


def test_rules_compile_to_what_they_say(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab A!$%|. \n1Z") for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", "x " * 50000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    x = np.array([r[0] for r in docs.select(quality.statistics("text")).collect()])
    assert x.shape == (202, len(quality.STATISTICS)) and np.isfinite(x).all()
    y = (x[:, 2] > 0.1).astype(float)
    model = quality.learn(x, y, quality.Config(least_rows=3))
    z = model.bias + sum(r.weight * quality._holds(x, r.conditions) for r in model.rules)
    got = [r["score"] for r in quality.score(docs, model).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and 0 < len(model.rules)
    assert np.mean((np.array(got) > 0.5) == y) > 0.95


def test_statistics_by_hand(spark):
    got = dict(zip(quality.STATISTICS, spark.createDataFrame([("To To To go!! AB$$ x|y end.",)], "text string").select(quality.statistics("text")).first()[0], strict=True))
    assert got["log_words"] == pytest.approx(math.log1p(7)) and got["repeats"] == 2 / 7 and got["bangs"] == 2 / 27 and got["symbols"] == 2 / 27
    assert got["bars"] == 1 / 7 and got["capital_words"] == 1 / 7 and got["stops"] == 2 / 7 and got["marked_ends"] == 2 / 7 or got["marked_ends"] == 1 / 7


def test_lasso_is_sparse_and_optimal():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (500, 30)).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(3 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    config = quality.Config(l1=0.02, iterations=3000)
    w, b = quality.lasso(z, y, config)
    g = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / 500
    assert (np.abs(g) <= 0.02 + 1e-4).all() and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-3)
    assert w[0] > 1 and w[1] < -1 and (w == 0).sum() > 15


def test_constant_quality(spark):
    assert quality.learn(np.zeros((0, 13)), np.zeros(0), quality.Config()).rules == ()
    assert quality.learn(np.zeros((9, 13)), np.ones(9), quality.Config()).bias > 0


@HAVE
def test_language_of_held_out_rows(spark, odd_tables):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    sf = odd_tables()
    got = queries.op8_language(spark, sf).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in got}
    assert odd[70001] == odd[70002] == odd[70003] == "und" and odd[70004] in set(truth.values())
    assert queries.op8_language(spark, odd_tables(empty=True)).count() == 0


@HAVE
def test_language_query_row_by_row(spark, odd_tables, monkeypatch):
    """Predictions of a fifth of the rows and the odd ones against n-grams hashed and weighed one by one."""
    models, sf = captured(monkeypatch, language_id), odd_tables()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_language(spark, sf).collect()
    (m,) = models
    dims, full = len(m.idf), (1 << 64) - 1

    def plain(text):
        points, some = language_id._code_points(text or "")
        if not some:
            return {"und": 0.0}
        points, n = [int(x) for x in points], {}
        for at in range(len(points)):
            h = 0
            for k, x in enumerate(points[at : at + m.orders]):
                h = (h * 0x9E3779B97F4A7C15 + x + k + 1) & full
                d = ((h * 0xD6E8FEB86659FD93 & full) >> 40) % dims
                n[d] = n.get(d, 0) + 1
        x = {d: (1 + math.log(c)) * m.idf[d] for d, c in n.items()}
        norm = math.sqrt(math.fsum(v * v for v in x.values()))
        s = [(math.fsum(v / norm * float(m.weights[d, j]) for d, v in x.items()) + m.bias[j]) / m.temperature for j in range(len(m.languages))]
        e = [math.exp(v - max(s)) for v in s]
        return dict(zip(m.languages, (v / sum(e) for v in e), strict=True))

    some = [r for r in got if r["doc_id"] is None or r["doc_id"] % 5 == 0 or r["doc_id"] > 70000]
    assert len(some) > 200
    for r in some:
        p = plain(texts[r["doc_id"]])
        assert r["score"] == pytest.approx(max(p.values()), abs=1e-6) and p[r["lang_pred"]] == pytest.approx(r["score"], abs=1e-6)


def test_language_without_labels_and_calibration(spark):
    docs = spark.createDataFrame([("a b",), (None,)], "text string").withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.lit(1))
    model = language_id.fit(docs)
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    ys = np.array([rng.choice(3, p=q) for q in p])
    assert language_id.temperature(logits * 4, ys) == pytest.approx(4, rel=0.15)


def test_ngram_counts_do_not_depend_on_blocks():
    points, _ = language_id._code_points("Ab çd " * 300_000)
    index, counts = language_id._counts(points, 1 << 12, 3)
    assert counts.sum() == 3 * len(points) - 3


LINES = {
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under CC BY-SA 4.0.": "CC-BY-SA", "RELEASED  under the BSD 3-clause license": "BSD",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,": "MIT",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,": "GPL",
}
ORDINARY = ["The licence of the bar was renewed.", "He is free to use the software of the public.", "mit", "Version 2.0", "", "A general public was there, and the affero people too.", "Copyright 2020 by nobody", "under the"]


@pytest.fixture(scope="module")
def licence_model():
    rng = random.Random(4)
    return licenses.fit([" ".join(rng.choices(["the", "of", "thand", "under", "er", "is", "to", "and", "thing", "in"], k=rng.randint(3, 40))) for _ in range(400)])


def test_licences_by_line(spark, licence_model):
    docs = spark.createDataFrame(list(enumerate([*LINES, *ORDINARY, None, "x\n" * 50_000])), "doc_id long, text string").withColumn("licences", F.lit(1))
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(docs, licence_model).collect()}
    for i, family in enumerate(LINES.values()):
        assert [x["family"] for x in got[i]] == [family], list(LINES)[i]
    assert all(got[i] == [] for i in range(len(LINES), len(got)))


def test_licences_in_long_documents(spark, licence_model):
    lines = list(LINES)
    text = "the thing of the er\n" * 400 + lines[0] + "\nand to\n" + lines[3]
    found = licenses.scan(spark.createDataFrame([(text,)], "text string"), licence_model).first()["licences"]
    assert [(x["paragraph"], x["family"]) for x in found] == [(400, "MIT"), (402, "CC-BY-NC")] and all(0.5 <= x["score"] <= 1 for x in found)


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "BSD": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
    "GPL": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or",
    "Apache-2.0": "Licensed under the\nApache License,\nVersion 2.0.",
}


def test_hard_wrapped_licences(spark, licence_model):
    around = "the thing of the er\nand to {}\nthe thing is to\n" + "\n\nunder the thing" * 3
    texts = [*WRAPPED.values(), *[around.format("\n" + w) for w in WRAPPED.values()], *["\n".join(licenses._tokens(w)) for w in WRAPPED.values()], *[w.replace("\n", "\r\n") for w in WRAPPED.values()]]
    texts += ["\n\n".join(WRAPPED.values()), WRAPPED["MIT"].replace("\n", "\n\n"), "license\n" * 1_000]
    got = [r["licences"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_model).orderBy("doc_id").collect()]
    for k, found in enumerate(got[: 4 * len(WRAPPED)]):
        assert [x["family"] for x in found] == [list(WRAPPED)[k % len(WRAPPED)]], texts[k]
    assert [x["paragraph"] for x in got[0]] == [0]
    assert [x["family"] for x in got[-3]] == list(WRAPPED) and got[-2] == got[-1] == []


FULL_MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_wrapped_at_any_width_and_identifiers(spark, licence_model):
    import textwrap

    notices = {k: " ".join(w.replace("#", " ").replace("*", " ").split()) for k, w in WRAPPED.items()}
    texts = {textwrap.fill(n, w): [k] for k, n in notices.items() for w in (24, 40, 72, 100)}
    texts |= {f"the thing of the er\n// SPDX-License-Identifier: {i}\nand to": [k] for i, k in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL"), ("BSD-3-Clause", "BSD"), ("ISC", "ISC"), ("EPL-2.0", "EPL-2.0"), ("Frob-7", "unknown"))}
    texts |= {FULL_MIT: ["MIT"], "Licensed under the Frobnitz License.": ["unknown"]}
    texts["Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above"] = ["ISC"]
    texts["Licensed under the zlib license."] = ["Zlib"]
    texts["Distributed under the Boost Software License, Version 1.0. (See accompanying file)"] = ["BSL-1.0"]
    texts["// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause"] = ["Apache-2.0", "BSD", "MIT"]
    texts["licensed under CC BY-NC-SA 4.0 by us"] = ["CC-BY-NC-SA"]
    texts['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'] = ["MIT"]
    texts["the er to " * 500 + notices["BSD"] + " and is of" * 500] = ["BSD"]  # in the middle of a long line
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_model).orderBy("doc_id").collect()
    for r, want in zip(got, texts.values(), strict=True):
        assert [x["family"] for x in r["licences"]] == want, r["text"]


def test_runs_equal_brute_force(spark, licence_model):
    """The runs of each notice against every run of words tried by itself."""
    rng = random.Random(11)
    notices = [(f, n) for f, ns in licenses.TEMPLATES.items() for n in ns]
    texts = []
    for k in range(12):
        words = []
        for _, n in rng.sample(notices, 2):
            words += [w for w in licenses._tokens(n) if rng.random() > 0.1] + rng.choices(["thing", "er", "\n\n", "the"], k=rng.randint(0, 4))
        texts.append(" ".join(words) if k % 3 else "\n".join(words))
    whole = licenses._notices(licence_model.coverage)
    docs = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", licenses._words(F.col("t")))
    got = docs.select("t", "w", F.transform(whole, lambda n: licenses._runs(licenses._places(F.col("w")), n)).alias("r")).collect()
    for row in got:
        words = [(x["block"], x["w"]) for x in row["w"]]
        for (_, n), runs in zip(notices, row["r"], strict=True):
            own = licenses._pairs(licenses._tokens(n))
            need, reach = max(math.ceil(licence_model.coverage * len(own)), 1), 2 * len(licenses._tokens(n))
            covers = 0
            for i in range(len(words)):
                inside = {f"{a[1]} {b[1]}" for a, b in zip(words[i : i + reach], words[i + 1 : i + reach], strict=False) if a[0] == b[0] == words[i][0]} & own
                covers = max(covers, len(inside))
            assert bool(runs) == (covers >= need) and max((r["share"] for r in runs), default=0) == pytest.approx(covers / len(own) if covers >= need else 0)
            assert all(a["last"] < b["first"] for a, b in zip(runs, runs[1:], strict=False))


def test_work_is_in_proportion_to_the_text(spark, licence_model):
    import time

    notice = "\n".join(licenses._tokens(WRAPPED["GPL"]))
    took = []
    for k in (25, 25, 200):
        docs = spark.createDataFrame([(("\n" + notice) * k,)], "text string")
        began = time.perf_counter()
        found = licenses.scan(docs, licence_model).first()["licences"]
        took.append(time.perf_counter() - began)
        assert [x["family"] for x in found] == ["GPL"] * k
    assert took[2] < 8 * took[1] + 8


def test_classifier_equals_the_plain_one(spark, licence_model):
    m, rng = licence_model, random.Random(5)
    words = sorted({w for ns in licenses.TEMPLATES.values() for n in ns for w in licenses._tokens(n)}) + ["thing", "er"]
    lines = [*LINES, *ORDINARY[:3], *(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(60))]
    docs = spark.createDataFrame([(x,) for x in lines], "t string")
    got = docs.select(licenses.classified(licenses.tokens(F.col("t")), m).alias("c")).select("c.*", licenses.coverage_of(F.col("c.words"), F.col("c.family")).alias("share")).collect()
    for x, r in zip(lines, got, strict=True):
        own = licenses._tokens(x)
        z = np.array(m.bias)
        for g in {*own, *licenses._pairs(own)}:
            z = z + np.array(m.weights.get(g, np.zeros(len(z))))
        p = np.exp(z / m.temperature)
        p /= p.sum()
        best = 1 + int(p[1:].argmax())
        assert r["family"] == m.families[best] and r["score"] == pytest.approx(p[best])
        assert r["share"] == pytest.approx(max(len(licenses._pairs(licenses._tokens(n)) & licenses._pairs(own)) / len(licenses._pairs(licenses._tokens(n))) for n in licenses.TEMPLATES[r["family"]]))


def test_anchors_miss_no_covering_paragraph(licence_model):
    """Any choice of enough pairs of a notice holds an anchor."""
    rng = random.Random(9)
    for notices in licenses.TEMPLATES.values():
        for n in notices:
            of = sorted(licenses._pairs(licenses._tokens(n)))
            for _ in range(50):
                kept = rng.sample(of, math.ceil(licence_model.coverage * len(of)))
                assert {w for p in kept for w in p.split(" ")} & set(licence_model.anchors)


@HAVE
def test_licence_query(spark, odd_tables):
    got = {r["doc_id"]: r for r in queries.op10_licenses(spark, odd_tables()).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        assert ("MIT" in got[r["doc_id"]]["families"].split(",")) == ("Released under the MIT License." in r["text"])
    assert queries.op10_licenses(spark, odd_tables(empty=True)).count() == 0
