"""Each stage of the pipeline on its own input, against plain versions."""

import importlib
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from proseplane.llm import decontaminate, queries, simhash

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(90001, None, "en", "s", 0), (90002, "", "en", "s", 0), (90003, "123 ...", None, None, 7)]
    t = spark.read.parquet(f"{SF}/documents.parquet")
    return t.unionByName(spark.createDataFrame(odd, t.schema)).cache()


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_drops_what_has_no_letter(spark, docs):
    got = pipeline.identify_language(spark, docs, SF)
    assert got.columns == docs.columns and ids(docs) - ids(got) == Counter([90001, 90002, 90003])


def test_quality_keeps_clean_documents(spark, docs):
    got = ids(pipeline.classify_quality(spark, docs, SF))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(k in got) == bool(y) for k, y in labels.items()]
    assert sum(right) >= 0.98 * len(right) and all(k in got for k, y in labels.items() if y)


def test_one_of_each_class_stays(spark, docs):
    rows = docs.where("text is not null").select("doc_id", "text").collect()
    fp = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows}
    order = sorted(fp)
    parent = {k: k for k in order}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert ids(pipeline.drop_near_duplicates(spark, docs.where("text is not null"), SF)) == Counter({find(k): 1 for k in order})


def test_benchmark_goes(spark, docs):
    got = {r["doc_id"]: r for r in pipeline.remove_benchmark(spark, docs, SF).collect()}
    judged = {r["doc_id"]: r for r in queries.op4_decontaminate(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in docs.collect()} - {k for k, r in judged.items() if r["contaminated"]}
    automaton = decontaminate.SuffixAutomaton([(str(r[0]), decontaminate.normalised(r[1])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    for r in docs.collect():
        if r["doc_id"] in got:
            after = got[r["doc_id"]]
            if r["doc_id"] in judged and judged[r["doc_id"]]["n_hit"] == 0:
                assert after["text"] == r["text"]
            assert automaton.hits(decontaminate.normalised(after["text"]))[0] == [] and after["n_chars"] == (None if after["text"] is None else len(after["text"]))


def test_mixed_sizes(spark, docs):
    got = pipeline.mix_sources(spark, docs, SF)
    assert set(docs.columns) < set(got.columns)
    sizes = docs.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0]
    mixed = got.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0]
    assert mixed == pytest.approx(1.5 * sizes, rel=0.1) and max(ids(got).values()) <= 2


def test_whole_run_chains_the_stages(spark, docs):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), stage(spark, now, SF).schema)
    rows = lambda df: Counter((r["doc_id"], r["copy"], r["text"]) for r in df.collect())
    assert rows(pipeline.run(spark, SF)) == rows(now)
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "mixing"]


NAMES = ("contamination", "n_hit", "contaminated", "m", "copies", "i", "s", "z", "row", "score", "lang_pred", "fp", "root", "_text", "held_out", "size", "_row")


def test_clashing_columns_and_repeated_rows(spark, docs):
    """Further columns of any name come through each stage as they are; repeated rows and null ids don't stop it."""
    some = docs.orderBy("doc_id").limit(120)
    some = some.unionByName(some.limit(30)).unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    some = some.withColumns({c: F.lit(f"own {c}") for c in NAMES}).cache()
    for name, stage in pipeline.STAGES:
        got = stage(spark, some, SF)
        assert set(some.columns) <= set(got.columns) and got.count() > 0, name
        row = got.first()
        assert all(row[c] == f"own {c}" for c in NAMES), name


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_imports_without_the_subpackage(tmp_path):
    """As a copy without corpus_pipeline.py and the subpackage."""
    import shutil

    root = os.path.dirname(os.path.abspath(pipeline.__file__))
    shutil.copytree(os.path.join(root, "proseplane"), tmp_path / "proseplane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rule_score' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("proseplane.llm") is not None
