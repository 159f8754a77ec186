"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from proseplane.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_duckdb(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert canonical(got.select(*columns).collect()) == canonical(want)


def test_sql_names_queries():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_rule_has_hits(spark):
    from proseplane.functions import rulebook as book
    from proseplane.operators import rules
    from proseplane.sources import probe

    sf = "/root/testdata/sf0.01"
    found = {r["rule"] for r in rules.long_form(rules.scored(probe.load(spark, sf)).select("doc_id", "violations")).select("rule").distinct().collect()}
    named = {r.name for r in (*book.WORDS, *book.PHRASES, *book.PRETENCE, *book.SIGNALS)}
    assert named | {"heading_density", "list_density", "sentence_length_cv", "short_sentence_ratio", "paragraph_uniformity", "para_opening_enumeration"} == found
