"""The queries with SQL give the rows that DuckDB gives, on the given tables and on odd ones."""

import os

import duckdb
import pytest

from proseplane.llm import queries

SF = "/root/testdata/sf0.001"
ODD = [(1, 0, "system", "be"), (1, 5000, "user", "a b"), (1, 10**7, "assistant", "c # </turn> d"), (2, None, None, None), (2, -3, "assistant", "x " * 900), (None, 1, "user", "n"), (3, 1, "user", "same"), (3, 1, "user", "same")]
DOCS = [(1, None, "en", None), (2, "", "en", "b"), (3, "word " * 3000, None, "a"), (3, "word " * 3000, None, "a"), (None, "é\n" * 9, "fr", "é")]


def canonical(rows):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in rows)


def both(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        at = f"{folder}/{t}/*.parquet" if os.path.isdir(f"{folder}/{t}") else f"{folder}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{at}'")
    got = queries.queries()[name](spark, folder)
    columns = sorted(got.columns)
    return canonical(got.select(*columns).collect()), canonical(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_equals_duckdb(spark, name):
    got, want = both(spark, SF, name)
    assert got == want


@pytest.mark.parametrize("name", ["op1_chat_windows", "mix_targets", "media_payloads"])
def test_equals_duckdb_on_odd_tables(spark, tmp_path, name):
    long = [(4, t * 997 - 10**5, "assistant" if t % 2 else "user", f"t{t} " * (t % 50)) for t in range(1200)]
    spark.createDataFrame(ODD + long, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = both(spark, str(tmp_path), name)
    assert got == want
