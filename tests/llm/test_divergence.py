"""The audit of sources against its SQL, and on odd tables."""
import duckdb
import pandas as pd
import pytest

from check import rows
from pricematch.llm import divergence, queries

SF = "/root/testdata/sf0.001"


def wanted(documents):
    con = duckdb.connect()
    con.register("documents", documents) if isinstance(documents, pd.DataFrame) else con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}'")
    cur = con.execute(divergence.AUDIT_SQL)
    return rows([d[0] for d in cur.description], cur.fetchall())


def found(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def test_equals_sql(spark):
    assert found(queries.QUERIES["op12_divergence"](spark, SF)) == wanted(f"{SF}/documents.parquet")


@pytest.mark.parametrize("words", [1, 4_000_000])
def test_odd_tables_in_blocks_of_any_size(spark, words):
    data = [(i, t, "en", s) for i, (t, s) in enumerate([("The cat's cat; the DOG, the end.", "a"), ("cat cats\tcat x Éa éa the", "b"), ("the the the-the the the the the", "a")] * 12)]
    data += [(100, None, "en", "c"), (101, "", None, "c"), (102, " \t\n", "de", None), (102, "der der", "de", "x"), (None, "the cat", "en", "a"), (103, "the " * 150_000, "en", "big")]
    data += [(200, "12 34 ..", "es", s) for s in "pqr"] + [(300, "solo " * 3, "fr", "only")] * 11
    docs = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source"]).assign(term="clash", chunk=1, rank=2)
    df = spark.createDataFrame([(*r, "clash", 1, 2, "g") for r in data], "doc_id long, text string, lang string, source string, term string, chunk int, rank int, grp string").repartition(3)
    got = found(divergence.audit(df, words=words))
    assert got == wanted(docs)
    assert {(r[got[0].index("source")], r[got[0].index("item")]) for r in got[1] if "es" in r} == {(a, b) for a in "pqr" for b in "pqr" if a != b}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(df).count() == 0
