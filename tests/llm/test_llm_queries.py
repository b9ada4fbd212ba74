import __spark_entry__ as entry
import duckdb
import pytest

from loomframe.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_runs(spark, name):
    df = q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns and (rows or name == "p9_found")
    if name in q.SQL:
        con = duckdb.connect()
        for table in ("rag_documents", "documents"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        rel = con.execute(q.SQL[name])
        names = [c[0] for c in rel.description]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall())


def test_registered():
    assert set(q.QUERIES) <= set(entry.queries()) and set(q.SQL) <= set(entry.oracle_sql())


def test_columns(spark):
    want = {"p1_found": ["id_a", "id_b"], "p2_found": ["key_a", "key_b"], "p4_found": ["id"], "p5_found": ["rec_a", "rec_b"], "p6_found": ["field", "row_id", "lang"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_a", "doc_b"]}
    assert {k: q.QUERIES[k](spark, SF).columns for k in want} == want
