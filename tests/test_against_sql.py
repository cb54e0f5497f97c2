"""Queries against their SQL on rows that the small tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from terraloom.plans import registry


def same(spark, d, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, d / f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got = registry.QUERIES[name](spark, str(d))
    want = sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall())
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def test_terms_of_any_case(spark, tmp_path):
    texts = ["SCHÖNE Welt", "schön", "Schön", "İNVEST", "ınvest", "Kolumbien MARKOV CHAIN", "LAND UſE", "nichts", None, "THE\nREOF", "ThereOF", "(GWR)"]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    assert [r[0] for r in same(spark, tmp_path, "relevance_filter", documents=docs)] == [0, 1, 3, 5, 10, 11]


def test_keys_past_two_letters(spark, tmp_path):
    """More than 703 rows of a key, of which one ends with a digit that begins another's."""
    n = 8000
    rows = pa.table({"c_custkey": pa.array(range(n), pa.int64()), "c_mktsegment": ["A"] * n, "c_nationkey": pa.array([1 if k % 8 else 12 for k in range(n)], pa.int32())})
    keys = {r[1] for r in same(spark, tmp_path, "dedup_key", customer=rows)}
    assert len(keys) == n and {"A1", "A1a", "A1aa", "A1zz", "A1{a", "A12zz"} <= keys
