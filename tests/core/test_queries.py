"""Every core query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from siltstone.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_knn_probed_recall(spark):
    r = catalog.queries()["knn_probed"](spark, SF).agg({"recall": "avg"}).collect()[0][0]
    assert r >= 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_hybrid_search_on_odd_rows_matches_sql(spark, tmp_path):
    """Infinite vectors, chunk ids of two contents, contents without text or hash."""
    con = duckdb.connect()
    odd = "UNION ALL SELECT * REPLACE (-vec_id - 1 AS vec_id, list_transform(vector, lambda x: CAST('inf' AS FLOAT)) AS vector)"
    con.execute(f"COPY (SELECT * FROM '{SF}/vectors.parquet' {odd} FROM '{SF}/vectors.parquet') TO '{tmp_path}/vectors.parquet'")
    more = [
        f"SELECT * REPLACE (text || ' gateway' AS text, text_hash || 'x' AS text_hash) FROM '{SF}/chunks.parquet' WHERE chunk_id % 3 = 0",
        f"SELECT * REPLACE (chunk_id + 1000000 AS chunk_id, text_hash || 'y' AS text_hash, CAST(NULL AS VARCHAR) AS text) FROM '{SF}/chunks.parquet' WHERE chunk_id % 5 = 0",
        f"SELECT * REPLACE (chunk_id + 2000000 AS chunk_id, CAST(NULL AS VARCHAR) AS text_hash) FROM '{SF}/chunks.parquet' WHERE chunk_id % 5 = 1",
    ]
    con.execute(f"COPY (SELECT * FROM '{SF}/chunks.parquet' UNION ALL {' UNION ALL '.join(more)}) TO '{tmp_path}/chunks.parquet'")
    for name in ("vectors", "chunks"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    df = catalog.queries()["hybrid_search"](spark, str(tmp_path))
    want = con.sql(catalog.oracle_sql()["hybrid_search"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
