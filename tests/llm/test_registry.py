"""The subpackage's queries on the smallest tables, against SQL where there is one."""

import os

import duckdb
import pytest

from siltstone.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
        assert all(t == "bigint" for c, t in df.dtypes if c != "kind")
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        want = con.sql(registry.oracle_sql()[name])
        order = [df.columns.index(c) for c in want.columns]
        assert sorted(tuple(r[i] for i in order) for r in rows) == sorted(want.fetchall())
