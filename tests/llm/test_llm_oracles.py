"""Registered queries of the package against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from sceneloom.llm.queries import ORACLES, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries()[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda f: sorted(f[cols].astype(str).replace({"None": "nan", "<NA>": "nan"}).itertuples(index=False, name=None))
    assert text(got) == text(want)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
