"""Every query against its SQL in another engine, over the smallest tables."""

import math
import os

import duckdb
import pytest

from quillgraph.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(([plain(x) for x in r] for r in df.select(columns).collect()), key=repr)
    found = tables.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    theirs = sorted(([plain(x) for x in r] for r in tables.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})").fetchall()), key=repr)
    assert ours == theirs


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
