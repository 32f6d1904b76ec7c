"""Every registered query against its SQL."""

import math
from datetime import datetime

import duckdb
import pytest

from rillmark.plans.all_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def place(row):
    """Rows that differ in their last bits only come at the same place."""
    return repr([round(v, 5) + 0.0 if isinstance(v, float) else v for v in row])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rel = db.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(([norm(v) for v in r] for r in rel.fetchall()), key=place)
    got = sorted(([norm(r[c]) for c in columns] for r in df.collect()), key=place)
    assert len(got) == len(want) and len(got) > 0
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and abs(x - y) <= 1e-9 * max(1.0, abs(x)), (a, b)
