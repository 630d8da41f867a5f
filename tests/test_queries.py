"""Every registered query against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from fernweave.plans.oracles import ORACLE_SQL
from fernweave.plans.queries import QUERIES
from tests.conftest import DATA


def compare(spark, folder, run, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = run(spark, folder)
    names = sorted(df.columns)
    told = con.execute(sql)
    own = [c[0] for c in told.description]
    assert sorted(own) == names
    want = sorted(tuple(repr(r[own.index(c)]) for c in names) for r in told.fetchall())
    assert sorted(tuple(repr(r[c]) for c in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    compare(spark, small, QUERIES[name], ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert os.path.isdir(DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
