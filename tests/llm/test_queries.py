"""The registered queries against their SQL, over the smallest test tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from sparkloom.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    want = c.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    rows = lambda columns, got: sorted(tuple(str(r[columns.index(n)]) for n in names) for r in got)
    made = queries.queries()[name](spark, str(SF))
    assert sorted(made.columns) == names
    assert rows(made.columns, made.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_one_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
