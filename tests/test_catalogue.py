import glob
import math
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value:.5g}"
    return str(value)


def rows(names, got, wanted):
    order = [names.index(n) for n in sorted(wanted)]
    return sorted(tuple(plain(r[k]) for k in order) for r in got)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, oracle, name):
    made = catalog.queries()[name](spark, str(SF))
    want = oracle.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(made.columns) == sorted(names)
    assert rows(made.columns, made.collect(), names) == rows(names, want.fetchall(), names)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_whole_joins_take_every_row(spark, tmp_path, how):
    spark.createDataFrame([(k, f"c{k}") for k in range(1, 8)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, c, float(k)) for k, c in enumerate([1, 1, 2, 4, 5, 9, 10], 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = [(c, f"c{c}", o, p) for o, c, p in orders if c < 8]
    want += [(c, f"c{c}", None, None) for c in (3, 6, 7) if how in ("left", "outer")]
    want += [(c, None, o, p) for o, c, p in orders if c > 7 and how in ("right", "outer")]
    made = catalog.queries()[f"join_{how}_whole"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, want))


def test_explode_takes_whole_texts(spark, tmp_path):
    texts = ["", "one", " two  three ", " ".join(f"w{k}" for k in range(30_000)), "x" * 90 + " end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.queries()["explode_lists_whole"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["pos"], r["word"]) for r in made) == [(k, i, w) for k, t in enumerate(texts) for i, w in enumerate(t.split(" "))]


def test_trig_rounds_halves_as_its_sql(spark, tmp_path):
    halves = [(k, (4 * k + 2) / 1.0) for k in range(-250, 2500)]
    spark.createDataFrame(halves, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = c.execute(catalog.oracle_sql()["math_trig"])
    names = [d[0] for d in want.description]
    made = catalog.queries()["math_trig"](spark, str(tmp_path))
    assert rows(made.columns, made.collect(), names) == rows(names, want.fetchall(), names)
