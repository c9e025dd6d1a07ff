"""Operators that cut sorted rows into ranges, on tables of more rows than Spark samples for their bounds."""

import bisect
import datetime as d
import math
import random

import pytest
from pyspark.sql import functions as F

import sparkloom as sl
from sparkloom import col


@pytest.fixture(scope="module")
def many(spark):
    rows = spark.range(0, 300_000, 1, 16).select(F.hash("id").alias("h"), "id", F.concat(F.lit("row "), "id").alias("label"))
    return sl.Frame(rows, order_by=["h", "id"])


def test_row_index_counts_all_ranges_alike(many):
    made = many.with_row_index("i", 5).df
    # every column is read, so that plans of fewer columns can't share a shuffle by chance
    got = made.agg(F.count_distinct("i"), F.min("i"), F.max("i"), F.max("label"), F.sum("h")).first()
    assert got[:3] == (300_000, 5, 300_004)
    rows = made.orderBy("i").toPandas()
    assert rows.h.is_monotonic_increasing and (rows.label == "row " + rows.id.astype(str)).all()


def test_row_index_of_an_empty_frame(many):
    assert many.filter(col("id") < 0).with_row_index().to_dicts() == []


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
def test_asof_without_by(spark, strategy, exact):
    rng = random.Random(f"{strategy} {exact}")
    left = [None, -7, 10**9] + [rng.randrange(400_000) for _ in range(6_000)]
    right = sorted({rng.choice([rng.randrange(2000), rng.randrange(350_000, 400_000)]) for _ in range(1_000)})
    a = sl.Frame(spark.createDataFrame([(k, t) for k, t in enumerate(left)], "n long, t long").repartition(16), order_by="n")
    b = sl.Frame(spark.createDataFrame([(t, f"r{t}") for t in right], "t long, r string"), order_by="t")
    got = {x["n"]: x["r"] for x in a.join_asof(b, on="t", strategy=strategy, allow_exact_matches=exact).to_dicts()}

    def wanted(t):
        if t is None:
            return None
        low = (bisect.bisect_right if exact else bisect.bisect_left)(right, t) - 1
        high = (bisect.bisect_left if exact else bisect.bisect_right)(right, t)
        back, ahead = right[low] if low >= 0 else None, right[high] if high < len(right) else None
        if strategy == "nearest" and back is not None and (ahead is None or t - back <= ahead - t):
            return back
        return back if strategy == "backward" else ahead

    assert got == {k: None if wanted(t) is None else f"r{wanted(t)}" for k, t in enumerate(left)}


def test_asof_without_right_rows(spark):
    a = sl.data(spark, {"t": [1, 2]})
    b = sl.data(spark, {"t": [5], "r": ["x"]}).filter(col("t") < 0)
    assert a.join_asof(b, on="t").to_array("r") == [None, None]


def test_over_aggregates_join_back(spark):
    f = sl.data(spark, {"k": ["a", "a", None, None, "b"], "x": [1.0, 3.0, 5.0, math.nan, None]})
    made = f.select("k", col("x").mean().over("k").alias("m"), col("x").n_unique().over("k").alias("n"), col("x").first().over("k").alias("f"), (col("x").sum() - col("x").sum().over("k")).alias("rest"))
    assert made.height == 5
    assert made.to_array("m") == [2.0, 2.0, 5.0, 5.0, None]
    assert made.to_array("n") == [2, 2, 2, 2, 1]
    assert made.to_array("f") == [1.0, 1.0, 5.0, 5.0, None]
    assert made.to_array("rest") == [5.0, 5.0, 4.0, 4.0, None]


def test_over_keys_that_are_aggregates(spark):
    f = sl.data(spark, {"k": ["a", "a", "b", "b"], "x": [1, 3, 5, 11]})
    assert f.select(col("x").max().over(col("x") > col("x").mean()).alias("m")).to_array("m") == [5, 5, 5, 11]
    assert f.select(col("x").count().over(col("x").sum().over("k") > 10).alias("n")).to_array("n") == [2, 2, 2, 2]
    assert f.filter(col("x") == col("x").max().over("k")).to_array("x") == [3, 11]


def test_calendar_and_right_closed_windows_are_keys(spark):
    days = [d.datetime(2023, 12, 31, 23), d.datetime(2024, 1, 1), d.datetime(2024, 1, 31, 12), d.datetime(2024, 3, 1)]
    f = sl.data(spark, {"at": days, "x": [1, 2, 4, 8]})
    months = f.group_by_dynamic("at", every="1mo").agg(col("x").sum().alias("s"))
    years = f.group_by_dynamic("at", every="1y", include_boundaries=True).agg(col("x").sum().alias("s"))
    assert months.to_array("s") == [1, 6, 8]
    assert [(r["_lower_boundary"].year, r["_upper_boundary"].year, r["s"]) for r in years.to_dicts()] == [(2023, 2024, 1), (2024, 2025, 14)]
    g = sl.data(spark, {"i": [0, 1, 10, 11, 20, 25], "x": [1, 2, 4, 8, 16, 32]})
    assert g.group_by_dynamic("i", every=10, closed="right").agg(col("x").sum().alias("s")).to_dicts() == [{"i": -10, "s": 1}, {"i": 0, "s": 6}, {"i": 10, "s": 24}, {"i": 20, "s": 32}]
    assert g.group_by_dynamic("i", every=10, period=5, closed="right").agg(col("x").sum().alias("s")).to_dicts() == [{"i": 0, "s": 2}, {"i": 10, "s": 8}, {"i": 20, "s": 32}]  # 0, 10 and 20 lie in the gaps


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_theta_join_meets_blocks_not_all_pairs(spark, how, monkeypatch):
    from sparkloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 50)
    rng = random.Random(how)
    odd = lambda x: rng.choice([x] * 30 + [None, math.nan, 7.0, -0.0])
    a = [(k, odd(rng.uniform(-50, 50)), rng.choice([None, 3, *range(400)])) for k in range(700)] + [(-1, 7.0, 3)] * 120
    # equal compared values, of which the third predicate leaves only some a match
    a += [(5000 + k, 1e6, 3) for k in range(20)] + [(6000, -60.0, 3)]
    b = [(k, odd(rng.uniform(-50, 50)), rng.choice([None, 3.0, *map(float, range(-380, 40))])) for k in range(900)]
    b += [(2000 + k, -60.0, 100.0) for k in range(20)] + [(3000, 1e6, 100.0)]
    left = sl.Frame(spark.createDataFrame(a, "n long, x double, y int"), order_by="n")
    right = sl.Frame(spark.createDataFrame(b, "n long, u double, v double"), order_by="n")
    made = left.join_where(right, (col("x") <= col("u")) & (col("v") > col("y")), (col("n") + col("n_right")) % 7 != 3, how=how)
    held = lambda p, q: None not in (*p, *q) and p[1] <= q[1] and q[2] > p[2] and (p[0] + q[0]) % 7 != 3
    want = [(*p, *q) for p in a for q in b if held(p, q)]
    if how == "left":
        want += [(*p, None, None, None) for p in a if not any(held(p, q) for q in b)]
    if how == "right":
        want += [(None, None, None, *q) for q in b if not any(held(p, q) for p in a)]
    plain = lambda r: str([x + 0.0 if isinstance(x, float) else x for x in r])
    assert made.columns == ["n", "x", "y", "n_right", "u", "v"]
    assert sorted(map(plain, made.df.collect())) == sorted(map(plain, want))


def test_theta_join_of_many_rows_with_few_matches(spark):
    a = sl.Frame(spark.range(400_000).select((F.col("id") * 3).alias("low"), (F.col("id") * 3 + 4).alias("high")), order_by="low")
    b = sl.Frame(spark.range(400_000).select((F.col("id") * 3).alias("at")), order_by="at")
    made = a.join_where(b, col("low") < col("at"), col("high") >= col("at"))  # 160,000,000,000 pairs
    assert made.df.agg(F.count("*"), F.sum(F.col("at") - F.col("low"))).first()[:] == (399_999, 3 * 399_999)


def test_theta_join_by_equal_values_stays_a_join_by_keys(spark, monkeypatch):
    from sparkloom.operators import joins

    monkeypatch.setattr(joins, "_theta", None)
    a, b = sl.data(spark, {"k": [1, 1, 2], "x.y": [1, 5, 9]}), sl.data(spark, {"j": [1, 2], "z": [3, 3]})
    assert a.join_where(b, col("k").eq(col("j")) & (col("x.y") < col("z"))).to_dicts() == [{"k": 1, "x.y": 1, "j": 1, "z": 3}]
    monkeypatch.undo()
    assert a.join_where(b, col("x.y") < col("z"), how="left").select("x.y", "j").to_dicts() == [{"x.y": 1, "j": 1}, {"x.y": 1, "j": 2}, {"x.y": 5, "j": None}, {"x.y": 9, "j": None}]
