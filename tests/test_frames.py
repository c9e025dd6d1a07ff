import pytest
from pyspark.sql import functions as F

import sparkloom as sl
from sparkloom import col


@pytest.fixture(scope="module")
def sides(spark):
    return sl.data(spark, {"id": [1, 2], "val": ["L1", "L2"]}), sl.data(spark, {"id": [1, 3], "rval": ["R1", "R3"]})


@pytest.mark.parametrize(("how", "rows"), [("inner", 1), ("left", 2), ("right", 2), ("outer", 3), ("semi", 1), ("anti", 1), ("cross", 4)])
def test_join_heights(sides, how, rows):
    left, right = sides
    made = left.join(right, how=how) if how == "cross" else left.join(right, on="id", how=how)
    assert made.height == rows


def test_join_keys_and_nulls(spark):
    a, b = sl.data(spark, {"k": [None, 1], "v": [1, 2]}), sl.data(spark, {"k": [None, 1], "v": [3, 4]})
    assert a.join(b, on="k").to_dicts() == [{"k": 1, "v": 2, "v_right": 4}]
    assert a.join(b, on="k", join_nulls=True).height == 2
    with pytest.raises(sl.InvalidArgumentError):
        a.join(b, on="k", left_on="k", right_on="k")


def test_join_where(spark):
    east = sl.data(spark, {"id": [100, 101, 102], "dur": [120, 140, 160], "rev": [12, 14, 16], "cores": [2, 8, 4]})
    west = sl.data(spark, {"t_id": [404, 498, 676, 742], "time": [90, 130, 150, 170], "cost": [9, 13, 15, 16], "cores": [4, 2, 1, 4]})
    made = east.join_where(west, col("dur") < col("time"), col("rev") < col("cost"))
    assert made.height == 5 and "cores_right" in made.columns


@pytest.mark.parametrize(
    ("options", "bids"),
    [({}, [99.5, 100.5, 102.0]), ({"strategy": "forward"}, [100.5, 102.0, 102.0]), ({"strategy": "nearest"}, [99.5, 100.5, 102.0]), ({"allow_exact_matches": False}, [99.5, 100.5, 100.5]), ({"tolerance": 4}, [None, None, 102.0])],
)
def test_join_asof(spark, options, bids):
    trades = sl.data(spark, {"time": [10, 20, 30], "symbol": ["A"] * 3, "price": [100.0, 101.5, 102.0]})
    quotes = sl.data(spark, {"time": [5, 15, 30], "symbol": ["A"] * 3, "bid": [99.5, 100.5, 102.0]})
    assert trades.join_asof(quotes, on="time", by="symbol", **options).to_array("bid") == bids


def test_groups(spark):
    pay = sl.data(spark, {"dept": ["HR", "HR", "IT", None], "salary": [1000, 2000, 4000, 10]})
    got = pay.group_by("dept").agg(col("salary").mean().alias("m"), col("salary").sum().div(2).alias("h")).to_dicts()
    assert got == [{"dept": "HR", "m": 1500.0, "h": 1500.0}, {"dept": "IT", "m": 4000.0, "h": 2000.0}, {"dept": None, "m": 10.0, "h": 5.0}]
    assert pay.group_by("dept").to_dataframe().to_array("dept") == ["HR", "IT", None]


@pytest.mark.parametrize(
    ("options", "sums"),
    [({"every": 10}, [250, 450, 300]), ({"every": 10, "period": 20}, [700, 750, 300]), ({"every": 10, "closed": "right"}, [100, 350, 550]), ({"every": 10, "start_by": "datapoint", "closed": "both"}, [450, 750, 300])],
)
def test_dynamic(spark, options, sums):
    ticks = sl.data(spark, {"time": [10, 15, 20, 25, 30], "val": [100, 150, 200, 250, 300]})
    assert ticks.group_by_dynamic("time", **options).agg(col("val").sum()).to_array("val") == sums


def test_dynamic_months(spark):
    frame = sl.data(spark, {"s": ["2024-01-15", "2024-01-31", "2024-03-01"], "v": [1, 2, 3]}).with_columns(col("s").str.to_datetime().alias("t"))
    made = frame.group_by_dynamic("t", every="1mo", label="right", include_boundaries=True).agg(col("v").sum())
    assert made.to_array("v") == [3, 3] and made.columns[:3] == ["t", "_lower_boundary", "_upper_boundary"]


def test_reshape(spark):
    sales = sl.data(spark, [{"year": y, "month": m, "sales": s} for y, m, s in ((2020, "Jan", 100), (2020, "Feb", 150), (2021, "Jan", 200), (2021, "Feb", 250))])
    assert sales.pivot("year", "month", "sales").to_dicts() == [{"year": 2020, "Jan": 100, "Feb": 150}, {"year": 2021, "Jan": 200, "Feb": 250}]
    wide = sl.data(spark, {"id": [1, 2], "math": [90, 80], "science": [85, 95]})
    assert wide.unpivot("id").to_array("value") == [90, 85, 80, 95]
    assert wide.transpose(include_header=True).to_dicts()[0] == {"column": "id", "column_0": 1, "column_1": 2}
    assert wide.unstack("id", 2).to_dicts() == [{"id_0": 1, "id_1": 2}]
    lists = sl.data(spark, [{"id": 1, "a": [10, 20], "b": ["x", "y"]}, {"id": 2, "a": [], "b": None}])
    assert lists.explode(["a", "b"]).to_dicts() == [{"id": 1, "a": 10, "b": "x"}, {"id": 1, "a": 20, "b": "y"}, {"id": 2, "a": None, "b": None}]
    assert lists.explode("a", empty_as_null=False).height == 2


def test_concat(sides):
    left, right = sides
    assert sl.concat([left, left]).to_array("id") == [1, 2, 1, 2]
    assert sl.concat([left, right], how="diagonal").columns == ["id", "val", "rval"]
    assert sl.concat([left.select("val"), right], how="horizontal").to_dicts()[1] == {"val": "L2", "id": 3, "rval": "R3"}
    with pytest.raises(sl.FrameError):
        sl.concat([left, right])


def test_rows(spark):
    frame = sl.data(spark, {"n": ["Alice", "Bob", "Charlie", "Dave"], "age": [30, 25, None, 35]})
    assert frame.sort("age").to_array("n") == ["Bob", "Alice", "Dave", "Charlie"]
    assert frame.sort("age", descending=True).to_array("n") == ["Dave", "Alice", "Bob", "Charlie"]
    assert frame.sort("n", descending=True).head(2).to_array("n") == ["Dave", "Charlie"]
    assert frame.reverse().to_array("n")[0] == "Dave"
    assert frame.tail(1).to_array("n") == ["Dave"]
    assert frame.slice(1, -1).to_array("n") == ["Bob", "Charlie"]
    assert frame.limit(1, 1).to_array("n") == ["Bob"]
    assert frame.unique("age").columns == ["age", "n"]
    assert frame.with_row_index("i", 5).to_array("i") == [5, 6, 7, 8]
    assert frame.insert_column(0, "k", sl.lit(1)).columns == ["k", "n", "age"]
    assert frame.drop_nulls().height == 3 and frame.fill_null(0).to_array("age") == [30, 25, 0, 35]
    assert frame.filter(lambda r: r["age"] == 25).to_array("n") == ["Bob"]
    assert frame.filter(col("age") > col("age").mean()).to_array("n") == ["Dave"]
    assert frame.item(1, "n") == "Bob" and frame.shape == (4, 2)
    assert list(frame.iter_rows())[0] == ["Alice", 30] and frame.rename({"n": "m"}).columns == ["m", "age"]
    assert frame.equals(frame.clone()) and not frame.equals(frame.head(2))
    with pytest.raises(sl.ShapeError):
        frame.item()


def test_empty_frame(spark):
    frame = sl.data(spark, {"a": [1]}).filter(col("a") > 1)
    assert frame.select(col("a").sum().alias("s"), col("a").count().alias("n")).to_dicts() == [{"s": None, "n": 0}]
    assert frame.group_by("a").agg(col("a").sum().alias("s")).to_dicts() == []


def test_csv(spark, tmp_path):
    frame = sl.read_csv(spark, 'id,name,age,active,score\n1,"Ali ""A"", x",30,true,95.5\n2,"Bob",25,false,88.0\n3,"Charlie",,1,NaN\n')
    assert [t.simpleString() for t in frame.dtypes] == ["bigint", "string", "bigint", "boolean", "double"]
    assert frame.to_array("name")[0] == 'Ali "A", x' and frame.to_array("active") == [True, False, True]
    text = frame.select("id", "name").write_csv()
    assert text.splitlines()[1] == '1,"Ali ""A"", x"'
    frame.select("id", "name").write_csv(str(tmp_path / "out"))
    back = sl.read_csv(spark, path=str(tmp_path / "out"))
    assert sorted(back.to_array("name")) == sorted(frame.to_array("name"))
    with pytest.raises(sl.InvalidArgumentError):
        sl.read_csv(spark)


def test_json(spark):
    frame = sl.read_json(spark, '[{"id":1,"name":"x"},{"id":2}]')
    assert frame.to_dicts() == [{"id": 1, "name": "x"}, {"id": 2, "name": None}]
    assert frame.write_json() == '[{"id":1,"name":"x"},{"id":2,"name":null}]'
    assert sl.read_json(spark, '{"a":1}\nbad\n', format="ndjson", skip_invalid_lines=True).height == 1
    with pytest.raises(sl.FrameError):
        sl.read_json(spark, "nope")


def test_streaming_windows(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkloom.streaming.windows import sessions, windowed

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts, id % 2 AS k, 1 AS v FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k long, v int").parquet(str(tmp_path / "in"))
    for name, made in (("w", windowed(stream, "ts", "5 minutes", [F.sum("v").alias("n")])), ("s", sessions(stream, "ts", "3 minutes", ["k"], [F.sum("v").alias("n")]))):
        q = made.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(f"out_{name}").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM out_w").collect()) == [5, 5]


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a", 5), (2, "b", 6), (2, "c", 7)]
    f = sl.Frame(spark.createDataFrame(rows, "__index_level_0__ int, __row string, __key0 int"), "__key0")
    names = ["__index_level_0__", "__row", "__key0"]
    assert f.columns == names and list(f.schema) == names and f.df.columns == names
    assert f.with_columns(sl.lit(1).alias("one")).columns == [*names, "one"]
    assert f.sort("__row", descending=True).to_dict()["__key0"] == [7, 6, 5]
    assert f.with_row_index("i").to_dict()["__row"] == ["a", "b", "c"]
    assert f.unique("__index_level_0__").to_dict()["__row"] == ["a", "b"]
    assert f.reverse().to_dict()["__row"] == ["c", "b", "a"]


def test_ndjson_strings_may_hold_other_line_breaks(spark):
    from sparkloom.sources.json import read_json

    text = '{"a": "x y"}\r\n{"a": "z\u0085"}\n'
    assert read_json(spark, text, format="ndjson").to_dict() == {"a": ["x y", "z\u0085"]}


def test_positions_in_lists_of_text(spark):
    f = sl.Frame(spark.createDataFrame([(1, ["b", "c", "a"]), (2, [None, "x"]), (3, [])], "k int, l array<string>"), "k")
    assert f.select(sl.col("l").arr.arg_max().alias("m")).to_dict()["m"] == [1, 1, None]


def test_sort_by_a_comparing_function(spark):
    frame = sl.data(spark, {"k": ["b", "ccc", None, "aa", "a", "dd"], "n": [1, 2, 3, 4, 5, 6]})
    by_length = lambda a, b: len(a or "") - len(b or "")
    assert frame.sort("k", custom_comp=by_length).to_dict()["n"] == [3, 1, 5, 4, 6, 2]
    assert frame.sort("k", descending=True, custom_comp={"k": by_length}).to_dict()["n"] == [2, 4, 6, 1, 5, 3]
    assert frame.sort(["k", "n"], descending=[False, True], custom_comp={"k": by_length}).to_dict()["n"] == [3, 5, 1, 6, 4, 2]


def test_sort_by_a_comparing_function_has_a_stated_bound(spark, monkeypatch):
    from sparkloom.operators import frame as module

    monkeypatch.setattr(module, "COMPARED", 2)
    with pytest.raises(sl.errors.ComputeError):
        sl.data(spark, {"k": [1, 2, 3]}).sort("k", custom_comp=lambda a, b: a - b)


def test_csv_number_formats(spark):
    frame = sl.data(spark, {"x": [1234567.125, -0.5, 2.0, None], "n": [-1200, 7, 0, 1]})
    assert frame.write_csv(include_header=False) == "1234567.125,-1200\n-0.5,7\n2,0\n,1\n"
    assert frame.write_csv(separator=";", include_header=False, use_grouping=True) == "1,234,567.125;-1,200\n-0.5;7\n2;0\n;1\n"
    assert frame.write_csv(include_header=False, float_decimals=2, accounting_negatives=True) == "1234567.13,(1200)\n(0.50),7\n2.00,0\n,1\n"


def test_json_lines_at_a_path_and_as_text_agree(spark, tmp_path):
    text = '{"a":1}\n\n{"a":2,"b":"x"}\nbad\n{"a":3}\n{"a":4}\n'
    (tmp_path / "in.json").write_text(text)
    for options in ({"skip_lines": 1}, {"max_lines": 2}, {"skip_lines": 1, "max_lines": 2}, {"max_lines": 0}):
        got = sl.read_json(spark, path=str(tmp_path / "in.json"), format="ndjson", skip_invalid_lines=True, **options)
        want = sl.read_json(spark, text, format="ndjson", skip_invalid_lines=True, **options)
        assert [r["a"] for r in got.to_dicts()] == [r["a"] for r in want.to_dicts()], options
    with pytest.raises(Exception, match="invalid JSON"):
        sl.read_json(spark, path=str(tmp_path / "in.json"), format="ndjson", skip_lines=1).to_dicts()
    with pytest.raises(sl.errors.InvalidArgumentError):
        sl.read_json(spark, path=str(tmp_path / "in.json"), format="ndjson", reviver=lambda k, v: v)


def test_write_json_options(spark):
    frame = sl.Frame(spark.sql("SELECT 5L AS n, DATE '2024-02-03' AS d, 'x' AS t"), order_by="n")
    assert frame.write_json(date_format="dd.MM.yyyy", bigint_strategy="string") == '[{"n":"5","d":"03.02.2024","t":"x"}]'
    assert frame.write_json(keys=["t"]) == '[{"t":"x"}]'


def test_entropy_of_weights(spark):
    import math

    frame = sl.data(spark, {"w": [1.0, 3.0, 0.0, None], "z": [0.0, None, -1.0, 0.0]})
    got = frame.select(sl.col("w").entropy(normalize=False).alias("w"), sl.col("z").entropy(normalize=False).alias("z")).to_dicts()[0]
    assert abs(got["w"] - (math.log(4) - 3 * math.log(3) / 4)) < 1e-12 and got["z"] is None


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_join_deals_out_keys_of_many_pairs(spark, how, monkeypatch):
    from sparkloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 8)
    spread, in_cells = [], joins._in_cells
    monkeypatch.setattr(joins, "_in_cells", lambda *x: spread.append(in_cells(*x)) or spread[-1])
    keys = [None] * 40 + [float("nan")] * 30 + [1.0] * 20 + [2.0] * 5 + [3.0, 4.0]
    a = sl.Frame(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k double, n int"), order_by="n")
    b = sl.Frame(spark.createDataFrame([(k if k != 3 else 5.0, 2, n) for n, k in enumerate(keys)], "k double, c int, m long"), order_by="m")
    made = a.join(b, on="k", join_nulls=True, coalesce=False, how=how).df
    key = lambda k: "nan" if k is not None and k != k else k
    left, right = [(key(k), n) for n, k in enumerate(keys)], [(key(k) if k != 3 else 5.0, 2, n) for n, k in enumerate(keys)]
    want = [(*p, *q) for p in left for q in right if p[0] == q[0]]
    want += [(3.0, 95, None, None, None)] if how in ("left", "outer") else []
    want += [(None, None, 5.0, 2, 95)] if how in ("right", "outer") else []
    assert sorted(str((key(r[0]), r[1], key(r[2]), *r[3:])) for r in made.collect()) == sorted(map(str, want))
    sizes = spread[0].filter("n is not null").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1600  # one task had the 1600 pairs of null
    assert a.join(b.filter(col("m") > 90), on="k", join_nulls=True).height == 5 * 4 + 1 and spread[1] is None
