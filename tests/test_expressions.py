import math

import pytest

import sparkloom as sl
from sparkloom import col


@pytest.fixture(scope="module")
def mixed(spark):
    return sl.data(spark, [{"g": "A", "x": 1, "y": 2.0}, {"g": "B", "x": 2, "y": float("nan")}, {"g": "A", "x": 3, "y": None}, {"g": None, "x": None, "y": 5.5}])


def values(frame, expr):
    return frame.select(expr.alias("v")).to_array("v")


def test_whole_frame_aggregates_join_rows(mixed):
    assert values(mixed, col("x") - col("x").mean()) == [-1.0, 0.0, 1.0, None]


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        (col("x").sum(), 6), (col("y").mean(), 3.75), (col("y").max(), 5.5), (col("y").min(), 2.0), (col("y").count(), 2), (col("y").null_count(), 2), (col("g").n_unique(), 3),
        (col("x").median(), 2.0), (col("x").quantile(0.25), 1.5), (col("x").std(), 1.0), (col("x").variance(), 1.0), (col("x").product(), 6.0), (col("x").first(), 1), (col("x").last(), None),
        (col("x").implode(), [1, 2, 3, None]), (col("x").arg_max(), 2), (col("x").arg_min(), 0), (col("g").max_by("x"), "A"), (col("g").min_by("x"), "A"), (col("x").mode(), [1, 2, 3]),
        (col("g").mode(), ["A"]), (col("x").any_null(), True), (col("x").all_null(), False), (col("x").bitwise_or(), 3), (col("x").bitwise_and(), 0), (col("x").bitwise_xor(), 0), (col("x").dot("x"), 14.0),
        (col("x").spearman_corr("x"), 1.0), (col("x").corr("x"), 1.0), (col("x").cov("x"), 1.0), (col("x").w_avg("x"), 14 / 6), (col("x").entropy(), math.log(3)),
    ],
)
def test_aggregates(mixed, expr, expected):
    got = mixed.select(expr.alias("v")).item()
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


def test_nan_counts_in_nan_max(mixed):
    assert math.isnan(mixed.select(col("y").nan_max().alias("v")).item())


def test_std_of_one_value_is_zero(spark):
    frame = sl.data(spark, {"v": [10.0, float("nan"), None]})
    assert frame.select(col("v").std()).item() == 0


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        (col("x").cum_sum(), [1, 3, 6, 6]), (col("x").cum_max(), [1, 2, 3, 3]), (col("x").cum_min(reverse=True), [1, 2, 3, None]), (col("x").cum_prod(), [1, 2, 6, 6]), (col("x").cum_count(), [1, 2, 3, 3]),
        (col("x").rolling_sum(2), [1, 3, 5, 3]), (col("x").rolling_mean(2), [1.0, 1.5, 2.5, 3.0]), (col("x").rolling_rank(3), [1, 2, 3, None]), (col("x").rank(), [1, 2, 3, None]),
        (col("x").lag(), [None, 1, 2, 3]), (col("x").lead(1, 0), [2, 3, None, 0]), (col("x").row_number(), [1, 2, 3, 4]), (col("x").reverse(), [None, 3, 2, 1]), (col("x").sum().over("g"), [4, 2, 4, None]),
        (col("x").fill_null(strategy="forward"), [1, 2, 3, 3]), (col("x").fill_null(strategy="mean"), [1, 2, 3, 2]), (col("x").fill_null(9), [1, 2, 3, 9]),
        (col("g").is_duplicated(), [True, False, True, False]), (col("g").is_unique(), [False, True, False, True]), (col("g").is_n_distinct(0), [True, False, True, False]),
    ],
)
def test_windows(mixed, expr, expected):
    assert values(mixed, expr) == expected


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        (col("a") / 0, [None, None, None]), (col("a") % 0, [None, None, None]), (col("a").sqrt(), [2.0, None, None]), (col("a").log(), [math.log(4), None, None]), ((col("a") / 10).arccos(), [math.acos(0.4), math.acos(-0.25), None]),
        (col("a").clip(-1, 3), [3.0, -1.0, None]), (col("a").round(), [4.0, -2.0, None]), (col("a").trunc(), [4, -2, None]), (col("a").floordiv(3), [1, -1, None]), (col("a").sign(), [1.0, -1.0, None]),
        (col("a").eq(4), [True, False, None]), (col("a").eq_missing(None), [False, False, True]), (col("a").between(0, 5), [True, False, None]), (col("a").is_in([4.0]), [True, False, None]), (col("a").is_close(4.0), [True, False, None]),
        (col("a").copysign(-1), [-4.0, -2.5, None]), (col("a").is_null(), [False, False, True]), (col("a").negate(), [-4.0, 2.5, None]),
    ],
)
def test_scalars(spark, expr, expected):
    got = values(sl.data(spark, {"a": [4.0, -2.5, None]}), expr)
    assert [g if g is None or isinstance(g, bool) else pytest.approx(g) for g in got] == expected


def test_nan_equals_nothing(mixed):
    assert values(mixed, col("y").eq(col("y"))) == [True, False, None, True]


def test_branches_and_coalesce(mixed):
    assert values(mixed, sl.when(col("x") > 1).then("g").when(col("x").eq(1)).then("one").otherwise("none")) == ["one", "B", "A", "none"]
    assert values(mixed, sl.coalesce("x", 0)) == [1, 2, 3, 0]


def test_selectors(mixed):
    assert mixed.select(col(sl.Float64)).columns == ["y"]
    assert mixed.select(col(sl.Numeric).sum()).to_dicts() == [{"x": 6, "y": 7.5}]
    assert mixed.select(sl.exclude("g")).columns == ["x", "y"]
    with pytest.raises(sl.ColumnNotFoundError):
        mixed.select("nothing").df


def test_camel_names(mixed):
    assert mixed.withColumns(col("x").cumSum().alias("c")).toArray("c") == [1, 3, 6, 6]


def test_casts(spark):
    frame = sl.data(spark, {"s": ["1,234.5", "(5)", "abc", "300"]})
    assert values(frame, col("s").cast(sl.Float64)) == [1234.5, -5.0, None, 300.0]
    assert values(frame, col("s").cast(sl.Int8)) == [127, -5, None, 127]
    assert values(frame, col("s").cast(sl.Int64)) == [1234, -5, None, 300]


def test_rolling_function(spark):
    frame = sl.data(spark, {"a": [1, 2, 3]})
    assert values(frame, col("a").rolling(2, lambda v: float(max(v)))) == [1.0, 2.0, 3.0]


STRINGS = [
    (lambda s: s.upper(), ["HELLO WORLD", None, "ÉA1"]), (lambda s: s.to_snake_case(), ["hello_world", None, "éa_1"]), (lambda s: s.to_camel_case(), ["helloWorld", None, "éa1"]), (lambda s: s.to_title_case(), ["Hello World", None, "Éa 1"]),
    (lambda s: s.len_bytes(), [11, None, 4]), (lambda s: s.len_chars(), [11, None, 3]), (lambda s: s.slice(-3), ["rld", None, "éa1"]), (lambda s: s.head(2), ["he", None, "éa"]), (lambda s: s.tail(2), ["ld", None, "a1"]),
    (lambda s: s.lpad(4, "*"), ["hello World", None, "*éa1"]), (lambda s: s.zfill(4), ["hello World", None, "0éa1"]), (lambda s: s.replace("l", "L"), ["heLlo World", None, "éa1"]), (lambda s: s.replace_all("l", "L"), ["heLLo WorLd", None, "éa1"]),
    (lambda s: s.extract(r"(\d)"), [None, None, "1"]), (lambda s: s.extract_all("l"), [["l", "l", "l"], None, []]), (lambda s: s.find("a"), [None, None, 2]), (lambda s: s.split(" "), [["hello", "World"], None, ["éa1"]]),
    (lambda s: s.encode("hex"), ["68656c6c6f20576f726c64", None, "c3a96131"]), (lambda s: s.encode("base64").str.decode("base64"), ["hello World", None, "éa1"]), (lambda s: s.strip_chars("hé1"), ["ello World", None, "a"]),
    (lambda s: s.strip_prefix("he"), ["llo World", None, "éa1"]), (lambda s: s.encode_uri_component(), ["hello%20World", None, "%C3%A9a1"]), (lambda s: s.encode_uri_component().str.decode_uri_component(), ["hello World", None, "éa1"]),
    (lambda s: s.replace_many(["hello", "a"], ["bye", "b"]), ["bye World", None, "éb1"]), (lambda s: s.extract_many(["World", "x"]), [["World", None], None, [None, None]]), (lambda s: s.contains_any(["a", "z"]), [False, None, True]),
    (lambda s: s.normalize("NFD").str.len_chars(), [11, None, 4]), (lambda s: s.count_matches("l"), [3, None, 0]), (lambda s: s.reverse(), ["dlroW olleh", None, "1aé"]),
]


@pytest.mark.parametrize(("method", "expected"), STRINGS)
def test_strings(spark, method, expected):
    assert values(sl.data(spark, {"s": ["hello World", None, "éa1"]}), method(col("s").str)) == expected


def test_json_paths(spark):
    frame = sl.data(spark, {"j": ['{"a":[1,{"b":"x"}]}', None]})
    assert values(frame, col("j").str.json_path_match("$.a[0]")) == ["1", None]
    assert values(frame, col("j").str.json_path_match("$..b")) == ["x", None]
    assert values(frame, col("j").str.json_path_match("$.a[-1].b")) == ["x", None]


def test_trim_of_blank_is_null(spark):
    assert values(sl.data(spark, {"s": [" a ", "  "]}), col("s").str.trim()) == ["a", None]


def test_dates(spark):
    frame = sl.data(spark, {"s": ["2024-02-29T12:34:56Z", "1969-12-31T23:59:59Z", None]}).with_columns(col("s").str.to_datetime().alias("t"))
    d = lambda: col("t").dt
    assert values(frame, d().year()) == [2024, 1969, None]
    assert values(frame, d().days_in_month()) == [29, 31, None]
    assert values(frame, d().epoch()) == [1709210096000, -1000, None]
    assert values(frame, d().strftime("%Y/%m/%d %u %j")) == ["2024/02/29 4 060", "1969/12/31 3 365", None]
    assert values(frame, d().is_leap_year()) == [True, False, None]
    assert values(frame, d().century()) == [21, 20, None]
    assert values(frame, d().utc_offset("Europe/Berlin", unit="h")) == [1.0, 1.0, None]
    assert values(frame, d().replace(day=1).dt.day()) == [1, 1, None]
    assert values(frame, d().offset_day(3, exclude_weekdays=(0, 6)).dt.strftime("%F")) == ["2024-03-05", "1970-01-05", None]
    assert values(frame, d().is_business_day()) == [True, True, None]
    assert values(frame, col("s").str.strptime("%Y-%m-%dT%H:%M:%SZ").dt.hour()) == [12, 23, None]


def test_lists(spark):
    frame = sl.data(spark, {"l": [[3, 1, 2], [], None]})
    a = lambda: col("l").arr
    assert values(frame, a().sum()) == [6.0, None, None]
    assert values(frame, a().median()) == [2.0, None, None]
    assert values(frame, a().sort(descending=True)) == [[3, 2, 1], [], None]
    assert values(frame, a().eval(sl.element() * 2)) == [[6, 2, 4], [], None]
    assert values(frame, a().filter(sl.element() > 1)) == [[3, 2], [], None]
    assert values(frame, a().agg(sl.element().max())) == [3, None, None]
    assert values(frame, a().get(-1)) == [2, None, None]
    assert values(frame, a().contains(1)) == [True, False, None]
    assert values(frame, a().slice(-2)) == [[1, 2], [], None]
    assert values(frame, a().splice(1, 1, 9)) == [[3, 9, 2], [9], None]
    assert values(frame, a().gather_every(2)) == [[3, 2], [], None]
    assert values(frame, a().arg_max()) == [0, None, None]
    assert values(frame, a().lengths()) == [3, 0, None]
    assert values(frame, a().count_matches(1)) == [1, 0, None]
    assert frame.select(col("l").arr.to_struct()).schema["l"].names == ["field_0", "field_1", "field_2"]


def test_structs_and_rows(mixed):
    made = mixed.select(sl.struct(["g", "x"]).alias("s"))
    assert made.select(col("s").struct.unnest()).columns == ["g", "x"]
    assert made.select(col("s").struct.rename_fields({"g": "h"}).alias("q")).schema["q"].names == ["x", "h"]
    assert values(mixed, sl.horizontal("x", "x").sum()) == [2.0, 4.0, 6.0, None]
    assert values(mixed, sl.seq_range(5, step=2)) == [5, 7, 9, 11]
    assert mixed.select(sl.duration("1d 12h")).item() == 129_600_000
