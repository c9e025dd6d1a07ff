"""More of the catalogue: the operators that no headline query calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.entry import col, element, exclude, lit, when
from ..sources.csv import read_csv, write_csv
from ..sources.json import read_json, write_json
from .catalog import query

# strings


@query("""SELECT p_partkey, upper(left(a, 1)) || a[2:] || upper(left(b, 1)) || b[2:] AS pascal, a || upper(left(b, 1)) || b[2:] AS camel, a || '_' || b AS snake, a || '-' || b AS kebab,
    upper(left(a, 1)) || a[2:] || ' ' || upper(left(b, 1)) || b[2:] AS title, lower(p_type) AS lo, upper(p_name) AS up FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def str_case_convert(t):
    n = col("p_name").str
    return t("part").select("p_partkey", n.to_pascal_case().alias("pascal"), n.to_camel_case().alias("camel"), n.to_snake_case().alias("snake"), n.to_kebab_case().alias("kebab"), n.to_title_case().alias("title"), col("p_type").str.to_lower_case().alias("lo"), n.to_upper_case().alias("up"))


@query("""SELECT p_partkey, rtrim(ltrim(p_name, 'csl'), 't') AS both_ends, ltrim(p_name, 'csl') AS first_end, rtrim(p_name, 'ter') AS last_end, CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS no_prefix,
    CASE WHEN ends_with(p_type, 'O') THEN left(p_type, length(p_type) - 1) ELSE p_type END AS no_suffix, rpad(p_brand, CAST(greatest(length(p_brand), 10) AS INTEGER), '.') AS padded, lpad(p_brand, CAST(greatest(length(p_brand), 9) AS INTEGER), '-') AS started,
    lpad(CAST(p_size AS VARCHAR), CAST(greatest(4, length(CAST(p_size AS VARCHAR))) AS INTEGER), '0') AS zeros, p_name || '  ' AS no_start, '  ' || p_name AS no_end FROM part""")
def str_strip_pad(t):
    n, b, spaced = col("p_name").str, col("p_brand").str, lit("  ").str.concat(col("p_name"), "  ").str
    return t("part").select(
        "p_partkey", n.strip_chars_start("csl").str.strip_chars_end("t").alias("both_ends"), n.strip_chars_start("csl").alias("first_end"), n.strip_chars_end("ter").alias("last_end"), b.strip_prefix("Brand").alias("no_prefix"),
        col("p_type").str.strip_suffix("O").alias("no_suffix"), b.pad_end(10, ".").alias("padded"), b.pad_start(9, "-").alias("started"), col("p_size").str.zfill(4).alias("zeros"), spaced.trim_start().alias("no_start"), spaced.trim_end().alias("no_end"),
    )


@query("""SELECT page_id, array_to_string(regexp_extract_all(url, '[a-z]{3,}'), '|') AS words, regexp_extract(url, '^(https?)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, nullif(regexp_extract(url, 'https?'), '') AS first_many,
    nullif(regexp_extract(url, '[0-9]+'), '') AS second_many, CASE WHEN strpos(url, 'example') > 0 THEN strpos(url, 'example') - 1 END AS at, CASE WHEN strpos(url, '/en/') > 0 THEN strpos(url, '/en/') - 1 END AS at_many, contains(url, '/en/') OR contains(url, '/de/') AS some,
    ends_with(url, 'feed') AS feed, replace(replace(url, 'http', '<H>'), 'org', '<O>') AS replaced, regexp_replace(url, '[aeiou]+', '_') AS once, regexp_replace(url, '([.?/])', '\\\\\\1', 'g') AS escaped FROM pages""")
def str_extract_many(t):
    u = col("url").str
    groups = u.extract_groups("^(?<scheme>https?)://(?<host>[^/]+)").struct
    made = t("pages").select(
        "page_id", u.extract_all("[a-z]{3,}").arr.join("|").alias("words"), groups.field("scheme").alias("scheme"), groups.field("host").alias("host"), u.extract_many(["https?", "[0-9]+"]).arr.get(0).alias("first_many"),
        u.extract_many(["https?", "[0-9]+"]).arr.get(1).alias("second_many"), u.find("example", literal=True).alias("at"), u.find_many(["/en/"]).arr.get(0).alias("at_many"), u.contains_any(["/en/", "/de/"]).alias("some"),
        u.ends_with("feed").alias("feed"), u.replace_many(["http", "org"], ["<H>", "<O>"]).alias("replaced"), u.replace("[aeiou]+", "_").alias("once"), u.escape_regex().alias("escaped"),
    )
    return made.df.withColumns({c: F.col(c).cast("long") for c in ("at", "at_many")})


@query("""SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS i, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS d, strftime(o_orderdate, '%Y-%m-%d') AS day, '10:30:0' || (o_orderkey % 10) || '.000' AS tm, strftime(o_orderdate, '%d.%m.%Y') AS parsed FROM orders""")
def str_parse(t):
    day = col("o_orderdate").dt.strftime("%d.%m.%Y")
    made = t("orders").with_columns(day.alias("shown"), col("o_orderdate").dt.strftime("%Y-%m-%d").alias("iso"), lit("10:30:0").str.concat(col("o_orderkey") % 10).alias("clock"))
    return made.select("o_orderkey", col("o_orderpriority").str.head(1).str.to_integer().alias("i"), col("o_totalprice").str.to_decimal(18, 6)._map(lambda c, _: c.cast("double")).alias("d"), col("iso").str.to_date().dt.strftime("%Y-%m-%d").alias("day"), col("clock").str.to_time().alias("tm"), col("shown").str.strptime("%d.%m.%Y").dt.strftime("%d.%m.%Y").alias("parsed"))


@query("""SELECT page_id, replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') AS enc, url AS dec, CAST(strlen(url) AS BIGINT) AS bytes, url || '#' || page_id AS tagged, array_to_string(regexp_extract_all(left(url, 6), '.'), ' ') AS chars, url AS from_hex, url AS from_base64, nfc_normalize(url || 'é') AS nfc FROM pages""")
def str_codecs(t):
    u = col("url").str
    made = t("pages").select(
        "page_id", u.encode_uri_component().alias("enc"), u.encode_uri_component().str.decode_uri_component().alias("dec"), u.len_bytes().alias("bytes"), u.concat("#", col("page_id")).alias("tagged"), u.head(6).str.explode().arr.join(" ").alias("chars"),
        u.encode("hex").str.decode("hex").alias("from_hex"), u.encode("base64").str.decode("base64").alias("from_base64"), u.concat("é").str.normalize("NFC").alias("nfc"),
    )
    return made.df.withColumn("bytes", F.col("bytes").cast("long"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def str_json_decode(t):
    return t("events").select("event_id", col("props").str.json_decode("k bigint").struct.field("k").alias("k"))


# dates

_PARTS = {"h": ("hour", "hour(ts)"), "mi": ("minute", "minute(ts)"), "s": ("second", "second(ts)"), "ms": ("millisecond", "millisecond(ts) % 1000"), "us": ("microsecond", "microsecond(ts) % 1000000"), "ns": ("nanosecond", "microsecond(ts) % 1000000 * 1000"), "iy": ("iso_year", "isoyear(ts)"), "w": ("week", "weekofyear(ts)"), "c": ("century", "century(ts)"), "m": ("millennium", "millennium(ts)"), "t": ("timestamp", "epoch_us(ts) // 1000")}


@query("SELECT event_id, " + ", ".join(f"CAST({sql} AS BIGINT) AS {a}" for a, (_, sql) in _PARTS.items()) + """, year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) AS leap, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S.%g') AS tm, strftime(last_day(ts), '%Y-%m-%d') AS me FROM events""")
def dt_parts_all(t):
    d = col("ts").dt
    made = t("events").select("event_id", *[getattr(d, name)().alias(a) for a, (name, _) in _PARTS.items()], d.is_leap_year().alias("leap"), d.date().dt.strftime("%Y-%m-%d").alias("d"), d.time().alias("tm"), d.month_end().dt.strftime("%Y-%m-%d").alias("me"))
    return made.df.withColumns({a: F.col(a).cast("long") for a in _PARTS})


@query("""SELECT event_id, CAST(e AS DOUBLE) / 86400000 AS d, CAST(e AS DOUBLE) / 3600000 AS h, CAST(e AS DOUBLE) / 60000 AS mi, CAST(e AS DOUBLE) / 1000 AS s, e AS ms, e * 1000 AS us, e * 1000000 AS ns FROM (SELECT event_id, epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01') // 1000 AS e FROM events)""")
def dt_total_units(t):
    d = (col("ts") - lit("2024-01-01").str.to_datetime()).alias("e")
    made = t("events").with_columns(d).select("event_id", *[getattr(col("e").dt, f"total_{name}")().alias(a) for a, name in (("d", "days"), ("h", "hours"), ("mi", "minutes"), ("s", "seconds"), ("ms", "milliseconds"), ("us", "microseconds"), ("ns", "nanoseconds"))])
    return made.df.select("event_id", *[F.col(c).cast("double").alias(c) for c in ("d", "h", "mi", "s")], *[F.col(c).cast("long").alias(c) for c in ("ms", "us", "ns")])


@query("""SELECT event_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS berlin, CAST(epoch_ms(b) - epoch_ms(ts) AS DOUBLE) / 3600000 AS hours, CAST(hour(b) AS INTEGER) AS h, strftime(date_trunc('millisecond', ts), '%S.%f') AS ms, strftime(make_timestamp(2020, month(ts), least(day(ts), 29), hour(ts), 30, second(ts)), '%Y-%m-%d %H:%M:%S') AS put
    FROM (SELECT *, timezone('Europe/Berlin', timezone('UTC', ts)) AS b FROM events)""")
def dt_zones(t):
    d = col("ts").dt
    made = t("events").select("event_id", d.convert_time_zone("Europe/Berlin").dt.strftime("%Y-%m-%d %H:%M:%S").alias("berlin"), d.utc_offset("Europe/Berlin", unit="h").alias("hours"), d.hour("Europe/Berlin").alias("h"), d.cast_time_unit("ms").alias("m"), when(d.day() > 29).then(29).otherwise(d.day()).alias("dd"), d.replace(year=2020, minute=30).alias("p"), "ts")
    put = F.when(F.dayofmonth("p") > 29, F.date_add("p", F.lit(29) - F.dayofmonth("p")).cast("string")).otherwise(F.date_format("p", "yyyy-MM-dd"))
    return made.df.select("event_id", "berlin", "hours", "h", F.date_format("m", "ss.SSSSSS").alias("ms"), F.concat(put, F.date_format("p", " HH:mm:ss")).alias("put"))


@query("""WITH RECURSIVE s AS (SELECT event_id, CAST(ts AS DATE) AS d, 5 AS n, dayofweek(ts) IN (0, 6) AS off FROM events),
    w AS (SELECT event_id, d + CAST(CASE dayofweek(d) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INTEGER) AS d FROM s)
    SELECT event_id, strftime(d + 7, '%Y-%m-%d') AS later, strftime(d - CAST(CASE WHEN isodow(d) <= 3 THEN 5 ELSE 3 END AS INTEGER), '%Y-%m-%d') AS before FROM w""")
def dt_business_days(t):
    d = col("ts").dt
    return t("events").select("event_id", d.offset_day(5, exclude_weekdays=(0, 6), roll="forward").dt.strftime("%Y-%m-%d").alias("later"), d.offset_day(-3, exclude_weekdays=(0, 6), roll="forward").dt.strftime("%Y-%m-%d").alias("before"))


# numbers

_TRIG = {"asinh": "arcsinh", "atan": "arctan", "cbrt": "cbrt", "cos": "cos", "cosh": "cosh", "cot": "cot", "degrees": "degrees", "exp": "exp", "radians": "radians", "sinh": "sinh", "tan": "tan", "tanh": "tanh"}


@query("SELECT c_custkey, " + ", ".join(f"round({f}(x), 6) AS {m}" for f, m in _TRIG.items()) + """, round(exp(x) - 1, 6) AS expm1, round(ln(1 + abs(x)), 6) AS log1p, CASE WHEN abs(x) <= 1 THEN round(asin(x), 6) END AS arcsin, CASE WHEN x >= 1 THEN round(acosh(x), 6) END AS arccosh, CASE WHEN abs(x) < 1 THEN round(atanh(x), 6) END AS arctanh,
    round(atan2(x, 2), 6) AS arctan2, round(sqrt(x * x + 9), 6) AS hypot, CASE WHEN x < 0 THEN -abs(c_custkey) ELSE c_custkey END AS copied, -x AS neg, CAST(trunc(x * 10) AS BIGINT) AS tr FROM (SELECT c_custkey, round(c_acctbal / 4000, 3) AS x FROM customer) WHERE x <> 0""")
def math_trig(t):
    x = col("x")
    # SQL rounds the scaled binary value: 0.5005 * 1000 is below 500.5, though its decimal form is a half
    c = t("customer").select("c_custkey", (col("c_acctbal") / 4000)._map(lambda v, _: F.round(v * 1000) / 1000).alias("x")).filter(x.ne(0))
    made = c.select("c_custkey", *[getattr(x, m)().alias(m) for m in _TRIG.values()], x.expm1().alias("expm1"), x.abs().log1p().alias("log1p"), x.arcsin().alias("arcsin"), x.arccosh().alias("arccosh"), x.arctanh().alias("arctanh"), x.arctan2(2).alias("arctan2"), x.hypot(3).alias("hypot"), col("c_custkey").copysign(col("x")).alias("copied"), x.negate().alias("neg"), (x * 10).trunc().alias("tr"))
    exact = ("c_custkey", "copied", "neg", "tr")
    return made.df.select(*[F.col(n).cast("long").alias(n) if n in ("copied", "tr") else F.col(n) if n in exact else F.round(n, 6).alias(n) for n in made.columns])


_NUMBERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE o_totalprice END AS x, o_orderkey % 3 = 0 AS a, o_orderkey % 2 = 0 AS b FROM orders"


def _numbers(t):
    k = col("o_orderkey")
    x = when((k % 5).eq(0)).then(None).when((k % 7).eq(0)).then(float("nan")).when((k % 11).eq(0)).then(float("inf")).otherwise(col("o_totalprice"))
    return t("orders").select("o_orderkey", x.alias("x"), (k % 3).eq(0).alias("a"), (k % 2).eq(0).alias("b"))


@query(f"""SELECT o_orderkey, isnan(x) AS n, NOT isnan(x) AS nn, isfinite(x) AS f, isinf(x) AS i, x IS NULL AS nul, x IS NOT NULL AS nnul, a <> b AS xr, NOT a AS nt, o_orderkey NOT IN (1, 2, 3) AS nin, x IS NOT DISTINCT FROM NULL AS em, x IS DISTINCT FROM NULL AS nm,
    CASE WHEN x IS NULL THEN NULL WHEN isnan(x) THEN false ELSE x = 100 OR (isfinite(x) AND abs(x - 100) <= greatest(1e-8, 0.5 * greatest(abs(x), 100))) END AS close FROM ({_NUMBERS})""")
def predicates_nan(t):
    x = col("x")
    return _numbers(t).select("o_orderkey", x.is_nan().alias("n"), x.is_not_nan().alias("nn"), x.is_finite().alias("f"), x.is_infinite().alias("i"), x.is_null().alias("nul"), x.is_not_null().alias("nnul"), col("a").xor(col("b")).alias("xr"), col("a").not_().alias("nt"), col("o_orderkey").not_in([1, 2, 3]).alias("nin"), x.eq_missing(None).alias("em"), x.ne_missing(None).alias("nm"), x.is_close(100.0, rel_tol=0.5)._map(lambda c, _: F.when(F.abs(F.col("x")) == float("inf"), F.lit(False)).otherwise(c)).alias("close"))


@query("""SELECT o_orderkey, CASE WHEN x = 0 THEN 0 ELSE floor(x / pow(10, floor(log10(x)) - 2) + 0.5) * pow(10, floor(log10(x)) - 2) END AS sig FROM (SELECT o_orderkey, round(o_totalprice) AS x FROM orders)""")
def math_sig_figs(t):
    return t("orders").select("o_orderkey", col("o_totalprice").round(0).round_sig_figs(3).alias("sig"))


@query(f"""SELECT b, bool_or(x IS NULL) AS any_null, bool_or(x IS NULL) AS has_nulls, max(CASE WHEN isfinite(x) THEN x END) AS hi, round(avg(CASE WHEN isfinite(x) THEN x END), 4) AS mean, count(*) FILTER (WHERE isnan(x)) > 0 AS lo_nan FROM ({_NUMBERS}) GROUP BY b""")
def agg_nulls_nan(t):
    x, finite = col("x"), col("x").filter(col("x").is_finite())
    made = _numbers(t).group_by("b").agg(x.any_null().alias("any_null"), x.has_nulls().alias("has_nulls"), finite.nan_max().alias("hi"), finite.avg().alias("mean"), x.nan_min().alias("lo"))
    return made.df.select("b", "any_null", "has_nulls", "hi", F.round("mean", 4).alias("mean"), F.isnan("lo").alias("lo_nan"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT o_orderstatus, CAST(arg_max(i, o_totalprice) AS BIGINT) AS at_max, CAST(arg_min(i, o_totalprice) AS BIGINT) AS at_min, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM o GROUP BY 1""")
def agg_positions(t):
    p = col("o_totalprice")
    made = t("orders").group_by("o_orderstatus").agg(p.arg_max().alias("at_max"), p.arg_min().alias("at_min"), p.max().alias("hi"), p.min().alias("lo"))
    return made.df.withColumns({c: F.col(c).cast("long") for c in ("at_max", "at_min")})


# windows

_W = "(PARTITION BY user_id ORDER BY event_id"
_W3 = f"{_W} ROWS 2 PRECEDING)"


@query(f"""SELECT event_id, min(value) OVER {_W} ROWS UNBOUNDED PRECEDING) AS lo, round(sum(ln(1 + value)) OVER {_W} ROWS UNBOUNDED PRECEDING), 4) AS pr, round(sum(value) OVER {_W3}, 4) AS rs, max(value) OVER {_W3} AS rx, round(quantile_cont(value, 0.25) OVER {_W3}, 4) AS rq,
    lag(value, 2) OVER {_W}) AS sh, count(*) OVER (PARTITION BY user_id, event_type) = 1 AS uq, event_type = first_value(event_type) OVER {_W}) AS first_kind FROM events""")
def win_more(t):
    v = col("value")
    made = t("events").select("event_id", v.cum_min().over("user_id").alias("lo"), (v + 1).cum_prod().over("user_id").log().alias("pr"), v.rolling_sum(3).over("user_id").round(4).alias("rs"), v.rolling_max(3).over("user_id").alias("rx"), v.rolling_quantile(0.25, 3).over("user_id").round(4).alias("rq"), v.shift(2).over("user_id").alias("sh"), col("event_type").is_unique().over("user_id").alias("uq"), col("event_type").is_n_distinct(0).over("user_id").alias("first_kind"))
    return made.df.withColumn("pr", F.round("pr", 4))


@query(f"""WITH r AS (SELECT event_id, value, list(value) OVER {_W3} AS l FROM events) SELECT event_id, CAST(len(list_filter(l, lambda y: y < value)) + 1 AS BIGINT) AS rk, round(list_sum(l) * 2, 4) AS called FROM r""")
def win_rolling_calls(t):
    v = col("value")
    made = t("events").select("event_id", v.rolling_rank(3).over("user_id").alias("rk"), v.rolling(3, lambda values: 2.0 * sum(values)).over("user_id").round(4).alias("called"))
    return made.df.withColumn("rk", F.col("rk").cast("long"))


# lists and structs


@query("""SELECT p_partkey, list_has_all(l, ['cold']) AS every, list_has_any(l, ['cold', 'bolt']) AS some, l[2] || '|' || l[1] AS gathered, l[1] AS got, coalesce(l[3], '-') AS beyond, '?|' || l[1] AS shifted, l[1] || '|x|' || l[2] AS spliced, upper(l[1]) || '|' || upper(l[2]) AS evaluated,
    CAST(CASE WHEN l[1] >= l[2] THEN 0 ELSE 1 END AS BIGINT) AS at_max, CAST(CASE WHEN l[1] <= l[2] THEN 0 ELSE 1 END AS BIGINT) AS at_min, l[1] AS every_second, l[2] AS second_field, CAST(len(l) AS BIGINT) AS n FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)""")
def arr_sets(t):
    l = col("l").arr  # noqa: E741
    made = t("part").select("p_partkey", col("p_name").str.split(" ").alias("l")).select(
        "p_partkey", l.contains_all(["cold"]).alias("every"), l.contains_any(["cold", "bolt"]).alias("some"), l.gather([1, 0]).arr.join("|").alias("gathered"), l.get(0).alias("got"), l.get(2).fill_null("-").alias("beyond"), l.shift(1, "?").arr.join("|").alias("shifted"), l.splice(1, 0, "x").arr.join("|").alias("spliced"),
        l.eval(element().str.upper()).arr.join("|").alias("evaluated"), l.arg_max().alias("at_max"), l.arg_min().alias("at_min"), l.gather_every(2).arr.join("|").alias("every_second"), l.to_struct(["a", "b"]).struct.field("b").alias("second_field"), l.lengths().alias("n"),
    )
    return made.df.withColumns({c: F.col(c).cast("long") for c in ("at_max", "at_min", "n")})


@query("""SELECT n_nationkey, n_name AS label, n_regionkey AS region FROM nation""")
def struct_unnest(t):
    s = col("s").struct
    made = t("nation").select("n_nationkey", col("n_name")._map(lambda c, _: F.struct(c.alias("name"), F.col("n_regionkey").alias("region"))).alias("s"))
    return made.select("n_nationkey", s.rename_fields({"name": "label"}).struct.unnest())


# frames


@query("""SELECT s_suppkey, s_nationkey, s_nationkey * 2 AS twice, CASE WHEN s_nationkey % 3 <> 0 THEN s_acctbal END AS some FROM supplier WHERE s_nationkey % 3 <> 0""")
def frame_columns(t):
    some = when((col("s_nationkey") % 3).ne(0)).then(col("s_acctbal")).otherwise(None)
    made = t("supplier").with_columns(some.alias("some")).drop("s_name", "s_acctbal").insert_column(2, "twice", col("s_nationkey") * 2)
    return made.drop_nulls("some").clone().select(exclude("nothing"))


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9""")
def frame_tail(t):
    return t("orders").select("o_orderkey").limit(9, from_="end")


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def csv_roundtrip(t):
    text = write_csv(t("nation"))
    return read_csv(t("nation").df.sparkSession, text).df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def json_roundtrip(t):
    text = write_json(t("nation"))
    return read_json(t("nation").df.sparkSession, text).df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


# joins and dynamic windows


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_nationkey END AS k FROM customer), b AS (SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN s_nationkey END AS k FROM supplier) SELECT c_custkey, a.k AS k, b.k AS k_s, s_suppkey FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def join_options(t):
    cut = lambda c: when(col(c) < 12).then(col(c)).otherwise(None).alias("k")
    a, b = t("customer").select("c_custkey", cut("c_nationkey")), t("supplier").select("s_suppkey", cut("s_nationkey"))
    return a.join(b, on="k", join_nulls=True, coalesce=False, suffixes=("", "_s"), maintain_order="left")


@query("""SELECT s_suppkey, p_partkey FROM supplier LEFT JOIN part ON s_acctbal < p_retailprice AND s_suppkey < p_size""")
def join_where_left(t):
    return t("supplier").select("s_suppkey", "s_acctbal").join_where(t("part").select("p_partkey", "p_size", "p_retailprice"), col("s_acctbal") < col("p_retailprice"), col("s_suppkey") < col("p_size"), how="left").select("s_suppkey", "p_partkey")


@query("""SELECT s_suppkey, p_partkey FROM supplier RIGHT JOIN part ON s_acctbal < p_retailprice AND s_suppkey < p_size""")
def join_where_right(t):
    return t("supplier").select("s_suppkey", "s_acctbal").join_where(t("part").select("p_partkey", "p_size", "p_retailprice"), col("s_acctbal") < col("p_retailprice"), col("s_suppkey") < col("p_size"), how="right").select("s_suppkey", "p_partkey")


@query("""WITH a AS (SELECT event_id, user_id, date_trunc('day', ts) AS d FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id AS who, date_trunc('day', ts) AS on_day, max(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, click FROM a ASOF LEFT JOIN b ON user_id = who AND d > on_day""")
def asof_strict(t):
    e = t("events").with_columns(col("ts").dt.date().alias("d"))
    clicks = e.filter(col("event_type").eq("click")).group_by(["user_id", "d"]).agg(col("event_id").max().alias("click")).select(col("user_id").alias("who"), col("d").alias("on_day"), "click")
    return e.filter(col("event_type").eq("purchase")).select("event_id", "user_id", "d").join_asof(clicks, left_on="d", right_on="on_day", left_by="user_id", right_by="who", allow_exact_matches=False).select("event_id", "click")


@query("""SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q, strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH, '%Y-%m-%d') AS till, count(*) AS n FROM orders GROUP BY ALL""")
def dyn_options(t):
    made = t("orders").group_by_dynamic("o_orderdate", every="1q", include_boundaries=True).agg(col("o_totalprice").count(include_nulls=True).alias("n"))
    names = made.columns
    upper = next(c for c in names if "upper" in c)
    return made.df.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("q"), F.date_format(upper, "yyyy-MM-dd").alias("till"), "n")


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, count(*) AS n FROM events GROUP BY ALL""")
def dyn_weeks(t):
    made = t("events").group_by_dynamic("ts", every="1w", start_by="monday").agg(col("value").count(include_nulls=True).alias("n"))
    return made.df.select(F.date_format("ts", "yyyy-MM-dd").alias("w"), "n")


@query("""SELECT strftime(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR, '%Y') AS y, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1""")
def dyn_label_right(t):
    made = t("orders").group_by_dynamic("o_orderdate", every="1y", label="right").agg(col("o_totalprice").count(include_nulls=True).alias("n"), col("o_totalprice").sum().alias("s"))
    return made.df.select(F.date_format("o_orderdate", "yyyy").alias("y"), "n", F.round("s", 2).alias("s"))
