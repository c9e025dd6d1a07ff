"""The catalogue: one query for each part of the engine over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entry import coalesce, col, element, horizontal, lit, seq_range, struct, when
from ..operators.frame import Frame
from ..operators.reshape import concat
from ..types import Int32

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS.get(name))


def query(sql: str | None = None):
    """Registers a function of a table reader (name -> frame) under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda name: table(spark, sf_dir, name))
            return out.df if isinstance(out, Frame) else out

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_more  # noqa: F401 registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _round(name: str, digits: int = 4):
    return col(name).round(digits).alias(name)


# aggregation


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    price = col("l_extendedprice") * (lit(1) - col("l_discount"))
    made = t("lineitem").filter(col("l_shipdate") <= lit("1998-09-02").str.to_datetime()).group_by(["l_returnflag", "l_linestatus"]).agg(col("l_quantity").sum().alias("sum_qty"), col("l_extendedprice").sum().alias("sum_base"), price.sum().alias("sum_disc"), col("l_quantity").mean().alias("avg_qty"), col("l_quantity").count(include_nulls=True).alias("n"))
    return made.select("l_returnflag", "l_linestatus", _round("sum_qty", 2), _round("sum_base", 2), _round("sum_disc", 2), _round("avg_qty"), "n")


@query("""SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS std, round(var_samp(o_totalprice), 2) AS var, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi,
    round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS q90, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL""")
def agg_stats(t):
    x = col("o_totalprice")
    made = t("orders").group_by("o_orderpriority").agg(x.std().alias("std"), x.variance().alias("var"), x.min().alias("lo"), x.max().alias("hi"), x.median().alias("med"), x.quantile(0.9).alias("q90"), col("o_custkey").n_unique().alias("customers"))
    return made.select("o_orderpriority", _round("std"), _round("var", 2), _round("lo"), _round("hi"), _round("med"), _round("q90"), "customers")


@query("""WITH m AS (SELECT event_type, avg(value) AS mu, count(*) AS n FROM events GROUP BY event_type),
    c AS (SELECT event_type, n, sum((value - mu) ** 2) / n AS m2, sum((value - mu) ** 3) / n AS m3, sum((value - mu) ** 4) / n AS m4 FROM events JOIN m USING (event_type) GROUP BY event_type, n)
    SELECT event_type, round(m3 / m2 ** 1.5, 4) AS skew, round(m4 / m2 ** 2 - 3, 4) AS kurt FROM c""")
def agg_skew_kurt(t):
    made = t("events").group_by("event_type").agg(col("value").skew().alias("skew"), col("value").kurtosis().alias("kurt"))
    return made.select("event_type", _round("skew"), _round("kurt"))


@query("""SELECT event_type, arg_min(event_id, value) AS at_min, arg_max(event_id, value) AS at_max, arg_min(user_id, event_id) AS first_user, arg_max(user_id, event_id) AS last_user FROM events GROUP BY ALL""")
def agg_first_last_by(t):
    made = t("events").group_by("event_type").agg(col("event_id").min_by("value").alias("at_min"), col("event_id").max_by("value").alias("at_max"), col("user_id").first().alias("first_user"), col("user_id").last().alias("last_user"))
    return made


@query("""SELECT o_orderpriority, round(corr(o_totalprice, o_custkey), 6) AS r, round(covar_samp(o_totalprice, o_custkey), 2) AS cov, round(sum(o_totalprice * o_custkey), 0) AS dot,
    round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS wavg FROM orders GROUP BY ALL""")
def agg_corr_cov(t):
    x, y = col("o_totalprice"), col("o_custkey")
    made = t("orders").group_by("o_orderpriority").agg(x.corr("o_custkey").alias("r"), x.cov("o_custkey").alias("cov"), x.dot("o_custkey").alias("dot"), x.w_avg("o_custkey").alias("wavg"))
    return made.select("o_orderpriority", _round("r", 6), _round("cov", 2), _round("dot", 0), _round("wavg"))


@query("""WITH r AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0 AS b FROM orders)
    SELECT o_orderstatus, round(corr(a, b), 6) AS rho FROM r GROUP BY ALL""")
def agg_spearman(t):
    return t("orders").group_by("o_orderstatus").agg(col("o_totalprice").spearman_corr("o_custkey").alias("rho")).select("o_orderstatus", _round("rho", 6))


@query("""SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x, CAST(round(product(n_nationkey + 1), 0) AS DOUBLE) AS p FROM nation GROUP BY ALL""")
def agg_bitwise_product(t):
    k = col("n_nationkey")
    made = t("nation").group_by("n_regionkey").agg(k.bitwise_and().alias("a"), k.bitwise_or().alias("o"), k.bitwise_xor().alias("x"), (k + 1).product().alias("p"))
    return made.select("n_regionkey", *[col(c).cast(Int32).alias(c) for c in "aox"], _round("p", 0))


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT o_orderpriority, sum(n) AS t, max(n) AS m FROM c GROUP BY ALL)
    SELECT o_orderpriority, round(sum(-n / t * ln(n / t)), 6) AS entropy, string_agg(CASE WHEN n = m THEN o_orderstatus END, ',' ORDER BY o_orderstatus) AS modes FROM c JOIN s USING (o_orderpriority) GROUP BY ALL""")
def agg_entropy_mode(t):
    made = t("orders").group_by("o_orderpriority").agg(col("o_orderstatus").entropy().alias("entropy"), col("o_orderstatus").mode().alias("modes"))
    return made.select("o_orderpriority", _round("entropy", 6), col("modes").arr.join(",").alias("modes"))


@query("""SELECT l_returnflag, bool_and(l_quantity > 1) AS every, bool_or(l_quantity > 49) AS some, count(*) - count(nullif(l_linestatus, 'O')) AS nulls, count(nullif(l_linestatus, 'O')) = 0 AS all_null FROM lineitem GROUP BY ALL""")
def agg_any_all_null(t):
    s = when(col("l_linestatus").ne("O")).then(col("l_linestatus")).otherwise(None)
    return t("lineitem").with_columns(s.alias("s")).group_by("l_returnflag").agg((col("l_quantity") > 1).all().alias("every"), (col("l_quantity") > 49).any().alias("some"), col("s").null_count().alias("nulls"), col("s").all_null().alias("all_null"))


@query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS customers FROM orders""")
def agg_global(t):
    x = col("o_totalprice")
    return t("orders").select(x.count().alias("n"), x.sum().alias("total"), x.mean().alias("mean"), col("o_custkey").n_unique().alias("customers")).select("n", _round("total", 2), _round("mean"), "customers")


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL""")
def agg_implode(t):
    return t("nation").group_by("n_regionkey").agg(col("n_name").implode().alias("l")).select("n_regionkey", col("l").arr.join(",").alias("names"))


# scalars


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
    coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders""")
def when_otherwise(t):
    p = col("o_totalprice")
    return t("orders").select("o_orderkey", when(p > 200000).then("high").when(p > 100000).then("mid").otherwise("low").alias("band"), coalesce(when(col("o_orderstatus").ne("O")).then(col("o_orderstatus")).otherwise(None), "open").alias("status"))


@query("""SELECT c_custkey, round(abs(c_acctbal), 4) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s,
    CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, round(sin(c_acctbal), 6) AS sn, CASE WHEN abs(c_acctbal / 10000) <= 1 THEN round(acos(c_acctbal / 10000), 6) END AS ac, sign(c_acctbal) AS sg FROM customer""")
def math_unary(t):
    x = col("c_acctbal")
    made = t("customer").select("c_custkey", x.abs().alias("a"), x.floor().alias("f"), x.ceil().alias("c"), x.sqrt().alias("s"), x.log().alias("l"), x.sin().alias("sn"), (x / 10000).arccos().alias("ac"), x.sign().alias("sg"))
    return made.df.select("c_custkey", F.round("a", 4).alias("a"), F.col("f").cast("double").alias("f"), F.col("c").cast("double").alias("c"), F.round("s", 6).alias("s"), F.round("l", 6).alias("l"), F.round("sn", 6).alias("sn"), F.round("ac", 6).alias("ac"), F.col("sg").cast("int").alias("sg"))


_SQL["math_unary"] = _SQL["math_unary"].replace("floor(c_acctbal) AS f", "CAST(floor(c_acctbal) AS DOUBLE) AS f").replace("ceil(c_acctbal) AS c", "CAST(ceil(c_acctbal) AS DOUBLE) AS c").replace("sign(c_acctbal)", "CAST(sign(c_acctbal) AS INTEGER)")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN round(l_quantity / (l_linenumber - 3), 6) END AS q, l_partkey % 7 AS m, round(l_quantity ** 2, 4) AS p,
    CASE WHEN l_linenumber <> 3 THEN CAST(floor(l_quantity / (l_linenumber - 3)) AS BIGINT) END AS fd FROM lineitem""")
def math_binary_guarded(t):
    d = col("l_linenumber") - 3
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (col("l_quantity") / d).round(6).alias("q"), (col("l_partkey") % 7).alias("m"), (col("l_quantity") ** 2).round(4).alias("p"), col("l_quantity").floordiv(d).alias("fd"))


_SQL["math_binary_guarded"] = _SQL["math_binary_guarded"].replace("round(l_quantity / (l_linenumber - 3), 6)", "floor(l_quantity / (l_linenumber - 3) * 1000000 + 0.5) / 1000000")


@query("""SELECT p_partkey, p_size BETWEEN 10 AND 20 AS b, p_size IN (1, 5, 9) AS i, p_brand LIKE '%1%' AND p_size > 5 AS x, greatest(10, least(20, p_size)) AS clip FROM part""")
def predicates(t):
    s = col("p_size")
    return t("part").select("p_partkey", s.between(10, 20).alias("b"), s.is_in([1, 5, 9]).alias("i"), (col("p_brand").str.contains("1") & (s > 5)).alias("x"), s.clip(10, 20).alias("clip"))


# joins


def _join_query(how: str, sql_how: str):
    def f(t):
        return t("customer").join(t("orders"), left_on="c_custkey", right_on="o_custkey", how=how).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")

    f.__name__ = f"join_{how}_whole"
    query(f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey, o_totalprice FROM customer {sql_how} JOIN orders ON c_custkey = o_custkey")(f)


for _how, _sql_how in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join_query(_how, _sql_how)


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def join_semi(t):
    return t("customer").join(t("orders").filter(col("o_totalprice") > 200000), left_on="c_custkey", right_on="o_custkey", how="semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def join_anti(t):
    return t("customer").join(t("orders").filter(col("o_totalprice") > 200000), left_on="c_custkey", right_on="o_custkey", how="anti").select("c_custkey", "c_name")


@query("""SELECT r_name, n_name FROM region, nation""")
def join_cross(t):
    return t("region").select("r_name").join(t("nation").select("n_name"), how="cross")


@query("""SELECT s_suppkey, p_partkey, s_acctbal, p_retailprice FROM supplier, part WHERE s_acctbal < p_retailprice AND s_suppkey < p_size""")
def join_where(t):
    return t("supplier").select("s_suppkey", "s_acctbal").join_where(t("part").select("p_partkey", "p_size", "p_retailprice"), col("s_acctbal") < col("p_retailprice"), col("s_suppkey") < col("p_size")).select("s_suppkey", "p_partkey", "s_acctbal", "p_retailprice")


def _purchases_clicks(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    return e.filter(col("event_type").eq("purchase")), e.filter(col("event_type").eq("click")).select("user_id", "ts", col("event_id").alias("click"), col("ts").alias("click_ts"))


_PC = "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click, user_id, ts, ts AS click_ts FROM events WHERE event_type = 'click') "


@query(_PC + "SELECT event_id, click FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts")
def join_asof_backward(t):
    p, c = _purchases_clicks(t)
    return p.join_asof(c, on="ts", by="user_id").select("event_id", "click")


@query(_PC + "SELECT event_id, click FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.ts")
def join_asof_forward(t):
    p, c = _purchases_clicks(t)
    return p.join_asof(c, on="ts", by="user_id", strategy="forward").select("event_id", "click")


@query(_PC + """, b AS (SELECT event_id, p.ts, click, click_ts FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts), f AS (SELECT event_id, click, click_ts FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.ts)
    SELECT event_id, CASE WHEN b.click IS NULL THEN f.click WHEN f.click IS NULL OR ts - b.click_ts <= f.click_ts - ts THEN b.click ELSE f.click END AS click FROM b JOIN f USING (event_id)""")
def join_asof_nearest(t):
    p, c = _purchases_clicks(t)
    return p.join_asof(c, on="ts", by="user_id", strategy="nearest").select("event_id", "click")


@query(_PC + "SELECT event_id, CASE WHEN p.ts - click_ts <= INTERVAL 6 HOUR THEN click END AS click FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts")
def join_asof_tolerance(t):
    p, c = _purchases_clicks(t)
    return p.join_asof(c, on="ts", by="user_id", tolerance="6h").select("event_id", "click")


# windows

_W = "(PARTITION BY user_id ORDER BY event_id"


@query(f"""SELECT event_id, round(sum(value) OVER {_W} ROWS UNBOUNDED PRECEDING), 4) AS cs, round(max(value) OVER {_W} ROWS UNBOUNDED PRECEDING), 4) AS cm, count(value) OVER {_W} ROWS UNBOUNDED PRECEDING) AS cc FROM events""")
def win_cum(t):
    v = col("value")
    return t("events").select("event_id", v.cum_sum().over("user_id").round(4).alias("cs"), v.cum_max().over("user_id").round(4).alias("cm"), v.cum_count().over("user_id").alias("cc"))


@query(f"""SELECT event_id, round(avg(value) OVER {_W} ROWS 2 PRECEDING), 4) AS rm, round(min(value) OVER {_W} ROWS 2 PRECEDING), 4) AS rn, round(coalesce(stddev_samp(value) OVER {_W} ROWS 2 PRECEDING), 0), 4) AS rs, round(median(value) OVER {_W} ROWS 2 PRECEDING), 4) AS rd FROM events""")
def win_rolling(t):
    v = col("value")
    return t("events").select("event_id", v.rolling_mean(3).over("user_id").round(4).alias("rm"), v.rolling_min(3).over("user_id").round(4).alias("rn"), v.rolling_std(3).over("user_id").round(4).alias("rs"), v.rolling_median(3).over("user_id").round(4).alias("rd"))


@query("""SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders""")
def win_rank(t):
    k = col("o_custkey")
    made = t("orders").select("o_orderkey", k.rank().over("o_orderpriority").alias("r"), k.dense_rank().over("o_orderpriority").alias("d"), k.row_number().over("o_orderpriority").alias("n"))
    return made.df.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in "rdn"])


@query(f"""SELECT event_id, lag(value) OVER {_W}) AS a, lead(value, 2) OVER {_W}) AS b FROM events""")
def win_lag_lead(t):
    return t("events").select("event_id", col("value").lag().over("user_id").alias("a"), col("value").lead(2).over("user_id").alias("b"))


@query("""SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS d, round(o_totalprice / sum(o_totalprice) OVER (), 9) AS share, count(*) OVER (PARTITION BY o_custkey) > 1 AS dup FROM orders""")
def win_over_agg(t):
    p = col("o_totalprice")
    made = t("orders").select("o_orderkey", (p - p.mean().over("o_orderstatus")).alias("d"), (p / p.sum()).alias("share"), col("o_custkey").is_duplicated().alias("dup"))
    return made.df.select("o_orderkey", F.round("d", 2).alias("d"), F.round("share", 9).alias("share"), "dup")


@query(f"""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
    SELECT event_id, last_value(v IGNORE NULLS) OVER {_W} ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e""")
def fill_forward_backward(t):
    e = t("events").with_columns(when(col("event_type").eq("purchase")).then(col("value")).otherwise(None).alias("v"))
    return e.select("event_id", col("v").fill_null(strategy="forward").over("user_id").alias("f"), col("v").fill_null(strategy="backward").over("user_id").alias("b"))


# dynamic windows


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1""")
def dyn_tumbling(t):
    return t("events").group_by_dynamic("ts", every="1h").agg(col("value").count(include_nulls=True).alias("n"), col("value").sum().alias("s")).select("ts", "n", _round("s"))


@query("""WITH m AS (SELECT time_bucket(INTERVAL 1 DAY, min(ts)) AS a FROM events), w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY AS s, value FROM events, (VALUES (0), (1), (2)) v(k))
    SELECT s AS ts, count(*) AS n, round(max(value), 4) AS hi FROM w, m WHERE s >= a GROUP BY 1""")
def dyn_sliding(t):
    return t("events").group_by_dynamic("ts", every="1d", period="3d").agg(col("value").count(include_nulls=True).alias("n"), col("value").max().alias("hi")).select("ts", "n", _round("hi"))


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1, 2""")
def dyn_calendar_month(t):
    made = t("orders").group_by_dynamic("o_orderdate", every="1mo", by="o_orderstatus").agg(col("o_totalprice").count(include_nulls=True).alias("n"), col("o_totalprice").sum().alias("s"))
    return made.select("o_orderdate", "o_orderstatus", "n", _round("s", 2))


@query("""SELECT CAST(ceil(o_custkey / 10.0) * 10 - 10 AS BIGINT) AS o_custkey, count(*) AS n FROM orders GROUP BY 1""")
def dyn_closed_right(t):
    return t("orders").group_by_dynamic("o_custkey", every=10, closed="right").agg(col("o_totalprice").count(include_nulls=True).alias("n"))


# reshaping


@query("""SELECT n_regionkey, arg_max(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) AS even, arg_max(CASE WHEN n_nationkey % 2 = 1 THEN n_name END, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey END) AS odd FROM nation GROUP BY 1""")
def pivot_last(t):
    n = t("nation").with_columns(when((col("n_nationkey") % 2).eq(0)).then("even").otherwise("odd").alias("kind"))
    return n.pivot("n_regionkey", "kind", "n_name")


@query("""SELECT s_suppkey, variable, value FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier) UNPIVOT (value FOR variable IN (s_nationkey, s_acctbal))""")
def unpivot(t):
    return t("supplier").unpivot("s_suppkey", ["s_nationkey", "s_acctbal"])


@query("""SELECT r_regionkey AS k, r_name AS n FROM region UNION ALL SELECT n_nationkey, n_name FROM nation""")
def concat_vertical(t):
    return concat([t("region").rename({"r_regionkey": "k", "r_name": "n"}), t("nation").select(col("n_nationkey").alias("k"), col("n_name").alias("n"))])


@query("""SELECT r_regionkey AS k, r_name, NULL AS n_name FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation""")
def concat_diagonal(t):
    return concat([t("region").rename({"r_regionkey": "k"}), t("nation").select(col("n_nationkey").alias("k"), "n_name")], how="diagonal")


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) JOIN (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) USING (i)""")
def concat_horizontal_whole(t):
    return concat([t("orders").select("o_orderkey"), t("orders").select("o_totalprice")], how="horizontal")


@query("""SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1""")
def unique_first(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice").unique("o_custkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def sort_head(t):
    return t("orders").select("o_orderkey", "o_totalprice").sort("o_totalprice", descending=True).head(20)


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5""")
def slice_offset(t):
    return t("orders").select("o_orderkey").slice(5, 12)


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) + 99 AS i, o_orderkey FROM orders""")
def row_index(t):
    return t("orders").select("o_orderkey").with_row_index("i", 100)


@query("""SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def explode_lists_whole(t):
    d = t("documents").select("doc_id", col("text").str.split(" ").alias("word"))
    out = d.with_columns(seq_pos("word").alias("pos")).explode(["word", "pos"])
    return out.df.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


def seq_pos(name: str):
    return col(name)._map(lambda c, _: F.transform(c, lambda x, i: i))


@query("""SELECT a AS n_nationkey_0, b AS n_nationkey_1, c AS n_nationkey_2, d AS n_nationkey_3, e AS n_nationkey_4 FROM (SELECT (i - 1) % 5 AS r, max(CASE WHEN (i - 1) // 5 = 0 THEN n_nationkey END) AS a, max(CASE WHEN (i - 1) // 5 = 1 THEN n_nationkey END) AS b, max(CASE WHEN (i - 1) // 5 = 2 THEN n_nationkey END) AS c,
    max(CASE WHEN (i - 1) // 5 = 3 THEN n_nationkey END) AS d, max(CASE WHEN (i - 1) // 5 = 4 THEN n_nationkey END) AS e FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) GROUP BY 1)""")
def unstack(t):
    return t("nation").unstack("n_nationkey", 5)


@query("""SELECT 'r_name' AS col, max(CASE WHEN r_regionkey = 0 THEN r_name END) AS a, max(CASE WHEN r_regionkey = 1 THEN r_name END) AS b, max(CASE WHEN r_regionkey = 2 THEN r_name END) AS c, max(CASE WHEN r_regionkey = 3 THEN r_name END) AS d, max(CASE WHEN r_regionkey = 4 THEN r_name END) AS e FROM region""")
def transpose(t):
    return t("region").select("r_name").transpose(include_header=True, header_name="col", column_names=list("abcde"))


# strings


@query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, CASE WHEN length(p_type) < 12 THEN lpad(p_type, 12, '*') ELSE p_type END AS pad, substr(p_name, 3, 4) AS mid, left(p_name, 3) AS h, right(p_name, 3) AS tl, reverse(p_brand) AS rev, length(p_name) AS n FROM part""")
def str_case_pad_slice(t):
    n = col("p_name").str
    made = t("part").select("p_partkey", n.lower().alias("lo"), col("p_brand").str.upper().alias("up"), col("p_type").str.lpad(12, "*").alias("pad"), n.slice(2, 4).alias("mid"), n.head(3).alias("h"), n.tail(3).alias("tl"), col("p_brand").str.reverse().alias("rev"), n.len_chars().alias("n"))
    return made.df.withColumn("n", F.col("n").cast("long"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, CAST(len(regexp_extract_all(url, '[aeiou]')) AS BIGINT) AS vowels, contains(url, 'example') AS ex, starts_with(url, 'https') AS sec FROM pages""")
def str_regex(t):
    u = col("url").str
    made = t("pages").select("page_id", u.extract("^https?://([^/]+)").alias("host"), u.replace_all("[0-9]+", "#").alias("masked"), u.count_matches("[aeiou]").alias("vowels"), u.contains("example").alias("ex"), u.starts_with("https").alias("sec"))
    return made.df.withColumn("vowels", F.col("vowels").cast("long"))


@query("""SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), '|') AS r, lower(hex(p_brand)) AS hx, base64(encode(p_brand)) AS b64, nullif(trim(p_type), '') AS tr FROM part""")
def str_split_encode(t):
    made = t("part").select("p_partkey", col("p_name").str.split(" ").arr.reverse().arr.join("|").alias("r"), col("p_brand").str.encode("hex").alias("hx"), col("p_brand").str.encode("base64").alias("b64"), col("p_type").str.trim().alias("tr"))
    return made


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def str_json(t):
    return t("events").select("event_id", col("props").str.json_path_match("$.k").alias("k"))


# dates


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(isodow(o_orderdate) AS INTEGER) AS wd, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
    CAST(weekofyear(o_orderdate) AS INTEGER) AS w, CAST(day(last_day(o_orderdate)) AS INTEGER) AS dim, epoch_ms(o_orderdate) AS e FROM orders""")
def dt_fields(t):
    d = col("o_orderdate").dt
    return t("orders").select("o_orderkey", d.year().alias("y"), d.month().alias("m"), d.day().alias("d"), d.quarter().alias("q"), d.weekday().alias("wd"), d.ordinal_day().alias("doy"), d.iso_week().alias("w"), d.days_in_month().alias("dim"), d.epoch("ms").alias("e"))


@query("""SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS f, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS o, dayofweek(ts) NOT IN (0, 6) AS b, strftime(date_trunc('month', ts), '%Y-%m-%d') AS ms FROM events""")
def dt_format_offset(t):
    d = col("ts").dt
    return t("events").select("event_id", d.strftime("%Y/%m/%d %H:%M:%S").alias("f"), d.offset_day(3).dt.strftime("%Y-%m-%d").alias("o"), d.is_business_day().alias("b"), d.month_start().dt.strftime("%Y-%m-%d").alias("ms"))


# lists and structs


@query("""SELECT vec_id, round(list_sum(e), 4) AS s, round(list_avg(e), 6) AS a, CAST(len(e) AS BIGINT) AS n, round(list_max(e), 6) AS mx, round(list_median(e), 6) AS md, CAST(len(list_filter(e, lambda x: x > 0)) AS BIGINT) AS pos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def arr_stats(t):
    a = col("embedding").arr
    made = t("embeddings").select("vec_id", a.sum().alias("s"), a.mean().alias("a"), a.len().alias("n"), a.max().alias("mx"), a.median().alias("md"), a.filter(element() > 0).arr.len().alias("pos"))
    return made.df.select("vec_id", F.round("s", 4).alias("s"), F.round("a", 6).alias("a"), F.col("n").cast("long").alias("n"), F.round(F.col("mx").cast("double"), 6).alias("mx"), F.round("md", 6).alias("md"), F.col("pos").cast("long").alias("pos"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(l_quantity + l_tax + l_discount, 4) AS s, greatest(l_quantity, l_tax, l_discount) AS m FROM lineitem""")
def horizontal_ops(t):
    h = lambda: horizontal("l_quantity", "l_tax", "l_discount")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", h().sum().round(4).alias("s"), h().max().alias("m"))


@query("""SELECT n_nationkey, n_name AS name, n_regionkey * 2 AS twice FROM nation""")
def struct_ops(t):
    s = struct({"name": col("n_name"), "region": col("n_regionkey")})
    made = t("nation").select("n_nationkey", s.alias("s")).with_columns(col("s").struct.with_fields({"twice": col("s").struct.field("region") * 2}).alias("s"))
    return made.select("n_nationkey", col("s").struct.field("name"), col("s").struct.field("twice"))


@query("""SELECT r_regionkey, 10 + 5 * (row_number() OVER (ORDER BY r_regionkey) - 1) AS seq FROM region""")
def seq_range_rows(t):
    made = t("region").select("r_regionkey", seq_range(10, step=5))
    return made.df.withColumn("seq", F.col("seq").cast("long"))
