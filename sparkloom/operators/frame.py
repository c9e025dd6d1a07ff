"""The frame: a Spark DataFrame with an explicit row order, immutable, planned lazily.

Order columns are carried as hidden columns `__ord…` (the one prefix that is the engine's own), which Catalyst prunes wherever no operation needs them. Frames of
local data are in the order given; for tables, name the columns that order their rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, ComputeError, FrameError, InvalidArgumentError, SchemaError, ShapeError
from ..functions.entry import all_, col
from ..functions.expr import CamelNames, Context, Expr, column, to_expr, truthy
from ..types import DType, Float64, Int32, TypeClass, coerce
from .ranges import PART, ROW, in_ranges

ORD = "__ord"
_ORDER = re.compile(ORD + r"\d+")
#: Distinct values of a key that a comparing function orders at most.
COMPARED = 10_000


def infer(values: list) -> T.DataType:
    """The type of a column of Python values: all are looked at; integers beyond 32 bits are doubles, mixed ones text."""
    have = [v for v in values if v is not None]
    if not have:
        return T.StringType() if not values else T.NullType()
    kinds = {type(v) for v in have}
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int, float}:
        small = kinds == {int} and all(-(1 << 31) <= v < 1 << 31 for v in have)
        return Int32.spark if small else Float64.spark
    if kinds <= {list, tuple}:
        return T.ArrayType(infer([x for v in have for x in v]) if any(have) else T.StringType(), True)
    if kinds <= {dict}:
        names = list(dict.fromkeys(k for v in have for k in v))
        return T.StructType([T.StructField(k, infer([v.get(k) for v in have])) for k in names])
    if kinds <= {bytes, bytearray}:
        return T.BinaryType()
    import datetime as d

    if kinds <= {d.datetime, d.date}:
        return T.DateType() if kinds == {d.date} else T.TimestampType()
    return T.StringType()


def _fit(value: Any, t: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(value)
    if isinstance(t, T.StringType) and not isinstance(value, str):
        return str(value).lower() if isinstance(value, bool) else str(value)
    if isinstance(t, T.ArrayType):
        return [_fit(v, t.elementType) for v in value]
    if isinstance(t, T.StructType):
        return {f.name: _fit(value.get(f.name), f.dataType) for f in t.fields}
    return value


def data(spark: SparkSession, rows: list[dict] | dict[str, list], schema: dict[str, DType] | None = None) -> Frame:
    """A frame of rows or columns; with a schema only its columns, coerced, missing ones null."""
    if isinstance(rows, dict):
        heights = {len(v) for v in rows.values()}
        if len(heights) > 1:
            raise ShapeError(f"columns of heights {sorted(heights)}")
        columns = {k: list(v) for k, v in rows.items()}
    else:
        names = dict.fromkeys(k for r in rows for k in r)
        columns = {k: [r.get(k) for r in rows] for k in names}
    height = max((len(v) for v in columns.values()), default=0)
    if schema is not None:
        columns = {k: columns.get(k, [None] * height) for k in schema}
    types = {k: infer(v) for k, v in columns.items()}
    spark_schema = T.StructType([*[T.StructField(k, t) for k, t in types.items()], T.StructField(f"{ORD}0", T.LongType())])
    made = [tuple(_fit(columns[k][i], t) for k, t in types.items()) + (i,) for i in range(height)]
    frame = Frame(spark.createDataFrame(made, spark_schema))
    return frame.cast(schema) if schema is not None else frame


class Frame(CamelNames):
    def __init__(self, df: DataFrame, order_by: list[str] | str | None = None):
        if order_by is not None:
            keys = [order_by] if isinstance(order_by, str) else list(order_by)
            hidden = [c for c in df.columns if c.startswith(ORD)]
            df = df.drop(*hidden).withColumns({f"{ORD}{k}": F.col(c) for k, c in enumerate(keys)})
        self._df = df
        self._order = [c for c in df.columns if _ORDER.fullmatch(c)]

    # properties

    @property
    def df(self) -> DataFrame:
        """The Spark DataFrame, without order columns."""
        return self._df.select(*[F.col(f"`{c}`") for c in self.columns])

    @property
    def ordered(self) -> DataFrame:
        """The Spark DataFrame in row order."""
        return self._sorted().select(*[F.col(f"`{c}`") for c in self.columns])

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if not c.startswith(ORD)]

    @property
    def schema(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self._df.schema.fields if not f.name.startswith(ORD)}

    @property
    def dtypes(self) -> list[T.DataType]:
        return list(self.schema.values())

    @property
    def height(self) -> int:
        return self._df.count()

    @property
    def width(self) -> int:
        return len(self.columns)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    # inner workings

    def _with(self, df: DataFrame) -> Frame:
        return Frame(df)

    def _sorted(self) -> DataFrame:
        return self._df.orderBy(*[F.col(c).asc_nulls_last() for c in self._order]) if self._order else self._df

    def _need_order(self) -> list:
        if not self._order:
            raise InvalidArgumentError("this operation needs row order: give the frame order columns")
        return [F.col(c).asc_nulls_last() for c in self._order]

    def _exprs(self, args) -> list[Expr]:
        out: list[Expr] = []
        for a in args:
            if isinstance(a, (list, tuple)):
                out += self._exprs(a)
            elif isinstance(a, dict):
                out += [to_expr(v).alias(k) for k, v in a.items()]
            else:
                e = a if isinstance(a, Expr) else col(a) if isinstance(a, str) else col(a) if isinstance(a, (DType, TypeClass)) or hasattr(a, "search") else to_expr(a)
                out += e.expand(self._df)
        return out

    def _built(self, exprs: list[Expr]) -> tuple[DataFrame, list]:
        """The frame to project from (whole-frame aggregates joined as one row) and (name, column) of each expression."""
        ctx = Context(self._df, self._order)
        made = []
        for e in exprs:
            c = e.build(ctx)
            if e.is_unnest:
                made += [(f.name, c.getField(f.name)) for f in ctx.dtype(c).fields]
            else:
                made.append((e.name, c))
        return ctx.joined(self._df), made

    @staticmethod
    def _distinct(names: list[str]) -> None:
        twice = {n for n in names if names.count(n) > 1}
        if twice:
            raise FrameError(f"more than one column named {', '.join(sorted(twice))}")

    # projection

    def select(self, *args) -> Frame:
        exprs = self._exprs(args)
        if any(e.explode_options for e in exprs):
            self._distinct([e.name for e in exprs])
            lists = [e for e in exprs if e.explode_options]
            base = self.select(*exprs_without_explode(exprs))
            empty, nulls = lists[0].explode_options
            return base.explode([e.name for e in lists], empty_as_null=empty, keep_nulls=nulls)
        if exprs and all(e.is_agg or e.is_literal for e in exprs):
            self._distinct([e.name for e in exprs])
            if not any(e.is_agg for e in exprs):
                ctx = Context(self._df, self._order)
                return Frame(self._df.sparkSession.range(1).select(F.lit(0).alias(f"{ORD}0"), *[e.build(ctx).alias(e.name) for e in exprs]))
            ctx = Context(self._df, self._order, "group")
            out = self._df.agg(*[e.build(ctx).alias(e.name) for e in exprs])
            return Frame(out.withColumn(f"{ORD}0", F.lit(0)))
        df, made = self._built(exprs)
        self._distinct([n for n, _ in made])
        return self._with(df.select(*[c.alias(n) for n, c in made], *self._order))

    def with_columns(self, *args) -> Frame:
        df, made = self._built(self._exprs(args))
        new = dict(made)
        kept = [new.pop(c).alias(c) if c in new else F.col(f"`{c}`") for c in self.columns]
        return self._with(df.select(*kept, *[c.alias(n) for n, c in new.items()], *self._order))

    def filter(self, *predicates) -> Frame:
        """Rows for which all predicates hold: expressions, or Python functions of the row (slow)."""
        frame = self
        for p in predicates:
            if callable(p) and not isinstance(p, Expr):
                call = F.udf(lambda row, p=p: bool(p(row.asDict(True))), "boolean")
                frame = frame._with(frame._df.filter(call(F.struct(*frame.columns))))
            else:
                ctx = Context(frame._df, frame._order)
                c = truthy(p.build(ctx), ctx)
                df = ctx.joined(frame._df)
                if p.is_over:
                    df = df.withColumn("__ord_keep", c).filter("__ord_keep")
                else:
                    df = df.filter(c)
                frame = frame._with(df.select(*frame.columns, *frame._order))
        return frame

    def drop(self, *names) -> Frame:
        gone = [n for a in names for n in (a if isinstance(a, (list, tuple)) else [a])]
        return self._with(self._df.drop(*gone))

    def rename(self, mapping: dict[str, str] | None = None) -> Frame:
        names = [(mapping or {}).get(c, c) for c in self.columns]
        self._distinct(names)
        return self._with(self._df.withColumnsRenamed(mapping or {}))

    def cast(self, dtypes: DType | dict[str, DType], strict: bool = False) -> Frame:
        want = dtypes if isinstance(dtypes, dict) else dict.fromkeys(self.columns, dtypes)
        unknown = set(want) - set(self.columns)
        if unknown:
            raise ColumnNotFoundError(f"no column {', '.join(sorted(unknown))}")
        return self._with(self._df.withColumns({c: coerce(F.col(f"`{c}`"), self.schema[c], t, strict) for c, t in want.items()}))

    def clone(self) -> Frame:
        return self._with(self._df)

    def insert_column(self, index: int, name: str, expr: Any) -> Frame:
        e = (column(expr) if isinstance(expr, str) and expr in self.columns else to_expr(expr)).alias(name)
        names = [c for c in self.columns if c != name]
        at = max(0, min(index if index >= 0 else len(names) + index, len(names)))
        return self.select(*names[:at], e, *names[at:])

    def with_row_index(self, name: str = "index", offset: int = 0) -> Frame:
        """Positions from offset on: each range of the sorted frame counts its rows, and offsets are summed over the ranges.

        The ranges are made when this is called, as both the rows and the offsets must see the same ones.
        """
        part = in_ranges(self._df, self._need_order())
        sizes = part.groupBy(PART).agg(F.max(ROW).alias("__ord_n"))
        before = sizes.select(PART, F.coalesce(F.sum(F.col("__ord_n") + 1).over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ord_before"))
        # one row for each range
        out = part.join(F.broadcast(before), PART)
        return self._with(out.select((F.col("__ord_before") + F.col(ROW) + offset).cast("long").alias(name), *[F.col(f"`{c}`") for c in self.columns], *self._order))

    # nulls

    def drop_nulls(self, subset: str | list[str] | None = None) -> Frame:
        names = [subset] if isinstance(subset, str) else subset or self.columns
        condition = F.lit(True)
        for c in names:
            condition = condition & F.col(f"`{c}`").isNotNull()
        return self._with(self._df.filter(condition))

    def fill_null(self, value=None, strategy: str | None = None, limit: int | None = None) -> Frame:
        if strategy is None:
            kind = bool if isinstance(value, bool) else (int, float) if isinstance(value, (int, float)) else str
            fits = {bool: T.BooleanType, str: T.StringType}.get(kind, T.NumericType)
            names = [c for c, t in self.schema.items() if isinstance(t, fits)]
        else:
            names = [c for c, t in self.schema.items() if strategy in ("forward", "backward") or isinstance(t, T.NumericType)]
        return self.with_columns(*[column(c).fill_null(value, strategy, limit) for c in names])

    # rows

    def sort(self, by: Any = None, descending: bool | list[bool] = False, nulls_last: bool = True, custom_comp=None) -> Frame:
        """Stable; nulls and NaN last whatever the direction (or first); the new order is (keys, old order).

        custom_comp, a function of two values (nulls too) or a dict of them by key, orders a key's distinct values on the
        driver; more than COMPARED of them are an error, as a Python function can't order rows where they are.
        """
        keys = [by] if not isinstance(by, (list, tuple)) else list(by)
        exprs = self._exprs(keys)
        down = descending if isinstance(descending, list) else [descending] * len(exprs)
        if len(down) != len(exprs):
            raise InvalidArgumentError("descending needs as many values as keys")
        df, made = self._built(exprs)
        order, names = [], []
        for k, ((_, c), d) in enumerate(zip(made, down)):
            t = df.select(c.alias("x")).schema[0].dataType
            compare = custom_comp.get(keys[k] if isinstance(keys[k], str) else None) if isinstance(custom_comp, dict) else custom_comp
            if compare is None and isinstance(t, (T.FloatType, T.DoubleType)):
                c = F.when(~F.isnan(c), c)
            if compare is None and isinstance(t, T.BooleanType):
                c = c.cast("int")
            names.append(f"__ord_key{k}")
            df = df.withColumn(f"__ord_key{k}", c)
            if compare is not None:
                df = _ranked(df, f"__ord_key{k}", compare)
            key = F.col(f"__ord_key{k}")
            order.append((key.desc_nulls_last() if d else key.asc_nulls_last()) if nulls_last else (key.desc_nulls_first() if d else key.asc_nulls_first()))
        out = Frame(df.select(*self.columns, *self._order, *names))
        out._sort = (order, names)
        return out._reordered(order, names, self._order)

    def _reordered(self, order, names, old) -> Frame:
        """A frame whose order is the given one. It stays a plan: order columns are made ascending where their type allows."""
        made = []
        for key, name in zip(order, names):
            c = F.col(name)
            text = key._jc.toString()
            t = self._df.schema[name].dataType
            down, last = "DESC" in text, "NULLS LAST" in text
            made.append(F.when(c.isNull(), F.lit(1 if last else -1)).otherwise(F.lit(0)))
            if down and isinstance(t, T.NumericType):
                made.append(-c.cast("decimal(38,0)") if isinstance(t, T.LongType) else -c)
            elif down and isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                made.append(-F.unix_micros(c.cast("timestamp")))
            elif down:  # text: complemented bytes, ended by a byte above all
                made.append(F.concat(F.translate(F.hex(F.encode(c.cast("string"), "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
            else:
                made.append(c)
        columns = [c.alias(f"{ORD}{k}") for k, c in enumerate(made)] + [F.col(c).alias(f"{ORD}{k + len(made)}") for k, c in enumerate(old)]
        return Frame(self._df.select(*self.columns, *columns))

    def reverse(self) -> Frame:
        order = [F.col(c).desc_nulls_first() for c in self._order]
        self._need_order()
        frame = Frame(self._df)
        names = [f"__ord_key{k}" for k in range(len(self._order))]
        df = self._df.withColumns({n: F.col(c) for n, c in zip(names, self._order)})
        frame = Frame(df)
        return frame._reordered([F.col(n).desc_nulls_first() for n in names], names, []) if order else frame

    def limit(self, n: int, offset: int = 0, from_: str = "start") -> Frame:
        if from_ not in ("start", "end"):
            raise InvalidArgumentError(f"from can't be {from_}")
        n, offset = max(0, n), max(0, offset)
        keys = self._need_order() if from_ == "end" or self._order else []
        if from_ == "end":
            keys = [F.col(c).desc_nulls_first() for c in self._order]
        df = self._df.orderBy(*keys) if keys else self._df
        return self._with((df.offset(offset) if offset else df).limit(n))

    def head(self, n: int = 10) -> Frame:
        return self.limit(n)

    def tail(self, n: int = 10) -> Frame:
        return self.limit(n, from_="end")

    def slice(self, start: int, end: int | None = None) -> Frame:
        if start >= 0 and end is None:
            return self.limit((1 << 31) - 1 - start, start)
        if start >= 0 and end >= 0:
            return self.limit(end - start, start)
        n = self.height
        s = max(0, n + start) if start < 0 else start
        e = n if end is None else max(0, n + end) if end < 0 else end
        return self.limit(e - s, s)

    def unique(self, columns: str | list[str] | None = None) -> Frame:
        """The first row of each key; key columns come first."""
        keys = [columns] if isinstance(columns, str) else columns or self.columns
        rest = [c for c in self.columns if c not in keys]
        if not self._order:
            return self._with(self._df.dropDuplicates(keys).select(*keys, *rest))
        row = F.struct(*self._order)
        value = F.min(F.struct(row.alias("o"), *[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(rest)])) if all(not isinstance(self.schema[c], (T.MapType, T.VariantType)) for c in rest) else F.min_by(F.struct(row.alias("o"), *[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(rest)]), row)
        got = self._df.groupBy(*keys).agg(value.alias("__ord_first"))
        return self._with(got.select(*keys, *[F.col(f"__ord_first.v{k}").alias(c) for k, c in enumerate(rest)], *[F.col(f"__ord_first.o.{c}").alias(c) for c in self._order]))

    # grouping and windows

    def group_by(self, keys: str | list[str]):
        from .grouped import GroupedData

        return GroupedData(self, [keys] if isinstance(keys, str) else list(keys))

    def group_by_dynamic(self, index_column: Any, **options):
        from .dynamic import group_by_dynamic

        return group_by_dynamic(self, index_column, **options)

    # joins

    def join(self, other: Frame, on=None, left_on=None, right_on=None, how: str = "inner", join_nulls: bool = False, coalesce: bool = True, suffixes=("", "_right"), maintain_order: str | bool = "left_right") -> Frame:
        from .joins import join

        return join(self, other, on, left_on, right_on, how, join_nulls, coalesce, suffixes, maintain_order)

    def join_asof(self, other: Frame, **options) -> Frame:
        from .joins import join_asof

        return join_asof(self, other, **options)

    def join_where(self, other: Frame, *predicates, how: str = "inner", suffixes=("", "_right")) -> Frame:
        from .joins import join_where

        return join_where(self, other, predicates, how, suffixes)

    # reshaping

    def concat(self, items, how: str = "vertical", strict: bool = True) -> Frame:
        from .reshape import concat

        return concat([self, *(items if isinstance(items, (list, tuple)) else [items])], how, strict)

    def explode(self, columns, empty_as_null: bool = True, keep_nulls: bool = True) -> Frame:
        from .reshape import explode

        return explode(self, columns, empty_as_null, keep_nulls)

    def pivot(self, index, columns: str, values: str, names: list | None = None) -> Frame:
        from .reshape import pivot

        return pivot(self, index, columns, values, names)

    def unpivot(self, id_vars, value_vars=None, variable_name: str = "variable", value_name: str = "value") -> Frame:
        from .reshape import unpivot

        return unpivot(self, id_vars, value_vars, variable_name, value_name)

    def transpose(self, include_header: bool = False, header_name: str = "column", column_names=None) -> Frame:
        from .reshape import transpose

        return transpose(self, include_header, header_name, column_names)

    def unstack(self, columns, step: int, how: str = "vertical", fill_value=None) -> Frame:
        from .reshape import unstack

        return unstack(self, columns, step, how, fill_value)

    # results

    def item(self, row: int | None = None, column: int | str | None = None) -> Any:
        if row is None and column is None:
            got = self.limit(2)._df.select(*self.columns).collect()
            if len(got) != 1 or self.width != 1:
                raise ShapeError("item without a position needs one row and one column")
            return got[0][0]
        name = self.columns[column or 0] if not isinstance(column, str) else column
        if name not in self.columns:
            raise ColumnNotFoundError(f"no column {name}")
        got = self.limit(1, row or 0).df.collect() if (row or 0) >= 0 else self.limit(1, -row - 1, "end").df.collect()
        if not got:
            raise ShapeError(f"no row {row}")
        return got[0][name]

    def iter_rows(self, named: bool = False) -> Iterator:
        for r in self.ordered.toLocalIterator():
            yield r.asDict(True) if named else list(r)

    def iter_columns(self) -> Iterator[list]:
        for c in self.columns:
            yield self.to_array(c)

    def to_array(self, expr: str | Expr) -> list:
        made = self.select(expr)
        return [r[0] for r in made.ordered.collect()]

    def to_dicts(self) -> list[dict]:
        return [r.asDict(True) for r in self.ordered.collect()]

    def to_dict(self) -> dict[str, list]:
        rows = self.ordered.collect()
        return {c: [r[c] for r in rows] for c in self.columns}

    def equals(self, other: Frame, nulls_equal: bool = True) -> bool:
        """The same columns in order, of the same types, with the same rows in order."""
        if self.columns != other.columns or [t.simpleString() for t in self.dtypes] != [t.simpleString() for t in other.dtypes]:
            return False
        if not nulls_equal:
            missing = F.lit(False)
            for c, t in self.schema.items():
                missing = missing | F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if isinstance(t, (T.FloatType, T.DoubleType)) else F.lit(False))
            if not self._df.filter(missing).isEmpty():
                return False
        a, b = (f.with_row_index("__ord_row")._df.select("__ord_row", *self.columns) for f in (self, other))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def write_csv(self, path: str | None = None, **options) -> str | None:
        from ..sources.csv import write_csv

        return write_csv(self, path, **options)

    def write_json(self, path: str | None = None, format: str = "json", **options) -> str | None:
        from ..sources.json import write_json

        return write_json(self, path, format, **options)


def _ranked(df: DataFrame, name: str, compare) -> DataFrame:
    """df with the values of a column replaced by their ranks under a comparing function; equal ones share a rank."""
    values = [r[0] for r in df.select(name).distinct().limit(COMPARED + 1).collect()]
    if len(values) > COMPARED:
        raise ComputeError(f"custom_comp orders at most {COMPARED} distinct values; sort by a key expression instead")
    ranks, rank = [], 0
    values.sort(key=functools.cmp_to_key(compare))
    for k, v in enumerate(values):
        rank += k > 0 and compare(values[k - 1], v) != 0
        ranks.append((v, rank))
    types = T.StructType([T.StructField("__ord_value", df.schema[name].dataType), T.StructField("__ord_rank", T.LongType())])
    made = df.join(df.sparkSession.createDataFrame(ranks, types), F.col(name).eqNullSafe(F.col("__ord_value")), "left")
    return made.withColumn(name, F.col("__ord_rank")).drop("__ord_value", "__ord_rank")


def exprs_without_explode(exprs: list[Expr]) -> list[Expr]:
    return [e._copy(e._build, explode_options=None) for e in exprs]
