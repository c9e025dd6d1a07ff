"""Column expressions. An `Expr` is compiled late, by `build(ctx)`, once the frame's schema, order and grouping are known.

Aggregates skip null and NaN. In a projection an aggregate without `over` is one value for the whole frame: it is computed
by a plan of its own and joined back as a single broadcast row, so no window gathers the frame in one task. With `over` it
is a grouped aggregation, partial before its shuffle, joined back by its keys, so no window gathers a hot group in one task.
Windows over row order use the frame's order columns; without `over` they sort the whole frame in one partition.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, ComputeError, InvalidArgumentError
from ..types import DType, TypeClass, clean_number, coerce, is_float, is_time


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])|(?<=[A-Z])([A-Z])(?=[a-z])", r"_\1\2", name).lower()


class CamelNames:
    """Every method answers to its camelCase name, too."""

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        other = snake(name)
        for form in (other, other + "_"):
            if form != name and hasattr(type(self), form):
                return getattr(self, form)
        raise AttributeError(name)


class Context:
    """What an expression is compiled in: the frame's columns and order, and whether it is grouped."""

    def __init__(self, df, order: list[str], mode: str = "row", keys: list[str] | None = None):
        self.df, self.order, self.mode, self.keys = df, order, mode, keys
        self.partition: list[Column] | None = None
        self.totals: list[tuple[str, Column]] = []
        self.groups: dict[str, tuple[list[Column], list[tuple[str, Column]]]] = {}
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.element: Column | None = None

    def dtype(self, c: Column) -> T.DataType:
        if self.element is not None:
            return T.DoubleType()
        return self.joined(self.df).select(c.alias("x")).schema[0].dataType

    def joined(self, df):
        """df with the aggregates that the expressions built so far need beside its rows."""
        out = df
        if self.totals:
            out = out.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in self.totals])))
        base = out
        for g, (keys, made) in enumerate(self.groups.values()):
            names = [f"__ord_group{g}_key{k}" for k in range(len(keys))]
            source = out if "__ord_group" in str([*keys, *made]) else base
            side = source.groupBy(*[c.alias(n) for c, n in zip(keys, names)]).agg(*[c.alias(n) for n, c in made])
            same = F.lit(True)
            for c, n in zip(keys, names):
                same = same & c.eqNullSafe(F.col(n))
            out = out.join(side, same).drop(*names)
        return out

    def num(self, c: Column) -> Column:
        """c as aggregates see it: NaN is null, booleans are 1 and 0, times milliseconds, text a number."""
        t = self.dtype(c)
        if is_float(t):
            return F.when(~F.isnan(c), c)
        if isinstance(t, T.BooleanType):
            return c.cast("int")
        if is_time(t):
            return F.unix_millis(c.cast("timestamp"))
        if isinstance(t, T.StringType):
            n = clean_number(c)
            return F.when(~F.isnan(n), n)
        return c

    def comparable(self, c: Column) -> Column:
        return F.when(~F.isnan(c), c) if is_float(self.dtype(c)) else c

    def ord(self) -> Column:
        if not self.order:
            raise InvalidArgumentError("this operation needs row order: give the frame order columns")
        return F.struct(*[F.col(c) for c in self.order])

    def window(self, reverse: bool = False):
        return Window.partitionBy(*(self.partition or [])).orderBy(*[F.col(c).desc_nulls_first() if reverse else F.col(c).asc_nulls_last() for c in self.order])

    def running(self, reverse: bool = False):
        """All rows up to this one, or from it on: either is a growing frame, which takes one step for each row."""
        return self.window(reverse).rowsBetween(Window.unboundedPreceding, 0)

    def aggregate(self, c: Column) -> Column:
        """An aggregate where it stands: as it is in groups, over its partition, or as the whole frame's value."""
        if self.mode == "group":
            return c
        if self.partition is not None:
            made = self.groups.setdefault(str(self.partition), (self.partition, []))[1]
            name = f"__ord_group{list(self.groups).index(str(self.partition))}_{len(made)}"
            made.append((name, c))
            return F.col(name)
        name = f"__ord_total{len(self.totals)}"
        self.totals.append((name, c))
        return F.col(name)


Build = Callable[[Context], Column]


def to_expr(value: Any, names: bool = False) -> Expr:
    """An expression of a literal; of a column's name, if names, where the frame has that column."""
    if isinstance(value, Expr):
        return value
    if names and isinstance(value, str):
        return Expr(lambda ctx: F.col(f"`{value}`") if value in ctx.types else F.lit(value), value)
    return Expr(lambda ctx: literal(value), "literal", literal=True)


def literal(value: Any) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    return F.lit(value)


class Expr(CamelNames):
    def __init__(self, build: Build, name: str, *, agg: bool = False, literal: bool = False, selector=None, over: bool = False, unnest: bool = False):
        self._build, self.name = build, name
        self.is_agg = self.has_agg = agg
        self.is_literal, self.is_over, self.is_unnest = literal, over, unnest
        self._selector = selector
        self.explode_options = None
        self.parts = None

    def build(self, ctx: Context) -> Column:
        return self._build(ctx)

    # expansion

    def expand(self, df) -> list[Expr]:
        """One expression for each column that the selector names."""
        if self._selector is None:
            return [self]
        return [self._replicate(name) for name in self._selector(df)]

    def _replicate(self, name: str) -> Expr:
        out = self._rebuilt(name)
        out._selector = None
        return out

    def _rebuilt(self, name: str) -> Expr:
        def build(ctx, inner=self._build):
            ctx.current, held = name, getattr(ctx, "current", None)
            try:
                return inner(ctx)
            finally:
                ctx.current = held

        out = self._copy(build)
        out.name = name if self.name == "*" else self.name
        return out

    def _copy(self, build: Build, **changes) -> Expr:
        out = object.__new__(type(self))
        out.__dict__ = dict(self.__dict__) | {"_build": build, "parts": None} | changes
        return out

    # derivation

    def _map(self, f: Callable[[Column, Context], Column], **changes) -> Expr:
        return self._copy(lambda ctx: f(self.build(ctx), ctx), is_literal=False, **changes)

    def _binary(self, other: Any, f: Callable[[Column, Column, Context], Column], names: bool = False, op: str | None = None) -> Expr:
        o = to_expr(other, names)
        # what a theta join looks at: the operator and its sides, lost by whatever is derived from them
        out = self._copy(lambda ctx: f(self.build(ctx), o.build(ctx), ctx), parts=op and (op, self, o))
        out.is_agg = (self.is_agg or o.is_agg) and (self.is_agg or self.is_literal) and (o.is_agg or o.is_literal)
        out.has_agg = self.has_agg or o.has_agg
        out.is_literal = self.is_literal and o.is_literal
        return out

    def _agg(self, f: Callable[[Column, Context], Column]) -> Expr:
        def build(ctx):
            held = ctx.mode, ctx.partition
            ctx.mode, ctx.partition = "group", None
            try:
                made = f(self.build(ctx), ctx)
            finally:
                ctx.mode, ctx.partition = held
            return ctx.aggregate(made)

        return self._copy(build, is_agg=True, has_agg=True, is_literal=False)

    def _window(self, f: Callable[[Column, Context], Column]) -> Expr:
        return self._copy(lambda ctx: f(self.build(ctx), ctx), is_literal=False, is_over=True)

    # root

    def alias(self, name: str) -> Expr:
        return self._copy(self._build, name=name)

    def cast(self, dtype: DType, strict: bool = False) -> Expr:
        return self._map(lambda c, ctx: coerce(c, ctx.dtype(c), dtype, strict))

    def debug(self, label: str = "") -> Expr:
        print(f"{label}{': ' if label else ''}{self.name}")
        return self

    def evaluate(self, frame) -> list:
        """The expression's values over a frame, in row order."""
        return frame.to_array(self)

    def over(self, *columns) -> Expr:
        keys = [c for x in columns for c in (x if isinstance(x, (list, tuple)) else [x])]

        def build(ctx):
            held = ctx.partition
            ctx.partition = [to_expr(k, True).build(ctx) for k in keys]
            try:
                return self._build(ctx)
            finally:
                ctx.partition = held

        return self._copy(build, is_agg=False, has_agg=False, is_over=True)

    # arithmetic

    def add(self, other) -> Expr:
        def f(a, b, ctx):
            ta, tb = ctx.dtype(a), ctx.dtype(b)
            if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
                return F.concat(a.cast("string"), b.cast("string"))
            return _shift_time(a, b, 1) if is_time(ta) else _shift_time(b, a, 1) if is_time(tb) else a + b

        return self._binary(other, f)

    def sub(self, other) -> Expr:
        def f(a, b, ctx):
            ta, tb = ctx.dtype(a), ctx.dtype(b)
            if is_time(ta) and is_time(tb):
                return F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))
            return _shift_time(a, b, -1) if is_time(ta) else a - b

        return self._binary(other, f)

    def mul(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: a * b)

    def div(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: F.try_divide(a.cast("double"), b.cast("double")))

    def floordiv(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: F.floor(F.try_divide(a.cast("double"), b.cast("double"))))

    def mod(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: F.try_mod(a, b))

    def pow(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: F.pow(a, b))

    def hypot(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: F.hypot(a, b))

    def arctan2(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: F.atan2(a, b))

    def copysign(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: F.abs(a) * F.when(b >= 0, 1).when(b < 0, -1))

    def abs(self) -> Expr:
        return self._map(lambda c, _: F.abs(c))

    def negate(self) -> Expr:
        return self._map(lambda c, _: -c)

    def sign(self) -> Expr:
        return self._map(lambda c, _: F.signum(c))

    def ceil(self) -> Expr:
        return self._map(lambda c, _: F.ceil(c))

    def floor(self) -> Expr:
        return self._map(lambda c, _: F.floor(c))

    def trunc(self) -> Expr:
        return self._map(lambda c, _: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)))

    def round(self, decimals: int = 0) -> Expr:
        """Halves go towards positive infinity."""
        return self._map(lambda c, _: F.when(c >= 0, F.round(c.cast("double"), decimals)).otherwise(_half_up(c.cast("double"), decimals)))

    def round_sig_figs(self, figures: int) -> Expr:
        def f(c, _):
            x = c.cast("double")
            scale = F.pow(F.lit(10.0), F.lit(figures - 1) - F.floor(F.log10(F.abs(x))))
            return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)

        return self._map(f)

    def clip(self, lower=None, upper=None) -> Expr:
        low, high = to_expr(lower, True), to_expr(upper, True)

        def f(c, ctx):
            out = F.greatest(c, low.build(ctx)) if lower is not None else c
            out = F.least(out, high.build(ctx)) if upper is not None else out
            return F.when(c.isNotNull(), out)

        return self._map(f)

    def sqrt(self) -> Expr:
        return self._map(lambda c, _: F.when(c >= 0, F.sqrt(c)))

    def cbrt(self) -> Expr:
        return self._map(lambda c, _: F.cbrt(c))

    def exp(self) -> Expr:
        return self._map(lambda c, _: F.exp(c))

    def expm1(self) -> Expr:
        return self._map(lambda c, _: F.expm1(c))

    def log(self, base: float | None = None) -> Expr:
        return self._map(lambda c, _: F.when(c > 0, F.ln(c) if base is None else F.log(float(base), c)))

    def log1p(self) -> Expr:
        return self._map(lambda c, _: F.when(c > -1, F.log1p(c)))

    def sin(self) -> Expr:
        return self._map(lambda c, _: F.sin(c))

    def cos(self) -> Expr:
        return self._map(lambda c, _: F.cos(c))

    def tan(self) -> Expr:
        return self._map(lambda c, _: F.tan(c))

    def cot(self) -> Expr:
        return self._map(lambda c, _: F.when(F.tan(c) != 0, F.try_divide(F.lit(1.0), F.tan(c))))

    def sinh(self) -> Expr:
        return self._map(lambda c, _: F.sinh(c))

    def cosh(self) -> Expr:
        return self._map(lambda c, _: F.cosh(c))

    def tanh(self) -> Expr:
        return self._map(lambda c, _: F.tanh(c))

    def arcsin(self) -> Expr:
        return self._map(lambda c, _: F.when(c.between(-1, 1), F.asin(c)))

    def arccos(self) -> Expr:
        return self._map(lambda c, _: F.when(c.between(-1, 1), F.acos(c)))

    def arctan(self) -> Expr:
        return self._map(lambda c, _: F.atan(c))

    def arcsinh(self) -> Expr:
        return self._map(lambda c, _: F.asinh(c))

    def arccosh(self) -> Expr:
        return self._map(lambda c, _: F.when(c >= 1, F.acosh(c)))

    def arctanh(self) -> Expr:
        return self._map(lambda c, _: F.when(F.abs(c) < 1, F.atanh(c)))

    def degrees(self) -> Expr:
        return self._map(lambda c, _: F.degrees(c))

    def radians(self) -> Expr:
        return self._map(lambda c, _: F.radians(c))

    def rand(self, seed: int | None = None, min: float = 0, max: float = 1, integer: bool = False) -> Expr:
        def f(_, __):
            r = F.rand(seed) if seed is not None else F.rand()
            return F.floor(r * (max - min + 1) + min) if integer else r * (max - min) + min

        return self._map(f)

    # comparison

    def eq(self, other) -> Expr:
        return self._binary(other, lambda a, b, ctx: _no_nan(a, b, ctx, a == b, False), op="==")

    def ne(self, other) -> Expr:
        return self._binary(other, lambda a, b, ctx: _no_nan(a, b, ctx, a != b, True))

    def gt(self, other) -> Expr:
        return self._binary(other, lambda a, b, ctx: _no_nan(a, b, ctx, a > b, False), op=">")

    def ge(self, other) -> Expr:
        return self._binary(other, lambda a, b, ctx: _no_nan(a, b, ctx, a >= b, False), op=">=")

    def lt(self, other) -> Expr:
        return self._binary(other, lambda a, b, ctx: _no_nan(a, b, ctx, a < b, False), op="<")

    def le(self, other) -> Expr:
        return self._binary(other, lambda a, b, ctx: _no_nan(a, b, ctx, a <= b, False), op="<=")

    def eq_missing(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: a.eqNullSafe(b), op="==")

    def ne_missing(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: ~a.eqNullSafe(b))

    def between(self, lower, upper, closed: str = "both") -> Expr:
        if closed not in ("both", "left", "right", "none"):
            raise InvalidArgumentError(f"closed can't be {closed}")
        low, high = to_expr(lower, True), to_expr(upper, True)

        def f(c, ctx):
            a, b = low.build(ctx), high.build(ctx)
            return (c >= a if closed in ("both", "left") else c > a) & (c <= b if closed in ("both", "right") else c < b)

        return self._map(f)

    def is_close(self, other, abs_tol: float = 1e-8, rel_tol: float = 1e-8, nans_equal: bool = False) -> Expr:
        def f(a, b, ctx):
            a, b = a.cast("double"), b.cast("double")
            near = (a == b) | (F.abs(a - b) <= F.greatest(rel_tol * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol)))
            return F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b) if nans_equal else F.lit(False)).otherwise(near)

        return self._binary(other, f)

    def is_in(self, values) -> Expr:
        if isinstance(values, Expr):
            return self._binary(values, lambda a, b, _: F.when(a.isNotNull(), F.exists(b, lambda x: x.eqNullSafe(a))))
        have = [v for v in values if v is not None]
        return self._map(lambda c, _: c.isin(have) if have else F.when(c.isNotNull(), F.lit(False)))

    def not_in(self, values) -> Expr:
        return self.is_in(values).not_()

    def and_(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: a & b, op="&")

    def or_(self, other) -> Expr:
        return self._binary(other, lambda a, b, _: a | b)

    def xor(self, other) -> Expr:
        return self._binary(other, lambda a, b, ctx: truthy(a, ctx) != truthy(b, ctx))

    def not_(self) -> Expr:
        return self._map(lambda c, ctx: F.when(c.isNotNull(), ~truthy(c, ctx)))

    def is_null(self) -> Expr:
        return self._map(lambda c, _: c.isNull())

    def is_not_null(self) -> Expr:
        return self._map(lambda c, _: c.isNotNull())

    def is_nan(self) -> Expr:
        return self._map(lambda c, _: F.when(c.isNotNull(), F.isnan(c.cast("double"))))

    def is_not_nan(self) -> Expr:
        return self._map(lambda c, _: F.when(c.isNotNull(), ~F.isnan(c.cast("double"))))

    def is_finite(self) -> Expr:
        return self._map(lambda c, _: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))

    def is_infinite(self) -> Expr:
        return self._map(lambda c, _: F.abs(c.cast("double")) == float("inf"))

    # manipulation

    def fill_null(self, value=None, strategy: str | None = None, limit: int | None = None) -> Expr:
        if strategy is None:
            return self._binary(value, lambda a, b, _: F.coalesce(a, b))
        if strategy in ("zero", "one"):
            return self.fill_null(0 if strategy == "zero" else 1)
        if strategy in ("min", "max", "mean"):
            return self._binary(getattr(self, strategy)(), lambda a, b, _: F.coalesce(a, b))
        if strategy == "forward":
            return self._window(lambda c, ctx: F.last(c, True).over(ctx.window().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)))
        if strategy == "backward":
            return self._window(lambda c, ctx: F.last(c, True).over(ctx.running(True)) if limit is None else F.first(c, True).over(ctx.window().rowsBetween(0, limit)))
        raise InvalidArgumentError(f"unknown strategy {strategy}")

    def filter(self, predicate: Expr) -> Expr:
        """The value where the predicate holds, else null."""
        return self._binary(predicate, lambda c, p, ctx: F.when(truthy(p, ctx), c))

    def reverse(self) -> Expr:
        """Values in reverse row order."""

        def f(c, ctx):
            w = Window.partitionBy(*(ctx.partition or []))
            rows = F.array_sort(F.collect_list(F.struct(ctx.ord().alias("o"), c.alias("v"))).over(w))
            n = F.row_number().over(ctx.window())
            return let(rows, lambda r: F.get(r, F.size(r) - n))["v"]

        return self._window(f)

    # frequency

    def _times(self, c, ctx) -> Column:
        return F.count(F.lit(1)).over(Window.partitionBy(*(ctx.partition or []), c))

    def is_duplicated(self) -> Expr:
        return self._window(lambda c, ctx: self._times(c, ctx) > 1)

    def is_unique(self) -> Expr:
        return self._window(lambda c, ctx: self._times(c, ctx) == 1)

    def is_n_distinct(self, index: int, null_on_oob: bool = True) -> Expr:
        """Equals the index-th distinct value in order of first appearance (negative: from the end)."""

        def f(c, ctx):
            p = ctx.partition or []
            first = F.min(ctx.ord()).over(Window.partitionBy(*p, c))
            if index >= 0:
                return F.dense_rank().over(Window.partitionBy(*p).orderBy(first)) == index + 1
            return F.dense_rank().over(Window.partitionBy(*p).orderBy(first.desc())) == -index

        return self._window(f)

    # aggregates

    def sum(self) -> Expr:
        return self._agg(lambda c, ctx: F.sum(ctx.num(c)))

    def mean(self) -> Expr:
        return self._agg(lambda c, ctx: F.avg(ctx.num(c)))

    avg = mean

    def min(self) -> Expr:
        return self._agg(lambda c, ctx: F.min(ctx.comparable(c)))

    def max(self) -> Expr:
        return self._agg(lambda c, ctx: F.max(ctx.comparable(c)))

    def nan_max(self) -> Expr:
        return self._agg(lambda c, ctx: F.max(c))

    def nan_min(self) -> Expr:
        return self._agg(lambda c, ctx: F.when(F.bool_or(F.isnan(c.cast("double"))), F.lit(float("nan"))).otherwise(F.min(c)))

    def count(self, include_nulls: bool = False) -> Expr:
        """Non-null (and not NaN) values; of text, too."""
        return self._agg(lambda c, ctx: F.count(F.lit(1)) if include_nulls else F.count(ctx.comparable(c)))

    def null_count(self) -> Expr:
        return self._agg(lambda c, ctx: F.count(F.lit(1)) - F.count(ctx.comparable(c)))

    def n_unique(self, strict: bool = True) -> Expr:
        """Distinct values; null is one."""
        return self._agg(lambda c, ctx: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0)))

    def product(self) -> Expr:
        return self._agg(lambda c, ctx: F.product(ctx.num(c)))

    def variance(self) -> Expr:
        return self._agg(lambda c, ctx: F.coalesce(F.var_samp(ctx.num(c)), F.lit(0.0)))

    def std(self) -> Expr:
        return self._agg(lambda c, ctx: F.coalesce(F.stddev_samp(ctx.num(c)), F.lit(0.0)))

    def median(self) -> Expr:
        return self.quantile(0.5)

    def quantile(self, q: float) -> Expr:
        if not 0 <= q <= 1:
            raise ComputeError(f"quantile {q} is outside 0 to 1")
        return self._agg(lambda c, ctx: F.percentile(ctx.num(c), F.lit(float(q))))

    def mode(self) -> Expr:
        """All most frequent values, ascending."""

        def f(c, ctx):
            values = F.collect_list(ctx.comparable(c))
            return _modes(values)

        return self._agg(f)

    def skew(self, bias: bool = True) -> Expr:
        def f(c, ctx):
            x = ctx.num(c)
            n = F.count(x).cast("double")
            return F.skewness(x) if bias else F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))

        return self._agg(f)

    def kurtosis(self, fisher: bool = True, bias: bool = True) -> Expr:
        def f(c, ctx):
            x = ctx.num(c)
            n, k = F.count(x).cast("double"), F.kurtosis(x)
            if not bias:
                k = F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * k + 6), (n - 2) * (n - 3)))
            return k if fisher else k + 3

        return self._agg(f)

    def entropy(self, base: float | None = None, normalize: bool = True) -> Expr:
        """Of the frequencies of the values if normalize, else of the values as weights."""
        import math

        scale = math.log(base) if base else 1.0

        def f(c, ctx):
            if not normalize:
                x = ctx.num(c).cast("double")
                w = F.when(x > 0, x)
                total = F.sum(w)
                return F.abs(F.ln(total) - F.sum(w * F.ln(w)) / total) / scale
            weights = _counts(F.collect_list(ctx.comparable(c)))

            def of(w):
                return let(F.aggregate(w, F.lit(0.0), lambda a, v: a + v), lambda t: F.when(t > 0, F.abs(F.aggregate(w, F.lit(0.0), lambda a, v: a - v / t * F.ln(v / t)) / scale)))

            return let(weights, of)

        return self._agg(f)

    def first(self) -> Expr:
        return self._agg(lambda c, ctx: F.min_by(F.struct(c.alias("v")), ctx.ord())["v"])

    def last(self) -> Expr:
        return self._agg(lambda c, ctx: F.max_by(F.struct(c.alias("v")), ctx.ord())["v"])

    def implode(self) -> Expr:
        """The values, nulls too, in row order."""
        return self._agg(lambda c, ctx: F.transform(F.array_sort(F.collect_list(F.struct(ctx.ord().alias("o"), c.alias("v")))), lambda x: x["v"]))

    def _position(self, c, ctx, largest: bool) -> Column:
        rows = F.transform(F.array_sort(F.collect_list(F.struct(ctx.ord().alias("o"), ctx.comparable(c).alias("v")))), lambda x: x["v"])
        at = let(rows, lambda v: F.array_position(v, F.array_max(v) if largest else F.array_min(v)))
        return F.when(at > 0, at - 1)

    def arg_max(self) -> Expr:
        return self._agg(lambda c, ctx: self._position(c, ctx, True))

    def arg_min(self) -> Expr:
        return self._agg(lambda c, ctx: self._position(c, ctx, False))

    def _by(self, by, largest: bool) -> Expr:
        key = to_expr(by, True)

        def f(c, ctx):
            k = ctx.comparable(key.build(ctx))
            both = c.isNotNull() & k.isNotNull()
            rank = F.when(both, F.struct(k.alias("k"), ctx.ord().alias("o")))
            if not largest:
                return F.min_by(c, rank)
            return _first_of_max(c, k, ctx, both)  # of ties the first row counts

        return self._agg(f)

    def max_by(self, by) -> Expr:
        return self._by(by, True)

    def min_by(self, by) -> Expr:
        return self._by(by, False)

    def all(self) -> Expr:
        return self._agg(lambda c, ctx: F.coalesce(F.bool_and(F.coalesce(truthy(c, ctx), F.lit(False))), F.lit(True)))

    def any(self) -> Expr:
        return self._agg(lambda c, ctx: F.coalesce(F.bool_or(truthy(c, ctx)), F.lit(False)))

    def all_null(self) -> Expr:
        return self._agg(lambda c, ctx: F.count(c) == 0)

    def any_null(self) -> Expr:
        return self._agg(lambda c, ctx: F.count(F.lit(1)) > F.count(c))

    has_nulls = any_null

    def bitwise_and(self) -> Expr:
        return self._agg(lambda c, ctx: F.bit_and(ctx.num(c).cast("long")))

    def bitwise_or(self) -> Expr:
        return self._agg(lambda c, ctx: F.bit_or(ctx.num(c).cast("long")))

    def bitwise_xor(self) -> Expr:
        return self._agg(lambda c, ctx: F.bit_xor(ctx.num(c).cast("long")))

    def _pair(self, other, f) -> Expr:
        """f over the rows where both sides are numbers."""
        o = to_expr(other, True)

        def agg(c, ctx):
            x, y = ctx.num(c).cast("double"), ctx.num(o.build(ctx)).cast("double")
            both = x.isNotNull() & y.isNotNull()
            return f(F.when(both, x), F.when(both, y))

        return self._agg(agg)

    def dot(self, other) -> Expr:
        return self._pair(other, lambda x, y: F.sum(x * y))

    def cov(self, other) -> Expr:
        return self._pair(other, lambda x, y: F.covar_samp(x, y))

    def corr(self, other) -> Expr:
        return self._pair(other, _pearson)

    def spearman_corr(self, other) -> Expr:
        """Pearson's correlation of average ranks over complete pairs; a group's values are ranked together."""
        o = to_expr(other, True)

        def agg(c, ctx):
            x, y = ctx.num(c).cast("double"), ctx.num(o.build(ctx)).cast("double")
            pairs = F.collect_list(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))
            return _spearman(pairs)

        return self._agg(agg)

    def w_avg(self, weights) -> Expr:
        return self._pair(weights, lambda x, w: F.when(F.abs(F.sum(w)) >= 1e-12, F.try_divide(F.sum(x * w), F.sum(w))))

    # windows over row order

    def _running(self, f, reverse: bool) -> Expr:
        return self._window(lambda c, ctx: f(ctx.num(c), ctx.running(reverse)))

    def cum_sum(self, reverse: bool = False) -> Expr:
        return self._running(lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)), reverse)

    def cum_min(self, reverse: bool = False) -> Expr:
        return self._running(lambda c, w: F.min(c).over(w), reverse)

    def cum_max(self, reverse: bool = False) -> Expr:
        return self._running(lambda c, w: F.max(c).over(w), reverse)

    def cum_prod(self, reverse: bool = False) -> Expr:
        return self._running(lambda c, w: F.product(c).over(w), reverse)

    def cum_count(self, reverse: bool = False) -> Expr:
        return self._window(lambda c, ctx: F.count(c).over(ctx.running(reverse)))

    def _rolling(self, size: int, f) -> Expr:
        if not isinstance(size, int) or size < 1:
            raise InvalidArgumentError(f"a window of {size} rows")
        return self._window(lambda c, ctx: f(ctx.num(c), ctx.window().rowsBetween(1 - size, 0)))

    def rolling_sum(self, size: int) -> Expr:
        return self._rolling(size, lambda c, w: F.sum(c).over(w))

    def rolling_mean(self, size: int) -> Expr:
        return self._rolling(size, lambda c, w: F.avg(c).over(w))

    def rolling_min(self, size: int) -> Expr:
        return self._rolling(size, lambda c, w: F.min(c).over(w))

    def rolling_max(self, size: int) -> Expr:
        return self._rolling(size, lambda c, w: F.max(c).over(w))

    def rolling_std(self, size: int) -> Expr:
        return self._rolling(size, lambda c, w: F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)))

    def rolling_median(self, size: int) -> Expr:
        return self.rolling_quantile(0.5, size)

    def rolling_quantile(self, quantile: float, size: int) -> Expr:
        if not 0 <= quantile <= 1:
            raise ComputeError(f"quantile {quantile} is outside 0 to 1")
        return self._rolling(size, lambda c, w: F.percentile(c, F.lit(float(quantile))).over(w))

    def rolling_rank(self, size: int) -> Expr:
        return self._rolling(size, lambda c, w: F.when(c.isNotNull(), F.size(F.filter(F.collect_list(c).over(w), lambda x: x < c)) + 1))

    def rolling(self, size: int, function: Callable[[list], Any], dtype: DType | None = None) -> Expr:
        """function of each window's values, nulls too; a Python function, so the slow way."""
        call = F.udf(lambda values: function([v["v"] for v in values]), dtype.spark if dtype else "double")
        return self._window(lambda c, ctx: call(F.collect_list(F.struct(c.alias("v"))).over(ctx.window().rowsBetween(1 - size, 0))))

    def _rank(self, f) -> Expr:
        def build(c, ctx):
            x = ctx.comparable(c)
            return F.when(x.isNotNull(), f().over(Window.partitionBy(*(ctx.partition or [])).orderBy(x.asc_nulls_last())))

        return self._window(build)

    def rank(self, dense: bool = False) -> Expr:
        return self._rank(F.dense_rank if dense else F.rank)

    def dense_rank(self) -> Expr:
        return self._rank(F.dense_rank)

    def row_number(self) -> Expr:
        return self._window(lambda c, ctx: F.row_number().over(ctx.window())).alias("row_number")

    def lag(self, offset: int = 1, fill_value=None) -> Expr:
        return self._window(lambda c, ctx: F.lag(c, offset, fill_value).over(ctx.window()))

    def lead(self, offset: int = 1, fill_value=None) -> Expr:
        return self._window(lambda c, ctx: F.lead(c, offset, fill_value).over(ctx.window()))

    shift = lag

    # namespaces

    @property
    def str(self):
        from .strings import StrNamespace

        return StrNamespace(self)

    @property
    def dt(self):
        from .temporal import DtNamespace

        return DtNamespace(self)

    @property
    def arr(self):
        from .arrays import ArrNamespace

        return ArrNamespace(self)

    @property
    def struct(self):
        from .structs import StructNamespace

        return StructNamespace(self)

    # operators

    __add__, __sub__, __mul__, __truediv__, __floordiv__, __mod__, __pow__ = add, sub, mul, div, floordiv, mod, pow
    __eq__, __ne__, __gt__, __ge__, __lt__, __le__ = eq, ne, gt, ge, lt, le
    __and__, __or__, __xor__, __invert__, __neg__, __abs__ = and_, or_, xor, not_, negate, abs
    __hash__ = object.__hash__

    def __radd__(self, other):
        return to_expr(other).add(self).alias(self.name)

    def __rsub__(self, other):
        return to_expr(other).sub(self).alias(self.name)

    def __rmul__(self, other):
        return to_expr(other).mul(self).alias(self.name)

    def __rtruediv__(self, other):
        return to_expr(other).div(self).alias(self.name)


def truthy(c: Column, ctx: Context) -> Column:
    t = ctx.dtype(c)
    if isinstance(t, T.BooleanType):
        return c
    if isinstance(t, T.StringType):
        return F.length(c) > 0
    if is_float(t):
        return (c != 0) & ~F.isnan(c)
    return c != 0 if isinstance(t, T.NumericType) else c.isNotNull()


def _no_nan(a: Column, b: Column, ctx: Context, result: Column, otherwise: bool) -> Column:
    """Comparisons with NaN are false (ne: true)."""
    for x in (a, b):
        if is_float(ctx.dtype(x)) and ctx.element is None:
            result = F.when(F.isnan(x) & a.isNotNull() & b.isNotNull(), F.lit(otherwise)).otherwise(result)
    return result


def _shift_time(c: Column, ms: Column, sign: int) -> Column:
    return F.timestamp_micros((F.unix_micros(c.cast("timestamp")) + sign * ms.cast("double") * 1000).cast("long"))


def _half_up(x: Column, decimals: int) -> Column:
    """Negative halves go up: the value's decimal form decides, not its binary one."""
    scale = 10**decimals
    exact = x.try_cast(f"decimal(38,{min(18, decimals + 6)})")
    return F.coalesce((F.floor(exact * scale + F.lit(0.5).cast("decimal(2,1)")) / scale).cast("double"), x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside lambda functions Catalyst would compute it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _heads(ordered: Column) -> Column:
    """1-based positions at which a sorted list's runs of equal values begin, and one past the end."""
    n = F.size(ordered)
    return F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i == 1) | (i == n + 1) | ~F.get(ordered, i - 1).eqNullSafe(F.get(ordered, i - 2)))


def _counts(values: Column) -> Column:
    """Frequencies of a list's values."""

    def runs(heads):
        return F.zip_with(F.slice(heads, 1, F.size(heads) - 1), F.slice(heads, 2, F.size(heads) - 1), lambda a, b: (b - a).cast("double"))

    return let(F.array_sort(values), lambda o: F.when(F.size(o) > 0, let(_heads(o), runs)).otherwise(F.array().cast("array<double>")))


def _modes(values: Column) -> Column:
    """All most frequent values of a list, ascending."""

    def of(o):
        def runs(heads):
            return F.zip_with(F.slice(heads, 1, F.size(heads) - 1), F.slice(heads, 2, F.size(heads) - 1), lambda a, b: F.struct((b - a).alias("n"), F.get(o, a - 1).alias("v")))

        def top(r):
            return let(F.array_max(F.transform(r, lambda x: x["n"])), lambda m: F.transform(F.filter(r, lambda x: x["n"] == m), lambda x: x["v"]))

        return F.when(F.size(o) > 0, let(let(_heads(o), runs), top)).otherwise(F.slice(o, 1, 0))

    return let(F.array_sort(values), of)


def _first_of_max(c: Column, k: Column, ctx: Context, both: Column) -> Column:
    rows = F.collect_list(F.when(both, F.struct(k.alias("k"), ctx.ord().alias("o"), c.alias("v"))))
    return F.reduce(rows, F.get(rows, 0), lambda a, b: F.when((b["k"] > a["k"]) | ((b["k"] == a["k"]) & (b["o"] < a["o"])), b).otherwise(a))["v"]


def _pearson(x: Column, y: Column) -> Column:
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))


def _spearman(pairs: Column) -> Column:
    def ranks(key, p):
        """Average ranks of the pairs' values, in the pairs' order."""

        def of(o):
            def spread(heads):
                runs = F.zip_with(F.slice(heads, 1, F.size(heads) - 1), F.slice(heads, 2, F.size(heads) - 1), lambda a, b: F.array_repeat((a + b - 1) / 2.0, (b - a).cast("int")))
                return F.transform(F.array_sort(F.zip_with(o, F.flatten(runs), lambda x, r: F.struct(x["i"].alias("i"), r.alias("r")))), lambda x: x["r"])

            return let(let(F.transform(o, lambda x: x["v"]), _heads), spread)

        return let(F.array_sort(F.transform(p, lambda x, i: F.struct(x[key].alias("v"), i.alias("i")))), of)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def of(p):
        mean = (F.size(p) + 1) / 2.0

        def corr(r):
            sxy = total(F.zip_with(r["x"], r["y"], lambda a, b: (a - mean) * (b - mean)))
            sxx, syy = (total(F.transform(r[k], lambda a: (a - mean) * (a - mean))) for k in "xy")
            return F.try_divide(sxy, F.sqrt(sxx * syy))

        return F.when(F.size(p) >= 2, let(F.struct(ranks("x", p).alias("x"), ranks("y", p).alias("y")), corr))

    return let(pairs, of)


def column(name: str) -> Expr:
    def build(ctx):
        if ctx.element is None and name not in ctx.types and not name.startswith("__ord"):
            raise ColumnNotFoundError(f"no column {name}; there are {', '.join(ctx.types)}")
        return F.col(f"`{name}`")

    return Expr(build, name)


def selected(selector: Callable[[Any], list[str]]) -> Expr:
    return Expr(lambda ctx: F.col(f"`{ctx.current}`"), "*", selector=selector)


def resolve_type(spec, t: T.DataType) -> bool:
    if isinstance(spec, TypeClass):
        return spec.holds(t)
    return isinstance(spec, DType) and spec.spark == t
