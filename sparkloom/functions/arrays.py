"""The array namespace: higher-order functions over list cells; null lists stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError
from .expr import CamelNames, Expr, _modes, let


def _sound(a: Column) -> Column:
    """Without nulls and NaN."""
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _variance(a: Column) -> Column:
    def of(v):
        mean = _total(v) / F.size(v)
        return F.when(F.size(v) > 1, let(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / (F.size(v) - 1)).otherwise(F.lit(0.0))

    return let(_sound(a), of)


class ArrNamespace(CamelNames):
    def __init__(self, expr: Expr):
        self.expr = expr

    def _map(self, f) -> Expr:
        return self.expr._map(lambda c, ctx: f(c))

    def _numbers(self, f) -> Expr:
        """f over the list's numbers; null if there are none."""
        return self._map(lambda a: let(_sound(a), lambda v: F.when(F.size(v) > 0, f(v))))

    def lengths(self) -> Expr:
        return self._map(lambda a: F.when(a.isNotNull(), F.size(a)))

    len = lengths

    def sum(self) -> Expr:
        return self._numbers(_total)

    def mean(self) -> Expr:
        return self._numbers(lambda v: _total(v) / F.size(v))

    def min(self) -> Expr:
        return self._numbers(F.array_min)

    def max(self) -> Expr:
        return self._numbers(F.array_max)

    def median(self) -> Expr:
        def of(s):
            n = F.size(s)
            low, high = (F.get(s, F.floor((n - 1 + k) / 2).cast("int")).cast("double") for k in (0, 1))
            return (low + high) / 2

        return self._numbers(lambda v: let(F.array_sort(v), of))

    def variance(self) -> Expr:
        return self._map(_variance)

    def std(self) -> Expr:
        return self._map(lambda a: F.sqrt(_variance(a)))

    def mode(self) -> Expr:
        return self._map(lambda a: F.when(a.isNotNull(), _modes(F.filter(a, lambda x: x.isNotNull()))))

    def n_unique(self) -> Expr:
        return self._map(lambda a: F.when(a.isNotNull(), F.size(F.array_distinct(a))))

    def unique(self) -> Expr:
        return self._map(F.array_distinct)

    def arg_max(self) -> Expr:
        return self._map(lambda a: let(F.transform(a, lambda x: F.when(~F.isnan(x.try_cast("double")), x)), lambda v: F.nullif(F.array_position(v, F.array_max(v)), F.lit(0)) - 1))

    def arg_min(self) -> Expr:
        return self._map(lambda a: let(F.transform(a, lambda x: F.when(~F.isnan(x.try_cast("double")), x)), lambda v: F.nullif(F.array_position(v, F.array_min(v)), F.lit(0)) - 1))

    def all(self) -> Expr:
        return self._map(lambda a: F.forall(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False))))

    def any(self) -> Expr:
        return self._map(lambda a: F.exists(a, lambda x: F.coalesce(x.cast("boolean"), F.lit(False))))

    def contains(self, item) -> Expr:
        return self.expr._binary(item, lambda a, b, _: F.exists(a, lambda x: x.eqNullSafe(b)))

    def contains_all(self, items) -> Expr:
        return self._map(lambda a: F.when(a.isNotNull(), F.size(F.array_except(F.array(*map(F.lit, items)), a)) == 0) if items else F.when(a.isNotNull(), F.lit(True)))

    def contains_any(self, items) -> Expr:
        return self._map(lambda a: F.when(a.isNotNull(), F.coalesce(F.exists(a, lambda x: x.isin(list(items))), F.lit(False)) if items else F.lit(False)))

    def count_matches(self, item) -> Expr:
        return self.expr._binary(item, lambda a, b, _: F.when(a.isNotNull(), F.size(F.filter(a, lambda x: x.eqNullSafe(b)))))

    def _inner(self, sub: Expr, use) -> Expr:
        """use(list, function of an element column)."""

        def f(a, ctx):
            def element(x):
                held, ctx.element = ctx.element, x
                try:
                    return sub.build(ctx)
                finally:
                    ctx.element = held

            return use(a, element)

        return self.expr._map(f)

    def eval(self, sub: Expr) -> Expr:
        """The element expression of each element; an aggregate of element() gives a list of one."""
        if getattr(sub, "list_agg", None):
            return self.agg(sub)._map(lambda c, _: F.array(c))
        return self._inner(sub, lambda a, f: F.transform(a, f))

    def filter(self, sub: Expr) -> Expr:
        return self._inner(sub, lambda a, f: F.filter(a, f))

    def agg(self, sub: Expr) -> Expr:
        """An aggregate of element(), such as element().sum(), of each list."""
        name = getattr(sub, "list_agg", None)
        if not name:
            raise InvalidArgumentError("agg takes an aggregate of element()")
        return getattr(self, name)()

    def explode(self, empty_as_null: bool = True, keep_nulls: bool = True) -> Expr:
        out = self.expr._copy(self.expr._build)
        out.explode_options = (empty_as_null, keep_nulls)
        return out

    def first(self) -> Expr:
        return self._map(lambda a: F.get(a, 0))

    def last(self) -> Expr:
        return self._map(lambda a: F.try_element_at(a, F.lit(-1)))

    def get(self, index: int, null_on_oob: bool = True) -> Expr:
        at = F.lit(index + 1 if index >= 0 else index)
        return self._map(lambda a: F.try_element_at(a, at) if null_on_oob else F.element_at(a, at))

    def gather(self, indices, null_on_oob: bool = True) -> Expr:
        def of(a, i):
            at = F.when(i >= 0, i + 1).otherwise(i)
            return F.try_element_at(a, at) if null_on_oob else F.element_at(a, at)

        if isinstance(indices, Expr):
            return self.expr._binary(indices, lambda a, b, _: F.transform(b, lambda i: of(a, i.cast("int"))))
        return self._map(lambda a: F.when(a.isNotNull(), F.array(*[of(a, F.lit(i)) for i in indices])))

    def gather_every(self, step: int = 1, offset_start: int = 0, offset_end: int = 0, max: int | None = None) -> Expr:
        if step < 1:
            raise InvalidArgumentError("step is 1 or more")

        def f(a):
            out = F.filter(a, lambda _, i: (i >= offset_start) & (i < F.size(a) - offset_end) & ((i - offset_start) % step == 0))
            return F.slice(out, 1, max) if max is not None else out

        return self._map(f)

    def join(self, separator: str = ",", ignore_nulls: bool = False, null_value: str = "", prefix: str = "", suffix: str = "", limit: int | None = None) -> Expr:
        def f(a):
            s = F.transform(F.slice(a, 1, limit) if limit is not None else a, lambda x: x.cast("string"))
            return F.concat(F.lit(prefix), F.array_join(s, separator) if ignore_nulls else F.array_join(s, separator, null_value), F.lit(suffix))

        return self._map(f)

    def reverse(self) -> Expr:
        return self._map(F.reverse)

    def shift(self, n: int = 1, fill_value=None) -> Expr:
        return self._map(lambda a: F.transform(a, lambda x, i: F.when((i - n >= 0) & (i - n < F.size(a)), F.get(a, i - n)).otherwise(F.lit(fill_value))))

    def slice(self, start: int | None = None, end: int | None = None) -> Expr:
        """From start up to end; negative ones count from the list's end."""

        def f(a):
            n = F.size(a)
            at = lambda k: F.least(F.lit(k), n) if k >= 0 else F.greatest(n + k, F.lit(0))
            s, e = at(start or 0), n if end is None else at(end)
            return F.slice(a, s + 1, F.greatest(e - s, F.lit(0)))

        return self._map(f)

    def splice(self, start: int, delete_count: int | None = None, *items) -> Expr:
        def f(a):
            n = F.size(a)
            s = F.least(F.lit(start), n) if start >= 0 else F.greatest(n + start, F.lit(0))
            gone = n - s if delete_count is None else F.least(F.lit(max(0, delete_count)), n - s)
            return F.concat(F.slice(a, F.lit(1), s), *([F.array(*map(F.lit, items))] if items else []), F.slice(a, s + gone + 1, n - s - gone))

        return self._map(f)

    def sort(self, descending: bool = False, nulls_last: bool = True) -> Expr:
        def f(a):
            full, nulls = F.array_sort(F.filter(a, lambda x: x.isNotNull())), F.filter(a, lambda x: x.isNull())
            full = F.reverse(full) if descending else full
            return F.concat(full, nulls) if nulls_last else F.concat(nulls, full)

        return self._map(f)

    def to_struct(self, fields: list[str] | None = None, upper_bound: int | None = None) -> Expr:
        """A struct of the first elements: of the given fields, or field_0 and on up to upper_bound (else the longest list's length)."""

        def f(a, ctx):
            names = fields or [f"field_{k}" for k in range(upper_bound if upper_bound is not None else ctx.df.select(F.max(F.size(a))).first()[0] or 0)]
            return F.when(a.isNotNull(), F.struct(*[F.get(a, k).alias(n) for k, n in enumerate(names)]))

        return self.expr._map(f)
