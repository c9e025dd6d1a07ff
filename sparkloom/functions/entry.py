"""Entry functions: columns, literals, branches, lists, durations and sequences."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import functions as F

from ..errors import InvalidArgumentError, ShapeError
from ..types import DType, TypeClass
from .arrays import ArrNamespace
from .expr import CamelNames, Expr, column, literal, resolve_type, selected, to_expr


def all_() -> Expr:
    return selected(lambda df: [c for c in df.columns if not c.startswith("__")])


def exclude(columns: str | list[str]) -> Expr:
    gone = {columns} if isinstance(columns, str) else set(columns)
    return selected(lambda df: [c for c in df.columns if c not in gone and not c.startswith("__")])


def col(spec: Any) -> Expr:
    """A column by name; columns by list of names, pattern(s), type(s) or type class(es)."""
    specs = list(spec) if isinstance(spec, (list, tuple)) else [spec]
    if len(specs) == 1 and isinstance(specs[0], str):
        return all_() if specs[0] == "*" else column(specs[0])

    def names(df):
        out = []
        for f in df.schema.fields:
            for s in specs:
                hit = f.name == s if isinstance(s, str) else bool(s.search(f.name)) if isinstance(s, re.Pattern) else resolve_type(s, f.dataType)
                if hit and not f.name.startswith("__"):
                    out.append(f.name)
                    break
        return out

    return selected(names)


def lit(value: Any, dtype: DType | None = None, name: str = "literal") -> Expr:
    return Expr(lambda ctx: literal(value).cast(dtype.spark) if dtype else literal(value), name, literal=True)


def coalesce(*values: Any) -> Expr:
    """The first non-null; a string that names a column is that column, else text."""
    parts = [to_expr(v, True) for v in values]
    return Expr(lambda ctx: F.coalesce(*[p.build(ctx) for p in parts]), parts[0].name)


class When(CamelNames):
    def __init__(self, branches, predicate):
        self._branches, self._predicate = branches, predicate

    def then(self, value: Any) -> Then:
        return Then([*self._branches, (self._predicate, to_expr(value, True))], None)


class Then(Expr):
    def __init__(self, branches, default):
        self._branches = branches

        def build(ctx):
            out = F
            for predicate, value in branches:
                out = out.when(predicate.build(ctx), value.build(ctx))
            return out if default is None else out.otherwise(default.build(ctx))

        super().__init__(build, branches[0][1].name)
        self.has_agg = any(e.has_agg for b in branches for e in b) or bool(default is not None and default.has_agg)

    def when(self, predicate: Expr) -> When:
        return When(self._branches, predicate)

    def otherwise(self, value: Any) -> Expr:
        out = Then(self._branches, to_expr(value, True))
        return out


def when(predicate: Expr) -> When:
    return When([], predicate)


def struct(fields: Any, *more: Any) -> Expr:
    pairs = list(fields.items()) if isinstance(fields, dict) else [(x if isinstance(x, str) else x.name, x) for x in [*(fields if isinstance(fields, (list, tuple)) else [fields]), *more]]
    made = [(n, column(e) if isinstance(e, str) else to_expr(e)) for n, e in pairs]
    return Expr(lambda ctx: F.struct(*[e.build(ctx).alias(n) for n, e in made]), "struct")


def implode(name: str) -> Expr:
    return column(name).implode()


class Element(Expr):
    """The element of a list; its aggregates stand for the whole list's."""


def _list_aggregate(name: str):
    return lambda self: self._copy(self._build, list_agg=name)


for _name in ("sum", "mean", "min", "max", "median", "std", "variance", "mode", "n_unique", "all", "any", "first", "last", "arg_max", "arg_min"):
    setattr(Element, _name, _list_aggregate(_name))
Element.avg, Element.count = Element.mean, _list_aggregate("lengths")


def element() -> Element:
    return Element(lambda ctx: ctx.element, "element")


def horizontal(*exprs: Any) -> ArrNamespace:
    """The columns' values as a row-wise list, with the array namespace's methods."""
    parts = [column(e) if isinstance(e, str) else to_expr(e) for e in exprs]

    def build(ctx):
        made = [p.build(ctx) for x in parts for p in x.expand(ctx.df)]
        return F.array(*made)

    return ArrNamespace(Expr(build, "horizontal"))


_UNIT_MS = {"weeks": 604_800_000, "days": 86_400_000, "hours": 3_600_000, "minutes": 60_000, "seconds": 1000, "milliseconds": 1, "microseconds": 1e-3, "nanoseconds": 1e-6}
_SHORT = {"w": "weeks", "d": "days", "h": "hours", "m": "minutes", "s": "seconds", "ms": "milliseconds", "us": "microseconds", "ns": "nanoseconds"}


def parse_duration(text: str) -> float:
    """Milliseconds of a text such as '1d 12h'."""
    parts = re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", text)
    if not parts or re.sub(r"[+-]?\d+(?:\.\d+)?\s*[a-z]+|[\s,]", "", text):
        raise InvalidArgumentError(f"can't read the duration {text!r}")
    total = 0.0
    for n, unit in parts:
        if unit not in _SHORT:
            raise InvalidArgumentError(f"unknown unit {unit}")
        total += float(n) * _UNIT_MS[_SHORT[unit]]
    return total


def duration(text: str | None = None, **parts: Any) -> Expr:
    """Milliseconds; parts may be expressions."""
    if text is not None:
        return lit(parse_duration(text), name="duration")
    if not parts or set(parts) - set(_UNIT_MS):
        raise InvalidArgumentError(f"a duration has one or more of {', '.join(_UNIT_MS)}")
    out = None
    for unit, value in parts.items():
        term = to_expr(value, True).mul(_UNIT_MS[unit])
        out = term if out is None else out.add(term)
    return out.alias("duration")


def seq_range(value: Any = 0, mode: str = "cumulative", step: Any = 1, n: int | None = None, dtype: DType | None = None, name: str = "seq", strict: bool = True, pad: bool = False, pad_value: Any = None, start_index: int = 0, end_index: int | None = None) -> Expr:
    """A sequence along the row order: constant, cumulative (value + step * row) or independent (step(row), a Python function).

    n values from start_index on; rows beyond are pad_value if pad, else an error in a strict sequence.
    """
    if mode not in ("constant", "cumulative", "independent"):
        raise InvalidArgumentError(f"unknown mode {mode}")

    def build(ctx):
        row = F.row_number().over(ctx.window()) - 1 - start_index
        if mode == "constant":
            out = F.lit(value)
        elif callable(step):
            out = F.udf(step, dtype.spark if dtype else "double")(row)
        else:
            out = F.lit(value) + F.lit(step) * row if mode == "cumulative" else F.lit(value) + F.lit(step)
        stop = n if n is not None else end_index - start_index if end_index is not None else None
        if stop is not None:
            inside = (row >= 0) & (row < stop)
            rest = F.lit(pad_value) if pad or not strict else F.raise_error(F.lit(f"{stop} values for more rows"))
            out = F.when(inside, out).otherwise(rest)
        return out.cast(dtype.spark) if dtype else out

    if n is not None and n < 0:
        raise ShapeError("n is negative")
    return Expr(build, name, over=True)
