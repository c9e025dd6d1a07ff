"""The struct namespace; an unknown attribute is a field."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, SchemaError
from .expr import Expr, snake, to_expr


class StructNamespace:
    def __init__(self, expr: Expr):
        self._expr = expr

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        form = snake(name)
        return getattr(self, form) if form != name and hasattr(type(self), form) else self.field(name)

    @staticmethod
    def _names(c, ctx) -> list[str]:
        t = ctx.dtype(c)
        if not isinstance(t, T.StructType):
            raise SchemaError(f"{t.simpleString()} is no struct")
        return t.names

    def field(self, name: str) -> Expr:
        def f(c, ctx):
            if name not in self._names(c, ctx):
                raise ColumnNotFoundError(f"no field {name}")
            return c.getField(name)

        return self._expr._map(f).alias(name)

    def rename_fields(self, mapping: dict[str, str]) -> Expr:
        """Renamed fields come last."""

        def f(c, ctx):
            names = self._names(c, ctx)
            kept = [c.getField(n).alias(n) for n in names if n not in mapping]
            return F.when(c.isNotNull(), F.struct(*kept, *[c.getField(n).alias(mapping[n]) for n in names if n in mapping]))

        return self._expr._map(f)

    def with_fields(self, fields) -> Expr:
        pairs = list(fields.items()) if isinstance(fields, dict) else [(e.name, e) for e in fields]

        def f(c, ctx):
            for name, e in pairs:
                c = c.withField(name, to_expr(e, True).build(ctx))
            return c

        return self._expr._map(f)

    def unnest(self) -> Expr:
        return self._expr._copy(self._expr._build, is_unnest=True)
