"""Grouped frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import ColumnNotFoundError
from ..functions.expr import CamelNames, Context
from .frame import ORD, Frame


class GroupedData(CamelNames):
    """Groups by key columns (null is a key); results come in order of first appearance."""

    def __init__(self, frame: Frame, keys: list[str], finish=None):
        unknown = [k for k in keys if k not in frame._df.columns]
        if unknown:
            raise ColumnNotFoundError(f"no column {', '.join(unknown)}")
        self.frame, self.keys, self._finish = frame, keys, finish

    def _first(self) -> list:
        """Order columns of a group: those of its first row."""
        if not self.frame._order:
            return []
        return [F.min(F.struct(*self.frame._order)).alias(f"{ORD}0")]

    def _done(self, frame: Frame) -> Frame:
        return self._finish(frame) if self._finish else frame

    def to_dataframe(self) -> Frame:
        made = self.frame._df.groupBy(*self.keys).agg(*(self._first() or [F.count(F.lit(1)).alias("__ord_n")]))
        return self._done(Frame(made.select(*self.keys, *[c for c in made.columns if c.startswith(ORD)])))

    to_frame = to_dataframe

    def agg(self, *exprs) -> Frame:
        """Keys, then the expressions; what has no aggregate is evaluated on the result's own columns."""
        made = self.frame._exprs([e if not isinstance(e, str) else e for e in exprs])
        ctx = Context(self.frame._df, self.frame._order, "group", self.keys)
        now = [e for e in made if e.has_agg]
        out = self.frame._df.groupBy(*self.keys).agg(*[e.build(ctx).alias(e.name) for e in now], *(self._first() or ([] if now else [F.count(F.lit(1)).alias("__ord_n")])))
        frame = Frame(out.drop("__ord_n"))
        later = [e for e in made if not e.has_agg]
        if later:
            frame = frame.with_columns(*later).select(*self.keys, *[e.name for e in made])
        return self._done(frame)
