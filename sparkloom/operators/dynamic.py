"""Windows over an index column: tumbling, sliding and calendar windows, grouped as keys.

A row's windows follow from arithmetic on its index: tumbling ones are a key, overlapping ones a short exploded sequence.
Windows begin at an anchor from each partition's least index; none begins before it.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, ComputeError, InvalidArgumentError
from ..functions.entry import parse_duration
from ..functions.expr import column, to_expr
from .frame import Frame
from .grouped import GroupedData

_DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_DAY_MS = 86_400_000


def step_of(value: Any) -> tuple[int, float]:
    """(months, other units) of a duration: a number in index units or milliseconds, or text with mo, q and y."""
    if isinstance(value, (int, float)):
        return 0, value
    months, rest = 0, value
    for n, unit in re.findall(r"(-?\d+)\s*(mo|q|y)\b", value):
        months += int(n) * {"mo": 1, "q": 3, "y": 12}[unit]
        rest = rest.replace(f"{n}{unit}", "").replace(f"{n} {unit}", "")
    if m := re.fullmatch(r"\s*(-?\d+)\s*i\s*", rest):
        return months, int(m[1])
    return months, parse_duration(rest) if rest.strip(" ,") else 0


def group_by_dynamic(frame: Frame, index_column: Any, every: Any, period: Any = None, offset: Any = 0, truncate: bool = True, closed: str = "left", label: str = "left", start_by: str = "window", include_boundaries: bool = False, by=None, group_by=None, check_sorted: bool = False) -> GroupedData:
    """Groups by windows [start, start + period) that begin every `every`; keys are the by columns and the window's label.

    Null and NaN indices are dropped. Sorted input is not needed; check_sorted makes unsorted input an error.
    """
    start_by, closed, label = start_by.lower(), closed.lower(), label.lower()
    if closed not in ("left", "right", "both", "none") or label not in ("left", "right", "datapoint") or start_by not in ("window", "datapoint", *_DAYS):
        raise InvalidArgumentError(f"closed {closed}, label {label}, start_by {start_by}")
    keys = [by or group_by] if isinstance(by or group_by, str) else list(by or group_by or [])
    index = column(index_column) if isinstance(index_column, str) else to_expr(index_column)
    name = index.name
    if isinstance(index_column, str) and index_column not in frame.columns:
        raise ColumnNotFoundError(f"no column {index_column}")
    work = frame.with_columns(index.alias("_index"))
    t = work.schema["_index"]
    timed = isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))
    months, size = step_of(every)
    p_months, p_size = step_of(every if period is None else period)
    _, shift = step_of(offset)
    if months <= 0 and size <= 0 or p_months <= 0 and p_size <= 0:
        raise InvalidArgumentError("every and period are positive")
    df = work._df
    x = F.unix_millis(F.col("_index").cast("timestamp")) if timed else F.col("_index")
    whole = timed or isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
    df = df.withColumn("_x", x).filter("_x is not null" + ("" if whole else " and not isnan(_x)"))
    if check_sorted and frame._order:
        from pyspark.sql import Window

        w = Window.partitionBy(*keys).orderBy(*frame._need_order())
        if not df.select((F.lag("_x").over(w) > F.col("_x")).alias("bad")).filter("bad").isEmpty():
            raise ComputeError(f"{name} is not sorted")
    number = "long" if whole and float(size).is_integer() and float(shift).is_integer() else "double"
    calendar = timed and (months or p_months)
    simple = not calendar and start_by == "window" and closed == "left" and p_size <= size
    ends_right = not calendar and start_by == "window" and closed == "right" and p_size <= size
    months_apart = timed and months in (1, 12) and p_months == months and start_by == "window" and closed == "left"
    if months_apart:  # whole months or years, whatever the least index
        start = F.date_trunc("month" if months == 1 else "year", F.timestamp_millis("_x"))
        df = df.withColumn("_lower", F.unix_millis(start)).withColumn("_upper", F.unix_millis(start + F.make_ym_interval(F.lit(0), F.lit(months))))
    elif ends_right:
        lower = ((F.ceil((F.col("_x") - shift) / F.lit(float(size))) - 1) * F.lit(size) + F.lit(shift)).cast(number)
        df = df.withColumn("_lower", lower)
        if p_size < size:
            df = df.filter(F.col("_x") <= F.col("_lower") + p_size)
        df = df.withColumn("_upper", (F.col("_lower") + F.lit(p_size)).cast(number))
    elif simple:
        lower = (F.floor((F.col("_x") - shift) / F.lit(float(size))) * F.lit(size) + F.lit(shift)).cast(number)
        df = df.withColumn("_lower", lower)
        if p_size < size:
            df = df.filter(F.col("_x") < F.col("_lower") + p_size)
        df = df.withColumn("_upper", (F.col("_lower") + F.lit(p_size)).cast(number))
    else:
        df = _exploded(df, keys, calendar, months, size, p_months, p_size, shift, closed, start_by, timed, number)
    to_time = (lambda c: F.timestamp_millis(c).cast(t)) if timed else (lambda c: c)
    df = df.withColumn("_lower_boundary", to_time(F.col("_lower"))).withColumn("_upper_boundary", to_time(F.col("_upper")))
    extra = []
    if label == "datapoint" or not truncate:
        from pyspark.sql import Window

        df = df.withColumn("_datapoint", F.min("_index").over(Window.partitionBy(*keys, "_lower")))
        extra = ["_datapoint"]
    grouped = Frame(df.drop("_x", "_lower", "_upper", "_index"))
    shown = "_datapoint" if extra else "_lower_boundary" if label == "left" else "_upper_boundary"
    inner = ["_lower_boundary", "_upper_boundary", *extra]

    def finish(made: Frame) -> Frame:
        rest = [c for c in made.columns if c not in (*keys, *inner, name)]
        order = [F.col(c) for c in (*keys, "_lower_boundary")]
        out = made._df.select(*keys, F.col(shown).alias(name), *(["_lower_boundary", "_upper_boundary"] if include_boundaries else []), *rest, *[c.alias(f"__ord{k}") for k, c in enumerate(order)])
        return Frame(out)

    return GroupedData(grouped, [*keys, *inner], finish)


def _exploded(df, keys, calendar, months, size, p_months, p_size, shift, closed, start_by, timed, number):
    """Rows once for each of their windows, with _lower and _upper."""
    least = df.groupBy(*keys).agg(F.min("_x").alias("_least")) if keys else df.agg(F.min("_x").alias("_least"))
    if keys:
        least = least.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_least")
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        df = df.join(least, condition).drop(*[f"_key_{k}" for k in keys])
    else:
        df = df.crossJoin(F.broadcast(least))
    low, x = F.col("_least"), F.col("_x")
    after = closed in ("left", "both")  # a window holds its start
    until = closed in ("right", "both")  # and its end
    if calendar:
        stamp = F.timestamp_millis(low)
        anchor = stamp if start_by == "datapoint" else F.date_trunc("year" if months and months % 12 == 0 else "month", stamp)
        if not months:
            raise InvalidArgumentError("a period in months needs every in months")
        back = F.lit(0) if after else F.when(F.unix_millis(anchor) == low, 1).otherwise(0)
        df = df.withColumn("_anchor", anchor).withColumn("_back", back.cast("int"))
        month = lambda c: F.year(c) * 12 + F.month(c)
        gap = month(F.timestamp_millis(x)) - month(F.col("_anchor"))
        span = p_months or int(p_size // (28 * _DAY_MS)) + 1
        first = F.greatest(F.floor((gap - span - 1) / months), -F.col("_back")).cast("int")
        last = F.ceil((gap + 1) / months).cast("int")
        df = df.filter(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
        start = F.col("_anchor") + F.make_ym_interval(F.lit(0), F.col("_k") * months)
        end = F.col("_anchor") + F.make_ym_interval(F.lit(0), F.col("_k") * months + p_months) if p_months else F.timestamp_millis((F.unix_millis(start) + p_size).cast("long"))
        df = df.withColumn("_lower", F.unix_millis(start)).withColumn("_upper", F.unix_millis(end))
        inside = (x >= F.col("_lower") if after else x > F.col("_lower")) & (x <= F.col("_upper") if until else x < F.col("_upper"))
        return df.filter(inside).drop("_least", "_anchor", "_back", "_k")
    if start_by == "datapoint":
        anchor: Column = low + shift
    elif start_by in _DAYS and timed:
        week = 7 * _DAY_MS
        monday = (_DAYS.index(start_by) - 3) % 7 * _DAY_MS  # 1970-01-01 was a Thursday
        anchor = F.floor((low - monday) / F.lit(float(week))) * week + monday + shift
    else:
        anchor = F.floor((low - shift) / F.lit(float(size))) * F.lit(size) + F.lit(shift)
    if not after:
        anchor = F.when(anchor == low, anchor - F.lit(size)).otherwise(anchor)
    d = (x - anchor) / F.lit(float(size))
    e = (x - anchor - F.lit(p_size)) / F.lit(float(size))
    last = F.floor(d) if after else F.ceil(d) - 1
    first = F.greatest(F.ceil(e) if until else F.floor(e) + 1, F.lit(0))
    df = df.withColumn("_anchor", anchor).filter(first <= last).withColumn("_k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    df = df.withColumn("_lower", (F.col("_anchor") + F.col("_k") * F.lit(size)).cast(number))
    return df.withColumn("_upper", (F.col("_lower") + F.lit(p_size)).cast(number)).drop("_least", "_anchor", "_k")
