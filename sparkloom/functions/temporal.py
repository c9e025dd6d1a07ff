"""The temporal namespace. Fields are read in UTC (the session's zone) unless a zone is given."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ComputeError, InvalidArgumentError
from ..types import from_epoch
from .expr import CamelNames, Context, Expr, to_expr

#: fixed values: strftime directives and the formatter's letters
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "A": "EEEE", "a": "EEE", "B": "MMMM", "b": "MMM", "h": "MMM", "j": "DDD", "f": "SSSSSS", "Z": "z", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy"}
_COMPOSED = {"u": lambda c: F.weekday(c) + 1, "w": lambda c: F.dayofweek(c) - 1, "V": lambda c: F.lpad(F.weekofyear(c).cast("string"), 2, "0"), "G": lambda c: F.extract(F.lit("YEAROFWEEK"), c)}


def java_format(format: str) -> str:
    out = ""
    for m in re.finditer(r"%(.)|([^%]+)", format, re.S):
        if m[1] == "%":
            out += "'%'"
        elif m[1]:
            if m[1] not in DIRECTIVES:
                raise InvalidArgumentError(f"unknown directive %{m[1]}")
            out += DIRECTIVES[m[1]]
        else:
            out += re.sub(r"[A-Za-z]+", lambda w: f"'{w[0]}'", m[2].replace("'", "''"))
    return out


def instant(c: Column, ctx: Context) -> Column:
    t = ctx.dtype(c)
    if isinstance(t, T.NumericType):
        return from_epoch(c)
    if isinstance(t, T.StringType):
        return c.try_cast("timestamp")
    return c.cast("timestamp")


class DtNamespace(CamelNames):
    def __init__(self, expr: Expr):
        self.expr = expr

    def _map(self, f, zone: str | None = None) -> Expr:
        return self.expr._map(lambda c, ctx: f(F.from_utc_timestamp(instant(c, ctx), zone) if zone else instant(c, ctx)))

    def year(self, time_zone: str | None = None) -> Expr:
        return self._map(F.year, time_zone)

    def month(self, time_zone: str | None = None) -> Expr:
        return self._map(F.month, time_zone)

    def day(self, time_zone: str | None = None) -> Expr:
        return self._map(F.dayofmonth, time_zone)

    def hour(self, time_zone: str | None = None) -> Expr:
        return self._map(F.hour, time_zone)

    def minute(self, time_zone: str | None = None) -> Expr:
        return self._map(F.minute, time_zone)

    def second(self) -> Expr:
        return self._map(F.second)

    def millisecond(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: F.pmod(F.unix_millis(c), F.lit(1000)).cast("int"))

    def microsecond(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: F.pmod(F.unix_micros(c), F.lit(1_000_000)).cast("int"))

    def nanosecond(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: F.pmod(F.unix_micros(c), F.lit(1_000_000)).cast("long") * 1000)

    def quarter(self, time_zone: str | None = None) -> Expr:
        return self._map(F.quarter, time_zone)

    def iso_week(self, time_zone: str | None = None) -> Expr:
        return self._map(F.weekofyear, time_zone)

    week = iso_week

    def iso_year(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: F.extract(F.lit("YEAROFWEEK"), c), time_zone)

    def weekday(self, time_zone: str | None = None) -> Expr:
        """Monday is 1."""
        return self._map(lambda c: F.weekday(c) + 1, time_zone)

    def ordinal_day(self, time_zone: str | None = None) -> Expr:
        return self._map(F.dayofyear, time_zone)

    def century(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: (F.floor((F.year(c) - 1) / 100) + 1).cast("int"), time_zone)

    def millennium(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: (F.floor((F.year(c) - 1) / 1000) + 1).cast("int"), time_zone)

    def is_leap_year(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: ((F.year(c) % 4 == 0) & (F.year(c) % 100 != 0)) | (F.year(c) % 400 == 0), time_zone)

    def days_in_month(self, time_zone: str | None = None) -> Expr:
        return self._map(lambda c: F.dayofmonth(F.last_day(c)), time_zone)

    def date(self) -> Expr:
        return self._map(lambda c: F.date_trunc("day", c))

    def time(self) -> Expr:
        return self._map(lambda c: F.date_format(c, "HH:mm:ss.SSS"))

    def month_start(self) -> Expr:
        return self._map(lambda c: F.date_trunc("month", c))

    def month_end(self) -> Expr:
        return self._map(lambda c: F.last_day(c).cast("timestamp"))

    def epoch(self, unit: str = "ms") -> Expr:
        made = {"s": F.unix_seconds, "ms": F.unix_millis, "us": F.unix_micros, "ns": lambda c: F.unix_micros(c) * 1000}
        if unit not in made:
            raise InvalidArgumentError(f"unknown unit {unit}")
        return self._map(made[unit])

    timestamp = epoch

    def cast_time_unit(self, unit: str) -> Expr:
        """Units are how a value is shown; the instant stays."""
        if unit not in ("ms", "us", "ns"):
            raise InvalidArgumentError(f"unknown unit {unit}")
        return self._map(lambda c: F.date_trunc("millisecond", c) if unit == "ms" else c)

    def convert_time_zone(self, time_zone: str) -> Expr:
        """The instant's wall-clock time in a zone, as a timestamp without zone."""
        return self._map(lambda c: F.from_utc_timestamp(c, time_zone).cast("timestamp_ntz"))

    def utc_offset(self, time_zone: str | None = None, kind: str = "total", unit: str = "ms") -> Expr:
        """Offset of a zone from UTC: total, base (winter's) or dst, in ms, min or h."""
        scale = {"ms": 1, "min": 60_000, "h": 3_600_000}[unit]
        zone = time_zone or "UTC"

        def at(c):
            return (F.unix_micros(F.from_utc_timestamp(c, zone)) - F.unix_micros(c)) / 1000

        def f(c):
            total = at(c)
            base = F.least(*[at(F.make_timestamp(F.year(c), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) for m in (1, 7)])
            return {"total": total, "base": base, "dst": total - base}[kind] / scale

        return self._map(f)

    def _total(self, ms: float) -> Expr:
        return self.expr._map(lambda c, _: c / ms)

    def total_days(self) -> Expr:
        return self._total(86_400_000)

    def total_hours(self) -> Expr:
        return self._total(3_600_000)

    def total_minutes(self) -> Expr:
        return self._total(60_000)

    def total_seconds(self) -> Expr:
        return self._total(1000)

    def total_milliseconds(self) -> Expr:
        return self.expr._map(lambda c, _: c)

    def total_microseconds(self) -> Expr:
        return self.expr._map(lambda c, _: c * 1000)

    def total_nanoseconds(self) -> Expr:
        return self.expr._map(lambda c, _: c * 1_000_000)

    def is_business_day(self, exclude_weekdays=(0, 6), holidays=()) -> Expr:
        """Weekdays count from Sunday, 0."""

        def f(c):
            free = (F.dayofweek(c) - 1).isin(list(exclude_weekdays))
            return ~(free | F.to_date(c).cast("string").isin([str(h) for h in holidays])) if holidays else ~free

        return self._map(f)

    def offset_day(self, n, exclude_weekdays=(), holidays=(), roll: str = "raise") -> Expr:
        """n days on; with excluded days, n business days, a start on an excluded day rolled forward or backward first."""
        days = to_expr(n, True)
        if not exclude_weekdays and not holidays:
            return self.expr._map(lambda c, ctx: F.timestamp_micros(F.unix_micros(instant(c, ctx)) + days.build(ctx).cast("long") * 86_400_000_000))
        free, off = set(exclude_weekdays), {pd.Timestamp(str(h)).date() for h in holidays}
        if len(free) >= 7:
            raise InvalidArgumentError("every weekday is excluded")

        mask, closed = [(k + 1) % 7 not in free for k in range(7)], np.array(sorted(off), dtype="datetime64[D]")

        @F.pandas_udf("timestamp")
        def call(t: pd.Series, k: pd.Series) -> pd.Series:
            out, known = pd.Series(pd.NaT, index=t.index, dtype="datetime64[us]"), t.notna() & k.notna()
            at = t[known].to_numpy().astype("datetime64[us]")
            day = at.astype("datetime64[D]")
            if roll == "raise" and not np.is_busday(day, weekmask=mask, holidays=closed).all():
                raise ComputeError("a date is no business day")
            out[known] = np.busday_offset(day, k[known].to_numpy().astype(np.int64), roll="forward" if roll == "forward" else "backward", weekmask=mask, holidays=closed).astype("datetime64[us]") + (at - day)
            return out

        return self.expr._map(lambda c, ctx: call(instant(c, ctx), days.build(ctx).cast("int")))

    def replace(self, year=None, month=None, day=None, hour=None, minute=None, second=None, millisecond=None, time_zone: str | None = None) -> Expr:
        """Components replaced; negative months and days count from the end (day -1: the month's last)."""

        def f(c):
            y = F.lit(year) if year is not None else F.year(c)
            m = F.lit(month if month > 0 else 13 + month) if month is not None else F.month(c)
            last = F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))
            d = F.least(F.dayofmonth(c), last) if day is None else F.lit(day) if day > 0 else last + 1 + day
            s = (F.lit(second) if second is not None else F.second(c)) + (F.lit(millisecond) if millisecond is not None else F.pmod(F.unix_millis(c), F.lit(1000))) / 1000
            return F.make_timestamp(y, m, d, F.lit(hour) if hour is not None else F.hour(c), F.lit(minute) if minute is not None else F.minute(c), s.cast("decimal(8,6)"))

        return self._map(f, time_zone)

    def strftime(self, format: str, time_zone: str | None = None) -> Expr:
        def f(c):
            parts = []
            for m in re.finditer(r"%([uwVG])|((?:%[^uwVG]|[^%])+)", format, re.S):
                parts.append(_COMPOSED[m[1]](c).cast("string") if m[1] else F.date_format(c, java_format(m[2])))
            return F.concat(*parts) if parts else F.lit("")

        return self._map(f, time_zone)
