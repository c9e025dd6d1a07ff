"""Data types, type classes that select columns, and coercion rules.

Numeric text is cleaned before it is parsed; small integers are truncated and clamped, 64-bit ones out of range become
null; any non-empty text is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgumentError


class DType:
    """A data type: its name, Spark type and, for integers, its range."""

    def __init__(self, name: str, spark: T.DataType, low: int | None = None, high: int | None = None, classes: tuple[str, ...] = ()):
        self.name, self.spark, self.low, self.high, self.classes = name, spark, low, high, classes

    def __repr__(self) -> str:
        return self.name

    def __eq__(self, other) -> bool:
        return isinstance(other, DType) and (self.name, self.spark) == (other.name, other.spark)

    def __hash__(self) -> int:
        return hash(self.name)


class TypeClass:
    """A class of types, as a column selector."""

    def __init__(self, name: str, *kinds: type):
        self.name, self.kinds = name, kinds

    def holds(self, spark: T.DataType) -> bool:
        return isinstance(spark, self.kinds)


def _int(name, spark, bits, signed=True):
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return DType(name, spark, low, high)


Int8, Int16, Int32, Int64 = _int("Int8", T.ByteType(), 8), _int("Int16", T.ShortType(), 16), _int("Int32", T.IntegerType(), 32), _int("Int64", T.LongType(), 64)
UInt8, UInt16, UInt32, UInt64 = _int("UInt8", T.ShortType(), 8, False), _int("UInt16", T.IntegerType(), 16, False), _int("UInt32", T.LongType(), 32, False), _int("UInt64", T.DecimalType(20, 0), 64, False)
Float32, Float64 = DType("Float32", T.FloatType()), DType("Float64", T.DoubleType())
Boolean, Utf8, Binary, Null = DType("Boolean", T.BooleanType()), DType("Utf8", T.StringType()), DType("Binary", T.BinaryType()), DType("Null", T.NullType())
Object, Date, Time, Duration = DType("Object", T.VariantType()), DType("Date", T.DateType()), DType("Time", T.StringType()), DType("Duration", T.LongType())


def Decimal(precision: int = 38, scale: int = 18) -> DType:
    return DType("Decimal", T.DecimalType(precision, scale))


def Datetime(unit: str = "ms", tz: str | None = None) -> DType:
    if unit not in ("ms", "us", "ns"):
        raise InvalidArgumentError(f"unknown time unit {unit}")
    return DType("Datetime", T.TimestampType())


def Array(inner: DType) -> DType:
    return DType("Array", T.ArrayType(inner.spark, True))


def Struct(fields: dict[str, DType]) -> DType:
    return DType("Struct", T.StructType([T.StructField(k, v.spark) for k, v in fields.items()]))


SignedInteger = TypeClass("SignedInteger", T.ByteType, T.ShortType, T.IntegerType, T.LongType)
UnsignedInteger = TypeClass("UnsignedInteger")
Integer = TypeClass("Integer", *SignedInteger.kinds)
Float = TypeClass("Float", T.FloatType, T.DoubleType)
Numeric = TypeClass("Numeric", *Integer.kinds, *Float.kinds, T.DecimalType)
Temporal = TypeClass("Temporal", T.DateType, T.TimestampType, T.TimestampNTZType)
Nested = TypeClass("Nested", T.ArrayType, T.StructType, T.MapType)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def clean_number(c: Column) -> Column:
    """A number from text: spaces and underscores dropped, thousands and decimal marks told apart, (5) and 5- negative; else null."""
    s = F.regexp_replace(F.trim(c), r"[\s_]", "")
    negative = s.rlike(r"^\(.*\)$") | s.rlike(r"^[^-].*-$")
    s = F.regexp_replace(s, r"^\((.*)\)$|^([^-].*)-$", "$1$2")
    s = F.when(s.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(s, ",", "")).when(s.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$"), F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).when(s.rlike(r"^[+-]?\d+,\d+$"), F.regexp_replace(s, ",", ".")).otherwise(s)
    value = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?Infinity$|^NaN$"), s).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def from_epoch(c: Column) -> Column:
    """A timestamp from an epoch number: seconds up to 3e10, milliseconds to 1e14, microseconds to 1e17, else nanoseconds."""
    n = c.cast("double")
    micros = F.when(F.abs(n) <= 3e10, n * 1e6).when(F.abs(n) <= 1e14, n * 1e3).when(F.abs(n) <= 1e17, n).otherwise(n / 1e3)
    return F.timestamp_micros(micros.cast("long"))


def coerce(c: Column, source: T.DataType, target: DType, strict: bool = False) -> Column:
    """c of type source as target; what can't be taken over is null, or an error if strict."""
    t = target.spark
    if source == t and target.low is None:
        return c
    text = isinstance(source, T.StringType)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or target.name == "UInt64":
        n = clean_number(c) if text else F.unix_millis(c.cast("timestamp")) if is_time(source) else c.cast("int") if isinstance(source, T.BooleanType) else c
        n_type = "double" if text or is_float(source) else "decimal(38,0)"
        n = F.when(~F.isnan(n), n) if n_type == "double" else n.cast(n_type)
        if target.name in ("Int64", "UInt64"):
            out = F.when((n >= F.lit(float(target.low))) & (n <= F.lit(float(target.high))), n).try_cast(t)
        elif target.low is None:  # durations
            out = n.try_cast(t)
        else:
            out = F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(target.low).cast(n_type)), F.lit(target.high).cast(n_type))).try_cast(t)
    elif is_float(t):
        out = (clean_number(c) if text else F.unix_millis(c.cast("timestamp")) if is_time(source) else c).try_cast(t)
    elif isinstance(t, T.DecimalType):
        out = F.round(clean_number(c) if text else c, t.scale).try_cast(t)
    elif isinstance(t, T.BooleanType):
        out = (F.length(c) > 0) if text else (c != 0) & ~F.isnan(c) if is_float(source) else c.try_cast(t)
    elif isinstance(t, T.TimestampType):
        out = from_epoch(c) if isinstance(source, T.NumericType) else c.try_cast(t)
    elif isinstance(t, T.DateType):
        out = from_epoch(c).cast("date") if isinstance(source, T.NumericType) else c.try_cast(t)
    elif isinstance(t, T.ArrayType) and not isinstance(source, T.ArrayType):
        out = F.when(c.isNotNull(), F.array(c.try_cast(t.elementType)))
    elif isinstance(t, T.StructType) and not isinstance(source, T.StructType):
        out = F.lit(None).cast(t)
    elif target.name == "Time":
        out = F.date_format(c.try_cast("timestamp"), "HH:mm:ss.SSS") if not text else c
    elif isinstance(t, T.VariantType):
        out = F.parse_json(F.to_json(F.struct(c.alias("v")))) if not text else F.try_parse_json(c)
    elif isinstance(t, T.BinaryType) and text:
        out = c.cast(t)
    else:
        out = c.try_cast(t)
    if strict:
        out = F.when(c.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"can't take over as {target}: "), c.cast("string"))).cast(t)).otherwise(out)
    return out
