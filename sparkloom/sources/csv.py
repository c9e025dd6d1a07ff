"""CSV: text or files in, with types inferred from all values in one pass; text or files out."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FrameError, InvalidArgumentError, IOStreamError
from ..operators.frame import ORD, Frame
from ..types import DType, coerce

NULLS = ("", "NA", "null", "NaN")  # fixed values: what stands for null
_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def read_csv(spark: SparkSession, content: str | None = None, path: str | None = None, separator: str = ",", quote_char: str = '"', has_header: bool = True, null_values=NULLS, schema: dict[str, DType] | None = None, infer_schema: bool = True, multi_line: bool = True) -> Frame:
    """A frame of CSV text, or of the files at a path (in file order).

    Values at a path may hold line breaks, so one task reads a file; with multi_line=False files are split among tasks.
    """
    if (content is None) == (path is None):
        raise InvalidArgumentError("give content or path")
    if content is not None:
        rows = [r for r in csv.reader(io.StringIO(content.removeprefix("﻿"), newline=""), delimiter=separator, quotechar=quote_char) if r]
        if has_header and not rows:
            return Frame(spark.createDataFrame([], T.StructType([T.StructField(f"{ORD}0", T.LongType())])))
        names = rows.pop(0) if has_header else [f"column_{k}" for k in range(max(map(len, rows), default=0))]
        if len(set(names)) < len(names):
            raise FrameError("columns of one name")
        types = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(f"{ORD}0", T.LongType())])
        df = spark.createDataFrame([(*(r + [""] * len(names))[: len(names)], i) for i, r in enumerate(rows)], types)
    else:
        df = spark.read.option("multiLine", multi_line).csv(path, sep=separator, quote=quote_char, escape=quote_char, header=has_header, inferSchema=False, ignoreLeadingWhiteSpace=False)
        if not has_header:
            df = df.toDF(*[f"column_{k}" for k in range(len(df.columns))])
        names = df.columns
        df = df.withColumn(f"{ORD}0", F.monotonically_increasing_id())
    null = lambda c: F.when(~F.trim(c).isin(list(null_values)), c)
    df = df.select(*[null(F.col(f"`{c}`")).alias(c) for c in names], f"{ORD}0")
    if schema is not None:
        return Frame(df.select(*[(coerce(F.col(f"`{c}`"), T.StringType(), t) if c in names else F.lit(None).cast(t.spark)).alias(c) for c, t in schema.items()], f"{ORD}0"))
    return Frame(infer_columns(df, names) if infer_schema else df)


def infer_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Text columns as the first of boolean, long, double, timestamp that fits all their values."""
    s = lambda c: F.trim(F.col(f"`{c}`"))
    tests = {
        "boolean": lambda c: F.lower(s(c)).isin("true", "false", "1", "0"),
        "long": lambda c: s(c).rlike(r"^[+-]?\d+$") & s(c).try_cast("long").isNotNull(),
        "double": lambda c: s(c).try_cast("double").isNotNull(),
        "timestamp": lambda c: s(c).rlike(_DATE) & s(c).try_cast("timestamp").isNotNull(),
    }
    if not names:
        return df
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.coalesce(t(c), F.lit(False))).alias(f"{kind}{k}") for k, c in enumerate(names) for kind, t in tests.items()], *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(names)]).first()
    made = []
    for k, c in enumerate(names):
        kind = next((kind for kind in tests if not counts[f"{kind}{k}"]), "string") if counts[f"n{k}"] else "string"
        value = F.lower(s(c)).isin("true", "1") if kind == "boolean" else s(c).try_cast(kind) if kind != "string" else F.col(f"`{c}`")
        made.append(value.alias(c))
    return df.select(*made, *[c for c in df.columns if c.startswith(ORD)])


def _number(x, t: T.DataType, decimals: int | None, grouping: bool, accounting: bool):
    """A number as text; a double that a decimal of 38 digits can't hold, NaN and infinities stand as Spark writes them."""
    s = x.cast("string")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        if decimals is not None:
            s = F.coalesce(F.round(x, decimals).try_cast(f"decimal(38,{decimals})").cast("string"), s)
        else:
            s = F.when(x == F.floor(x), F.coalesce(x.try_cast("long").cast("string"), s)).otherwise(s)
    if grouping:
        sign, digits, rest = (F.regexp_extract(s, r"^(-?)(\d+)(.*)$", k) for k in (1, 2, 3))
        s = F.when(digits != "", F.concat(sign, F.format_number(digits.try_cast("decimal(38,0)"), 0), rest)).otherwise(s)
    return F.when(F.startswith(s, F.lit("-")), F.concat(F.lit("("), F.substr(s, F.lit(2)), F.lit(")"))).otherwise(s) if accounting else s


def write_csv(frame: Frame, path: str | None = None, separator: str = ",", include_header: bool = True, quote_char: str = '"', quote_style: str = "necessary", null_value: str = "", line_terminator: str = "\n", date_format: str | None = None, datetime_format: str | None = None, time_format: str | None = None, float_decimals: int | None = None, use_grouping: bool = False, accounting_negatives: bool = False, include_bom: bool = False) -> str | None:
    """CSV as text (in row order) without a path; with one, files that Spark's tasks write.

    time_format is for timestamps where datetime_format is not given. float_decimals rounds half away from zero;
    use_grouping sets commas between thousands; accounting_negatives writes -x as (x).
    """
    if quote_style not in ("necessary", "always", "never", "non_numeric"):
        raise InvalidArgumentError(f"unknown quote style {quote_style}")
    columns, q = [], quote_char
    for c, t in frame.schema.items():
        x = F.col(f"`{c}`")
        numeric = isinstance(t, (T.NumericType, T.BooleanType))
        if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
            s = F.to_json(x)
        elif isinstance(t, T.DateType):
            s = F.date_format(x, date_format or "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            s = F.date_format(x, datetime_format or time_format or "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif isinstance(t, T.NumericType):
            s = _number(x, t, float_decimals, use_grouping, accounting_negatives)
        else:
            s = x.cast("string")
        quoted = F.concat(F.lit(q), F.replace(s, F.lit(q), F.lit(q + q)), F.lit(q))
        if quote_style == "always" or quote_style == "non_numeric" and not numeric:
            s = quoted
        elif quote_style == "necessary":
            s = F.when(F.contains(s, F.lit(separator)) | F.contains(s, F.lit(q)) | s.rlike(r"[\r\n]"), quoted).otherwise(s)
        columns.append(F.coalesce(s, F.lit(null_value)))
    head = separator.join(c if quote_style in ("necessary", "never", "non_numeric") and not any(x in c for x in (separator, q, "\n")) else q + c.replace(q, q + q) + q for c in frame.columns)
    lines = frame._sorted().select(F.concat_ws(separator, *columns).alias("value"))
    if path is None:
        rows = [r["value"] for r in lines.collect()]
        return ("﻿" if include_bom else "") + "".join(x + line_terminator for x in ([head] if include_header else []) + rows)
    try:
        if include_header:
            # each file begins with the header, as Spark's own writer has it
            frame_out = lines.withColumnRenamed("value", head)
            frame_out.write.option("header", True).option("quote", "").option("sep", "\u0001").option("lineSep", line_terminator).mode("errorifexists").csv(path)
        else:
            lines.write.option("lineSep", line_terminator).text(path)
    except Exception as e:
        raise IOStreamError(str(e)) from e
    return None
