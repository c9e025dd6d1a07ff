"""JSON: an array, one object or lines, as text or files; out as an array or lines."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FrameError, InvalidArgumentError, IOStreamError
from ..functions.entry import col
from ..operators.frame import ORD, Frame, data
from ..types import DType


def read_json(spark: SparkSession, content: str | None = None, path: str | None = None, format: str = "json", schema: dict[str, DType] | None = None, skip_invalid_lines: bool = False, max_lines: int | None = None, skip_lines: int = 0, reviver=None) -> Frame:
    """A frame of JSON text or files. Of lines, skip_lines that are not blank are left out, and max_lines valid ones read."""
    if (content is None) == (path is None):
        raise InvalidArgumentError("give content or path")
    if format not in ("json", "ndjson"):
        raise InvalidArgumentError(f"unknown format {format}")
    if format == "json" and (max_lines is not None or skip_lines):
        raise InvalidArgumentError("max_lines and skip_lines need format ndjson")
    if path is not None:
        if reviver is not None:
            raise InvalidArgumentError("reviver needs content")
        if max_lines is not None or skip_lines:
            frame = _some_lines(spark, path, skip_invalid_lines, max_lines, skip_lines)
        else:
            reader = spark.read.option("multiLine", format == "json").option("mode", "DROPMALFORMED" if skip_invalid_lines else "FAILFAST")
            frame = Frame(reader.json(path).withColumn(f"{ORD}0", F.monotonically_increasing_id()))
        return frame.select(*schema).cast(schema) if schema else frame
    hook = (lambda o: {k: reviver(k, v) for k, v in o.items()}) if reviver else None
    rows = []
    if format == "json":
        try:
            got = json.loads(content.strip(), object_hook=hook)
        except ValueError as e:
            raise FrameError(f"invalid JSON: {e}") from e
        rows = got if isinstance(got, list) else [got]
    else:
        lines = [x for x in content.split("\n") if x.strip()]  # other line breaks may stand in a string
        for line in lines[skip_lines:]:
            if max_lines is not None and len(rows) >= max_lines:
                break
            try:
                rows.append(json.loads(line, object_hook=hook))
            except ValueError as e:
                if not skip_invalid_lines:
                    raise FrameError(f"invalid JSON: {e}") from e
    if not all(isinstance(r, dict) for r in rows):
        raise FrameError("rows are objects")
    return data(spark, rows, schema)


def _some_lines(spark: SparkSession, path: str, skip_invalid: bool, most: int | None, skipped: int) -> Frame:
    """Lines of the files at a path, in file order, without the first and to a number of valid ones."""
    bad = "__ord_bad"
    lines = spark.read.text(path, lineSep="\n").withColumn(f"{ORD}0", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    lines = Frame(lines).with_row_index("__row").filter(col("__row") >= skipped)
    types = spark.read.option("mode", "DROPMALFORMED").json(path).schema
    parsed = F.from_json("value", T.StructType([*types.fields, T.StructField(bad, T.StringType())]), {"columnNameOfCorruptRecord": bad})
    df = lines._df.withColumn("__parsed", parsed)
    names = [F.col(f"__parsed.`{c}`").alias(c) for c in types.names]
    if skip_invalid:
        df = df.filter(F.col(f"__parsed.{bad}").isNull())
    else:
        df = df.filter(F.when(F.col(f"__parsed.{bad}").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid JSON: "), F.col("value")))))
    frame = Frame(df.select(*names, *lines._order))
    return frame if most is None else frame.head(most)


def write_json(frame: Frame, path: str | None = None, format: str = "json", date_format: str | None = None, datetime_format: str | None = None, bigint_strategy: str = "number", keys: list[str] | None = None) -> str | None:
    """Text in row order without a path; with one, files of lines, whatever the format, as tasks write them apart.

    Longs are numbers or, with bigint_strategy="string", text; of keys given, only these columns are written.
    """
    if bigint_strategy not in ("number", "string"):
        raise InvalidArgumentError(f"unknown bigint strategy {bigint_strategy}")
    if format not in ("json", "ndjson"):
        raise InvalidArgumentError(f"unknown format {format}")
    options = {"ignoreNullFields": "false"}
    if date_format is not None:
        options["dateFormat"] = date_format
    if datetime_format is not None:
        options["timestampFormat"] = options["timestampNTZFormat"] = datetime_format
    text = [c for c, t in frame.schema.items() if bigint_strategy == "string" and isinstance(t, T.LongType)]
    written = [F.col(f"`{c}`").cast("string").alias(c) if c in text else F.col(f"`{c}`") for c in frame.columns if keys is None or c in keys]
    rows = frame._sorted().select((F.to_json(F.struct(*written), options) if written else F.lit("{}")).alias("value"))
    if path is None:
        got = [r["value"] for r in rows.collect()]
        return f"[{','.join(got)}]" if format == "json" else "".join(x + "\n" for x in got)
    try:
        rows.write.text(path)
    except Exception as e:
        raise IOStreamError(str(e)) from e
    return None
