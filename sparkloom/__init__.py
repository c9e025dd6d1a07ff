"""Spark-native expression DataFrame engine.

    import sparkloom as sl
    frame = sl.Frame(spark.read.parquet("orders.parquet"), order_by="o_orderkey")
    frame.filter(sl.col("o_totalprice") > 1000).group_by("o_orderstatus").agg(sl.col("o_totalprice").mean().alias("mean"))

Every method also answers to its camelCase name.
"""

from .errors import ColumnNotFoundError, ComputeError, EngineError, FrameError, InvalidArgumentError, IOStreamError, SchemaError, ShapeError
from .functions.entry import all_, coalesce, col, duration, element, exclude, horizontal, implode, lit, seq_range, struct, when
from .functions.expr import Expr
from .operators.frame import Frame, data
from .operators.grouped import GroupedData
from .operators.reshape import concat
from .sources.csv import read_csv
from .sources.json import read_json
from .types import Array, Binary, Boolean, Date, Datetime, Decimal, Duration, Float, Float32, Float64, Int8, Int16, Int32, Int64, Integer, Nested, Null, Numeric, Object, SignedInteger, Struct, Temporal, Time, UInt8, UInt16, UInt32, UInt64, UnsignedInteger, Utf8

readCsv, readJson, seqRange = read_csv, read_json, seq_range
all = all_  # noqa: A001
