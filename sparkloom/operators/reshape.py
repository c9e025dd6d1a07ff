"""Reshaping: concatenation, explode, pivot, unpivot, transpose, unstack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, FrameError, InvalidArgumentError, SchemaError, ShapeError
from ..functions.expr import Expr
from .frame import ORD, Frame


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def _plain(types) -> T.DataType | None:
    """The one type that holds all: text beside anything, doubles among numbers; None if they are equal."""
    if len({t.simpleString() for t in types}) == 1:
        return None
    return T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()


def concat(frames: list[Frame], how: str = "vertical", strict: bool = True) -> Frame:
    if how not in ("vertical", "horizontal", "diagonal"):
        raise InvalidArgumentError(f"unknown way {how}")
    if not frames:
        raise InvalidArgumentError("nothing to concatenate")
    if how == "horizontal":
        return _beside(frames, strict)
    frames = [f for f in frames if f.columns] or frames[:1]
    first = frames[0]
    types: dict[str, T.DataType] = {}
    for f in frames:
        if how == "vertical" and f.columns != first.columns:
            raise FrameError(f"columns {f.columns} beside {first.columns}")
        for c, t in f.schema.items():
            if types.setdefault(c, t) != t and not isinstance(t, T.NullType):
                raise SchemaError(f"{c} is {t.simpleString()} beside {types[c].simpleString()}")
    orders = {tuple(f._df.schema[c].dataType.simpleString() for c in f._order) for f in frames}
    ordered = len(orders) == 1 and () not in orders
    parts = []
    for k, f in enumerate(frames):
        keys = [F.lit(k).alias(f"{ORD}0"), *[F.col(c).alias(f"{ORD}{i + 1}") for i, c in enumerate(f._order)]] if ordered else []
        parts.append(f._df.select(*f.columns, *keys))
    return Frame(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=how == "diagonal"), parts))


def _beside(frames: list[Frame], strict: bool) -> Frame:
    names = [c for f in frames for c in f.columns]
    if len(set(names)) < len(names):
        raise FrameError("columns of one name")
    if strict and len({f.height for f in frames}) > 1:
        raise ShapeError("frames of different heights")
    parts = [f.with_row_index("__ord_at")._df.select(*f.columns, F.col("__ord_at").alias(f"{ORD}0")) for f in frames]
    return Frame(reduce(lambda a, b: a.join(b, f"{ORD}0", "full"), parts).select(*names, f"{ORD}0"))


def explode(frame: Frame, columns, empty_as_null: bool, keep_nulls: bool) -> Frame:
    """Lists to rows, several in lock-step (unequal lengths are an error); other values are lists of one."""
    names = [c.name if isinstance(c, Expr) else c for c in (columns if isinstance(columns, (list, tuple)) else [columns])]
    unknown = [c for c in names if c not in frame.columns]
    if unknown:
        raise ColumnNotFoundError(f"no column {', '.join(unknown)}")
    df, lists = frame._df, []
    for c in names:
        x = F.col(f"`{c}`")
        if isinstance(frame.schema[c], T.ArrayType):
            if not keep_nulls:
                df = df.filter(x.isNotNull())
            if not empty_as_null:
                df = df.filter(x.isNull() | (F.size(x) > 0))
            none = F.array(F.lit(None).cast(frame.schema[c].elementType))
            lists.append(F.when(x.isNull() | (F.size(x) == 0), none).otherwise(x).alias(c))
        else:
            lists.append(F.array(x).alias(c))
    zipped = F.arrays_zip(*[x.alias(f"c{k}") for k, x in enumerate(lists)])
    if len(lists) > 1:
        sizes = [F.size(x) for x in lists]
        same = reduce(lambda a, b: a & b, [s == sizes[0] for s in sizes[1:]])
        df = df.withColumn("__ord_zip", F.when(same, zipped).otherwise(F.raise_error(F.lit("lists of different lengths")).cast(df.select(zipped).schema[0].dataType)))
    else:
        df = df.withColumn("__ord_zip", F.transform(lists[0], lambda v: F.struct(v.alias("c0"))))
    rest = [c for c in frame.columns if c not in names]
    out = df.select(*rest, *frame._order, F.posexplode("__ord_zip").alias("__ord_pos", "__ord_row"))
    fields = {c: F.col("__ord_row").getField(out.schema["__ord_row"].dataType.names[k]) for k, c in enumerate(names)}
    shown = [fields[c].alias(c) if c in fields else F.col(f"`{c}`") for c in frame.columns]
    return Frame(out.select(*shown, *frame._order, *([F.col("__ord_pos").alias(f"{ORD}{len(frame._order)}")] if frame._order else [])))


def pivot(frame: Frame, index, columns: str, values: str, names: list | None = None) -> Frame:
    """One column for each value of `columns`; of several rows the last counts. names spares the pass that finds them."""
    keys = _names(index)
    if names is None:
        rows = frame._df.groupBy(F.col(f"`{columns}`").alias("v")).agg(*([F.min(F.struct(*frame._order)).alias("o")] if frame._order else []))
        names = [r["v"] for r in (rows.orderBy("o") if frame._order else rows.orderBy("v")).collect()]
    order = F.struct(*frame._order) if frame._order else F.lit(0)
    cells = frame._df.groupBy(*[F.col(f"`{k}`") for k in keys], F.col(f"`{columns}`").alias("__ord_name")).agg(F.max_by(F.struct(F.col(f"`{values}`").alias("v")), order).alias("__ord_v"), F.min(order).alias("__ord_o"))
    made = [F.max(F.when(F.col("__ord_name").eqNullSafe(F.lit(n)), F.col("__ord_v"))).alias(str(n)) for n in names]
    out = cells.groupBy(*keys).agg(*made, F.min("__ord_o").alias(f"{ORD}0"))
    shown = [F.col(f"`{n}`")["v"].alias(str(n)) for n in names]
    return Frame(out.select(*keys, *shown, *([f"{ORD}0"] if frame._order else [])))


def unpivot(frame: Frame, id_vars, value_vars=None, variable_name: str = "variable", value_name: str = "value") -> Frame:
    ids = _names(id_vars)
    names = _names(value_vars) or [c for c in frame.columns if c not in ids]
    if not names:
        raise InvalidArgumentError("no columns to unpivot")
    t = _plain([frame.schema[c] for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("n"), (F.col(f"`{c}`").cast(t) if t else F.col(f"`{c}`")).alias("v")) for c in names])
    out = frame._df.select(*ids, *frame._order, F.posexplode(pairs).alias("__ord_pos", "__ord_p"))
    last = [F.col("__ord_pos").alias(f"{ORD}{len(frame._order)}")] if frame._order else []
    return Frame(out.select(*ids, F.col("__ord_p.n").alias(variable_name), F.col("__ord_p.v").alias(value_name), *frame._order, *last))


def transpose(frame: Frame, include_header: bool = False, header_name: str = "column", column_names=None) -> Frame:
    """Rows become columns, so there must be few; named by a column's values, a list, or column_0 on."""
    source = frame.drop(column_names) if isinstance(column_names, str) else frame
    height = frame.height
    names = frame.cast({}).to_array(column_names) if isinstance(column_names, str) else list(column_names or [f"column_{k}" for k in range(height)])[:height]
    if len(names) < height:
        raise ShapeError("fewer names than rows")
    t = _plain(source.dtypes)
    rows = source.with_row_index("__ord_row")._df
    cells = F.array(*[F.struct(F.lit(c).alias("n"), (F.col(f"`{c}`").cast(t) if t else F.col(f"`{c}`")).alias("v")) for c in source.columns])
    long = rows.select("__ord_row", F.posexplode(cells).alias("__ord_pos", "__ord_p"))
    made = [F.max(F.when(F.col("__ord_row") == k, F.struct(F.col("__ord_p.v").alias("v")))).alias(f"c{k}") for k in range(height)]
    out = long.groupBy("__ord_pos", F.col("__ord_p.n").alias("__ord_n")).agg(*made)
    head = [F.col("__ord_n").alias(header_name)] if include_header else []
    return Frame(out.select(*head, *[F.col(f"c{k}.v").alias(str(n)) for k, n in enumerate(names)], F.col("__ord_pos").alias(f"{ORD}0")))


def unstack(frame: Frame, columns, step: int, how: str = "vertical", fill_value=None) -> Frame:
    """Each column as `step` columns name_0 on: contiguous parts (vertical), or row by row (horizontal)."""
    if step < 1 or how not in ("vertical", "horizontal"):
        raise InvalidArgumentError(f"step {step}, how {how}")
    names = [c.name if isinstance(c, Expr) else c for c in (columns if isinstance(columns, (list, tuple)) else [columns])]
    rows = frame.with_row_index("__ord_row")._df
    height = -(-frame.height // step)
    i = F.col("__ord_row")
    r, k = (i % max(1, height), F.floor(i / max(1, height))) if how == "vertical" else (F.floor(i / step), i % step)
    made = [F.max(F.when(F.col("__ord_k") == j, F.struct(F.col(f"`{c}`").alias("v")))).alias(f"{c}_{j}") for c in names for j in range(step)]
    out = rows.withColumn("__ord_r", r).withColumn("__ord_k", k).groupBy("__ord_r").agg(*made)
    cell = lambda n: F.when(F.col(f"`{n}`").isNull(), F.lit(fill_value)).otherwise(F.col(f"`{n}`")["v"]).alias(n)
    return Frame(out.select(*[cell(f"{c}_{j}") for c in names for j in range(step)], F.col("__ord_r").alias(f"{ORD}0")))
