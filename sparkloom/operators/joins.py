"""Joins: equi, theta and as-of. Catalyst picks the physical join; nothing is broadcast by hand."""

from __future__ import annotations

import math
import operator
import re
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFoundError, InvalidArgumentError, SchemaError
from ..functions.entry import parse_duration
from ..functions.expr import Context, Expr, to_expr, truthy
from ..types import is_float
from .frame import ORD, Frame
from .ranges import PART, ROW, in_ranges

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}
_R = "__ord_r_"
#: Rows of a block of a theta join, and of a group of rows of one key.
BLOCK = 4096
_COMPARED = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def _right(other: Frame):
    """The right side under names of its own, its order columns as well."""
    return other._df.select(*[F.col(f"`{c}`").alias(f"{_R}{c}") for c in other._df.columns])


def _need(frame: Frame, names: list[str]) -> None:
    unknown = [n for n in names if n not in frame.columns]
    if unknown:
        raise ColumnNotFoundError(f"no column {', '.join(unknown)}")


def _output(left: Frame, other: Frame, keys: list[tuple[str, str]], coalesce: bool, suffixes, key_value) -> list[Column]:
    """Output columns: left ones (keys coalesced), then right ones, renamed where they clash."""
    right_keys = {r for _, r in keys} if coalesce else set()
    right_names = [c for c in other.columns if c not in right_keys]
    key_of = dict(keys)
    out, taken = [], set()
    for c in left.columns:
        name = c
        if c not in key_of and c in right_names and suffixes[0]:
            name = c + suffixes[0]
        taken.add(name)
        out.append((key_value(c, key_of[c]) if coalesce and c in key_of else F.col(f"`{c}`")).alias(name))
    for c in right_names:
        name = c
        if name in taken or c in left.columns:
            name = c + (suffixes[1] or "_right")
            base, k = name, 0
            while name in taken:
                k += 1
                name = f"{base}_{k}"
        taken.add(name)
        out.append(F.col(f"`{_R}{c}`").alias(name))
    return out


def _orders(left: Frame, other: Frame, first: str) -> list[Column]:
    own, theirs = [F.col(c) for c in left._order], [F.col(f"{_R}{c}") for c in other._order]
    if not own or not theirs:
        return []
    both = theirs + own if first == "right" else own + theirs
    return [c.alias(f"{ORD}{k}") for k, c in enumerate(both)]


def join(left: Frame, other: Frame, on, left_on, right_on, how: str, join_nulls: bool, coalesce: bool, suffixes, maintain_order) -> Frame:
    """Equi-join. Null keys match only with join_nulls, where keys of very many pairs are dealt out; rows come in left order, then right."""
    if how not in HOW:
        raise InvalidArgumentError(f"unknown join {how}")
    if maintain_order not in (True, False, None, "none", "left", "right", "left_right", "right_left"):
        raise InvalidArgumentError(f"unknown order {maintain_order}")
    if how == "cross":
        if on or left_on or right_on:
            raise InvalidArgumentError("a cross join has no keys")
        pairs: list[tuple[str, str]] = []
    else:
        if on and (left_on or right_on):
            raise InvalidArgumentError("give on, or left_on and right_on")
        lk, rk = (_names(on), _names(on)) if on else (_names(left_on), _names(right_on))
        if not lk or len(lk) != len(rk):
            raise InvalidArgumentError("keys of either side, as many of one as of the other, are needed")
        _need(left, lk)
        _need(other, rk)
        pairs = list(zip(lk, rk))
    right = _right(other)
    if how == "cross":
        joined = left._df.crossJoin(right)
    else:
        match = lambda a, b: F.col(f"`{a}`").eqNullSafe(F.col(f"`{_R}{b}`")) if join_nulls else F.col(f"`{a}`") == F.col(f"`{_R}{b}`")
        joined = left._df.join(right, reduce(lambda x, y: x & y, [match(a, b) for a, b in pairs]), HOW[how])
        if join_nulls and how in ("inner", "left", "right", "outer") and not joined.isStreaming:
            joined = _in_cells(left._df, right, [(a, f"{_R}{b}") for a, b in pairs], HOW[how]) or joined
    if how in ("semi", "anti"):
        return Frame(joined)
    columns = _output(left, other, pairs, coalesce and bool(pairs), suffixes, lambda a, b: F.coalesce(F.col(f"`{a}`"), F.col(f"`{_R}{b}`")))
    return Frame(joined.select(*columns, *_orders(left, other, "right" if str(maintain_order).startswith("right") else "left")))


def _in_cells(left, right, pairs: list[tuple[str, str]], how: str):
    """The join in which null is a key like others, or None if no key has more than BLOCK x BLOCK pairs.

    Such keys, as null often is, would be a task each. Their rows are dealt, by a hash of all their columns, to groups of
    about BLOCK rows of either side, and each pair of groups is a cell with a key of its own. As these keys are on both
    sides, all their rows match, whatever the join; the other keys are joined as ever.
    """
    def counted(df, keys: list[str], name: str):
        return df.groupBy(*[F.col(f"`{k}`").alias(f"{name}{n}") for n, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(name))

    def same(keys: list[str], name: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"{name}{n}")) for n, k in enumerate(keys)])

    def dealt(df, keys: list[str], name: str, own: str, other: str):
        """The rows of hot keys, with the cells in which they meet the other side's."""
        values = [F.col(f"`{f.name}`") for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
        rows = df.join(F.broadcast(hot), same(keys, name)).withColumn(own, F.pmod(F.xxhash64(*values), F.col(f"{own}s")))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))
        cell = F.shiftleft("__ord_hot", 40) + F.shiftleft("__ord_row", 20) + F.col("__ord_column")
        return rows.withColumn("__ord_cell", cell).select(*[F.col(f"`{c}`") for c in df.columns], "__ord_cell")

    lk, rk = [a for a, _ in pairs], [b for _, b in pairs]
    x, y = "__ord_x", "__ord_y"
    both = counted(left, lk, x).join(counted(right, rk, y), reduce(operator.and_, [F.col(f"{x}{n}").eqNullSafe(F.col(f"{y}{n}")) for n in range(len(pairs))]))
    groups = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    hot = both.filter(F.col(x).cast("double") * F.col(y) > BLOCK**2).withColumns({"__ord_rows": groups(x), "__ord_columns": groups(y), "__ord_hot": F.row_number().over(Window.orderBy(*[f"{x}{n}" for n in range(len(pairs))])).cast("long")})
    cells = hot.agg(F.sum(F.col("__ord_rows") * F.col("__ord_columns"))).first()[0]
    if not cells:
        return None
    most = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(most, min(cells, 4 * most))
    a, b = dealt(left, lk, x, "__ord_row", "__ord_column"), dealt(right, rk, y, "__ord_column", "__ord_row")
    # tasks of their own number: small partitions of many pairs are not put together, nor either side sent to all tasks
    met = a.repartition(tasks, "__ord_cell").join(b.repartition(tasks, "__ord_cell").hint("merge"), "__ord_cell").drop("__ord_cell")
    cold = left.join(F.broadcast(hot), same(lk, x), "left_anti").join(right.join(F.broadcast(hot), same(rk, y), "left_anti"), reduce(operator.and_, [F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")) for a, b in pairs]), how)
    return met.union(cold)


def join_where(left: Frame, other: Frame, predicates, how: str, suffixes) -> Frame:
    """Theta join: all predicates hold; they name a clashing right column with its suffix.

    Equal values are left to Catalyst, which joins by them. Without any, comparisons of a left with a right value (<, <=, >,
    >=) decide which blocks of rows meet, and without either all pairs do.
    """
    if how not in ("inner", "left", "right"):
        raise InvalidArgumentError(f"a theta join can't be {how}")
    flat = [p for x in predicates for p in (x if isinstance(x, (list, tuple)) else [x])]
    if not flat:
        raise InvalidArgumentError("a theta join needs a predicate")
    columns = _output(left, other, [], False, suffixes, None)
    # a scope in which predicates see the output's names
    scope_left = left._df.select("*")
    names = {}
    right = other._df
    taken = set(left._df.columns)
    for c in other._df.columns:
        name = c if c not in taken else c + (suffixes[1] or "_right")
        names[c] = name
        right = right.withColumnRenamed(c, name)
    probe = scope_left.limit(0).crossJoin(right.limit(0))
    ctx = Context(probe, [])
    condition = reduce(lambda x, y: x & y, [truthy(p.build(ctx), ctx) for p in flat])
    conjuncts = [x for p in flat for x in _between(p, ctx, scope_left, right)]
    between = [x for x in conjuncts if x]
    joined = scope_left.join(right, condition, how)
    # whole rows without a match are told apart by joins, in which maps can't be
    told_apart = len(between) == len(conjuncts) or how == "inner" or not re.search("map<|variant", (scope_left if how == "left" else right).schema.simpleString())
    hashed = any(_hashed(p, ctx) for p in flat)
    if between and told_apart and not hashed and not joined.isStreaming:
        joined = _theta(scope_left, right, between, len(between) < len(conjuncts), condition, how, left._order, [names[c] for c in other._order])
    back = joined.select(*[F.col(f"`{c}`") for c in left._df.columns], *[F.col(f"`{names[c]}`").alias(f"{_R}{c}") for c in other._df.columns])
    return Frame(back.select(*columns, *_orders(left, other, "left")))


def _hashed(p: Expr, ctx: Context) -> bool:
    """Whether p needs two values to be equal, of types whose comparison Catalyst sees as a key."""
    op, a, b = p.parts or (None, None, None)
    if op == "&":
        return _hashed(a, ctx) or _hashed(b, ctx)
    return op == "==" and not any(x.is_literal or is_float(ctx.dtype(x.build(ctx))) for x in (a, b))


def _between(p: Expr, ctx: Context, left, right) -> list[tuple[Column, str, Column] | None]:
    """What p needs to hold: left value, operator, right value, of types whose order casts keep; None for any other predicate."""
    if p.parts is None or p.has_agg or p.is_over:
        return [None]
    op, a, b = p.parts
    if op == "&":
        return [*_between(a, ctx, left, right), *_between(b, ctx, left, right)]
    if op == "==" or a.is_literal or b.is_literal:
        return [None]

    def kind(df, c: Column) -> T.DataType | None:
        try:
            return df.select(c.alias("x")).schema[0].dataType
        except AnalysisException:
            return None

    x, y = a.build(ctx), b.build(ctx)
    for v, o, w in ((x, op, y), (y, _TURNED[op], x)):
        s, t = kind(left, v), kind(right, w)
        if s is not None and t is not None:
            numbers = isinstance(s, T.NumericType) and isinstance(t, T.NumericType)
            return [(v, o, w)] if numbers or s == t and isinstance(s, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else [None]
    return [None]


def _theta(left, right, between, more: bool, condition: Column, how: str, left_order: list[str], right_order: list[str]):
    """The theta join of two sides whose names differ, without meeting all pairs of rows.

    Rows that the other side's least and greatest values rule out are left aside. The rest of either side is cut into
    blocks of BLOCK rows, near each other in the first two compared values; pairs of blocks whose bounds allow a match are
    the cells in which rows meet. Each cell is a key of its own, so that neither memory nor a task grows with the input.
    Whether a row has a match depends on its compared values, and on the rest of it if there are more predicates: rows
    without one are those whose values no match has.
    """
    def valued(df, values: list[Column], name: str):
        keys = [f"__ord_{name}{k}" for k in range(len(values))]
        rows = df.withColumns(dict(zip(keys, values)))
        for k in keys:
            rows = rows.filter(F.col(k).isNotNull() & ~F.isnan(k) if is_float(rows.schema[k].dataType) else F.col(k).isNotNull())
        return rows, keys

    def ends(keys: list[str]) -> list[Column]:
        return [f(k).alias(f"{k}_{end}") for k in keys for end, f in (("low", F.min), ("high", F.max))]

    def may_match(x_end: bool, y_end: bool) -> Column:
        """All comparisons, with the ends of either side that allow most instead of its values."""
        made = F.lit(True)
        for x, (_, op, _), y in zip(a_keys, between, b_keys):
            low, high = ("_low", "_high") if op[0] == "<" else ("_high", "_low")
            made = made & _COMPARED[op](F.col(x + low * x_end), F.col(y + high * y_end))
        return made

    def blocks(rows, keys: list[str], order: list[str], name: str):
        cut = max(1, -(-rows.count() // BLOCK))
        most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = min(most, cut if len(keys) == 1 else math.ceil(cut**0.5))
        by = [F.col(k) for k in keys]
        # rows of equal values are dealt by their order; within a range the second value leads
        made = in_ranges(rows, by + [F.col(c) for c in order], parts, by[1:] + by[:1])
        return made.withColumn(name, F.shiftleft(F.col(PART).cast("long"), 33) + F.floor(F.col(ROW) / BLOCK)).drop(PART, ROW)

    a, a_keys = valued(left, [x for x, _, _ in between], "a")
    b, b_keys = valued(right, [y for _, _, y in between], "b")
    a_ends, b_ends = a.agg(*ends(a_keys)), b.agg(*ends(b_keys))
    a = blocks(a.join(F.broadcast(b_ends), may_match(False, True)).drop(*b_ends.columns), a_keys, left_order, "__ord_a")
    b = blocks(b.join(F.broadcast(a_ends), may_match(True, False)).drop(*a_ends.columns), b_keys, right_order, "__ord_b")
    cells = a.groupBy("__ord_a").agg(*ends(a_keys)).join(F.broadcast(b.groupBy("__ord_b").agg(*ends(b_keys))), may_match(True, True)).select("__ord_a", "__ord_b")
    met = a.join(cells, "__ord_a").join(b.join(cells.withColumnRenamed("__ord_a", "__ord_c"), "__ord_b").withColumnRenamed("__ord_b", "__ord_d"), (F.col("__ord_a") == F.col("__ord_c")) & (F.col("__ord_b") == F.col("__ord_d")) & condition)
    found = met.select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])
    if how == "inner":
        return found
    kept, values, keys = (left, [x for x, _, _ in between], a_keys) if how == "left" else (right, [y for _, _, y in between], b_keys)
    told = [*keys, *(kept.columns if more else [])]
    matched = met.select(*[F.col(f"`{c}`").alias(f"__ord_m{k}") for k, c in enumerate(told)]).distinct()
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__ord_m{k}")) for k, c in enumerate(told)]
    rest = kept.withColumns(dict(zip(keys, values))).join(matched, reduce(lambda x, y: x & y, same), "left_anti")
    types = {f.name: f.dataType for f in found.schema.fields}
    return found.union(rest.select(*[F.col(f"`{c}`") if c in kept.columns else F.lit(None).cast(types[c]).alias(c) for c in found.columns]))


def join_asof(left: Frame, other: Frame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, by=None, left_by=None, right_by=None, strategy: str = "backward", tolerance: Any = None, allow_exact_matches: bool = True, suffixes=("", "_right"), check_sorted: bool = False) -> Frame:
    """Each left row with the nearest right row by key: the last at or before, the first at or after, or the nearer.

    Both sides go through one window per `by` group, ordered by key: one shuffle, no pairs of rows. Without `by` the
    windows are ranges of the key, and each range takes over the last right row before it and the first after it. The
    nearest of two equally far rows is the earlier. A null left key, or one without a row within the tolerance, has nulls.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise InvalidArgumentError(f"unknown strategy {strategy}")
    lk, rk = left_on or on, right_on or on
    lb, rb = _names(left_by or by), _names(right_by or by)
    if not lk or not rk or len(lb) != len(rb):
        raise InvalidArgumentError("as-of joins need a key of either side, and as many by columns")
    _need(left, [lk, *lb])
    _need(other, [rk, *rb])
    if check_sorted:
        for frame, key in ((left, lk), (other, rk)):
            w = Window.orderBy(*frame._need_order())
            if not frame._df.select((F.lag(key).over(w) > F.col(key)).alias("x")).filter("x").isEmpty():
                raise InvalidArgumentError(f"{key} is not sorted")

    def number(c: Column, t: T.DataType) -> Column:
        return F.unix_micros(c.cast("timestamp")) if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else c

    timed = isinstance(left.schema[lk], (T.TimestampType, T.TimestampNTZType, T.DateType))
    limit = None if tolerance is None else (parse_duration(tolerance) if isinstance(tolerance, str) else tolerance) * (1000 if timed else 1)
    own = F.struct(*[F.col(f"`{c}`") for c in left._df.columns]).alias("l")
    value = F.struct(*[F.col(f"`{c}`") for c in other._df.columns]).alias("r")
    own_order, their_order = (F.struct(*f._order) if f._order else F.struct(F.lit(0).alias("o")) for f in (left, other))
    keys = [f"b{k}" for k in range(len(lb))]
    a = left._df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(lb, keys)], number(F.col(f"`{lk}`"), left.schema[lk]).alias("t"), F.lit(0).alias("side"), own_order.cast("string").alias("o"), own, F.lit(None).cast(other._df.select(value).schema[0].dataType).alias("r"))
    b = other._df.filter(F.col(f"`{rk}`").isNotNull()).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rb, keys)], number(F.col(f"`{rk}`"), other.schema[rk]).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("o"), F.lit(None).cast(left._df.select(own).schema[0].dataType).alias("l"), value)
    b = b.withColumn("place", their_order_column(other))
    a = a.withColumn("place", F.lit(None).cast(b.schema["place"].dataType))
    rows = a.unionByName(b)
    found = F.when(F.col("side") == 1, F.struct("t", "r"))
    if not keys:
        rows = in_ranges(rows, [F.col("t")])
    w = Window.partitionBy(*(keys or [PART]))
    back = F.last(found, True).over(w.orderBy("t", F.desc("side") if allow_exact_matches else F.asc("side"), "place").rowsBetween(Window.unboundedPreceding, 0))
    # the way back, too, is a running frame: one from each row to the end would be made anew for each row
    ahead = F.last(found, True).over(w.orderBy(F.desc("t"), F.desc("side") if allow_exact_matches else F.asc("side"), F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    if not keys:
        rows, back, ahead = _beyond_ranges(rows, found, back, ahead)
    if strategy == "nearest":
        rows = rows.withColumn("x", back).withColumn("y", ahead)
        nearer = F.col("x").isNotNull() & (F.col("y").isNull() | (F.col("t") - F.col("x.t") <= F.col("y.t") - F.col("t")))
        rows = rows.withColumn("m", F.when(nearer, F.col("x")).otherwise(F.col("y")))
    else:
        rows = rows.withColumn("m", back if strategy == "backward" else ahead)
    within = F.col("t").isNotNull() if limit is None else F.col("t").isNotNull() & (F.abs(F.col("t") - F.col("m.t")) <= limit)
    got = rows.filter("side = 0").withColumn("m", F.when(within, F.col("m")))
    flat = got.select(*[F.col(f"l.`{c}`").alias(c) for c in left._df.columns], *[F.col(f"m.r.`{c}`").alias(f"{_R}{c}") for c in other._df.columns])
    pairs = [*zip(lb, rb)] + ([(lk, rk)] if lk == rk else [])
    columns = _output(left, other, pairs, True, suffixes, lambda x, _: F.col(f"`{x}`"))
    return Frame(flat.select(*columns, *[F.col(c) for c in left._order]))


def _beyond_ranges(rows, found: Column, back: Column, ahead: Column):
    """Rows with the nearest right rows outside their range, and what back and ahead are with them."""
    at = F.when(F.col("side") == 1, F.struct("t", "place"))
    ends = rows.groupBy(PART).agg(F.min_by(found, at).alias("first"), F.max_by(found, at).alias("last"))
    # one row for each range
    w = Window.orderBy(PART)
    before = F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before")
    after = F.last("first", True).over(Window.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)).alias("after")
    local = rows.withColumns({"back": back, "ahead": ahead})
    joined = local.join(F.broadcast(ends.select(F.col(PART).alias("range"), before, after)), F.col(PART) == F.col("range"))
    return joined, F.coalesce("back", "before"), F.coalesce("ahead", "after")


def their_order_column(other: Frame) -> Column:
    return F.struct(*[F.col(f"r.`{c}`") for c in other._order]) if other._order else F.struct(F.lit(0).alias("o"))
