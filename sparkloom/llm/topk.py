"""Exact top-k search by inner product: columnar branch and bound.

Vectors are quantised to integers and stored in blocks in vertical layout (dimension by dimension). For a block of
queries and a block of vectors, scores accumulate dimension block by dimension block; what the remaining dimensions can
add is bounded by the remaining masses (Cauchy-Schwarz), pairs whose bound stays below the query's k-th best score so far
are dropped, and the survivors are compacted. The first blocks are met for all pairs in one product, the bound included,
as many as left few pairs alive before; the bounds allow for rounding, and what survives them is scored exactly. Where
sums stay below 2^24 (2^53), float32 (float64) is exact; beyond, float64 sums with an error bound choose the pairs that
can be among the best, and these are scored in integers of any size.

The stated query set meets all vectors block by block: data blocks are dealt over cells, query blocks over groups, and a
task of its own takes each cell with each group. It holds its group's queries (`GROUP_BYTES` at most) and their best, and
reads its data blocks once. Copies are bounded: with `TASKS` tasks at most, unless the queries need more groups, and the
numbers of cells and groups by those of vectors and queries, what is shuffled is about 2 sqrt(TASKS x vectors x queries)
rows, in proportion to the table. Each task returns k rows for a query at most, packed by query block, and these are merged.
Of large tables, a `FIRST`th of the blocks is met before the others, whose tasks all begin with the thresholds of that.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; only
vectors of the query's length are compared; a score among the best that a long can't hold is an error, and so is a
component that no double can hold when scaled; rows that repeat an id are candidates each, and as queries count once (the
least vector); all candidates are returned if there are fewer than k; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored

K = 5
SCALE = 256
BLOCK_VECTORS, QUERY_BLOCK = 4096, 256
BLOCK_BYTES, GROUP_BYTES = 2 << 20, 64 << 20
TASKS = 256
DIMENSIONS = 16
#: From so many vectors on, one block in FIRST is met before the others (for k up to FIRST_K: best are held packed).
FIRST, FIRST_VECTORS, FIRST_K = 16, 1 << 20, 1000
#: Below this share of live pairs they are compacted.
SPARSE = 0.002
#: Products are made in parts of so many pairs, which stay in a core's cache.
PART = 1 << 18
#: Met so often, blocks try fewer dimensions for all pairs.
TRY = 16
_BLOCK = "block long, dims int, ids binary, data binary"  # data: int16, or int32 or float64 where that is too small
_RESULT = "query_id long, rank int, vec_id long, score long"
_FOUND = "block long, query_id binary, score binary, vec_id binary"


def _blocks(most: int, scale: int):
    def run(batches):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, {}

        def blocks(dims, width, least):
            """Of what is held: full blocks, and the rest if it has least vectors."""
            nonlocal made
            size = max(1, min(most, BLOCK_BYTES // (width * dims + 8)))
            if sum(len(x[0]) for x in held[dims, width]) < min(size, least):
                return
            ids, rows = (np.concatenate(x) for x in zip(*held[dims, width]))
            s = 0
            while len(ids) - s >= min(size, least) and s < len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([dims], pa.int32()), pa.array([ids[s : s + size].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows[s : s + size].T).tobytes()], pa.binary())], names=["block", "dims", "ids", "data"])
                made, s = made + 1, s + size
            held[dims, width] = [(ids[s:], rows[s:])]

        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            size = np.diff(offsets)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            with np.errstate(all="ignore"):
                whole = np.floor(scale * np.nan_to_num(values))
            width = np.full(len(size), 2)
            for bits, wider in ((15, 4), (31, 8)):
                large = np.concatenate([[0], np.cumsum(np.abs(whole) >= 2.0**bits)])
                width[large[offsets[1:]] > large[offsets[:-1]]] = wider
            for dims, wide in np.unique(np.stack([size[good], width[good]], axis=1), axis=0).tolist():
                k = np.flatnonzero(good & (size == dims) & (width == wide))
                held.setdefault((dims, wide), []).append((ids[k], whole[offsets[k][:, None] + np.arange(dims)].reshape(len(k), dims).astype({2: np.int16, 4: np.int32, 8: np.float64}[wide])))
                yield from blocks(dims, wide, most)
        for dims, wide in list(held):
            yield from blocks(dims, wide, 1)

    return run


def _ranked(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) rows (query, score, vec_id) of each query, in order, and their ranks from 0."""
    rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]
    rank = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[rank < k], rank[rank < k]


class Best:
    """The k best (score, then smaller id) of each of a block's queries so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self._rows, self._new, self._count = np.empty((0, 3), dtype=np.int64), [], 0  # query's index, score, vec_id
        self.threshold = np.full(len(ids), -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        other = vec_id != self.ids[q]
        self._new.append(np.stack([q[other], score[other].astype(np.int64), vec_id[other]], axis=1))
        self._count += len(self._new[-1])
        if self._count >= len(self.ids):
            self.merge()

    def merge(self) -> None:
        """Raises the thresholds by what was added; until then they are lower ones, which hold too."""
        if self._count:
            self._rows, rank = _ranked(np.concatenate([self._rows, *self._new]), self.k)
            last = self._rows[rank == self.k - 1]
            self.threshold[last[:, 0]] = np.maximum(self.threshold[last[:, 0]], last[:, 1])
        self._new, self._count = [], 0

    def begin(self, query_id: np.ndarray, score: np.ndarray) -> None:
        """Takes thresholds from ranked best of vectors that are not among those to come."""
        query, start, count = np.unique(query_id, return_index=True, return_counts=True)
        query, last = query[count == self.k], (start + count - 1)[count == self.k]
        order = np.argsort(self.ids)
        self.threshold[order[np.searchsorted(self.ids, query, sorter=order)]] = score[last]

    @property
    def rows(self) -> np.ndarray:
        self.merge()
        return self._rows


class Block:
    """Vectors (dims x n) with what each search of them needs."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.most = float(np.abs(data).max(initial=0))
        self._tails: dict[int, np.ndarray] = {}
        self._kept: tuple = (None, None)

    def tail(self, c: int) -> np.ndarray:
        """The masses from dimension c on, rounded up."""
        if c not in self._tails:
            self._tails[c] = np.sqrt((self.data[c:].astype(np.float64) ** 2).sum(axis=0)) * (1 + 2.0**-40)
        return self._tails[c]

    def bounded(self, kind: type, c: int) -> np.ndarray:
        """The first c dimensions and, where there are more, the masses of the others (rounded up in kind, too)."""
        if self._kept[0] != (kind, c):
            more = [self.tail(c)[None] * (1 + 2.0**-20)] if c < len(self.data) else []
            self._kept = (kind, c), np.concatenate([self.data[:c], *more]).astype(kind)
        return self._kept[1]


class Depth:
    """Of blocks of DIMENSIONS, the number met for all pairs before compaction."""

    def __init__(self):
        self.blocks, self.met = 1, 0


_SPACE: dict[type, np.ndarray] = {}


def _space(kind: type, m: int, n: int) -> np.ndarray:
    """An m x n array that the next call of this kind takes again."""
    if kind not in _SPACE or _SPACE[kind].size < m * n:
        _SPACE[kind] = np.empty(m * n, dtype=kind)
    return _SPACE[kind][: m * n].reshape(m, n)


def _nonzero(live: np.ndarray) -> np.ndarray:
    """np.flatnonzero, eight at a time, as few are."""
    whole = len(live) // 8 * 8
    some = np.flatnonzero(live[:whole].view(np.uint64) != 0)
    at, k = np.nonzero(live[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[at] * 8 + k, whole + np.flatnonzero(live[whole:])])


def _live(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, share: float) -> tuple | None:
    """The pairs whose product is at least the query's least, with it; None if they are more than this share of some part's."""
    m, n = len(least), vectors.shape[1]
    found, step = [], max(64, PART // m)
    for s in range(0, n, step):
        part = np.matmul(queries.T, vectors[:, s : s + step], out=_space(least.dtype.type, m, min(step, n - s)))
        rows = np.flatnonzero(part.max(axis=1) >= least)  # most queries have no live pair, once their thresholds are good
        if 2 * len(rows) > m:
            rows = np.arange(m)
        else:
            part = part[rows]
        at = _nonzero(np.greater_equal(part, least[rows, None], out=_space(np.bool_, *part.shape)).ravel())
        if len(at) > share * m * min(step, n - s):
            return None
        q, v = np.divmod(at, part.shape[1])
        found.append((rows[q], v + s, part.ravel()[at].astype(np.float64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Adds to best what the vectors (dims x n) hold for the queries (dims x m)."""
    meet(best, Block(best.ids, queries), Block(ids, vectors), Depth())


def meet(best: Best, queries: Block, vectors: Block, depth: Depth) -> None:
    """Adds to best what the vectors hold for the queries."""
    (dims, n), ids = vectors.data.shape, vectors.ids
    most = vectors.most * queries.most * max(1, dims)
    if most >= 2.0**53:
        best.merge()
        _search_wide(best, queries.data, ids, vectors.data)
        return
    kind = np.float32 if most < 2.0**24 else np.float64
    seed = min(n, 64 * best.k) if np.isneginf(best.threshold).any() else 0
    if seed:  # a first threshold from some of the vectors
        score = queries.data.T.astype(kind) @ vectors.data[:, :seed].astype(kind)
        score[best.ids[:, None] == ids[:seed]] = -np.inf
        least = np.partition(score, seed - best.k, axis=1)[:, seed - best.k, None] if seed > best.k else -np.inf
        q, v = np.nonzero((score >= least) & (score > -np.inf))
        best.add(q, score[q, v], ids[v])
        best.merge()
        ids, n = ids[seed:], n - seed
    if not n or not len(best.ids):
        return
    depth.met += 1
    if depth.met % TRY == 0:
        depth.blocks = max(1, depth.blocks - 1)
    #: What sums of rounded products may be off by: twice the usual bound.
    slack = (2 * dims + 16) * float(np.finfo(kind).eps) * queries.tail(0) * vectors.tail(0).max() + 1
    while True:
        c = min(dims, DIMENSIONS * depth.blocks)
        least = best.threshold if c == dims else np.floor(best.threshold - slack)
        bounds = queries.bounded(kind, c), vectors.bounded(kind, c)[:, seed:]
        live = _live(*bounds, least.astype(kind), 1 if c == dims else SPARSE)
        if live:
            break
        depth.blocks += max(1, depth.blocks // 2)
    q, v, score = live
    if c < dims:
        v += seed
        score -= queries.tail(c)[q] * vectors.tail(c)[v]
        while c < dims and len(q):  # the survivors' next dimensions
            end = min(dims, c + max(DIMENSIONS, c // 2))
            score += _products(queries, vectors, q, v, c, end)
            c = end
            alive = score + queries.tail(c)[q] * vectors.tail(c)[v] >= best.threshold[q] - slack[q]
            q, v, score = q[alive], v[alive], score[alive]
        score = _products(queries, vectors, q, v, 0, dims)
        v -= seed
        alive = score >= best.threshold[q]
        q, v, score = q[alive], v[alive], score[alive]
    best.add(q, score, ids[v])


def _products(queries: Block, vectors: Block, q: np.ndarray, v: np.ndarray, start: int, end: int) -> np.ndarray:
    """The pairs' inner products over dimensions start to end, in float64."""
    out, step = np.empty(len(q)), max(1, (1 << 20) // (end - start))
    for s in range(0, len(q), step):
        left, right = (np.take(x.data[start:end], at[s : s + step], axis=1).astype(np.float64) for x, at in ((queries, q), (vectors, v)))
        out[s : s + step] = np.einsum("ij,ij->j", left, right)
    return out


def _search_wide(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """search beyond exact floats: pairs that may be among the best by a bounded sum, scored exactly."""
    q_all, v_all = queries.astype(np.float64), vectors.astype(np.float64)
    if not (np.isfinite(q_all).all() and np.isfinite(v_all).all()):
        raise OverflowError("a scaled component is beyond double precision")
    with np.errstate(all="ignore"):
        score = q_all.T @ v_all
        slack = (len(v_all) + 2) * 2.0**-51 * (np.abs(q_all).T @ np.abs(v_all))
        low, high = score - slack, score + slack
    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)
    same = best.ids[:, None] == ids
    low[same], high[same] = -np.inf, -np.inf
    least = np.nextafter(best.threshold, -np.inf)
    if len(ids) >= best.k:
        least = np.maximum(least, np.partition(low, len(ids) - best.k, axis=1)[:, len(ids) - best.k])
    q, v = np.nonzero((high >= least[:, None]) & ~same)
    exact = [sum(int(a) * int(b) for a, b in zip(q_all[:, i], v_all[:, j])) for i, j in zip(q.tolist(), v.tolist())]
    if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
        raise OverflowError("a score is beyond 64 bits")
    best.add(q, np.array(exact, dtype=np.int64), ids[v])


def _packed(block: int, *parts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["block", "query_id", "score", "vec_id"])


def _search_batches(k: int):
    """Of a task's blocks, first queries (side 0) and then vectors: a row of packed best for each block of queries."""

    def run(batches):
        asked: dict[int, list[tuple[int, Best, Block]]] = {}
        depths: dict[int, Depth] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, dims = np.frombuffer(row["ids"], dtype=np.int64), row["dims"]
                kind = {4: np.int32, 8: np.float64}.get(len(row["data"]) // max(1, len(ids) * dims), np.int16)
                block = Block(ids, np.frombuffer(row["data"], dtype=kind).reshape(dims, len(ids)))
                if row["side"] == 0:
                    asked.setdefault(dims, []).append((row["block"], best := Best(ids, k), block))
                    if row["query_id"]:
                        best.begin(*(np.frombuffer(row[x], dtype=np.int64) for x in ("query_id", "score")))
                    continue
                for _, best, queries in asked.get(dims, []):
                    meet(best, queries, block, depths.setdefault(dims, Depth()))
        for name, best, _ in (x for held in asked.values() for x in held):
            for s in range(0, len(best.rows), 1 << 16):
                r = best.rows[s : s + (1 << 16)]
                yield _packed(name, best.ids[r[:, 0]], r[:, 1], r[:, 2])

    return run


def _merge_batches(k: int, packed: bool = False):
    """Of packed best in the order of their blocks: a row for each query and rank, or a packed one for each block."""

    def made(name, rows):
        rows, rank = _ranked(rows, k)
        if packed:
            yield _packed(name, *rows.T)
            return
        for s in range(0, len(rows), 1 << 16):
            r = rows[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(rank[s : s + (1 << 16)] + 1, pa.int32()), pa.array(r[:, 2]), pa.array(r[:, 1])], names=["query_id", "rank", "vec_id", "score"])

    def run(batches):
        name, held, count = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != name and held:
                    yield from made(name, np.concatenate(held))
                    held, count = [], 0
                name = row["block"]
                held.append(np.stack([np.frombuffer(row[x], dtype=np.int64) for x in ("query_id", "score", "vec_id")], axis=1))
                count += len(held[-1])
                if count > max(1 << 18, 4 * k * QUERY_BLOCK):
                    held = [_ranked(np.concatenate(held), k)[0]]
                    count = len(held[0])
        if held:
            yield from made(name, np.concatenate(held))

    return run


def grid(vectors: int, queries: int, query_bytes: int, tasks: int) -> tuple[int, int]:
    """Cells of vectors and groups of queries for so many tasks: vectors are copied groups times, queries (and their best) cells times."""
    groups = min(tasks, round(math.sqrt(2 * tasks * queries / max(1, vectors))))
    groups = max(1, groups, -(-query_bytes // GROUP_BYTES))
    return max(1, -(-tasks // groups)), groups


def _found(asked: DataFrame, data: DataFrame, k: int, cells: int, groups: int) -> DataFrame:
    """Packed best of each group of query blocks in each cell of data blocks."""

    def copied(df, side, of, others, at):
        own, other = F.pmod(F.xxhash64("block"), F.lit(of)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.withColumn("own", own).withColumn("other", other).select(at.cast("int").alias("at"), F.lit(side).alias("side"), *df.columns)

    asked = copied(asked, 0, groups, cells, F.col("other") * groups + F.col("own"))
    data = copied(data, 1, cells, groups, F.col("own") * groups + F.col("other"))
    met = asked.unionByName(data, allowMissingColumns=True).repartitionById(cells * groups, F.col("at")).sortWithinPartitions("side")
    return map_arrow(met, _search_batches(k), _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries (vec_id, embedding) its k best of vectors, itself apart."""
    spark = vectors.sparkSession
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.select(*pick).filter(F.col("vec_id").isNotNull() & sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(map_arrow(asked, _blocks(QUERY_BLOCK, scale), _BLOCK), "queries")
    data = stored(map_arrow(vectors.select(*pick), _blocks(BLOCK_VECTORS, scale), _BLOCK), "vectors")
    tasks = min(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    m, size = asked.agg(F.sum(F.length("ids")), F.sum(F.length("ids") + F.length("data"))).first()
    n = data.agg(F.sum(F.length("ids"))).first()[0]
    m, n, size = (m or 0) // 8, (n or 0) // 8, size or 0
    asked = asked.withColumn("query_id", F.lit(None).cast("binary")).withColumn("score", F.lit(None).cast("binary"))

    def merged(found, schema, packed=False):
        return map_arrow(found.repartition("block").sortWithinPartitions("block"), _merge_batches(k, packed), schema)

    if n < FIRST_VECTORS or k > FIRST_K:
        return merged(_found(asked, data, k, *grid(n, m, size, tasks)), _RESULT)
    part = F.pmod(F.hash("block"), F.lit(FIRST))
    first = stored(merged(_found(asked, data.filter(part == 0), k, *grid(n // FIRST, m, size, -(-tasks // 4))), _FOUND, packed=True), "first")
    asked = asked.drop("query_id", "score").join(first.drop("vec_id"), "block", "left")
    return merged(_found(asked, data.filter(part != 0), k, *grid(n, m, size, tasks)).unionByName(first), _RESULT)
