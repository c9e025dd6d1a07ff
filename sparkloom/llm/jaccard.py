"""N-gram Jaccard join with count vectors in R-trees.

Which documents are linked: those whose sets of word shingles have a Jaccard similarity of at least `SIMILARITY` %.
Equal sets are one vertex. A set is a point: its shingles are hashed into `GROUPS` groups, and the group counts are
indexed in R-trees. The sum of coordinate minima bounds the overlap of two points, or of two nodes by their maxima; a
tree joined with itself gives the pairs that the bound leaves, and these are verified on the sets themselves.

A forest of trees keeps the join from being quadratic. Two linked sets always share a shingle of their prefixes (the
rarest `n - ceil(0.8 n) + 1` of each; rarity is known for heavy shingles only, any order is exact), so there are trees for
shingles, not for all points:

1. Each point is in the trees of `SEEDS` of its shared prefix shingles (those of the least hashes, so that near copies
   choose alike), sorted and cut into trees of `CELL` points and `CELL_SHINGLES` shingles at most, wherever a hot shingle
   falls. Of each tree, every point gives its most likely partner and the partner that most others have. This joins groups
   of near copies into components without comparing all their pairs.
2. Every prefix shingle whose sets still lie in different components has a tree (a frequent one is dealt into blocks, with
   a tree for each pair of blocks). Each point gives its most likely partner of every other component.
3. Shingles of trees that left out a pair in 2, and whose sets still lie in different components, give every pair.

Components of links, by label propagation with pointer jumping over the components so far, give each document its class.

Vertices and shingles are 64-bit hashes (n sets collide with a chance of n^2 / 2^65). Whole sets are shuffled only for
pairs that the bound leaves, in blocks of one tree's pairs each, cut by bytes: a Bloom filter of fixed size picks them
while the texts are read again.

Edge cases: null text, or text without words, has the empty set and links with nothing; fewer words than a shingle's are
one shingle; rows that repeat a doc_id each keep a row; a null doc_id never names a component unless alone in it; an
empty table gives an empty table; other columns are ignored, whatever their names. Texts are read whole, in segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow, shared_dir, spread_join, stored, unused, whole_text

WORDS, SIMILARITY = 5, 80
GROUPS = 512
#: A shingle counts as heavy from so many documents on; so many heavy ones at most are told to all tasks.
HEAVY_LOCAL, HEAVY, MOST_HEAVY = 4, 32, 400_000
#: Trees of a point in the first pass.
SEEDS = 3
#: Points, and shingles of all its points, of a tree.
CELL, CELL_SHINGLES = 1024, 2_000_000
LEAF = 16
#: Pairs that are bounded at once.
STEP_PAIRS = 4096
#: A key is hot from one part in so many of all rows on.
HOT_KEYS = 1000
#: Bytes that are hashed at once.
SEGMENT = 1 << 18
BLOOM_BITS = 24
_U = np.uint64
#: fixed values: odd constants of multiplicative hashing
_R, _M = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_R_INVERSE = pow(_R, -1, 1 << 64)
_STEPS = [pow(_M, k + 1, 1 << 64) for k in range(64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(_M)
    x = (x ^ (x >> _U(29))) * _U(_R)
    return x ^ (x >> _U(32))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group, size = [], 0
    for k, t in enumerate(texts):
        group.append(t.encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size > SEGMENT or k == len(texts) - 1:
            out += _shingle_group(group, words)
            group, size = [], 0
    return out


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of data, which ends in a blank; hashed in segments, so that memory stays bounded."""
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    cut = np.append(np.searchsorted(starts, np.arange(0, len(data), SEGMENT)), len(starts))
    hashes = np.empty(len(starts), dtype=np.uint64)
    for a, b in zip(cut.tolist(), cut[1:].tolist()):
        if a < b:
            at, to, size = starts[a], ends[b - 1], ends[a:b] - starts[a:b]
            place = np.arange(at, to) - np.repeat(starts[a:b], np.diff(np.append(starts[a:b], to)))
            values = ((place.astype(np.uint64) << _U(8)) + _FOLD[data[at:to]] + _U(1)) * _U(_R)
            values = (values ^ (values >> _U(31))) * _U(_M)
            values[blank[at:to]] = 0
            hashes[a:b] = _mix(np.add.reduceat(values ^ (values >> _U(32)), starts[a:b] - at) + size.astype(np.uint64))
    return hashes, starts


def _shingle_group(raw: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    word, starts = _word_hashes(data)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))
    n = len(word) - words + 1
    grams = _mix(sum((word[k : k + n] * _U(_STEPS[k]) for k in range(words)), np.zeros(max(0, n), dtype=np.uint64))) if n > 0 else np.zeros(0, dtype=np.uint64)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(_mix(np.array([sum(int(w) * _STEPS[k] for k, w in enumerate(word[a:b])) + (b - a) & (1 << 64) - 1], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def vertex(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    return n - (SIMILARITY * n + 99) // 100 + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def count_vector(shingles: np.ndarray) -> tuple[bytes, int]:
    """Group counts as bytes, and what they leave out of groups that are fuller."""
    counts = np.bincount((shingles >> _U(20)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), int(np.maximum(counts - 255, 0).sum())


_FIRST = "kind int, doc_id long, n long, key long, counts binary, excess long"


def _describe(words: int):
    """(kind 0) doc_id, size, vertex and count vector of each document; (kind 1) a shingle that a part of the task holds often, and how often."""

    def row(kind, *columns):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(columns[0]), pa.int32()), *columns], names=[x.split()[0] for x in _FIRST.split(", ")])

    def run(batches):
        held, size = [], 0

        def heavy():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= HEAVY_LOCAL
            n = int(often.sum())
            return row(1, pa.nulls(n, pa.int64()), pa.array(count[often], pa.int64()), _signed(value[often]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()))

        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            vectors = [count_vector(s) for s in sets]
            yield row(0, batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([vertex(s) if len(s) else None for s in sets], pa.int64()), pa.array([v for v, _ in vectors], pa.binary()), pa.array([e for _, e in vectors], pa.int64()))
            held += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                yield heavy()
                held, size = [], 0
        if held:
            yield heavy()

    return run


def _keys(words: int, heavy):
    """(token, mixed): a prefix shingle of a set, and its vertex behind a bijection that the shingle keys."""

    def run(batches):
        value, count = heavy.value
        seen: set[int] = set()
        for batch in batches:
            tokens, mixed = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                if not len(s) or (v := vertex(s)) in seen:
                    continue
                seen.add(v)
                if len(value):
                    at = np.minimum(np.searchsorted(value, s), len(value) - 1)
                    s = s[np.argsort(np.where(value[at] == s, count[at], 0), kind="stable")]
                t = s[: prefix_length(len(s))]
                tokens.append(t)
                mixed.append((_U(v & (1 << 64) - 1) ^ t) * _U(_R))
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), _signed(np.concatenate(mixed))], names=["token", "mixed"])

    return run


def _buckets(batches):
    """From rows sorted by token and mixed: token and vertex of tokens with two vertices or more."""
    last = None  # token, mixed of a row whose successor is not yet known; whether its token was written before
    for batch in batches:
        token, mixed = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        if not len(token):
            continue
        before = last is not None and last[2]
        if last is not None:
            token, mixed = np.append(_U(last[0]), token), np.append(_U(last[1]), mixed)
        fresh = np.append(True, (token[1:] != token[:-1]) | (mixed[1:] != mixed[:-1]))
        token, mixed = token[fresh], mixed[fresh]
        same = token[1:] == token[:-1]
        linked = np.append(before, same)  # to the row before
        emit = linked | np.append(same, False)
        emit[-1] = False
        yield pa.RecordBatch.from_arrays([_signed(token[emit]), _signed(((mixed * _U(_R_INVERSE)) ^ token)[emit])], names=["token", "vertex"])
        last = (int(token[-1]), int(mixed[-1]), bool(linked[-1]))
    if last is not None and last[2]:
        own = (last[1] * _R_INVERSE & (1 << 64) - 1) ^ last[0]
        yield pa.RecordBatch.from_arrays([_signed(np.array([x], dtype=np.uint64)) for x in (last[0], own)], names=["token", "vertex"])


def _starts(rows: pa.Table, keys: int) -> np.ndarray:
    """First rows of the runs that agree in the first `keys` columns, and the number of rows."""
    columns = [rows.column(k).to_numpy() for k in range(keys)]
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, [len(rows)]])


def _chunks(batches, keys: int, split=None):
    """Tables of whole runs, from sorted rows; split(table) may cut a run that grows."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        last = int(_starts(rows, keys)[-2])
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last)
        if split is not None:
            *full, held = split(held)
            yield from full
    if held is not None:
        yield held


def _gather(words: int, bloom):
    def run(batches):
        bits, seen = bloom.value, set()
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                if len(s) and (v := vertex(s)) not in seen and bits[(v & (1 << BLOOM_BITS) - 1) >> 3] >> (v & 7) & 1:
                    seen.add(v)
                    rows.append((v, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 2, [pa.int64(), pa.binary()])], names=["vertex", "shingles"])

    return run


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SIMILARITY * (len(both) - common)


def _verify(batches):
    """From rows (block, kind, a, b, shingles) sorted by block and kind, sets (kind 0, of vertex a) before pairs: the similar pairs."""
    for chunk in _chunks(batches, 1):
        start = _starts(chunk, 1).tolist()
        for s, e in zip(start, start[1:]):
            rows = chunk.slice(s, e - s)
            n = int((rows.column("kind").to_numpy() == 0).sum())
            a, b = (rows.column(c).slice(n).to_numpy() for c in ("a", "b"))
            of = {v: np.frombuffer(x.as_buffer(), dtype=np.uint64) for v, x in zip(rows.column("a").slice(0, n).to_pylist(), rows.column("shingles").slice(0, n))}
            keep = np.array([similar(of[x], of[y]) for x, y in zip(a.tolist(), b.tolist())], dtype=bool)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; a pair's block says in whose company it is verified."""
    bloom = _bloom(pairs.select(F.explode(F.array("a", "b")).alias("vertex")))
    sets = map_arrow(texts, _gather(words, bloom), "vertex long, shingles binary").groupBy("vertex").agg(F.first("shingles").alias("shingles"))
    need = pairs.select("block", F.explode(F.array("a", "b")).alias("vertex")).distinct().join(sets, "vertex")
    rows = need.select("block", F.lit(0).alias("kind"), F.col("vertex").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = rows.unionByName(pairs.select("block", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("shingles")))
    return map_arrow(rows.repartition("block").sortWithinPartitions("block", "kind"), _verify, "a long, b long")


class RTree:
    """Points (count vectors) in nodes of `LEAF` children each; a node has its points' coordinate maxima, and least and largest size."""

    def __init__(self, counts: np.ndarray, excess: np.ndarray, size: np.ndarray):
        order = np.lexsort((*counts[:, :4].T, size))
        self.order = order
        self.levels = [(counts[order], excess[order], size[order], size[order])]
        while len(self.levels[-1][0]) > 1:
            c, e, low, high = self.levels[-1]
            cut = np.arange(0, len(c), LEAF)
            self.levels.append((np.maximum.reduceat(c, cut), np.maximum.reduceat(e, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def query(self, counts: np.ndarray, excess: int, size: int) -> np.ndarray:
        """Points that may be similar to the given one."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            c, e, low, high = self.levels[level]
            bound = np.minimum(c[at], counts).sum(axis=1, dtype=np.int64) + np.minimum(e[at], excess)
            near = (100 * high[at] >= SIMILARITY * size) & (100 * size >= SIMILARITY * low[at])
            at = at[near & ((100 + SIMILARITY) * bound >= SIMILARITY * (size + low[at]))]
            if level:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]

    def join(self, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of points that may be similar, and how much of their sizes' sum their overlap may be.

        Nodes meet from the root down: 9 * overlap >= 4 * (size + size) is what 80 % takes, and 5 * size >= 4 * size.
        """
        i = j = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            c, e, low, high = self.levels[level]
            if level < len(self.levels) - 1:
                step = np.arange(LEAF)
                i, j = (np.broadcast_to(x, (len(i), LEAF, LEAF)).ravel() for x in ((i[:, None] * LEAF + step)[:, :, None], (j[:, None] * LEAF + step)[:, None, :]))
                inside = (i < j if level == 0 else i <= j) & (i < len(c)) & (j < len(c))
                i, j = i[inside], j[inside]
            elif level == 0:  # a single point
                return i[:0], j[:0], np.zeros(0)
            near = 100 * high[i] >= SIMILARITY * low[j]  # sizes ascend
            if level == 0 and allowed is not None:
                near &= allowed(self.order[i], self.order[j])
            i, j = i[near], j[near]
            keep, share = np.zeros(len(i), dtype=bool), np.zeros(len(i))
            for s in range(0, len(i), STEP_PAIRS):
                a, b = i[s : s + STEP_PAIRS], j[s : s + STEP_PAIRS]
                bound = np.minimum(c[a], c[b]).sum(axis=1, dtype=np.uint32).astype(np.int64) + np.minimum(e[a], e[b])
                keep[s : s + STEP_PAIRS] = (100 + SIMILARITY) * bound >= SIMILARITY * (low[a] + low[b])
                share[s : s + STEP_PAIRS] = bound / np.maximum(1, low[a] + low[b])
            i, j, share = i[keep], j[keep], share[keep]
        return self.order[i], self.order[j], share


def _points(rows: pa.Table):
    column = rows.column("counts").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    first = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    counts = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=len(column) * GROUPS, offset=first).reshape(-1, GROUPS)
    return counts, *(rows.column(c).to_numpy() for c in ("excess", "n", "vertex"))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Places of the first row of each last key, in the order of the keys before it."""
    order = np.lexsort(keys)
    last = keys[-1][order]
    return order[np.append(True, last[1:] != last[:-1])] if len(order) else order


def _bounded(counts, excess, size, start, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one run each that the bound leaves, and their share. Runs of one leaf are joined together."""
    length = np.diff(start)
    run = np.repeat(np.arange(len(length)), length)
    lone = np.where(length <= LEAF, length, 0)[run]  # a run's rows, if it is one leaf
    i = [np.flatnonzero((run[d:] == run[:-d]) & (lone[d:] > 0)) for d in range(1, LEAF)]
    j = np.concatenate([x + d for d, x in enumerate(i, 1)])
    i = np.concatenate(i)
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    near = (100 * low >= SIMILARITY * high) & allowed(i, j)
    i, j = i[near], j[near]
    bound = np.concatenate([np.zeros(0, dtype=np.int64), *(np.minimum(counts[i[s : s + STEP_PAIRS]], counts[j[s : s + STEP_PAIRS]]).sum(axis=1, dtype=np.uint32) for s in range(0, len(i), STEP_PAIRS))])
    bound += np.minimum(excess[i], excess[j])
    keep = (100 + SIMILARITY) * bound >= SIMILARITY * (size[i] + size[j])
    found = [(i[keep], j[keep], bound[keep] / np.maximum(1, size[i] + size[j])[keep])]
    for s, e in zip(start[:-1][length > LEAF].tolist(), start[1:][length > LEAF].tolist()):
        i, j, share = RTree(counts[s:e], excess[s:e], size[s:e]).join(lambda a, b, s=s: allowed(a + s, b + s))
        found.append((i + s, j + s, share))
    return tuple(np.concatenate(x) for x in zip(*found))


def _everything(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.ones(len(a), dtype=bool)


def likely_pairs(rows: pa.Table, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each tree (a run of rows): each point's most likely partner, and the one that most points have."""
    counts, excess, size, _ = _points(rows)
    i, j, share = _bounded(counts, excess, size, start, _everything)
    a, b, both = np.append(i, j), np.append(j, i), np.append(share, share)
    known = np.bincount(a, minlength=len(size))
    picked = np.append(_first_of(b, -both, a), _first_of(b, -known[b], a))
    return a[picked], b[picked]


def open_pairs(rows: pa.Table, start: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components that the bound leaves, if best a point's most likely one of each component; runs that leave out a pair."""
    counts, excess, size, _ = _points(rows)
    part, side = rows.column("part").to_numpy(), rows.column("side").to_numpy()
    length = np.diff(start)
    two = np.repeat(np.maximum.reduceat(side, start[:-1]) > 0, length)  # two blocks: only pairs across
    i, j, share = _bounded(counts, excess, size, start, lambda a, b: (part[a] != part[b]) & (~two[a] | (side[a] != side[b])))
    if not best or not len(i):
        return i, j, np.zeros(0, dtype=np.int64)
    a, b, both = np.append(i, j), np.append(j, i), np.append(share, share)
    label = np.unique(part, return_inverse=True)[1]
    picked = _first_of(b, -both, a * len(part) + label[b])
    pairs = np.unique(np.minimum(a, b)[picked] * len(part) + np.maximum(a, b)[picked])
    run = np.repeat(np.arange(len(length)), length)
    every, kept = np.bincount(run[i], minlength=len(length)), np.bincount(run[pairs // len(part)], minlength=len(length))
    return pairs // len(part), pairs % len(part), np.flatnonzero(kept < every)


_PAIRS = "block long, a long, b long, token long"


def _blocks(a: np.ndarray, b: np.ndarray, size: np.ndarray, name: int) -> np.ndarray:
    """Blocks of a tree's pairs of rows: the sets of each have CELL_SHINGLES shingles at most, but for single pairs."""
    out, inside, total, block = [], set(), 0, 0
    for x, y in zip(a.tolist(), b.tolist()):
        more = sum(int(size[v]) for v in {x, y} - inside)
        if inside and total + more > CELL_SHINGLES:
            inside, total, block = set(), 0, block + 1
            more = int(size[x]) + int(size[y])
        inside |= {x, y}
        total += more
        out.append(hash((name, block)))
    return np.array(out, dtype=np.int64)


def _pair_batch(a, b, rows: pa.Table, start: np.ndarray, keys: int, left_out=()) -> pa.RecordBatch:
    """Pairs of rows as pairs of vertices in blocks, each block of one run; and shingles of runs that left out a pair."""
    length = np.diff(start)
    run = np.repeat(np.arange(len(length)), length)
    name = np.zeros(len(length), dtype=np.uint64)
    for k in range(keys):
        name = _mix(name * _U(_R) + rows.column(k).to_numpy()[start[:-1]].astype(np.int64).view(np.uint64))
    pairs = np.unique(np.minimum(a, b) * len(rows) + np.maximum(a, b))
    a, b = pairs // len(rows), pairs % len(rows)
    size, key = rows.column("n").to_numpy(), rows.column("vertex").to_numpy()
    block = name.view(np.int64)[run[a]]
    for r in np.flatnonzero(np.add.reduceat(size, start[:-1]) > CELL_SHINGLES).tolist():
        at = run[a] == r
        block[at] = _blocks(a[at], b[at], size, int(name[r]))
    left = np.minimum(key[a], key[b]), np.maximum(key[a], key[b])
    arrays = [pa.array(block, pa.int64()), *(pa.array(x, pa.int64()) for x in left), pa.nulls(len(a), pa.int64())]
    if len(left_out):
        token = pa.array(rows.column(0).to_numpy()[start[:-1]][left_out], pa.int64())
        arrays = [pa.concat_arrays([x, y]) for x, y in zip(arrays, (*[pa.nulls(len(token), pa.int64())] * 3, token))]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _PAIRS.split(", ")])


def _cut_cells(rows: pa.Table) -> list[pa.Table]:
    """A run of one shingle's points in trees of bounded size, the last one open."""
    size = np.cumsum(rows.column("n").to_numpy())
    out, at = [], 0
    while True:
        before = size[at - 1] if at else 0
        stop = min(at + CELL, max(at + 1, int(np.searchsorted(size, before + CELL_SHINGLES, side="right"))))
        if stop >= len(rows):
            return [*out, rows.slice(at)]
        out.append(rows.slice(at, stop - at))
        at = stop


def _seed_trees(batches):
    """Pairs from rows (cell, vertex, n, excess, counts) sorted by cell and vertex."""
    for rows in _chunks(batches, 1, _cut_cells):
        start = _starts(rows, 1)
        a, b = likely_pairs(rows, start)
        if len(a):
            yield _pair_batch(a, b, rows, start, 2)


def seed_pairs(shared: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs of the first pass. Points are dealt by ranges of (cell, vertex): no shingle, however frequent, meets in one task."""
    seeds = shared.groupBy("vertex").agg(*[F.min(F.xxhash64("token", F.lit(k))).alias(f"s{k}") for k in range(SEEDS)])
    rows = vectors.join(seeds, "vertex").withColumn("cell", F.explode(F.array_distinct(F.array(*[f"s{k}" for k in range(SEEDS)]))))
    rows = rows.select("cell", "vertex", "n", "excess", "counts")
    dealt = rows.repartitionByRange(int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "vertex").sortWithinPartitions("cell", "vertex")
    return map_arrow(dealt, _seed_trees, _PAIRS).dropDuplicates(["a", "b"])


def _open_trees(best: bool):
    """Pairs, and shingles that left out some, from rows sorted by shingle and pair of blocks."""

    def run(batches):
        for rows in _chunks(batches, 3):
            start = _starts(rows, 3)
            a, b, left_out = open_pairs(rows, start, best)
            if len(a):
                yield _pair_batch(a, b, rows, start, 3, left_out)

    return run


def open_rows(shared: DataFrame, known: DataFrame, vectors: DataFrame, best: bool) -> DataFrame:
    """Pairs of sets of different components that share a prefix shingle and may be similar, and shingles that left out some; known: vertex, part."""
    member = shared.select("token", "vertex").join(known, "vertex")
    tokens = member.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("vertex")).alias("x"), F.bit_xor(F.xxhash64("vertex", F.lit(1))).alias("y"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    # of shingles with the same sets, one
    tokens = tokens.groupBy("members", "x", "y").agg(F.min("token").alias("token"))
    blocks = F.when(F.col("members") <= CELL, 1).otherwise(F.ceil(F.col("members") / (CELL // 2))).cast("int")
    inside = member.join(tokens.select("token", blocks.alias("blocks")), "token").withColumn("own", F.pmod(F.xxhash64("vertex", F.lit(2)), F.col("blocks")).cast("int"))
    dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", "vertex", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    cells = dealt.join(vectors, "vertex").select("token", "i", "j", "side", "vertex", "part", "n", "excess", "counts")
    return map_arrow(cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j"), _open_trees(best), _PAIRS)


def joined_evenly(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left (a table that is cheap to read) joined (left) with right, whose keys are unique, without a hot task for keys that many rows share."""
    n = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > n / HOT_KEYS).select(key).join(right, key)
    return spread_join(left, right, key, hot)


def merged(known: DataFrame | None, links: DataFrame, vectors: DataFrame, keep) -> DataFrame:
    """known (vertex, part; None: each vertex is its own part) after links (a, b): components of the parts that they join."""
    if known is None:
        labels = components(links, keep)
        return keep(vectors.select("vertex").join(labels, "vertex", "left").select("vertex", F.coalesce("part", "vertex").alias("part")), "parts")
    side = lambda x: known.select(F.col("vertex").alias(x), F.col("part").alias(f"part_{x}"))
    joined = links.join(side("a"), "a").join(side("b"), "b").filter("part_a <> part_b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
    labels = components(joined, keep).filter("part <> vertex").select(F.col("vertex").alias("part"), F.col("part").alias("root"))
    return keep(joined_evenly(known, labels, "part").select("vertex", F.coalesce("root", "part").alias("part")), "parts")


def components(links: DataFrame, keep=stored) -> DataFrame:
    """vertex, part: each linked vertex and the least vertex of its component; keep writes a table and reads it back."""
    both = keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("vertex")).agg(F.least(F.min("v"), F.first("u")).alias("part"))
    while True:
        near = both.join(labels.select(F.col("vertex").alias("u"), "part"), "u").groupBy(F.col("v").alias("vertex")).agg(F.min("part").alias("near"))
        step = keep(labels.join(near, "vertex").select("vertex", F.col("part").alias("old"), F.least("part", "near").alias("part")), "labels")
        if step.filter("old <> part").isEmpty():
            return labels
        far = step.filter("part <> vertex").select(F.col("vertex").alias("part"), F.col("part").alias("far"))
        labels = joined_evenly(step.select("vertex", "part"), far, "part").select("vertex", F.coalesce("far", "part").alias("part"))


def _bloom(vertices: DataFrame):
    """Broadcast bits of fixed size with the vertices' low bits set."""
    low = F.col("vertex").bitwiseAND((1 << BLOOM_BITS) - 1)
    words = vertices.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(vertex & {63} as int))")).alias("bits"))
    got = words.toArrow()  # at most 2^BLOOM_BITS / 64 rows
    bits = np.zeros(1 << BLOOM_BITS - 6, dtype=np.int64)
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return vertices.sparkSession.sparkContext.broadcast(bits.tobytes())


def similar_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, vertex, part of each row; rows of one part (null: no words) are reachable by links."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = rows.select("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark) as scratch:
        keep = scratch.stored
        first = keep(map_arrow(rows, _describe(words), _FIRST), "shingles")
        often = first.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY).orderBy(F.desc("n"), "key").limit(MOST_HEAVY).toArrow()
        value, count = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
        order = np.argsort(value)
        heavy = spark.sparkContext.broadcast((value[order], count[order]))
        keys = map_arrow(texts, _keys(words, heavy), "token long, mixed long").repartition(parts, "token").sortWithinPartitions("token", "mixed")
        shared = keep(map_arrow(keys, _buckets, "token long, vertex long"), "buckets")
        described = first.filter("kind = 0 and key is not null").withColumnRenamed("key", "vertex").groupBy("vertex").agg(*[F.first(c).alias(c) for c in ("n", "counts", "excess")])
        vectors = keep(described.join(shared.select("vertex").distinct(), "vertex", "left_semi"), "vectors")
        pairs = keep(seed_pairs(shared, vectors), "pairs")
        known = merged(None, keep(verified(pairs, texts, words), "links"), vectors, keep)
        left = shared
        for best in (True, False):
            found = keep(open_rows(left, known, vectors, best), "candidates")
            pairs = found.filter("token is null").dropDuplicates(["a", "b"])
            if not pairs.isEmpty():
                known = merged(known, keep(verified(keep(pairs, "pairs"), texts, words), "links"), vectors, keep)
            if best:
                left = shared.join(found.filter("token is not null").select("token").distinct(), "token", "left_semi")
        documents = first.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("vertex"))
        return stored(joined_evenly(documents, known, "vertex").select("doc_id", "n_shingles", "vertex", F.coalesce("part", "vertex").alias("part")), "classes")


def document_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach from the row's."""
    rows = similar_documents(docs, words)
    least = rows.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    return joined_evenly(rows, least, "part").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _in_bloom(bits: bytes, key: pa.Array) -> np.ndarray:
    low = key.to_numpy() & (1 << BLOOM_BITS) - 1
    return (np.frombuffer(bits, dtype=np.uint8)[low >> 3] >> (low & 7) & 1).astype(bool)


def _may(bits):
    """A condition on rows: their doc_id may be one of those in the Bloom filter."""

    @F.arrow_udf("boolean")
    def may(key: pa.Array) -> pa.Array:
        return pa.array(_in_bloom(bits.value, key))

    return may(_id_hash())


def _id_hash():
    return F.xxhash64(F.col("doc_id").cast("long"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs (every column) without those of a group but its smallest doc_id's, of which one stays.

    Rows without a doc_id or without words stay. Texts are shuffled only where a Bloom filter of fixed size says that
    their row may go; all others pass.
    """
    id_, goes_ = unused(docs, "id", "goes")
    rows = stored(document_components(docs, words), "components")
    goes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("component_id") < F.col("doc_id")).cast("int")).alias(goes_), F.count(F.lit(1)).alias("n"))
    doubtful = goes.filter(f"{goes_} = 1 or n > 1").select(F.col("doc_id").alias(id_), goes_)
    may = _may(_bloom(doubtful.select(F.xxhash64(id_).alias("vertex"))))
    asked = docs.filter(may & F.col("doc_id").isNotNull()).withColumn(id_, F.col("doc_id").cast("long")).join(doubtful, id_, "left")
    once = asked.filter(f"{goes_} is null").select(*docs.columns)
    twice = asked.filter(f"{goes_} = 0").dropDuplicates([id_]).select(*docs.columns)
    return docs.filter(~may | F.col("doc_id").isNull()).unionByName(once).unionByName(twice)


def _with_vertex(at: int, words: int, bits):
    """Of rows whose last column is their doc_id's hash, those in the Bloom filter, with their vertex in its place."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_in_bloom(bits.value, batch.column(batch.num_columns - 1))))
            sets = shingle_sets([t or "" for t in batch.column(at).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([vertex(x) if len(x) else None for x in sets], pa.int64())], names=batch.schema.names)

    return run


def keep_one_of_group(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs (every column) with one of each group: of its smallest doc_id (null ones last), then vertex.

    Rows without words stay, and so do rows of one doc_id in different groups. Texts are shuffled only where a Bloom
    filter of fixed size says that their row may go or repeats the one that stays; all others pass.
    """
    rows = similar_documents(docs, words).filter("part is not null").select("doc_id", "vertex", "part")
    best = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "vertex")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marked = joined_evenly(rows, best.select("part", "best"), "part").filter("best is not null")
    goes = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("vertex") == F.col("best.vertex")))
    marks = marked.groupBy("doc_id", "vertex").agg(F.bool_or(goes).alias("goes"), F.count(F.lit(1)).alias("n"))
    id_, of_, goes_ = unused(docs, "id", "of", "goes")
    doubtful = stored(marks.filter("goes or n > 1").select(F.col("doc_id").alias(id_), F.col("vertex").alias(of_), F.col("goes").alias(goes_)), "doubtful")
    bits = _bloom(doubtful.select(F.xxhash64(id_).alias("vertex")))
    schema = T.StructType([*docs.schema.fields, T.StructField(of_, T.LongType())])
    asked = stored(map_arrow(docs.withColumn(of_, _id_hash()), _with_vertex(docs.columns.index("text"), words, bits), schema), "asked")
    key = F.col("doc_id").cast("long")
    judged = asked.filter(F.col(of_).isNotNull()).withColumn(id_, key).join(doubtful.withColumnRenamed(id_, f"{id_}2").withColumnRenamed(of_, f"{of_}2"), F.col(id_).eqNullSafe(F.col(f"{id_}2")) & (F.col(of_) == F.col(f"{of_}2")), "left")
    once = judged.filter(F.col(goes_).isNull()).select(*docs.columns)
    twice = judged.filter(~F.col(goes_)).dropDuplicates([id_, of_]).select(*docs.columns)
    wordless = asked.filter(F.col(of_).isNull()).select(*docs.columns)
    return docs.filter(~_may(bits)).unionByName(wordless).unionByName(once).unionByName(twice)
