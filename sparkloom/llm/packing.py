"""Best-fit packing by patterns: non-negative least squares over few-document length patterns.

Texts are tokenised once; of each document the pieces (at most `width` ids; only longer documents are cut) are written
with their length and their place among the task's pieces of the same length. The driver sees the histogram of lengths
alone (at most `width` counts): it enumerates the patterns of one to three lengths that fill a sequence, fits repeat
counts to the histogram by non-negative least squares, rounds them within the counts, and packs the rest by best fit
decreasing. The resulting recipe (its size depends on `width` alone) maps the r-th piece of a length to its sequence and
offset; ranks come from prefix sums over (task, length) counts, so no length, however frequent, meets in one task.

Edge cases: null or empty text is just the end id; rows that repeat a doc_id are packed each on its own; an empty table
gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_encoder
from .common import map_arrow, stored, whole_text

WIDTH = 1024
ITERATIONS = 400
_PIECES = "task int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if it fits, else a shorter first piece and then full ones."""
    first = n % width or min(n, width)
    return [(0, first), *((s, width) for s in range(first, n, width))]


def _pieces(path: str, end_id: int, width: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        task, seen, encode = TaskContext.get().partitionId(), defaultdict(int), byte_encoder(path).encode
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encode(text) + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, width)):
                    out.append((task, doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                    seen[length] += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


def patterns(width: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 and a + b + c = width; 0 stands for no document."""
    b, c = np.meshgrid(np.arange(width + 1), np.arange(width + 1), indexing="ij")
    a = width - b - c
    keep = (a >= b) & (b >= c)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit(histogram: np.ndarray, pats: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squared residual histogram - A x (accelerated projected gradient).

    Long lengths weigh more: short documents left over fill gaps, long ones do not.
    """
    width = len(histogram) - 1
    weight = np.maximum(np.arange(width + 1) / width, 0.1)
    weight[0] = 0
    scale = max(1.0, histogram.max())
    goal = histogram / scale

    def apply(x):
        return sum(np.bincount(pats[:, k], x, width + 1) for k in range(3)) * weight

    def back(r):
        r = r * weight
        return r[pats[:, 0]] + r[pats[:, 1]] + r[pats[:, 2]]

    v = np.ones(len(pats))
    for _ in range(15):
        v = back(apply(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0, y - back(apply(y) - goal * weight) / (1.05 * size))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def best_fit(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) groups of sequences that hold counts[length] pieces of each length, by best fit decreasing.

    It moves whole groups of equal sequences, so its steps depend on the number of lengths, not of pieces.
    """
    width = len(counts) - 1
    spare: dict[int, list] = defaultdict(list)  # free ids -> groups
    for length in range(width, 0, -1):
        left = int(counts[length])
        while left:
            room = next((s for s in range(length, width) if spare[s]), width)
            if room == width:
                each = width // length
                repeats = left // each
                groups = [(repeats, (length,) * each)] * (repeats > 0) + [(1, (length,) * (left % each))] * (left % each > 0)
                left = 0
            else:
                repeats, held = spare[room].pop()
                used = min(repeats, left)
                if repeats > used:
                    spare[room].append((repeats - used, held))
                groups = [(used, (*held, length))]
                left -= used
            for repeats, held in groups:
                spare[width - sum(held)].append((repeats, held))
    return [g for groups in spare.values() for g in groups]


def plan(histogram: np.ndarray, iterations: int = ITERATIONS) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) groups of sequences for histogram[length] pieces: fitted patterns, then best fit for the rest."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    if not left.any():
        return []
    pats = patterns(len(left) - 1)
    pats = pats[((left[pats] > 0) | (pats == 0)).all(axis=1)]
    out = []
    if len(pats):
        x = fit(left, pats, iterations)
        have = left.tolist()
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            lengths = tuple(int(n) for n in pats[k] if n)
            repeats = min([round(float(x[k])), *(have[n] // lengths.count(n) for n in lengths)])
            if repeats:
                out.append((repeats, lengths))
                for n in lengths:
                    have[n] -= repeats
        left = np.array(have)
    return out + best_fit(left)


def slots(groups: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: key (length << 40 | first rank), sorted; the run's first sequence and offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for repeats, lengths in groups:
        offset = 0
        for n in lengths:
            rows.append((n << 40 | used[n], sequence, offset, used[n]))
            used[n] += repeats
            offset += n
        sequence += repeats
    key, first, offset, rank = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T
    return {"key": key, "first": first, "offset": offset, "rank": rank}


def _place(recipe):
    def run(batches):
        s = recipe.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(s["key"], length << 40 | rank, side="right") - 1
            sequence = s["first"][k] + rank - s["rank"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(s["offset"][k])], names=[x.split()[0] for x in _PACKED.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, width: int = WIDTH) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = stored(map_arrow(rows, _pieces(tokenizer_path, end_id, width), _PIECES), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(width + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `width` rows
        histogram[r["length"]] = r["count"]
    recipe = spark.sparkContext.broadcast(slots(plan(histogram)))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return map_arrow(ranked, _place(recipe), _PACKED)
