"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes of the UTF-8 text ends a chunk where it meets the block size's condition; each
chunk gives one of 64 letters. A fingerprint is `block size:signature:signature at twice the block size`; the block size
(3 * 2^k) follows the text's length and is halved while the signature is short. Likeness is 1 minus the edit distance of
signatures of equal block sizes over the longer one's length (0 where block sizes are not compatible).

`edited_likeness` meets each document with the next one in descending doc_id order: rows are dealt by ranges of doc_id
(bounds from quantiles, one shuffle of the texts), and each range also gets the first document of the following range.

Edge cases: null text is empty; empty texts have the empty signature (likeness 1 to another, 0 to any other text); a null
doc_id comes last; rows that repeat a doc_id are ordered by text; a single row is its own next document; an empty table
gives an empty table; other columns of the input are ignored. Texts of any length are hashed whole, in segments.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH, MIN_BLOCK, WINDOW = 64, 3, 7
SEGMENT = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the odd number next to 2^64 over the golden ratio


def triggers(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks at block size MIN_BLOCK * 2^level, ascending, and their hashes; those of higher levels are among them."""
    ends, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
    padded = bytes(8) + data
    for s in range(0, len(data), SEGMENT):
        n = min(SEGMENT, len(data) - s)
        # the eight bytes up to and with each byte; the oldest is shifted out
        words = np.ndarray((n,), dtype="<u8", buffer=padded, offset=s + 1, strides=(1,)) >> np.uint64(8)
        h = ((words * _MULTIPLIER) >> np.uint64(32)).astype(np.uint32)
        at = np.flatnonzero((h & np.uint32((1 << level) - 1)) == 0)
        at = at[(h[at] >> np.uint32(24)) % np.uint32(MIN_BLOCK) == 0]
        ends.append(at + s + 1)
        hashes.append(h[at])
    return np.concatenate(ends), np.concatenate(hashes)


def _signature(view: memoryview, ends: list[int]) -> str:
    bounds = [0, *ends[: LENGTH - 1]]
    if bounds[-1] < len(view):
        bounds.append(len(view))
    return "".join([LETTERS[zlib.crc32(view[a:b]) & 63] for a, b in zip(bounds, bounds[1:])])


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    level = 0
    while MIN_BLOCK * LENGTH << level < len(data):
        level += 1
    low = max(0, level - 1)
    ends, hashes = triggers(data, low)
    while True:
        own = (hashes & np.uint32((1 << level) - 1)) == 0
        if level == 0 or own.sum() >= LENGTH // 2 - 1:
            break
        level -= 1
        if level < low:
            low = level
            ends, hashes = triggers(data, low)
    view, twice = memoryview(data), (hashes & np.uint32((2 << level) - 1)) == 0
    return f"{MIN_BLOCK << level}:{_signature(view, ends[own].tolist())}:{_signature(view, ends[twice].tolist())}"


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of the pairs of strings."""
    la, lb = (np.array([len(x) for x in y], dtype=np.int64) for y in (a, b))
    width = lambda x: int(x.max(initial=0))
    grid = lambda y, w, fill: np.frombuffer("".join(x.ljust(w, fill) for x in y).encode(), dtype=np.uint8).reshape(len(y), w)
    left, right = grid(a, width(la), "\0"), grid(b, width(lb), "\1")
    steps = np.arange(width(lb) + 1, dtype=np.int16)
    row = np.broadcast_to(steps, (len(a), len(steps))).copy()
    out, each = np.where(la == 0, lb, 0), np.arange(len(a))
    for i in range(width(la)):
        new = row + np.int16(1)
        np.minimum(new[:, 1:], row[:, :-1] + (left[:, i, None] != right), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = la == i + 1
        out[done] = row[each[done], lb[done]]
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out, at, left, right = np.zeros(len(a)), [], [], []
    for k, (x, y) in enumerate(zip(a, b)):
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        for p, q in ((x1, y1), (x2, y2)) if bx == by else ((x1, y2),) if bx == 2 * by else ((x2, y1),) if by == 2 * bx else ():
            at.append(k)
            left.append(p)
            right.append(q)
    if at:
        longer = np.array([max(len(p), len(q), 1) for p, q in zip(left, right)])
        np.maximum.at(out, at, 1 - distances(left, right) / longer)
    return np.where([x == y for x, y in zip(a, b)], 1.0, out)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare_batches(batches):
    """Rows (part, edge, doc_id, text) in order; an edge row only lends its text to the row before it."""

    def flush(rows):
        texts = [r[3] for r in rows]
        prints = [fingerprint(t) for t in texts]
        use = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        changed = [edited(texts[k], texts[k + 1]) for k in use]
        own, others, following = [prints[k] for k in use], [fingerprint(t) for t in changed], [prints[k + 1] for k in use]
        columns = [[rows[k][2] for k in use], [len(texts[k]) for k in use], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], own, others, likeness(own, others), likeness(own, following)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += len(row[3])
            if size > 2 << 20 or len(rows) > 1000:
                yield flush(rows)
                rows, size = rows[-1:], len(row[3])
    if len(rows) > 1:
        yield flush(rows)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint, its edited text's, and its likeness to that and to the next document."""
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 10 * parts + 1000).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds, dtype=np.int64))

    @F.arrow_udf("int")
    def part_of(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    # each range's first document in descending order; one row for each range
    heads = {r["part"]: r["head"] for r in rows.groupBy(part_of("key").alias("part")).agg(F.max("key").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    lent = [(part, heads[following]) for part, following in zip(order, order[1:] + order[:1])]
    edge = spark.createDataFrame(lent, "part int, key long")
    first = rows.filter(F.col("key").isin([h for _, h in lent])).groupBy("key").agg(F.min("text").alias("text"))
    edges = first.join(F.broadcast(edge), "key").select("part", F.lit(1).alias("edge"), F.lit(least).alias("key"), F.lit(None).cast("long").alias("doc_id"), "text")
    own = rows.select(part_of("key").alias("part"), F.lit(0).alias("edge"), "key", "doc_id", "text")
    dealt = own.unionByName(edges).repartition(parts, "part").sortWithinPartitions("part", "edge", F.desc("key"), "text")
    return map_arrow(dealt.select("part", "edge", "doc_id", "text"), _compare_batches, _SCHEMA)
