"""Token-ID / binary output: Parquet token lists, written in document order.

Layout: one file for each range of doc_id, rows ascending; columns doc_id, part, local_start, n_tokens and the token
list. Tokens are dictionary-encoded (delta or plain where a dictionary does not pay, format version 2), row groups have a
bounded size, and every column carries page indexes, so that a reader fetches the tokens of few documents, or only the
metadata, without scanning the rest. Each document's position in the whole token stream is its file's base (summed from
the metadata columns alone) plus local_start, so texts are tokenised once and no file is rewritten.

Edge cases: null text is empty and yields just the end id; a null doc_id sorts first; rows that repeat a doc_id keep
their input order; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_encoder
from .common import map_arrow, whole_text

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 2_000
_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"


def _tokenise(path: str, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, at, encode = TaskContext.get().partitionId(), 0, byte_encoder(path).encode
        for batch in batches:
            ids, starts, lengths = [], [], []
            for text in batch.column(1).to_pylist():
                ids.append(encode(text) + end)
                starts.append(at)
                lengths.append(len(ids[-1]) // 4)
                at += lengths[-1]
            offsets = [0]
            for n in lengths:
                offsets.append(offsets[-1] + n)
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), tokens], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Writes the token lists of docs (doc_id, text) to the folder out, in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    (
        map_arrow(ordered, _tokenise(tokenizer_path, end_id), _SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(out)
    )


def read_tokens(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens (and tokens) of a folder that write_tokens wrote. A filter on doc_id prunes files, row groups and pages."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row for each file: as small as the folder's listing
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    start = (F.col("base") + F.col("local_start")).alias("start")
    return rows.join(F.broadcast(bases), "part").select("doc_id", start, "n_tokens", *["tokens"] * tokens)


def _crc(batches):
    for batch in batches:
        column = batch.column("tokens")
        raw = memoryview(column.values.buffers()[1]) if len(column) and len(column.values) else memoryview(b"")
        base, offsets = column.values.offset, column.offsets.to_pylist()
        crcs = [zlib.crc32(raw[4 * (base + a) : 4 * (base + b)]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(rows: DataFrame) -> DataFrame:
    """read_tokens' rows with the crc32 of each token list in place of it."""
    return map_arrow(rows.select("doc_id", "start", "n_tokens", "tokens"), _crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
