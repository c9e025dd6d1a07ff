"""What the training-data operators share: tables, the shared folder, Arrow batch bounds and names of helper columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: one setting for all operators, so that plans may run in any order.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    A folder of this machine is taken only where a session of one process (local mode, as in tests) sets none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="sparkloom-"))
        base = _LOCAL[0]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def _stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lost executors cost no recomputation of what stands before."""
    return _stored_at(df, fresh_path(df.sparkSession, label))


class Scratch:
    """Tables of the shared folder that one operator passes on to itself: they go at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, label))
        return _stored_at(df, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            fs, at = _file_system(self.spark, path)
            fs.delete(at, True)


def _pieces(batches):
    """Batches of BATCH_BYTES at most, but for single rows."""
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if len(b) > 1 and b.nbytes > 2 * BATCH_BYTES:
                half = len(b) // 2
                todo += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema), whose batches are bounded where they are made and, whatever the session says, where they come in."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: function(_pieces(batches)), schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns: those given, with underscores as long as df has such a column."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left joined (left) with right, whose keys are unique, so that keys that many rows of left share don't meet in one task.

    hot are right's rows of such keys: fewer than 1000, as each has more than a thousandth of left's rows; they are
    broadcast. Rows of left that have one, or a null key, are dealt by a hash of all their columns instead.
    """
    values = [c for c in right.columns if c != key]
    at, *found = unused(left.select(*left.columns, *[F.lit(0).alias(c) for c in values]), "at", *[f"hot_{c}" for c in values])
    is_hot, dealt = found[-1] + "_is", at + "_dealt"
    broad = hot.select(F.col(key).alias(at), *[F.col(c).alias(n) for c, n in zip(values, found)], F.lit(True).alias(is_hot))
    marked = left.join(F.broadcast(broad), left[key] == F.col(at), "left").drop(at)
    own = F.when(F.col(is_hot) | F.col(key).isNull(), F.xxhash64(*left.columns).cast("string").cast(left.schema[key].dataType)).otherwise(F.col(key))
    rest = right.withColumnRenamed(key, at)
    joined = marked.withColumn(dealt, own).join(rest, F.col(dealt) == F.col(at), "left")
    kept = F.col(is_hot).isNull() & F.col(key).isNotNull()
    return joined.select(*left.columns, *[F.when(F.col(is_hot), F.col(n)).when(kept, F.col(c)).alias(c) for c, n in zip(values, found)])


def whole_text(col: str = "text"):
    """The text, empty for null."""
    return F.coalesce(F.col(col), F.lit(""))
