"""Ranges of sorted rows that several plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART, ROW = "__ord_part", "__ord_row"


def in_ranges(df: DataFrame, keys: list[Column], parts: int | None = None, within: list[Column] | None = None) -> DataFrame:
    """df in ranges of keys (as many as parts, if given), each sorted by within or else by keys, with the number of each row's range and its place there, from 0.

    Spark samples the bounds of ranges for each plan anew, and merges small ranges for each plan on its own: two plans over
    one range partitioning may cut it differently, so that what one counts does not fit the other's rows. Here the shuffle
    is planned once, now, and every reader shares it; lost parts of it are made again within the same bounds. Rows of equal
    keys are in one range.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    made = df.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*(within or keys)).withColumns({PART: F.spark_partition_id(), ROW: place})._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(made.queryExecution().toRdd(), made.schema(), False), spark)
