"""Numbering all rows of a table in one order, over the whole cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The low bits of a row's id that Spark gives to its place within a partition.
_BITS = 33


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names, or to one in the warehouse where it names none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: str | Column, into: str = "row_no") -> DataFrame:
    """df with row numbers from 0 in the given order; null comes first.

    Rows go to ranges of the order, of about equal size whatever the keys; a row's number is its place
    in its range and the sizes of the ranges before. Only those sizes, one row a partition, meet in
    one task. No key, however common, is held by one task, unless all of the order's columns are equal.

    Rows equal in all of the order's columns are numbered in any order. Empty table: no rows. A column
    with the name of the number is replaced.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(ranged.withColumn(into, F.monotonically_increasing_id()))  # ranges are sampled: fix them before they are used twice
    part = F.shiftright(into, _BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", F.shiftright(into, _BITS)).join(F.broadcast(before), "_part")  # one row a partition: a proven bound
    return joined.withColumn(into, F.col("_before") + F.col(into).bitwiseAND((1 << _BITS) - 1)).drop("_part", "_before")
