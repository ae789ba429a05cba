"""Numbering rows in an order, by ranges: no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.sources import sinks as W


def numbered(df: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """``df`` with ``name``: each row's place, from 0, in an order that leaves no ties.

    Rows are sorted over ranges and written, so that their places hold however often they are read; the ranges' counts,
    a row for each shuffle partition, are summed up and added to the places inside.
    """
    at, range_ = F.col("_at"), F.shiftright("_at", 33).alias("_range")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = W.written(placed, f"{W.scratch_folder(df.sparkSession)}/placed")
    ranges = placed.groupBy(range_).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    ahead = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(ranges.select("_range", (ahead - F.col("_from")).alias("_shift")))  # a row for each shuffle partition
    return placed.withColumn("_range", range_).join(shifts, "_range").withColumn(name, (at + F.col("_shift")).cast("long")).select(*df.columns, name)
