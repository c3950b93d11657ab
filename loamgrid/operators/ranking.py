"""Row numbers within keys of any size, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import written


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "row") -> DataFrame:
    """``rows`` with their places from 1 in ``order`` within each key ``by`` (in all rows, without keys).

    Rows are laid by ranges of key and order, so a key with many rows spans many ranges; the ranges
    are stored, their rows counted, and a row's place is that within its range plus the rows of the
    same key in the ranges before. ``order`` must end in something unique for places to be determined.
    """
    keys = [F.col(c) for c in by]
    held = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = held.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    placed = held.withColumn("_row", inside).join(written(starts), same)  # a row for each key and range: its stored size decides the join
    return placed.select(*rows.columns, (F.col("_row") + F.col("_start")).cast("long").alias(name))
