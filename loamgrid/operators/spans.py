"""Spans within keys: which lie in another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_containment(spans: DataFrame, keys: list[str], start: str, end: str, among: Column | None = None) -> DataFrame:
    """``spans`` with ``contained``, whether another span of the key holds it whole.

    One sort a key: by start, longer ones first, a span lies in an earlier one exactly if the greatest
    end before it reaches its own, so nothing is joined or paired. Of equal spans all but one are
    contained. ``among`` restricts the holders: spans for which it is false hold no other.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(start), F.desc(end), *([F.desc(among)] if among is not None else []))
    holder = F.col(end) if among is None else F.when(among, F.col(end))
    before = F.max(holder).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("contained", F.coalesce(before >= F.col(end), F.lit(False)))


def outermost(spans: DataFrame, keys: list[str], start: str, end: str, among: Column | None = None) -> DataFrame:
    """The spans that no other one holds."""
    return with_containment(spans, keys, start, end, among).where("NOT contained").drop("contained")
