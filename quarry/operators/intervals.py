"""Interval union and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, touch: Column | int = 1) -> DataFrame:
    """keys, start, end, pieces: closed intervals that overlap or touch (the next starts at end + touch or before) as one.

    One sort by key and start; a running maximum of ends marks where an island begins.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = F.col(start) > reach + (F.lit(touch) if isinstance(touch, int) else touch)
    islands = df.withColumn("_new", F.when(reach.isNull() | far, 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("pieces")).drop("_island")


def within(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (inner_start >= outer_start) & (inner_end <= outer_end)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Of closed intervals."""
    return (a_start <= b_end) & (b_start <= a_end)
