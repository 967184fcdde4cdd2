"""Order-dependent operators: last wins, last unconditional binding, top with remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """keys, seq (of the first row of the key), values (of its last row): a map that is overwritten keeps its place."""
    last = F.max_by(F.struct(*values), seq).alias("_last")
    return df.groupBy(*keys).agg(F.min(seq).alias(seq), last).select(*keys, seq, *(F.col(f"_last.{v}").alias(v) for v in values))


def reaching(df: DataFrame, keys: list[str], order: list[str], conditional: Column) -> DataFrame:
    """df with `since` and `alternatives`: where the last unconditional row at or before each row stands in its key's
    order (null if there is none), and how many conditional rows have come since."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumn("_at", F.row_number().over(w)).withColumn("_cond", conditional.cast("int"))
    since = F.max(F.when(F.col("_cond") == 0, F.col("_at"))).over(running)
    seen = F.sum("_cond").over(running)
    placed = placed.withColumn("since", since).withColumn("_seen", seen)
    before = F.max(F.when(F.col("_cond") == 0, F.col("_seen"))).over(running)
    return placed.withColumn("alternatives", F.col("_seen") - F.coalesce(before, F.lit(0))).drop("_at", "_cond", "_seen")


def top_with_remainder(df: DataFrame, order: list[Column], limit: int = 25) -> DataFrame:
    """The first rows in that order, each with how many rows there are beyond the limit."""
    more = df.agg(F.greatest(F.lit(0), F.count("*") - limit).alias("additional"))
    return df.orderBy(*order).limit(limit).join(F.broadcast(more), F.lit(True))  # one row by at most `limit`
