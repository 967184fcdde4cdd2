"""Prioritised joins: references to targets, tier by tier."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A name, and what gives ref and target of the references that it is asked about.
Tier = tuple[str, Callable[[DataFrame], DataFrame]]


def first_tier(refs: DataFrame, ref: str, tiers: list[Tier]) -> DataFrame:
    """ref, target, tier: the targets of the first tier that has any for a reference. A tier is asked only about the
    references that those before it left over."""
    found = []
    for name, targets in tiers:
        own = targets(refs).select(ref, "target").distinct()
        found.append(own.withColumn("tier", F.lit(name)))
        refs = refs.join(own.select(ref).distinct(), ref, "left_anti")
    return reduce(DataFrame.unionByName, found)


def certain(found: DataFrame, ref: str) -> DataFrame:
    """found with targets (how many its reference has) and resolution: one target is exact, more are conservative, none
    (a null one) is unresolved."""
    n = F.count("target").over(Window.partitionBy(ref))
    how = F.when(F.col("targets") == 0, "unresolved").when(F.col("targets") == 1, "exact").otherwise("conservative")
    return found.withColumn("targets", n).withColumn("resolution", how)


def resolve(refs: DataFrame, ref: str, tiers: list[Tier]) -> DataFrame:
    """ref, tier, target, targets, resolution for refs; a reference without any target has a row, too."""
    found = refs.select(ref).distinct().join(first_tier(refs, ref, tiers), ref, "left")
    return certain(found, ref).select(ref, "tier", "target", "targets", "resolution")
