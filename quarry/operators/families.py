"""Families: equal keys, compatible selectors, and what their members have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import jaccard
from quarry.operators.components import connected_components


def key_families(df: DataFrame, keys: list[str], member: str, least: int = 2, least_members: int = 1, also: tuple[Column, ...] = ()) -> DataFrame:
    """keys, occurrences, members (distinct), and more aggregates: groups with enough of both. Hot keys add up before they shuffle."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.count_distinct(member).alias("members"), *also)
    return groups.where((F.col("occurrences") >= least) & (F.col("members") >= least_members))


def selector_families(df: DataFrame, key: list[str], member: str, fields: str, shape: str | None = None, least: float = 0.5, local: int = 0) -> DataFrame:
    """member, family: members of the same key that are alike: the same shape, or sets of fields (an array) whose
    Jaccard similarity is `least` or more, directly or through others. Only families of two or more.

    Pairs with no field in common can't reach a positive bound, so they meet through their fields.
    """
    base = df.select(*key, member, F.array_distinct(fields).alias("fields"), (F.col(shape) if shape else F.lit(None).cast("string")).alias("shape"))
    seeds = base.select(*key, member, "fields", F.explode("fields").alias("seed"))
    left = seeds.select(*key, F.col(member).alias("u"), F.col("fields").alias("f"), "seed")
    right = seeds.select(*key, F.col(member).alias("v"), F.col("fields").alias("g"), "seed")
    alike = left.join(right, [*key, "seed"]).where("u < v").select("u", "v", "f", "g").dropDuplicates(["u", "v"]).where(jaccard(F.col("f"), F.col("g")) >= least)
    edges = alike.select("u", "v")
    if shape:
        hubs = base.where("shape IS NOT NULL").groupBy(*key, "shape").agg(F.min(member).alias("v"))
        edges = edges.unionByName(base.join(hubs, [*key, "shape"]).select(F.col(member).alias("u"), "v"))
    return connected_components(edges, local=local).select(F.col("node").alias(member), F.col("component").alias("family"))


def set_summary(members: DataFrame, family: str, member: str, fields: str) -> DataFrame:
    """family, n, common, all: how many members, the fields that all of them have, the fields that any has; sorted."""
    n = members.groupBy(family).agg(F.count_distinct(member).alias("n"))
    each = members.select(family, member, F.explode(fields).alias("field")).distinct().groupBy(family, "field").agg(F.count("*").alias("has"))
    sets = each.join(n, family).groupBy(family, "n").agg(
        F.array_sort(F.collect_set(F.when(F.col("has") == F.col("n"), F.col("field")))).alias("common"), F.array_sort(F.collect_set("field")).alias("all")
    )
    return sets


def decision(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The outcome of the first rule that holds."""
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)
