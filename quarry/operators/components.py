"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import columns, gathered
from quarry.plans.stages import run_dir, stored


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", local: int = 0) -> DataFrame:
    """node, component for every node of an edge; a component's name is its least node.

    local: a relation of at most so many edges is gathered and united in plain Python (see graph.gathered); 0: never.

    Each round points the neighbours of a node at the least of them, first the larger ones, then the smaller ones; the
    edges end up as stars. Rounds grow with the logarithm of the graph. A round is aggregates and joins (no group is
    gathered). The first aggregate is stored before it is joined: a join right behind an aggregate would keep all edges
    of a node in one task, while a join of two plain exchanges is split where a node has very many neighbours. Nodes may be
    of any type that has an order. Edges with a null end and loops are left out.
    """
    path, turn, before = run_dir(edges.sparkSession, "components"), 0, None
    if (table := gathered(edges.select(left, right), local)) is not None:
        return edges.sparkSession.createDataFrame(united(columns(table)), f"node {dict(edges.dtypes)[left]}, component {dict(edges.dtypes)[left]}")
    now = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now, f"{path}/{turn}")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{path}/{turn}-all")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # of few edges each: a hub is behind the edges now
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        small = large.join(least, "u").select(ends.alias("e")).select("e.u", "e.v").where("u != v").distinct()
        turn += 1
        now = stored(small, f"{path}/{turn}")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
        if seen == before:
            break
        before = seen
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))


def united(pairs: list[tuple]) -> list[tuple]:
    """(node, least node of its component) of pairs of different nodes."""
    top: dict = {}

    def root(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            top.setdefault(a, a)
            top.setdefault(b, b)
            one, two = sorted((root(a), root(b)))
            top[two] = one
    return [(n, root(n)) for n in list(top)]
