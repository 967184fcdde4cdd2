"""Reachability, closures and what follows from them, level by level with DataFrames.

Every search takes `local`: a relation of at most so many rows is gathered (a bounded count tells) and searched in
plain Python, because a job for each level costs more than the search of a small graph. 0, the default, never gathers.
Both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.stages import run_dir, stored

#: Rows of a relation of one project that its driver may hold: some tens of megabytes.
PROJECT = 300_000
#: Rows that a task gathers of labels' results before it hands them on.
BATCH = 10_000


def gathered(df: DataFrame, most: int) -> pa.Table | None:
    """The rows of df if there are at most `most`, and it isn't 0. They are counted first, so that no rows of a larger one come here."""
    if not most or df.limit(most + 1).count() > most:
        return None
    return df.toArrow()


def columns(table: pa.Table) -> list[tuple]:
    return list(zip(*(table[c].to_pylist() for c in table.column_names), strict=True))


def reach(edges: DataFrame, seeds: DataFrame, paths: bool = False, local: int = 0, places: bool = False) -> DataFrame:
    """node, hops (0 for seeds) and, if asked for, path (from a seed to the node) of all nodes that seeds lead to.

    edges: source, target, and optionally slot; seeds: node, and optionally rank and label. A level is one join and one
    anti-join and is stored, so that lineage stays short. Where several nodes lead to a new one, the one that was itself
    found first counts, then the edge with the least slot: the order of a first-in first-out search. Seeds with labels
    are searched from label by label; the label is then the first column, and `place` (with paths or places) the order in
    a level. A gathered graph with so many labels that the result may have over `local` rows is searched by the executors.
    """
    edges = edges.select("source", "target", "slot") if "slot" in edges.columns else edges.select("source", "target", F.lit(0).cast("long").alias("slot"))
    rank = (F.min("rank") if "rank" in seeds.columns else F.lit(0)).cast("long").alias("rank")
    key = (["label"] if "label" in seeds.columns else []) + ["node"]
    start = seeds.groupBy(*key).agg(rank)
    shown = [*key, "hops", *(["place"] if len(key) > 1 and (paths or places) else []), *(["path"] if paths else [])]
    links = gathered(edges, local)
    if links is not None and len(key) > 1 and (links.num_rows + 1) * start.select("label").distinct().count() > local:
        return stored(_spread(start, links, paths).select(*shown), run_dir(edges.sparkSession, "reach"))
    if links is not None and (seeded := gathered(start, local)) is not None:
        return _searched(edges.sparkSession, start, links, seeded, paths).select(*shown)

    path, level = run_dir(edges.sparkSession, "reach"), 0
    start = start.withColumn("hops", F.lit(0)).withColumn("path", F.array("node") if paths else F.lit(None).cast("array<string>"))
    found = new = stored(start, f"{path}/0")
    to = [*key[:-1], "to"]
    while not new.isEmpty():
        level += 1
        step = new.join(edges, F.col("node") == F.col("source")).select(*key[:-1], F.col("target").alias("to"), F.struct("rank", "slot", "node").alias("by"), "path")
        step = step.groupBy(*to).agg(F.min("by").alias("by"), F.min_by("path", "by").alias("path"))
        fresh = step.join(found.select(*key[:-1], F.col("node").alias("to")), to, "left_anti")
        grown = F.concat("path", F.array("to")) if paths else F.col("path")
        if paths or places:  # ranks matter only to choose among parents; numbered within ranges, so that no task sorts all
            fresh = ranked(fresh, "by")
        else:
            fresh = fresh.withColumn("rank", F.lit(0).cast("long"))
        new = stored(fresh.select(*key[:-1], F.col("to").alias("node"), "rank", F.lit(level).alias("hops"), grown.alias("path")), f"{path}/{level}")
        found = stored_union(edges.sparkSession, path, level, found.schema)
    return found.withColumnRenamed("rank", "place").select(*shown)


def _searched(spark, start: DataFrame, links: pa.Table, seeded: pa.Table, paths: bool) -> DataFrame:
    """label (if seeds have one), node, hops, place, path (null if not asked for), of a gathered graph."""
    out: dict = defaultdict(list)
    for source, target, slot in columns(links):
        out[source].append((slot, target))
    kinds = {f.name: f.dataType.simpleString() for f in start.schema}
    found: dict[tuple, tuple] = {}
    new = {tuple(key): (rank, None) for *key, rank in columns(seeded)}
    hops = 0
    while new:
        order = sorted(new.items(), key=lambda x: x[1][0])
        found |= {key: (hops, place, parent) for key, (place, parent) in order}
        best: dict[tuple, tuple] = {}
        for (*label, node), (place, _) in order:
            for slot, target in out[node]:
                key, by = (*label, target), (place, slot, node)
                if key not in found and (key not in best or by < best[key]):
                    best[key] = by
        hops += 1
        new = {key: (place, (*key[:-1], by[2])) for place, (key, by) in enumerate(sorted(best.items(), key=lambda x: x[1]), 1)}

    def path(key: tuple) -> list:
        back = []
        while key is not None:
            back.append(key[-1])
            key = found[key][2]
        return back[::-1]

    own = "".join(f"{c} {kinds[c]}, " for c in start.columns[:-1])
    schema = f"{own}hops int, place long, path array<{kinds['node']}>"
    if not found:
        return spark.createDataFrame([], schema)
    keys = seeded.schema.names[:-1]
    data = [pa.array([key[k] for key in found], seeded.schema.field(c).type) for k, c in enumerate(keys)]
    data += [pa.array([x[0] for x in found.values()], pa.int32()), pa.array([x[1] for x in found.values()], pa.int64())]
    way = pa.list_(seeded.schema.field("node").type)
    data.append(pa.array(map(path, found), way) if paths else pa.nulls(len(found), way))
    return spark.createDataFrame(pa.table(data, [*keys, "hops", "place", "path"]), schema)  # as Arrow: rows of Python take several times as long and as much memory


def _spread(start: DataFrame, links: pa.Table, paths: bool) -> DataFrame:
    """label, node, hops, place, path (null if not asked for): each label is searched for in one task, in the whole gathered graph."""
    spark, kinds = start.sparkSession, {f.name: f.dataType.simpleString() for f in start.schema}
    names = pc.unique(pa.chunked_array(links["source"].chunks + links["target"].chunks, links.schema.field("source").type)).drop_null()
    names = names.take(pc.sort_indices(names))  # a node's number is its place, so that numbers compare as nodes do
    order = links.filter(pc.and_(pc.is_valid(links["source"]), pc.is_valid(links["target"]))).sort_by([("source", "ascending"), ("slot", "ascending"), ("target", "ascending")])
    source, target = (pc.index_in(order[c], names).combine_chunks().to_numpy(zero_copy_only=False) for c in ("source", "target"))
    graph = spark.sparkContext.broadcast((names, np.searchsorted(source, np.arange(len(names) + 1)), target, order["slot"].combine_chunks().to_numpy(zero_copy_only=False)))

    def search(seeds: list[tuple[int, int]], first: list[int], to: list[int], slots: list[int]) -> dict[int, tuple]:
        """hops, place and parent of each number that is found."""
        found: dict[int, tuple] = {}
        new, hops = [(rank, n, None) for n, rank in seeds], 0
        while new:
            new.sort(key=lambda x: x[0])
            found |= {n: (hops, place, parent) for place, n, parent in new}
            best: dict[int, tuple] = {}
            for place, n, _ in new:
                for e in range(first[n], first[n + 1]):
                    if (t := to[e]) not in found and (t not in best or (place, slots[e], n) < best[t]):
                        best[t] = place, slots[e], n
            hops += 1
            new = [(place, t, by[2]) for place, (t, by) in enumerate(sorted(best.items(), key=lambda x: x[1]), 1)]
        return found

    def searched(batches):
        graph_ = names_ = None
        held: list[pa.RecordBatch] = []
        together = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()
        for b in batches:
            if graph_ is None:
                names_, *graph_ = graph.value
                graph_ = [x.tolist() for x in graph_]
            # numbers of all seeds at once: each lookup hashes all names
            numbers_of, at = pc.index_in(b["nodes"].flatten(), names_).to_pylist(), 0
            for label, own, ranks in zip(b["label"], b["nodes"], b["ranks"], strict=True):
                ids, at = numbers_of[at : at + len(own)], at + len(own)
                found = search([(i, r) for i, r in zip(ids, ranks.as_py(), strict=True) if i is not None], *graph_)
                lone = [k for k, i in enumerate(ids) if i is None]  # seeds without edges
                numbers = pa.array(list(found), pa.int64())
                nodes = pa.concat_arrays([names_.take(numbers), own.values.take(pa.array(lone, pa.int64()))])
                way = []
                for n in found if paths else ():
                    back = []
                    while n is not None:
                        back.append(n)
                        n = found[n][2]
                    way.append(names_.take(pa.array(back[::-1], pa.int64())).to_pylist())
                way = way + [[own.values[k].as_py()] for k in lone] if paths else [None] * len(nodes)
                seen = list(found.values())
                held.append(pa.record_batch([
                    pa.array([label.as_py()] * len(nodes), b["label"].type), nodes, pa.array([x[0] for x in seen] + [0] * len(lone), pa.int32()),
                    pa.array([x[1] for x in seen] + [ranks[k].as_py() for k in lone], pa.int64()), pa.array(way, pa.list_(names_.type)),
                ], ["label", "node", "hops", "place", "path"]))
                if sum(x.num_rows for x in held) >= BATCH:
                    yield from together(held)
                    held = []
        if held:
            yield from together(held)

    own = F.sort_array(F.collect_list(F.struct("node", "rank"))).alias("own")
    each = start.where("node IS NOT NULL").groupBy("label").agg(own).select("label", F.col("own.node").alias("nodes"), F.col("own.rank").alias("ranks"))
    each = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label")  # a number, or its few bytes would meet in one task
    return each.mapInArrow(searched, f"label {kinds['label']}, node {kinds['node']}, hops int, place long, path array<{kinds['node']}>")


def stored_union(spark, path: str, level: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{k}" for k in range(level + 1)))


def ranked(df: DataFrame, order: str) -> DataFrame:
    """df with rank: its place in that order. Rows are ranged over partitions; only partition sizes meet in one task."""
    spread = df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    spread = stored(spread, run_dir(df.sparkSession, "ranked"))
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return spread.join(before, F.col("_part") == F.col("_p")).withColumn("rank", (nth + F.col("_before")).cast("long")).drop("_part", "_p", "_before")


def three_valued(nodes: DataFrame, edges: DataFrame, production: DataFrame, tests: DataFrame, local: int = 0) -> DataFrame:
    """nodes with reachability: production, test-only or unreachable.

    What tests lead to is searched for only beyond what production leads to: the second search starts where the first
    has not been, and its edges are those into such nodes.
    """
    live = reach(edges, production, local=local).select(F.col("node").alias("_seen"))
    beyond = lambda df, column: df.join(live, F.col(column) == F.col("_seen"), "left_anti")
    tested = reach(beyond(edges, "target"), beyond(tests, "node"), local=local).select("node", F.lit("test-only").alias("_how"))
    how = live.select(F.col("_seen").alias("node"), F.lit("production").alias("_how")).unionByName(tested)
    return nodes.join(how, "node", "left").withColumn("reachability", F.coalesce("_how", F.lit("unreachable"))).drop("_how")


def closure(parents: DataFrame, local: int = 0) -> DataFrame:
    """node, ancestor, depth: all pairs of a child-to-parent relation (node, parent); cycles end where they close."""
    path, level = run_dir(parents.sparkSession, "closure"), 1
    direct = parents.select("node", F.col("parent").alias("ancestor")).where("ancestor IS NOT NULL").distinct()
    table = gathered(direct, local)
    if table is not None:
        up = defaultdict(set)
        for node, parent in columns(table):
            up[node].add(parent)
        found = {}
        for node in list(up):
            new, depth = up[node], 1
            while new:
                found |= {(node, a): depth for a in new}
                new, depth = {b for a in new for b in up.get(a, ()) if (node, b) not in found}, depth + 1
        kind = direct.schema["node"].dataType.simpleString()
        return parents.sparkSession.createDataFrame([(*k, d) for k, d in found.items()], f"node {kind}, ancestor {kind}, depth int")
    new = stored(direct.withColumn("depth", F.lit(1)), f"{path}/1")
    schema, found = new.schema, new
    while not new.isEmpty():
        level += 1
        up = parents.select(F.col("node").alias("ancestor"), "parent")
        step = new.join(up, "ancestor").where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor")).distinct()
        step = step.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(level))
        new = stored(step, f"{path}/{level}")
        found = parents.sparkSession.read.schema(schema).parquet(*(f"{path}/{k}" for k in range(1, level + 1)))
    return found


def circular(edges: DataFrame, local: int = 0) -> DataFrame:
    """node: from which edges (source, target) lead into a circle. Nodes that lead nowhere go, level by level; the rest stays."""
    left = edges.select("source", "target").distinct()
    table = gathered(left, local)
    if table is not None:
        out, into = defaultdict(set), defaultdict(set)
        for source, target in columns(table):
            out[source].add(target)
            into[target].add(source)
        ends = [n for n in into if n not in out]
        while ends:
            n = ends.pop()
            for source in into[n]:
                out[source].discard(n)
                if not out[source]:
                    del out[source]
                    ends.append(source)
        return edges.sparkSession.createDataFrame([(n,) for n in out], f"node {left.schema['source'].dataType.simpleString()}")
    path, level = run_dir(edges.sparkSession, "circular"), 0
    left = stored(left, f"{path}/0")
    size, before = left.count(), -1
    while size != before:
        level += 1
        goes_on = left.select(F.col("source").alias("target")).distinct()
        left = stored(left.join(goes_on, "target", "left_semi").select("source", "target"), f"{path}/{level}")
        size, before = left.count(), size
    return left.select(F.col("source").alias("node")).distinct()


def exclusive(path_nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """path, node: nodes of a path that are no entries and are led to from nowhere but that path.

    path_nodes: path, node; edges: source, target; entries: node.
    """
    inbound = path_nodes.join(edges, F.col("node") == F.col("target")).select("path", "node", "source")
    mine = path_nodes.select(F.col("path").alias("_p"), F.col("node").alias("_n"))
    outside = inbound.join(mine, (F.col("path") == F.col("_p")) & (F.col("source") == F.col("_n")), "left_anti").select("path", "node").distinct()
    return path_nodes.join(entries.select("node"), "node", "left_anti").join(outside, ["path", "node"], "left_anti").select("path", "node")
