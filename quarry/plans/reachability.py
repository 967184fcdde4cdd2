"""Symbols, references and entries to edges, reachability, evidence paths and candidates: joins and level-by-level search."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import normalize_name, simple_type_name
from quarry.operators.graph import PROJECT, closure, reach
from quarry.operators.resolve import certain, first_tier
from quarry.plans.stages import run_dir, stored
from quarry.sources.apex import PLATFORM_CALLBACKS

# Receivers that are the platform's.
BUILTIN_RECEIVERS = "blob boolean date datetime decimal double id integer long object string time list map set system database schema test type math limits".split()
TYPE_KINDS = ("class", "interface", "enum", "trigger")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def type_keys(symbols: DataFrame) -> DataFrame:
    """key, type: each type by its whole and by its simple name."""
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS))
    keys = F.explode(F.array_distinct(F.array(normalize_name(F.col("qualifiedName")), normalize_name(F.col("name"))))).alias("key")
    return types.select(keys, F.col("id").alias("type")).distinct()


def named(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df by each type that the column may name, as `type`."""
    own = F.explode(F.array_distinct(F.array(normalize_name(F.col(column)), normalize_name(simple_type_name(F.col(column))))))
    return df.withColumn("key", own).join(keys, "key").drop("key").distinct()


def subtypes(symbols: DataFrame, keys: DataFrame) -> DataFrame:
    """type, sub: each type with itself and all that extend or implement it."""
    bases = F.explode(F.filter(F.concat("interfaces", F.array("superclass")), lambda x: x.isNotNull())).alias("base")
    direct = named(symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("node"), bases), "base", keys)
    every = closure(direct.select("node", F.col("type").alias("parent")), local=PROJECT)
    selves = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("type"), F.col("id").alias("sub"))
    return selves.unionByName(every.select(F.col("ancestor").alias("type"), F.col("node").alias("sub"))).distinct()


class Names(NamedTuple):
    """What names lead to: types by name, their members, and types with those under them."""

    keys: DataFrame
    members: DataFrame
    types: DataFrame
    under: DataFrame

    @classmethod
    def of(cls, symbols: DataFrame, path: str) -> Names:
        """Stored once, because references of every kind ask them."""
        keys = stored(type_keys(symbols), f"{path}/keys")
        members = symbols.where("ownerId IS NOT NULL").select(F.col("ownerId").alias("type"), normalize_name(F.col("name")).alias("m"), F.col("arity").alias("n"), F.col("id").alias("target"), "modifiers", "annotations", "kind")
        types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("type"), normalize_name(F.col("name")).alias("m"), "interfaces")
        return cls(keys, stored(members, f"{path}/members"), stored(types, f"{path}/types"), stored(subtypes(symbols, keys), f"{path}/under"))


def resolve(known: Names, refs: DataFrame) -> DataFrame:
    """ref_seq, target: what each reference leads to, by its kind."""
    keys, members, names, under = known
    out = lambda df: df.select("ref_seq", "target")

    simple = refs.where("kind IN ('type', 'inheritance') AND targetType IS NOT NULL")
    typed = named(simple.select("ref_seq", "targetType"), "targetType", keys).select("ref_seq", F.col("type").alias("target"))

    made = named(refs.where("kind = 'construct' AND targetType IS NOT NULL").select("ref_seq", "targetType", "arity"), "targetType", keys)
    constructors = lambda left: left.join(names.select("type", "m"), "type").join(members, ["type", "m"]).where("n = arity")
    created = out(first_tier(made, "ref_seq", [("constructor", constructors), ("type", lambda left: left.withColumn("target", F.col("type")))]))
    callbacks = [(i, m) for i, own in PLATFORM_CALLBACKS.items() for m in own]
    platform = refs.sparkSession.createDataFrame(callbacks, "i string, m string")
    called = names.select("type", F.explode("interfaces").alias("i")).withColumn("i", normalize_name(simple_type_name(F.col("i")))).join(F.broadcast(platform), "i")
    called = out(made.join(called.select("type", "m"), "type").join(members, ["type", "m"]))

    meta = named(refs.where("kind = 'metadata' AND targetType IS NOT NULL").select("ref_seq", "targetType", "memberName", "detail"), "targetType", keys)
    bare = meta.where("memberName IS NULL")
    open_ = F.array_contains("modifiers", "public") | F.array_contains("modifiers", "global")
    wanted = (F.col("detail").startswith("Visualforce controller") & open_) | (F.col("detail").startswith("Flow Apex action") & F.array_contains("annotations", "invocablemethod"))
    more = out(bare.join(members, "type").where(wanted))
    exact = out(meta.where("memberName IS NOT NULL").withColumn("m", normalize_name(F.col("memberName"))).join(members, ["type", "m"]))

    calls = refs.where("kind = 'call' AND memberName IS NOT NULL").select("ref_seq", "receiver", "receiverType", "arity", normalize_name(F.col("memberName")).alias("m"))

    def dispatched(left: DataFrame) -> DataFrame:
        """Members of the receiver's type and of those under it."""
        received = named(left.where("receiverType IS NOT NULL").select("ref_seq", "receiverType", "arity", "m"), "receiverType", keys)
        return received.join(under, "type").select("ref_seq", F.col("sub").alias("type"), "arity", "m").join(members, ["type", "m"]).where("n = arity")

    def anywhere(left: DataFrame) -> DataFrame:
        """Members of any type, if the receiver is neither the platform's nor just made."""
        platform = normalize_name(simple_type_name(F.coalesce("receiverType", F.lit("")))).isin(*BUILTIN_RECEIVERS)
        constructed = F.regexp_replace(F.coalesce("receiver", F.lit("")), r"\s+", "").rlike(r"(?i)^new[A-Za-z_]\w*(\.[A-Za-z_]\w*)*\(")
        return left.where(~platform & ~constructed).join(members.select("m", "n", "target"), "m").where("n = arity")

    owned = out(first_tier(calls, "ref_seq", [("owner", dispatched), ("anywhere", anywhere)]))
    return union(typed, created, called, bare.select("ref_seq", F.col("type").alias("target")), more, exact, owned).distinct()


def edges_of(known: Names, refs: DataFrame) -> DataFrame:
    """References with targetId and resolution, a row for each target; those that lead nowhere are left out."""
    found = certain(resolve(known, refs), "ref_seq")
    own = refs.select("ref_seq", "sourceId", "kind", "testContext", "location", "detail", "arguments", "passed")
    return own.join(found, "ref_seq").select("ref_seq", "sourceId", F.col("target").alias("targetId"), "kind", "resolution", "testContext", "location", "detail", "arguments", "passed")


def entries_of(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared entries and those that metadata makes, each once: the first place, the last row. seq orders them."""
    made = edges.where("sourceId IS NULL AND kind = 'metadata'").select(
        F.col("targetId").alias("symbolId"), F.lit("metadata").alias("source"), F.col("detail").alias("reason"), F.lit(False).alias("testOnly"), "location", (F.col("ref_seq") + F.lit(1 << 60)).alias("seq")
    )
    keys = ["symbolId", "source", "reason", F.col("location.path").alias("p")]
    every = declared.unionByName(made)
    return every.groupBy(*keys).agg(F.min("seq").alias("seq"), F.max_by(F.struct("testOnly", "location"), "seq").alias("l")).select("symbolId", "source", "reason", F.col("l.testOnly").alias("testOnly"), F.col("l.location").alias("location"), "seq")


def classify(symbols: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """id, reachability, path: by production entries, else by all, else unreachable. The path starts at an entry."""
    owner = symbols.where("ownerId IS NOT NULL").select(F.col("id").alias("source"), F.col("ownerId").alias("target"), F.lit(-1).cast("long").alias("slot"))
    links = edges.where("sourceId IS NOT NULL").select(F.col("sourceId").alias("source"), F.col("targetId").alias("target"), F.col("ref_seq").alias("slot"))
    graph = owner.unionByName(links).groupBy("source", "target").agg(F.min("slot").alias("slot"))
    graph = stored(graph, run_dir(symbols.sparkSession, "links"))  # every level reads it
    labels = F.when(F.col("testOnly"), F.array(F.lit("tested"))).otherwise(F.array(F.lit("live"), F.lit("tested")))
    seeds = entries.select(F.explode(labels).alias("label"), F.col("symbolId").alias("node"), F.col("seq").alias("rank"))
    found = reach(graph, seeds, paths=True, local=PROJECT)
    live, tested = (found.where(F.col("label") == label).select(F.col("node").alias("id"), F.col("path").alias(label)) for label in ("live", "tested"))
    both = symbols.select("id").join(live, "id", "left").join(tested, "id", "left")
    value = F.when(F.col("live").isNotNull(), "production").when(F.col("tested").isNotNull(), "test-only").otherwise("unreachable")
    return both.select("id", value.alias("reachability"), F.coalesce("live", "tested", F.array().cast("array<string>")).alias("path"))


def candidates_of(symbols: DataFrame, reached: DataFrame, exposures: DataFrame) -> DataFrame:
    """Unreachable symbols outside tests: members, and top-level types none of whose members outside tests is reached."""
    s = symbols.join(reached.select("id", "reachability"), "id")
    is_type: Column = F.col("kind").isin(*TYPE_KINDS)
    alive = s.where("ownerId IS NOT NULL AND NOT testCode AND reachability <> 'unreachable'").select(F.col("ownerId").alias("id")).distinct()
    dead = s.where("NOT testCode AND reachability = 'unreachable'").where(~is_type | F.col("ownerId").isNull())
    dead = dead.where(~is_type).unionByName(dead.where(is_type).join(alive, "id", "left_anti"))
    related = dead.select("id", F.col("id").alias("symbolId")).unionByName(
        dead.where(is_type).select(F.col("id").alias("top")).join(symbols.select(F.col("ownerId").alias("top"), F.col("id").alias("symbolId")), "top").select(F.col("top").alias("id"), "symbolId")
    )
    shown = related.join(exposures.select("symbolId", "reason"), "symbolId").groupBy("id").agg(F.array_sort(F.collect_set("reason")).alias("exposures"))
    return dead.join(shown, "id", "left").select(
        F.col("id").alias("symbolId"), "kind", "qualifiedName", "sourceCharacters", "sourceBytes", F.coalesce("exposures", F.array().cast("array<string>")).alias("exposures"), "location"
    )
