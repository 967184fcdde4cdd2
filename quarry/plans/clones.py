"""Clone families of method bodies: exact, parameterised, fragments, near misses; and what they cover."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import kernels
from quarry.operators import similarity
from quarry.operators.components import connected_components
from quarry.operators.graph import PROJECT
from quarry.operators.intervals import merge_intervals
from quarry.plans.stages import run_dir, stored
from quarry.sources.lexer import lex, parameterized

LEAST_TOKENS, SEPARATOR, VERSION = 25, kernels.SEPARATOR, 4
REGION = "id string, path string, line int, column int, exact string, shape string, tokens array<string>, texts array<string>, starts array<int>, stops array<int>, file_tokens int"
PLACE = "path string, start int, end int"


def regions(files: DataFrame) -> DataFrame:
    """The bodies of methods, constructors and triggers outside tests, of LEAST_TOKENS or more. files: path, text, facts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, symbols in zip(b["path"], b["text"], b["symbols"], strict=True):
                tokens = lex(text)[0]
                for s in symbols:
                    at = s["location"]
                    begin, end = (at["line"], at["column"]), (at["endLine"], at["endColumn"])
                    own = [t for t in tokens if begin <= (t.line, t.column + 1) and (t.line, t.column + 1) <= end]
                    braces = [i for i, t in enumerate(own) if t.text == "{"], [i for i, t in enumerate(own) if t.text == "}"]
                    if not braces[0] or not braces[1] or braces[1][-1] - braces[0][0] - 1 < LEAST_TOKENS:
                        continue
                    own = own[braces[0][0] + 1 : braces[1][-1]]
                    shape = parameterized(own)
                    exact = kernels.stable_hash(SEPARATOR.join(t.text.lower() for t in own))
                    rows.append((s["id"], path, at["line"], at["column"], exact, kernels.stable_hash(SEPARATOR.join(shape)), shape, [t.text for t in own], [t.start for t in own], [t.stop for t in own], len(tokens)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REGION.split(", ")])

    wanted = F.filter("facts.symbols", lambda s: ~s["testCode"] & s["kind"].isin("method", "constructor", "trigger"))
    return files.select("path", "text", wanted.alias("symbols")).mapInPandas(cut, REGION)


def whole_families(bodies: DataFrame) -> DataFrame:
    """kind, family (the shape's hash), id, similarity: bodies with the same shape; exact if all have the same text."""
    groups = bodies.groupBy("shape").agg(F.count("*").alias("n"), F.count_distinct("exact").alias("n_texts")).where("n >= 2")
    kind = F.when(F.col("n_texts") == 1, "exact").otherwise("parameterized").alias("kind")
    return bodies.join(groups, "shape").select(kind, F.col("shape").alias("family"), "id", F.lit(1.0).alias("similarity"))


def families(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(families: kind, family, id, first, last (tokens), similarity; near pairs: left, right, similarity)."""
    path = run_dir(bodies.sparkSession, "clones")
    whole = stored(whole_families(bodies), f"{path}/whole")
    prints = stored(similarity.fingerprints(bodies, "id", "tokens"), f"{path}/prints")
    same = whole.select("family", "id")
    pairs = similarity.candidate_pairs(prints, "id", hashes=True)
    for side in ("left", "right"):
        pairs = pairs.join(same.select(F.col("id").alias(side), F.col("family").alias(f"{side}_family")), side, "left")
    apart = F.coalesce(F.col("left_family") != F.col("right_family"), F.lit(True))
    pairs = stored(pairs.where(apart).select("left", "right", "seeds", "hashes"), f"{path}/pairs")
    checked = stored(similarity.verified(pairs, bodies, "id", "tokens"), f"{path}/verified")
    near = checked.where("near").select("left", "right", "similarity")
    groups = connected_components(near, "left", "right", local=PROJECT)
    means = near.join(groups, F.col("left") == F.col("node")).groupBy("component").agg(F.avg("similarity").alias("similarity"))
    close = groups.join(means, "component").select(F.lit("near-miss").alias("kind"), F.col("component").alias("family"), F.col("node").alias("id"), "similarity")
    ends = bodies.select("id", (F.size("tokens") - 1).alias("last"))
    complete = whole.unionByName(close).join(ends, "id").select("kind", "family", "id", F.lit(0).alias("first"), "last", "similarity")
    return complete.unionByName(_fragments(checked.where("NOT near"), bodies)), near


def _fragments(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    found = similarity.fragments(pairs, bodies, "id", "tokens")
    texts = similarity.with_tokens(found, bodies, "id", "texts")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                one, two = (SEPARATOR.join(x.lower() for x in t[a : z + 1]) for t, a, z in ((list(r.left_tokens), r.left_start, r.left_end), (list(r.right_tokens), r.right_start, r.right_end)))
                key = kernels.stable_hash(SEPARATOR.join(parameterized(lex(" ".join(list(r.left_tokens)[r.left_start : r.left_end + 1]))[0])))
                rows += [(key, one == two, r.left, r.left_start, r.left_end), (key, one == two, r.right, r.right_start, r.right_end)]
            yield pd.DataFrame(rows, columns=["family", "same", "id", "first", "last"])

    rows = texts.mapInPandas(keyed, "family string, same boolean, id string, first int, last int")
    kinds = rows.groupBy("family").agg(F.when(F.bool_and("same"), "exact").otherwise("parameterized").alias("kind"))
    return rows.drop("same").distinct().join(kinds, "family").select("kind", "family", "id", "first", "last", F.lit(1.0).alias("similarity"))


def occurrences(members: DataFrame, bodies: DataFrame, reached: DataFrame) -> DataFrame:
    """kind, family, similarity, id, path, line, start, end, tokens, chars, place: production first, then unreachable,
    then tests, the longest first; place 0 is the representative."""
    at = lambda name, k: F.element_at(name, F.col(k) + 1)
    rows = members.join(bodies.select("id", "path", "line", "column", "starts", "stops"), "id").join(reached.select("id", "reachability"), "id", "left")
    rows = rows.select("kind", "family", "similarity", "id", "path", "line", "column", "first", "last", at("starts", "first").alias("start"), at("stops", "last").alias("end"), (F.col("last") - F.col("first") + 1).alias("tokens"), "reachability")
    rank = F.when(F.col("reachability") == "production", 0).when(F.col("reachability") == "test-only", 2).otherwise(1)
    rows = rows.withColumn("chars", F.col("end") - F.col("start") + 1)
    w = Window.partitionBy("kind", "family").orderBy(rank, F.desc("chars"), "path", "line", "column", "start")
    return rows.withColumn("place", F.row_number().over(w) - 1).drop("reachability", "column")


def groups(rows: DataFrame) -> DataFrame:
    """id, kind, profile, similarity, duplicatedTokens, duplicatedCharacters, occurrences: the largest first."""
    top = rows.where("place = 0").select("kind", "family", F.col("tokens").alias("t"), F.col("chars").alias("c"))
    joined = rows.join(top, ["kind", "family"])
    more = F.col("place") > 0
    extra = lambda own, first: F.sum(F.when(more, F.least(own, first)).otherwise(0)).cast("long")
    each = F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("symbolId"), "path", "line", "start", "end", "tokens", "chars", "first", "last"))).alias("occurrences")
    found = joined.groupBy("kind", "family").agg(F.round(F.avg("similarity"), 4).alias("similarity"), extra("tokens", "t").alias("duplicatedTokens"), extra("chars", "c").alias("duplicatedCharacters"), each)
    profile = F.when(F.col("kind") == "exact", "exact-token").when(F.col("kind") == "parameterized", "identifier-and-literal-parameterized").when(F.col("similarity") >= similarity.STRONG, "verified-near-miss-strong").otherwise("verified-near-miss-broad")
    own = F.concat_ws("-", "kind", F.lit(f"v{VERSION}"), F.when(F.length("family") == 8, F.col("family")).otherwise(F.substring(F.md5("family"), 1, 8)))
    return found.select(own.alias("id"), "kind", profile.alias("profile"), "similarity", "duplicatedTokens", "duplicatedCharacters", "occurrences")


def covered(rows: DataFrame) -> DataFrame:
    """path, start, end: the union of the occurrences' spans in each file."""
    return merge_intervals(rows.select("path", "start", "end"), ["path"], "start", "end")


def differences(kind: str, sequences: list[list[str]]) -> list[str]:
    """How each later sequence differs from the first: by common subsequence, or by up to twelve examples."""
    out = []
    for other in sequences[1:] if kind != "exact" else []:
        first = sequences[0]
        if kind == "near-miss":
            common = kernels.lcs_length([x.lower() for x in first], [x.lower() for x in other])
            out.append(f"Compared occurrence: {len(first) - common} representative token deletion(s), {len(other) - common} insertion(s) under ordered LCS alignment.")
        else:
            shown = list(dict.fromkeys(f"{a} <> {b}" for a, b in zip(first, other, strict=False) if a.lower() != b.lower()))[:12]
            out.append(f"Compared occurrence: {len(shown)} shown identifier/literal difference(s): {', '.join(shown) or 'none'}.")
    return out


def token_places(files: DataFrame) -> DataFrame:
    """path, starts: where each token of a file begins."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "starts": [[t.start for t in lex(text)[0]] for text in b["text"]]})

    return files.select("path", "text").mapInPandas(placed, "path string, starts array<int>")


def tokens_within(spans: DataFrame, places: DataFrame) -> DataFrame:
    """tokens: how many tokens begin inside the spans (path, start, end, which don't overlap)."""
    inside = F.size(F.filter("starts", lambda x: x.between(F.col("start"), F.col("end"))))
    return spans.join(places, "path").agg(F.coalesce(F.sum(inside), F.lit(0)).alias("tokens"))
