"""Which classes are named by others, told from text alone: names are taken out of each file once and joined."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import normalize_name, simple_type_name
from quarry.sources import strings as st

PATTERNS = (
    ("apex-static-member", re.compile(r"\b([A-Za-z_]\w*)\s*\.", re.A), True, "{}.member"),
    ("apex-constructor", re.compile(r"\bnew\s+([A-Za-z_]\w*)\s*\(", re.A | re.I), True, "new {}(...)"),
    ("apex-type-literal", re.compile(r"\bType\s*\.\s*forName\s*\(\s*['\"]([A-Za-z_]\w*)['\"]", re.A | re.I), False, "Type.forName('{}')"),
)


def class_files(files: DataFrame) -> DataFrame:
    """name, path, testCode, characters, bytes of each class file; its like-named class says whether it is a test."""
    top = F.filter("facts.symbols", lambda s: s["ownerId"].isNull() & (s["kind"] == "class"))
    own = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.cls$", "")
    named = files.where(F.lower("path").endswith(".cls")).select("path", "text", "characters", "bytes", own.alias("name"), top.alias("top"))
    same = F.filter("top", lambda s: F.lower(s["name"]) == F.lower(F.col("name")))
    marked = F.col("text").rlike(r"(?i)@\s*isTest\b[\s\S]{0,500}?\bclass\s")
    test = F.coalesce(F.get(same, F.lit(0))["testCode"], F.get("top", F.lit(0))["testCode"], marked)
    return named.select("name", "path", test.alias("testCode"), "characters", "bytes")


def names_in(files: DataFrame) -> DataFrame:
    """path, line, column, kind, name, pattern: every name that code uses as one of PATTERNS says."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                code, quoted = st.masked(text, strings=True), st.masked(text)
                for kind, pattern, bare, shown in PATTERNS:
                    source = code if bare else quoted
                    for m in pattern.finditer(source):
                        at = st.location(source, path, m.start())
                        rows.append((path, at["line"], at["column"], kind, m[1].lower(), shown))
            yield pd.DataFrame(rows, columns=["path", "line", "column", "kind", "key", "shown"])

    return files.select("path", "text").mapInPandas(found, "path string, line int, column int, kind string, key string, shown string")


def audit(files: DataFrame, metadata_refs: DataFrame) -> DataFrame:
    """name, path, testCode, characters, bytes, references, referencedByName: a row for each class file."""
    classes = class_files(files)
    callers = files.join(classes.where("testCode").select("path"), "path", "left_anti")
    targets = classes.where("NOT testCode").select(normalize_name(F.col("name")).alias("key"), F.col("path").alias("own_path"), F.col("name").alias("target"))
    code = names_in(callers).join(targets, "key").where("path <> own_path").select("key", "own_path", "path", "line", "column", "kind", F.format_string("%s", F.expr("replace(shown, '{}', target)")).alias("detail"))
    meta = metadata_refs.where("targetType IS NOT NULL").withColumn("key", normalize_name(simple_type_name(F.col("targetType")))).join(targets, "key")
    meta = meta.select("key", "own_path", "location.path", "location.line", "location.column", F.lit("metadata").alias("kind"), "detail")
    every = code.unionByName(meta).groupBy("own_path", "path", "line", "column", "kind").agg(F.max("detail").alias("detail"))
    rows = every.groupBy(F.col("own_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("path", "line", "column", "kind", "detail"))).alias("references"))
    none = F.array().cast("array<struct<path:string,line:int,column:int,kind:string,detail:string>>")
    joined = classes.join(rows, "path", "left").withColumn("references", F.coalesce("references", none))
    return joined.withColumn("referencedByName", F.col("testCode") | (F.size("references") > 0))
