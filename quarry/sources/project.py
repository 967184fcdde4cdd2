"""A project's files as rows, and the facts in them."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import utf16_length
from quarry.sources import apex, metadata

# The files that count, and those that never do.
CODE_SUFFIXES = ("cls", "trigger")
TEXT_SUFFIXES = ("xml", "js", "ts", "json", "html", "css", "cmp", "app", "page", "component", "flow", "yaml", "yml", "txt")
IGNORED_FOLDERS = ("node_modules", ".git", ".sf", ".sfdx", "dist", "coverage", "validation", "__tests__", "__mocks__")
IGNORED_ENDS = (".test.js", ".spec.js")

LOCATION = "struct<path:string,line:int,column:int,endLine:int,endColumn:int>"
SYMBOL = f"struct<id:string,kind:string,name:string,qualifiedName:string,ownerId:string,arity:int,parameterTypes:array<string>,parameterNames:array<string>,modifiers:array<string>,annotations:array<string>,interfaces:array<string>,superclass:string,testCode:boolean,location:{LOCATION},sourceCharacters:bigint,sourceBytes:bigint>"
REFERENCE = f"struct<sourceId:string,kind:string,memberName:string,arity:int,arguments:array<string>,passed:array<string>,receiver:string,receiverType:string,targetType:string,testContext:boolean,location:{LOCATION},detail:string>"
ENTRY = f"struct<symbolId:string,source:string,reason:string,testOnly:boolean,location:{LOCATION}>"
BLOCKER = f"struct<code:string,scope:string,message:string,blocksClosedWorldConclusion:boolean,symbolId:string,repositoryMetadataField:string,dynamicExpression:string,location:{LOCATION}>"
EXPOSURE = f"struct<kind:string,symbolId:string,reason:string,location:{LOCATION}>"
SOQL = f"struct<symbolId:string,object:string,fields:array<string>,filterShape:string,normalizedQuery:string,dynamic:boolean,securityMode:string,sharingContext:string,aggregate:boolean,locking:boolean,location:{LOCATION}>"
DML = f"struct<symbolId:string,operation:string,targetExpression:string,targetType:string,allOrNone:string,accessMode:string,location:{LOCATION}>"
BEHAVIOR = f"struct<symbolId:string,statements:int,branches:int,loops:int,tryBlocks:int,throws:int,assignments:int,assignmentTargets:array<string>,valueBindings:array<struct<name:string,type:string,expression:string,conditional:boolean,location:{LOCATION}>>,returnExpressions:array<struct<expression:string,location:{LOCATION}>>,enhancedForLoops:array<struct<variable:string,collection:string>>,advancedCollectionTypes:array<string>,callDetails:array<string>,queries:array<{SOQL}>,dynamicQueryGaps:array<struct<symbolId:string,expression:string,reason:string,location:{LOCATION}>>,dml:array<{DML}>>"
DIAGNOSTIC = "struct<path:string,line:int,column:int,message:string>"
CODE_FACTS = f"struct<symbols:array<{SYMBOL}>,references:array<{REFERENCE}>,entries:array<{ENTRY}>,blockers:array<{BLOCKER}>,exposures:array<{EXPOSURE}>,behaviors:array<{BEHAVIOR}>,diagnostics:array<{DIAGNOSTIC}>>"
TEXT_FACTS = f"struct<references:array<struct<targetType:string,memberName:string,location:{LOCATION},detail:string,known:boolean>>,bundle:struct<bundle:string,controllers:array<string>,calls:array<struct<member:string,location:{LOCATION}>>>,fields:array<string>,automation:struct<kind:string,object:string,timing:string,path:string>>"


def source_roots(root: Path) -> list[Path]:
    """Package directories of the project file; the root where there is none."""
    config = root / "sfdx-project.json"
    if not config.exists():
        return [root]
    try:
        found = [root / d["path"] for d in json.loads(config.read_text()).get("packageDirectories", []) if d.get("path")]
    except (ValueError, AttributeError, TypeError) as e:
        raise ValueError(f"Unable to read sfdx-project.json: {e}") from e
    return found or [root]


def glob_pattern(glob: str) -> str:
    """A glob as a pattern of whole paths: ** is any folders, * and ? stay in a name, [...] is a set."""
    kinds = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    piece = lambda m: kinds.get(m[0]) or (m[0].replace("[!", "[^") if m[0][0] == "[" and len(m[0]) > 1 else re.escape(m[0]))
    return "^" + re.sub(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|.", piece, glob) + "$"


def chosen(found: DataFrame, exclude: list[str] = (), include: list[str] | None = None) -> DataFrame:
    """path, kind (code or text), text, seq, of files (path, text): what counts, ordered by Unicode collation of paths."""
    escaped = lambda words: "|".join(re.escape(w) for w in words)
    path = F.col("path")
    counts = path.rlike(rf"\.({escaped(CODE_SUFFIXES + TEXT_SUFFIXES)})$") & ~path.rlike(rf"(^|/)({escaped(IGNORED_FOLDERS)})/") & ~path.rlike(rf"({escaped(IGNORED_ENDS)})$")
    for glob in exclude:
        counts &= ~path.rlike(glob_pattern(glob))
    code = path.rlike(rf"\.({escaped(CODE_SUFFIXES)})$")
    picked = path.rlike("|".join(map(glob_pattern, include))) if include else F.lit(True)
    named = found.select("path", "text").where(counts & (picked | ~code)).dropDuplicates(["path"]).withColumn("kind", F.when(code, "code").otherwise("text"))
    # paths alone are put in order, not texts
    order = named.select("path", F.row_number().over(Window.partitionBy("kind").orderBy(F.collate("path", "UNICODE"))).alias("seq"))
    return named.join(order, "path").select("path", "kind", "text", "seq")


def files(spark: SparkSession, root: Path, exclude: list[str] = (), include: list[str] | None = None) -> DataFrame:
    """See chosen(); paths are from the root. Read by executors."""
    root = root.resolve()
    roots = [str(r.resolve()) for r in source_roots(root) if r.exists() and r.resolve().is_relative_to(root)]
    if not roots:
        return spark.createDataFrame([], "path string, kind string, text string, seq int")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(CODE_SUFFIXES + TEXT_SUFFIXES) + "}")
    found = read.load(sorted(set(roots))).select(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^file:/*", "/").alias("full"), F.decode("content", "UTF-8").alias("text"))
    relative = F.substring("full", len(str(root)) + 2, 1 << 20)
    return chosen(found.select(relative.alias("path"), "text"), exclude, include)


def _read(all_files: DataFrame, kind: str, read: Callable[[str, str], dict], facts: str) -> DataFrame:
    """path, seq, text and facts of the files of a kind: read in Arrow batches, about as many files in each task."""
    schema = f"path string, seq int, text string, facts {facts}"
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read(t, p) for p, t in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["path"], b["seq"], b["text"], pa.array(found, shape.field("facts").type)], schema=shape)

    return all_files.where(F.col("kind") == kind).select("path", "seq", "text").repartition(all_files.sparkSession.sparkContext.defaultParallelism, "seq").mapInArrow(rows, schema)


def code_facts(all_files: DataFrame) -> DataFrame:
    """path, seq, text, characters, bytes, and facts: a row for each code file."""
    df = _read(all_files, "code", apex.extract, CODE_FACTS)
    return df.select("path", "seq", "text", utf16_length(F.col("text")).alias("characters"), F.octet_length("text").cast("long").alias("bytes"), "facts")


def text_facts(all_files: DataFrame) -> DataFrame:
    """path, seq and facts: a row for each metadata file."""
    return _read(all_files, "text", metadata.facts, TEXT_FACTS).select("path", "seq", "facts")


def revision(root: Path) -> dict:
    """Branch, commit and whether there are changes; only `available` if git says nothing."""
    git = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True, text=True, check=True, timeout=60).stdout.strip()
    try:
        return {"available": True, "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}
    except (OSError, subprocess.SubprocessError):
        return {"available": False}
