"""The analysis of one project: from files to one versioned report."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import __version__
from quarry.functions import normalize_name
from quarry.functions import kernels
from quarry.operators import families as fam
from quarry.operators import ordered, similarity
from quarry.operators.graph import PROJECT, closure
from quarry.plans import clones, flow, name_audit, provenance, reachability
from quarry.plans.markdown import KINDS, LABELS, LIMIT, OTHER
from quarry.plans.stages import run_dir, stored
from quarry.sources import project as src

SCHEMA_VERSION = "4.1.0"
#: Symbols of a project whose facts about values are gathered; those of a larger one are followed by the executors.
FEW = 20_000
#: Plans that the driver makes at the same time; more fill its memory.
AT_ONCE = 6
TYPES = ("class", "interface", "enum")


def rows(df: DataFrame, *order) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def together(*tasks):
    """The results of tasks that don't need each other, some run at the same time: most are jobs too small to fill the cluster."""
    with ThreadPoolExecutor(min(len(tasks), AT_ONCE)) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


class Shown(list):
    """The first items of a list, and how many it has."""

    def __init__(self, items: Iterable, total: int):
        super().__init__(items)
        self.total = total


def head(df: DataFrame, *order, n: int = LIMIT) -> Shown:
    """The first n rows, and how many there are: counted only if there are more."""
    got = rows(df.orderBy(*order).limit(n + 1))
    return Shown(got[:n], df.count() if len(got) > n else len(got))


class Project:
    """Each relation is a DataFrame; `report()` puts them together, `overview()` what its Markdown shows and `totals()` its totals."""

    def __init__(self, spark: SparkSession, path: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, files: DataFrame | None = None):
        """A project in a folder, or in a table of files (path, text)."""
        self.root = Path(path).resolve() if path else None
        if self.root and not self.root.is_dir():
            raise FileNotFoundError(f"Project directory does not exist: {self.root}")
        self.spark, self.path = spark, run_dir(spark, "project")
        found = src.files(spark, self.root, exclude or [], include) if self.root else src.chosen(files, exclude or [], include)
        self.chosen = stored(found, f"{self.path}/files")
        read = ((src.code_facts, "code"), (src.text_facts, "texts"))
        self.code, self.texts = together(*(lambda f=f, name=name: stored(f(self.chosen), f"{self.path}/{name}") for f, name in read))

    def _rows(self, name: str, seq: str | None = None) -> DataFrame:
        """One of the code facts as rows, in walk order if seq names a column for it."""
        df = self.code.select("seq", "path", F.posexplode(f"facts.{name}").alias("pos", "r"))
        order = (F.col("seq").cast("long") * (1 << 22) + F.col("pos")).alias(seq) if seq else None
        return df.select("r.*", *([order] if seq else []))

    @cached_property
    def symbols(self) -> DataFrame:
        return stored(self._rows("symbols", "sym_seq"), f"{self.path}/symbols")

    @cached_property
    def files(self) -> DataFrame:
        """code with first_test (its first top-level symbol is a test) and test_only (all are, and there are some)."""
        top = F.filter("facts.symbols", lambda s: s["ownerId"].isNull())
        first = F.coalesce(F.get(top, F.lit(0))["testCode"], F.lit(False))
        only = (F.size(top) > 0) & F.forall(top, lambda s: s["testCode"])
        return self.code.select("*", first.alias("first_test"), only.alias("test_only"))

    @cached_property
    def metadata_refs(self) -> DataFrame:
        """References of metadata: of one place, type and member the first place and the last detail count."""
        known = self.symbols.where("ownerId IS NULL AND kind <> 'trigger' AND NOT testCode")
        known = known.groupBy(normalize_name(F.col("name")).alias("key")).agg(F.max_by("name", "sym_seq").alias("own"))
        every = self.texts.select("seq", F.posexplode("facts.references").alias("pos", "r")).select("r.*", (F.col("seq").cast("long") * (1 << 22) + F.col("pos")).alias("at"))
        mentioned = every.where("known").withColumn("key", normalize_name(F.col("targetType"))).join(F.broadcast(known), "key")
        member = F.when(F.col("memberName").isNull(), "").otherwise(F.concat(F.lit("."), F.col("memberName")))
        mentioned = mentioned.select(F.col("own").alias("targetType"), "memberName", "location", F.concat_ws(" ", "detail", F.concat("own", member)).alias("detail"), "at")
        plain = every.where("NOT known").select("targetType", "memberName", "location", "detail", "at")
        parts = self.texts.where("facts.bundle.bundle IS NOT NULL").select("seq", "facts.bundle.*")
        controllers = parts.select("bundle", F.explode("controllers").alias("targetType"))
        calls = parts.select("bundle", "seq", F.posexplode("calls").alias("pos", "c")).select("bundle", "c.member", "c.location", (F.lit(1 << 50) + F.col("seq").cast("long") * (1 << 22) + F.col("pos")).alias("at"))
        bundled = controllers.join(calls, "bundle").select("targetType", F.col("member").alias("memberName"), "location", F.concat(F.lit("Aura bundle call "), "targetType", F.lit("."), "member").alias("detail"), "at")
        rows_ = mentioned.unionByName(plain).unionByName(bundled).select("*", F.col("location.path").alias("p"), F.col("location.line").alias("l"), F.coalesce("memberName", F.lit("")).alias("m"))
        one = ordered.last_wins(rows_, ["p", "l", "targetType", "m"], "at", ["memberName", "location", "detail"])
        return stored(one.select("targetType", "memberName", "location", "detail", "at"), f"{self.path}/metadata_refs")

    @cached_property
    def raw_refs(self) -> DataFrame:
        code = self._rows("references", "ref_seq")
        none = lambda kind: F.lit(None).cast(kind)
        meta = self.metadata_refs.select(
            none("string").alias("sourceId"), F.lit("metadata").alias("kind"), "memberName", none("int").alias("arity"), none("array<string>").alias("arguments"), none("array<string>").alias("passed"), none("string").alias("receiver"),
            none("string").alias("receiverType"), "targetType", F.lit(False).alias("testContext"), "location", "detail", (F.lit(1 << 54) + F.col("at")).alias("ref_seq"),
        )
        return stored(code.unionByName(meta), f"{self.path}/raw_refs")

    @cached_property
    def blockers_found(self) -> list[dict]:
        """Gaps before any is resolved: open class names, and diagnostics of files that aren't tests alone."""
        broken = self.files.where("NOT test_only").select("seq", F.posexplode("facts.diagnostics").alias("pos", "d")).orderBy("seq", "pos")
        parse = [
            {"code": "parse-error", "scope": "project", "message": d["message"], "blocksClosedWorldConclusion": True, "symbolId": None, "location": {"path": d["path"], "line": d["line"], "column": d["column"]}}
            for d in (r["d"].asDict() for r in broken.collect())
        ]
        return rows(self._rows("blockers", "at"), "at") + parse

    @cached_property
    def names(self) -> reachability.Names:
        return reachability.Names.of(self.symbols, self.path)

    def _graph(self, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """edges, stored, with the entries and the reachability that they make."""
        edges = stored(edges, f"{self.path}/{name}-edges")
        declared = self._rows("entries", "seq").select("symbolId", "source", "reason", "testOnly", "location", "seq")
        entries = stored(reachability.entries_of(declared, edges), f"{self.path}/{name}-entries")
        return edges, entries, stored(reachability.classify(self.symbols, edges, entries), f"{self.path}/{name}-reached")

    @cached_property
    def behaviors(self) -> DataFrame:
        return stored(self._rows("behaviors", "at"), f"{self.path}/behaviors")

    @cached_property
    def configured(self) -> set[str]:
        return {r[0] for r in self.texts.select(F.explode("facts.fields")).distinct().collect()}

    @cached_property
    def graph(self) -> dict:
        """edges, entries, reached, blockers: after class names that can be proven have become references."""
        edges, entries, reached = self._graph(reachability.edges_of(self.names, self.raw_refs), "first")
        blockers = self.blockers_found
        if any(b["code"] == "dynamic-type" for b in blockers):
            returns = self.behaviors.select("symbolId", F.explode("returnExpressions").alias("r")).select("symbolId", "r.expression", "r.location")
            calls = edges.where("kind IN ('call', 'construct')").select("sourceId", "targetId", "kind", "detail", "arguments", "testContext", "location", "ref_seq")
            starts = entries.where("NOT testOnly").select("symbolId").distinct()
            names = self.symbols.select("id", "kind", "name", "qualifiedName", "ownerId", "arity", "parameterNames", "sym_seq")
            bindings = provenance.bindings_of(self.behaviors)
            if self.symbols.count() <= FEW:
                live = {r["id"]: r["reachability"] for r in reached.select("id", "reachability").collect()}
                values = provenance.Values(rows(names, "sym_seq"), rows(bindings), rows(returns), rows(calls, "ref_seq"), {r[0] for r in starts.collect()}, live)
                blockers, made = provenance.resolve(values, blockers, live, self.configured)
            else:
                asked = [(n, b["symbolId"], b["location"], b["dynamicExpression"]) for n, b in enumerate(blockers) if b["code"] == "dynamic-type" and b["symbolId"] and b["dynamicExpression"]]
                opened = self.spark.createDataFrame(asked, f"n int, symbolId string, location {src.LOCATION}, dynamicExpression string")
                blockers, made = provenance.resolved(provenance.found_by_parts(opened, names, bindings, returns, calls, starts, reached), blockers, self.configured)
            if made:
                fields = "sourceId string, kind string, targetType string, testContext boolean, location " + src.LOCATION + ", detail string, ref_seq long"
                added = self.spark.createDataFrame([{**m, "location": {**m["location"], "endLine": None, "endColumn": None}, "ref_seq": (1 << 57) + i} for i, m in enumerate(made)], fields)
                added = self.raw_refs.limit(0).unionByName(added, allowMissingColumns=True)
                edges, entries, reached = self._graph(edges.unionByName(reachability.edges_of(self.names, added)), "last")
        at = self.spark.createDataFrame([(b["symbolId"],) for b in blockers if b.get("symbolId")], "id string").distinct()
        live = {r["id"] for r in reached.where("reachability = 'production'").join(at, "id", "left_semi").select("id").collect()}
        return {"edges": edges, "entries": entries, "reached": reached, "blockers": [b for b in blockers if b.get("symbolId") is None or b["symbolId"] in live]}

    @cached_property
    def candidates(self) -> DataFrame:
        return stored(reachability.candidates_of(self.symbols, self.graph["reached"], self._rows("exposures")), f"{self.path}/candidates")

    @cached_property
    def audit(self) -> DataFrame:
        return stored(name_audit.audit(self.files, self.metadata_refs), f"{self.path}/audit")

    @cached_property
    def production(self) -> DataFrame:
        return self.files.where("NOT first_test")

    @cached_property
    def clone_members(self) -> tuple[DataFrame, DataFrame]:
        """Bodies of executables, and which of them are of which family."""
        bodies = stored(clones.regions(self.production), f"{self.path}/bodies")
        return bodies, stored(clones.families(bodies)[0], f"{self.path}/clone-members")

    @cached_property
    def occurrences(self) -> DataFrame:
        bodies, members = self.clone_members
        return stored(clones.occurrences(members, bodies, self.graph["reached"]), f"{self.path}/occurrences")

    def prepare(self, with_lists: bool = True) -> None:
        """The relations that others build on, those together that don't need each other. with_lists: clones and verdicts, too."""
        together(lambda: self.symbols, lambda: self.behaviors)
        together(lambda: self.raw_refs, lambda: self.blockers_found, lambda: self.configured)
        together(lambda: self.graph, lambda: self.audit, *[lambda: self.clone_members] * with_lists)
        together(lambda: self.candidates, *[lambda: self.assessments, lambda: self.occurrences] * with_lists)

    def _observed(self, name: str) -> DataFrame:
        """One of the lists of production behaviours as rows, with `at`: their place in walk order."""
        each = self.production.select("seq", F.posexplode("facts.behaviors").alias("n", "b")).select("seq", "n", F.posexplode(f"b.{name}").alias("pos", "q"))
        return each.select("q.*", (F.col("seq").cast("long") * (1 << 36) + F.col("n").cast("long") * (1 << 16) + F.col("pos")).alias("at"))

    def query_families(self) -> DataFrame:
        """kind, object, occurrences, symbols, commonFields, allFields, shapes: equal queries, and selectors that overlap."""
        q = stored(self._observed("queries"), f"{self.path}/queries").withColumn("o", F.lower("object"))
        w = Window.partitionBy("o")
        q = q.withColumn("many", F.count("*").over(w)).withColumn("owners", F.size(F.collect_set("symbolId").over(w))).where("many >= 2 AND owners >= 2")
        q = q.withColumn("semantics", F.concat_ws("|", "o", "securityMode", "sharingContext", "aggregate", "locking"))
        same = q.groupBy("normalizedQuery", "o").agg(F.count("*").alias("n")).where("n >= 2").select("normalizedQuery", "o")
        exact = q.join(same, ["normalizedQuery", "o"]).withColumn("family", F.col("normalizedQuery")).withColumn("kind", F.lit("exact-query"))
        distinct = q.groupBy("normalizedQuery", "o").agg(F.max_by(F.struct("symbolId", "object", "fields", "filterShape", "semantics", "at"), "at").alias("l")).select("normalizedQuery", "o", "l.*")
        shape = F.concat_ws("|", "semantics", "filterShape")
        groups = fam.selector_families(distinct.withColumn("shape", shape).withColumn("member", F.concat_ws("|", "o", "normalizedQuery")), ["semantics"], "member", "fields", "shape", local=PROJECT)
        selector = distinct.withColumn("member", F.concat_ws("|", "o", "normalizedQuery")).join(groups, "member").withColumn("kind", F.lit("selector-family"))
        cols = ["kind", "family", "object", "symbolId", "fields", "filterShape", "at"]
        every = stored(exact.select(*cols).unionByName(selector.select(*cols)), f"{self.path}/query-members")
        keyed = every.withColumn("key", F.concat_ws("~", "kind", "family"))
        sets = fam.set_summary(keyed, "key", "at", "fields")
        about = keyed.groupBy("key", "kind").agg(F.min("object").alias("object"), F.count("*").alias("occurrences"), F.array_sort(F.collect_set("symbolId")).alias("symbols"), F.array_sort(F.collect_set("filterShape")).alias("shapes"))
        return about.join(sets.select("key", F.col("common").alias("commonFields"), F.col("all").alias("allFields")), "key").select(F.concat_ws("-", "kind", F.substring(F.md5("key"), 1, 8)).alias("id"), "kind", "object", "occurrences", "symbols", "commonFields", "allFields", "shapes")

    def dml_families(self) -> DataFrame:
        d = self._observed("dml").withColumn("target", F.coalesce("targetType", "targetExpression"))
        keys = ["operation", "target", "allOrNone", "accessMode"]
        return fam.key_families(d, keys, "symbolId", 2, 2, (F.array_sort(F.collect_set("symbolId")).alias("symbols"), F.min("at").alias("at"))).drop("members")

    def _flow_facts(self) -> tuple[DataFrame, ...]:
        """What verdicts on triggers are made of."""
        g = self.graph
        triggers = self.symbols.where("kind = 'trigger'").select("id", "name", F.col("location.path").alias("path"), "sym_seq").join(self.code.select("path", "text"), "path").select("id", "name", "text", "sym_seq")
        automations = self.texts.where("facts.automation IS NOT NULL").select("facts.automation.*")
        closing = [(n, b["code"], b["message"], b.get("symbolId"), (b.get("location") or {}).get("path")) for n, b in enumerate(g["blockers"]) if b["blocksClosedWorldConclusion"]]
        blockers = self.spark.createDataFrame(closing, "n int, code string, message string, symbolId string, path string")
        entries = g["entries"].where("NOT testOnly").select(F.col("symbolId").alias("node")).distinct()
        return triggers, self.symbols, self.behaviors, g["edges"], entries, self.code.select("path", "characters"), automations, blockers

    @cached_property
    def assessments(self) -> DataFrame:
        return stored(flow.assessments(*self._flow_facts()), f"{self.path}/assessments")

    def twice(self) -> DataFrame:
        """key, shown, top, at (places) of names that are declared twice."""
        owner = self.symbols.select(F.col("id").alias("ownerId"), F.col("qualifiedName").alias("owner"))
        signature = F.concat_ws(",", F.transform(F.coalesce("parameterTypes", F.array().cast("array<string>")), normalize_name))
        member = F.concat("kind", F.lit(":"), normalize_name(F.coalesce("owner", F.lit("unknown"))), F.lit("."), normalize_name(F.col("name")), F.lit("("), signature, F.lit(")"))
        key = F.when(F.col("ownerId").isNull(), F.concat(F.lit("type:"), normalize_name(F.col("qualifiedName")))).otherwise(member)
        named = self.symbols.join(owner, "ownerId", "left").withColumn("key", key)
        about = (F.min_by("qualifiedName", "sym_seq").alias("shown"), F.min_by("owner", "sym_seq").alias("owner"), F.bool_and(F.col("ownerId").isNull()).alias("top"), F.array_sort(F.collect_list(F.struct("sym_seq", "location"))).alias("at"))
        twice = fam.key_families(named, ["key"], "id", also=about)
        tops = twice.where("top").select(normalize_name(F.col("shown")).alias("t"))
        return twice.join(tops, normalize_name(F.col("owner")) == F.col("t"), "left_anti")

    def test_diagnostics(self) -> DataFrame:
        return self.files.where("test_only").select(F.explode("facts.diagnostics").alias("d")).select("d.*")

    def findings(self, some=rows) -> list[dict]:
        """Names that are declared twice, and diagnostics of test files. some: which rows of each, in order."""
        out = []
        kept, tests = together(lambda: some(self.twice(), "key"), lambda: some(self.test_diagnostics(), "path", "line"))
        for r in kept:
            places = ", ".join(f"{x['location']['path']}:{x['location']['line']}" for x in r["at"])
            text = f"Duplicate top-level Apex component {r['shown']} appears at {places}. Calls are conservatively connected to every declaration." if r["top"] else f"Duplicate symbol {r['shown']} appears at {places}."
            out.append({"code": "duplicate-symbol", "message": text, "locations": [x["location"] for x in r["at"]]})
        out += [{"code": "test-parse-error", "message": f"Test-only parse diagnostic: {d['message']}", "locations": [{k: d[k] for k in ("path", "line", "column")}]} for d in tests]
        return out if some is rows else Shown(out, kept.total + tests.total)

    def evidence(self) -> DataFrame:
        """Edges that matter: of metadata, on an evidence path, at a candidate, or from where nothing leads to."""
        g, e = self.graph, self.graph["edges"]
        steps = g["reached"].where(F.size("path") > 1).select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("s")).select(F.col("s.a").alias("sourceId"), F.col("s.b").alias("targetId")).distinct().withColumn("on_path", F.lit(True))
        mark = lambda df, column, name: df.select(F.col(df.columns[0]).alias(column)).distinct().withColumn(name, F.lit(True))
        ids = self.candidates.select("symbolId")
        e = e.join(steps, ["sourceId", "targetId"], "left").join(mark(ids, "sourceId", "a"), "sourceId", "left").join(mark(ids, "targetId", "b"), "targetId", "left")
        e = e.join(mark(g["reached"].where("reachability = 'unreachable'").select("id"), "sourceId", "c"), "sourceId", "left")
        return e.where("kind = 'metadata' OR on_path OR a OR b OR c").drop("on_path", "a", "b", "c")

    def inventory(self) -> dict:
        test = F.col("first_test")
        total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
        every = F.lit(True)
        found = self.files.agg(F.count("*").alias("apexFiles"), *(total(c, when).alias(f"{name}Apex{c.title()}") for name, when in (("production", ~test), ("test", test)) for c in ("characters", "bytes")), *(total(c, every).alias(f"apex{c.title()}") for c in ("characters", "bytes"))).first().asDict()
        roots = [str(p.resolve().relative_to(self.root)) or "." for p in src.source_roots(self.root)] if self.root else ["."]
        return found | {"root": str(self.root or ""), "sourceRoots": roots, "metadataFiles": self.texts.count()}

    def summary(self) -> dict:
        n = lambda when: F.coalesce(F.sum(F.when(when, 1)), F.lit(0))
        total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
        kinds, code, g = F.col("kind").isin(*TYPES), F.col("kind").isin("method", "constructor"), self.graph
        counts, by, c, entries, edges = together(
            lambda: self.symbols.agg(F.count("*").alias("symbols"), n(F.col("kind") == "class").alias("classes"), n(code).alias("methods")).first().asDict(),
            lambda: {r["reachability"]: r["count"] for r in g["reached"].groupBy("reachability").count().collect()},
            lambda: self.candidates.agg(n(kinds).alias("candidateClasses"), n(code).alias("candidateMethods"), total("sourceCharacters", kinds).alias("candidateClassCharacters"), total("sourceBytes", kinds).alias("candidateClassBytes")).first().asDict(),
            lambda: g["entries"].count(), lambda: g["edges"].count(),
        )
        # a construction of a type of the project always leads to a constructor or the type itself, and nothing else counts as unresolved
        return counts | {"entryPoints": entries, "resolvedReferences": edges, "unresolvedReferences": 0, "productionReachable": by.get("production", 0), "testOnlyReachable": by.get("test-only", 0), "unreachable": by.get("unreachable", 0)} | c

    def clone_totals(self) -> dict:
        """Characters and tokens of production, covered by clones, and of those beyond each family's first."""
        places = clones.token_places(self.production)
        more = self.occurrences.where("place > 0")
        chars = lambda df: int(clones.covered(df).agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0))).first()[0])
        inside = lambda df: clones.tokens_within(clones.covered(df), places).first()[0]
        coverage, repeated, tokens, covered, doubled = together(lambda: chars(self.occurrences), lambda: chars(more), lambda: places.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0], lambda: inside(self.occurrences), lambda: inside(more))
        return {"cloneCoverageCharacters": coverage, "duplicatedCharacters": repeated, "productionTokens": tokens, "cloneCoverageTokens": covered, "duplicatedTokens": doubled}

    def clone_groups(self) -> list[dict]:
        bodies = self.clone_members[0]
        found, texts = together(
            lambda: rows(clones.groups(self.occurrences), F.desc("duplicatedCharacters"), "id"),
            lambda: {r["id"]: r["texts"] for r in bodies.join(self.occurrences.select("id").distinct(), "id").select("id", "texts").collect()},
        )
        return [g | {"differences": clones.differences(g["kind"], [texts[o["symbolId"]][o["first"] : o["last"] + 1] for o in g["occurrences"]])} for g in found]

    def deprecation(self) -> tuple[dict, dict]:
        """Files of candidate types, and candidate members of other types: how many, and their characters."""
        tops = self.candidates.where(F.col("kind").isin(*TYPES)).select("symbolId", "location.path")
        whole = tops.select("path").distinct().join(self.code.select("path", "characters"), "path")
        under = self._owners().join(tops.select(F.col("symbolId").alias("ancestor")), "ancestor").select(F.col("node").alias("symbolId")).distinct()
        loose = self.candidates.where("kind IN ('method', 'constructor')").join(under, "symbolId", "left_anti")
        counted = lambda df, c: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("c")).first().asDict()
        return tuple(together(lambda: counted(whole, "characters"), lambda: counted(loose, "sourceCharacters")))

    def audit_totals(self) -> dict:
        n = lambda when: F.coalesce(F.sum(F.when(when, 1)), F.lit(0))
        tests, named = F.col("testCode"), F.col("referencedByName")
        lost = F.coalesce(F.sum(F.when(~named, F.col("characters"))), F.lit(0)).cast("long")
        return self.audit.agg(n(~tests).alias("productionClasses"), n(tests).alias("testClasses"), n(~tests & ~named).alias("unreferencedProductionClasses"), n(~tests & named).alias("referencedProductionClasses"), lost.alias("unreferencedProductionCharacters")).first().asDict()

    def _about(self) -> dict:
        return {
            "schemaVersion": SCHEMA_VERSION, "tool": {"name": "quarry", "version": __version__}, "generatedAt": datetime.datetime.now(datetime.UTC).isoformat(),
            "revision": src.revision(self.root) if self.root else {"available": False},
        }

    def _analysis(self, findings: list[dict]) -> dict:
        blockers = self.graph["blockers"]
        return {"universe": "repository", "assumption": "All code and metadata that make production calls are in the analyzed package directories; callers elsewhere are outside this result.",
                "status": "blocked" if any(b["blocksClosedWorldConclusion"] for b in blockers) else "complete", "blockers": blockers, "findings": findings}

    def _executive(self, production: int, whole: dict, loose: dict, coverage: int, repeated: int, groups: int, query_families: int, migration: dict) -> dict:
        gone = min(production, whole["c"] + loose["c"])
        share = lambda part: flow.percent(part, production)
        return {
            "productionCharacters": production, "deprecationCandidateCharacters": gone, "deprecationCandidatePercent": share(gone), "retainedCharacters": max(0, production - gone), "retainedPercent": share(max(0, production - gone)),
            "topLevelCandidateFiles": whole["n"], "internalRefactorCandidates": loose["n"],
            "redundancy": {"coveredCharacters": coverage, "coveredPercent": share(coverage), "duplicatedCharacters": repeated, "duplicatedPercent": share(repeated), "cloneGroups": groups, "queryFamilies": query_families},
            "flowAutomation": {k: migration[k] for k in ("eligibleTriggers", "reclaimableCharacters", "reclaimablePercent")},
        }

    def totals(self) -> dict:
        """inventory, summary, verdicts on triggers, classes by name and findings in numbers, as report() has them. No list of the report comes to the driver."""
        self.prepare(with_lists=False)
        inv, summary, migration, audit, twice, tests = together(
            self.inventory, self.summary, lambda: flow.in_numbers(*self._flow_facts()), self.audit_totals, lambda: self.twice().count(), lambda: self.test_diagnostics().count()
        )
        return {"inventory": inv, "summary": summary, "flowMigration": migration, "topLevelClassNameAudit": audit, "findings": twice + tests}

    def overview(self) -> dict:
        """What of report() its Markdown shows: the totals, the whole lists that it shows whole, and of others the first items and how many there are."""
        self.prepare()
        kind, label = F.col("kind"), F.lit(OTHER)
        for begin, shown in reversed(LABELS):
            label = F.when(F.col("r.detail").startswith(begin), shown).otherwise(label)
        for own, shown in KINDS.items():
            label = F.when(F.col("r.kind") == own, shown).otherwise(label)
        named = self.audit.where("NOT testCode").select("path", F.explode("references").alias("r")).groupBy(label.alias("label")).agg(F.count_distinct("path").alias("n"), F.count("*").alias("each"))
        by_size = (F.desc("sourceBytes"), F.collate("qualifiedName", "UNICODE"))
        chars = lambda df: int(clones.covered(df).agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0))).first()[0])
        verdicts = self.assessments.select("triggerName", "object", "status", "kind", "reclaimableCharacters", "reasons", "blockers", "rank", "sym_seq")
        inv, summary, coverage, repeated, groups, gaps, query_families, dml_families, audit, sources, unused, (whole, loose), findings, types, members, verdicts = together(
            self.inventory, self.summary, lambda: chars(self.occurrences), lambda: chars(self.occurrences.where("place > 0")), lambda: head(clones.groups(self.occurrences), F.desc("duplicatedCharacters"), "id"),
            lambda: head(self._observed("dynamicQueryGaps"), "at"), lambda: rows(self.query_families().select("id", "kind", "object", "occurrences", "commonFields"), F.desc("occurrences"), "id"), lambda: rows(self.dml_families().drop("symbols"), "at"),
            self.audit_totals, lambda: [tuple(r) for r in named.orderBy(F.desc("n"), F.desc("each"), "label").collect()], lambda: head(self.audit.where("NOT testCode AND NOT referencedByName").select("name", "bytes", "path"), F.desc("bytes"), "name", F.collate("path", "UNICODE")),
            self.deprecation, lambda: self.findings(head), lambda: head(self.candidates.where(kind.isin(*TYPES)), *by_size), lambda: head(self.candidates.where(~kind.isin(*TYPES)), *by_size), lambda: rows(verdicts),
        )
        production = inv["productionApexCharacters"]
        migration = flow.summary(verdicts, production)
        return self._about() | {
            "inventory": inv, "summary": summary, "topLevelClassNameAudit": audit | {"unreferencedProductionPercent": flow.percent(audit["unreferencedProductionCharacters"], production), "sources": sources, "unused": unused},
            "executive": self._executive(production, whole, loose, coverage, repeated, groups.total, len(query_families), migration), "flowMigration": migration, "analysis": self._analysis(findings),
            "duplicates": {"cloneGroups": groups, "queryFamilies": query_families, "dmlFamilies": dml_families, "queryCoverage": {"unresolvedDynamicQueries": gaps}}, "candidates": {"types": types, "members": members},
        }

    def report(self, full_graph: bool = False) -> dict:
        self.prepare()
        g, s = self.graph, self.symbols
        inv, summary, totals, groups, blocked, gaps, query_families, dml_families, a, audit_rows, tested, (whole, loose), findings, reached, edges, entries, candidates, exposures, diagnostics, symbols, verdicts = together(
            self.inventory, self.summary, self.clone_totals, self.clone_groups,
            lambda: [r[0] for r in self.production.where(F.size("facts.diagnostics") > 0).select("path").orderBy("path").collect()],
            lambda: rows(self._observed("dynamicQueryGaps"), "at"), lambda: rows(self.query_families(), F.desc("occurrences"), "id"), lambda: rows(self.dml_families(), "at"),
            self.audit_totals,
            lambda: rows(self.audit, F.collate("path", "UNICODE")), lambda: self.files.where("first_test").count(), self.deprecation, self.findings,
            lambda: rows(g["reached"], "id"), lambda: rows((g["edges"] if full_graph else self.evidence()).drop("ref_seq", "passed"), "location.path", "location.line", "location.column"),
            lambda: rows(g["entries"].drop("seq"), "location.path", "location.line", "location.column"), lambda: rows(self.candidates, F.desc("sourceBytes"), F.collate("qualifiedName", "UNICODE")),
            lambda: rows(self._rows("exposures", "at").drop("at")), lambda: rows(self._rows("diagnostics"), "path", "line", "column"), lambda: rows(s.drop("sym_seq"), "location.path", "location.line", "qualifiedName"),
            lambda: rows(self.assessments),
        )
        production = inv["productionApexCharacters"]
        share = lambda part: flow.percent(part, production)
        tokens, coverage, repeated = totals["productionTokens"], totals["cloneCoverageCharacters"], totals["duplicatedCharacters"]
        duplicates = totals | {
            "coverage": {"status": "blocked" if blocked else "complete", "blockedFiles": blocked, "testFilesExcluded": tested},
            "cloneCoverageTokenPercent": flow.percent(totals["cloneCoverageTokens"], tokens), "duplicatedTokenPercent": flow.percent(totals["duplicatedTokens"], tokens), "cloneCoverageCharacterPercent": share(coverage), "duplicatedCharacterPercent": share(repeated),
            "cloneGroups": groups, "queryFamilies": query_families, "dmlFamilies": dml_families,
            "queryCoverage": {"status": "blocked" if gaps else "complete", "unresolvedDynamicQueries": [{k: v for k, v in x.items() if k != "at"} for x in gaps]},
            "algorithm": {"minimumFragmentTokens": kernels.FRAGMENT, "minimumMethodTokens": clones.LEAST_TOKENS, "nearMissSimilarity": similarity.STRONG, "nearMissBroadSimilarity": similarity.BROAD, "nearMissBroadMinimumTokens": similarity.BROAD_TOKENS, "testCodeExcluded": True, "overlappingIntervalsDeduplicated": True},
        }
        audit = a | {"unreferencedProductionPercent": share(a["unreferencedProductionCharacters"]), "entries": audit_rows}
        migration = flow.summary(verdicts, production)
        executive = self._executive(production, whole, loose, coverage, repeated, len(groups), len(query_families), migration)
        return self._about() | {
            "inventory": inv, "summary": summary, "topLevelClassNameAudit": audit, "executive": executive, "duplicates": duplicates, "flowMigration": migration,
            "analysis": self._analysis(findings),
            "symbols": symbols, "references": edges, "entryPoints": entries, "reachability": {r["id"]: r["reachability"] for r in reached}, "evidencePaths": {r["id"]: r["path"] for r in reached},
            "candidates": candidates, "exposures": exposures, "diagnostics": diagnostics,
        }

    def _owners(self) -> DataFrame:
        return closure(self.symbols.where("ownerId IS NOT NULL").select(F.col("id").alias("node"), F.col("ownerId").alias("parent")), local=PROJECT)


def analyze_project(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, full_graph: bool = False) -> dict:
    """The report of the project in a folder."""
    return Project(spark, path, include, exclude).report(full_graph)


def to_json(report: dict, pretty: bool = True) -> str:
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if v is not None}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(report), indent=2 if pretty else None, ensure_ascii=False)
