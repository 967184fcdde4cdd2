"""Secret scan with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds, for each blob that was
ever scanned, the rules (name@version) that it was scanned with and what they found. A scan reads the ledger, scans
only the (blob, rule version) pairs that it lacks, one copy of each blob, appends them, and joins the findings of the
present rule versions back to all rows. A run's part of the ledger counts once Spark has committed it.

Regular expressions are beyond what Spark's own functions can place (they give no offsets), so texts are scanned in
Arrow batches. Whole texts are scanned; rows shuffle by (blob, doc_id), so copies of one blob spread out.

Defined results: null text is empty text (no findings); repeated rows each get their findings; offsets are code
points, ends exclusive; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import run_dir, stored, text_of


class Rule(NamedTuple):
    name: str
    version: int
    pattern: str
    #: At least one of these, in lower case, is in every text with a match, also in lower case. Empty: no such words.
    words: tuple[str, ...] = ()
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE = (
    Rule("assign", 1, r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", (), 0, 24),
)
RULES = (
    *BASE,
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", ("-----begin",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
)
SPANS = "array<struct<rule:string,start:int,end:int>>"
#: Where the ledger has most blobs, the hashes of up to so many others are broadcast (about 60 bytes each), and no text
#: shuffles; more of them, or more than one in SHARE of all, are joined by a shuffle.
FEW, SHARE = 200_000, 10


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(rule, start, end) of each finding: leftmost matches that don't overlap, of each rule by itself; too short ones drop out."""
    low, found = text.lower(), []
    for r in rules:
        if not r.words or any(w in low for w in r.words):
            found += [(r.name, *m.span()) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return found


class BlobLedger:
    """A ledger in a folder; every run of scan() appends a folder of its own."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def runs(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS")) or []
        return sorted(str(f.getPath().getParent()) for f in found)

    def rows(self) -> DataFrame:
        """sha, rules, spans: a row for each run that scanned the blob."""
        schema = f"sha binary, rules array<string>, spans {SPANS}"
        runs = self.runs()
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """doc_id, sha, spans for every row of docs, by rules; unseen pairs are scanned and appended first."""
        work = run_dir(self.spark, "secrets")
        versions = stored(docs.select("doc_id", F.unhex(F.sha2(text_of(), 256)).alias("sha")), f"{work}/versions")
        blobs = versions.groupBy("sha").agg(F.min("doc_id").alias("one_id"))
        asked = F.array(*(F.lit(r.key) for r in rules))
        known = self.rows().groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        todo = blobs.join(known, "sha", "left").select("sha", "one_id", F.array_except(asked, F.coalesce("known", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
        todo = stored(todo, f"{work}/todo")
        if SHARE * todo.limit(FEW + 1).count() <= min(SHARE * FEW, versions.count()):
            todo = F.broadcast(todo)
        texts = docs.select("doc_id", F.unhex(F.sha2(text_of(), 256)).alias("blob"), text_of().alias("text"))
        unseen = texts.join(todo, (F.col("blob") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("sha", "rules", "text")
        by_key = {r.key: r._replace(name=r.key) for r in rules}  # spans in the ledger are of a rule version

        def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                spans = [[{"rule": k, "start": s, "end": e} for k, s, e in find(t, tuple(by_key[x] for x in keys))] for t, keys in zip(b["text"], b["rules"], strict=True)]
                yield pd.DataFrame({"sha": b["sha"], "rules": b["rules"], "spans": spans})

        unseen.mapInPandas(scanned, f"sha binary, rules array<string>, spans {SPANS}").write.parquet(f"{self.path}/run-{len(self.runs()):06d}-{work[-8:]}")
        wanted = F.array(*(F.lit(r.key) for r in rules))
        present = self.rows().where(F.arrays_overlap("rules", wanted))
        # older ledgers have names without versions; the row's rules tell which version it was
        asks = F.array_intersect("rules", wanted)
        of = lambda s: F.array_contains(asks, s["rule"]) | F.exists(asks, lambda k: F.substring_index(k, "@", 1) == s["rule"])
        named = lambda s: F.struct(F.substring_index(s["rule"], "@", 1).alias("rule"), s["start"].alias("start"), s["end"].alias("end"))
        present = present.select("sha", F.transform(F.filter("spans", of), named).alias("spans"))
        found = present.where(F.size("spans") > 0).groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        found = stored(found, f"{work}/found")  # so that the join is of plain exchanges, and split where a blob has many paths
        return versions.join(found, "sha", "left").select("doc_id", "sha", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans, kinds: tuple[str, ...]):
    """kind:start:end of those kinds by start, then by kind in that order, joined by commas."""
    place = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(F.filter(spans, lambda s: s["rule"].isin(*kinds)), lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["rule"]).alias("place"), s["end"].alias("end"), s["rule"].alias("rule")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
