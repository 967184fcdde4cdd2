"""N-gram Jaccard self-join: MinHash bands for candidates, full n-gram sets for the verdict.

Each document becomes the set of its five-word shingles and a MinHash signature of BANDS x ROWS values; at a Jaccard
similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.9999. Documents with
the same shingle set are one node, so copies are never paired with each other. Signatures shuffle on band hashes; each
band is a star of edges to its least node, never all pairs. Nodes that bands connect form candidate groups. The texts
of a group's nodes meet once, and all pairs of the group are verified there on full shingle sets, as counts from an
inverted index that are added up in place: only each node's number of links and its class come out. A group of over
BLOCK nodes or BLOCK_BYTES of text is dealt out as pairs of blocks.

Words are what white space separates, unchanged; a shingle is known by its 64-bit fingerprint, a shingle set (a node)
by a 128-bit one.

Defined results: a text of fewer than five words is one shingle; an empty or null text has none and is linked to
nothing; a class's id is its least doc_id, null if it has none; repeated rows link like any copies; an empty table
gives an empty result; other columns are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import row_key, run_dir, stored, text_of
from quarry.llm.token_store import sliced
from quarry.operators.components import connected_components

WORDS, BANDS, ROWS, BLOCK, BLOCK_BYTES = 5, 32, 6, 256, 16_000_000
#: Nodes in groups whose places are broadcast (about 150 bytes each), so that only their texts move; more are joined by a shuffle.
FEW = 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Added to the hash of a shingle's first, second, ... word.
_PLACES = _MIX * np.arange(1, WORDS + 1, dtype=np.uint64)
_RNG = np.random.default_rng(8)
_FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle fingerprints of each text."""
    split = [t.encode(errors="surrogatepass").split() for t in texts]
    flat = [w for own in split for w in own]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in dict.fromkeys(flat)}
    hashes = np.array(list(map(known.__getitem__, flat)), np.uint64)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(min(WORDS, len(hashes))):
        rolled[: len(hashes) - k] += mixed(hashes[k:] + _PLACES[k])
    rolled = mixed(rolled)
    out, at = [], 0
    for own in split:
        n = len(own)
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """The band hashes of non-empty sets, a row for each."""
    flat = np.concatenate(sets)
    sizes = np.array(list(map(len, sets)))
    starts = np.cumsum(sizes) - sizes
    folded, held = np.zeros((len(sets), BANDS), np.uint64), np.empty_like(flat)
    for k, a in enumerate(_FACTORS):
        np.multiply(flat, a, out=held)
        band, row = divmod(k, ROWS)
        folded[:, band] += mixed(np.minimum.reduceat(held, starts)) * _FOLD[row]
    return mixed(folded + np.arange(1, BANDS + 1, dtype=np.uint64))


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key, bytes of text, node (null for texts without words), bands."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in sliced(b["text"]):
                sets = shingles(texts.to_pylist())
                full = [s for s in sets if len(s)]
                hashes = bands_of(full).view(np.int64) if full else np.empty((0, BANDS), np.int64)
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                ends = np.concatenate([[0], np.cumsum([BANDS * bool(len(s)) for s in sets])]).astype(np.int32)
                own = slice(begin, begin + len(texts))
                yield pa.record_batch([b["doc_id"][own], b["key"][own], b["bytes"][own], pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel()))], ["doc_id", "key", "bytes", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), text_of()).alias("key"), F.octet_length(text_of()).cast("long").alias("bytes"), text_of().alias("text"))
    return rows.mapInArrow(sketches, "doc_id long, key long, bytes long, node binary, bands array<long>")


def linked(sets: list[np.ndarray], weights: np.ndarray, blocks: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each set, the weights of the sets with a similarity of 0.8 or more, and the first set of its class.

    across: only sets of different blocks are compared with each other; else all are.
    """
    n = len(sets)
    sizes = np.array(list(map(len, sets)))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    docs = np.repeat(np.arange(n), sizes)
    by_id = docs[np.argsort(ids, kind="stable")]
    df = np.bincount(ids)
    first = np.cumsum(df) - df
    links, top = np.zeros(n, np.int64), list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    at = 0
    for i in range(n):
        own = ids[at : at + sizes[i]]
        at += sizes[i]
        spans = df[own]
        ends = np.cumsum(spans)
        posted = by_id[np.arange(ends[-1]) + np.repeat(first[own] - (ends - spans), spans)]
        shared = np.bincount(posted, minlength=n)
        near = (9 * shared >= 4 * (sizes + sizes[i])) & ((blocks != blocks[i]) if across else True)
        near[i] = False
        found = np.flatnonzero(near)
        links[i] = weights[found].sum()
        for j in found[found > i].tolist():
            a, b = root(i), root(j)
            if a != b:
                top[max(a, b)] = min(a, b)
    return links, np.array([root(i) for i in range(n)], np.int64)


def _verified(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """pair: the group, and its two blocks, of which one may have no nodes."""
    group = group.drop_duplicates("node").reset_index(drop=True)
    nodes, across = group["node"].to_numpy(), pair[1] != pair[2]
    if across and group["block"].nunique() < 2:
        return pd.DataFrame({"node": nodes[:0], "links": np.empty(0, np.int64), "root": nodes[:0]})
    links, roots = linked(shingles(group["text"].tolist()), group["copies"].to_numpy(), group["block"].to_numpy(), across)
    return pd.DataFrame({"node": nodes, "links": links, "root": nodes[roots]})


class NgramJoin:
    """`classes()` has a row for each row of docs; `survivors()` has one document of each class."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES):
        self.docs, self.path = docs, run_dir(docs.sparkSession, "ngram-join")
        self.sketches = stored(_sketched(docs), f"{self.path}/sketches")
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        full = self.sketches.where("node IS NOT NULL").groupBy("node")
        self.nodes = stored(full.agg(rep.alias("rep"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.any_value("bands").alias("bands")), f"{self.path}/nodes")
        bands = self.nodes.select("node", F.explode("bands").alias("band"))
        stars = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("band", "least")
        stars = stored(stars, f"{self.path}/stars")  # so that the join is of plain exchanges, and split where a band is hot
        edges = bands.join(stars, "band").where("node != least").select("node", "least").distinct()
        groups = stored(connected_components(edges, "node", "least").join(self.nodes.drop("bands"), "node"), f"{self.path}/groups")
        sizes = groups.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("bytes") / block_bytes)).cast("int").alias("blocks"))
        placed = groups.join(stored(sizes, f"{self.path}/sizes"), "component")
        placed = placed.select("node", "component", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key"))
        if groups.limit(FEW + 1).count() <= FEW:
            placed = F.broadcast(placed)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), text_of()).alias("key"), text_of().alias("text"))
        met = texts.join(placed, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key")))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        met = met.select("component", "block", "node", "copies", "text", other)
        met = met.select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "copies", "text")
        verified = stored(met.groupBy("component", "one", "two").applyInPandas(_verified, "node binary, links long, root binary"), f"{self.path}/verified")
        links = verified.groupBy("node").agg(F.sum("links").alias("links"))
        classes = connected_components(verified.where("node != root").select("node", "root"), "node", "root")
        every = self.nodes.drop("bands").join(links, "node", "left").join(classes, "node", "left")
        every = every.select("node", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        tops = every.groupBy("component").agg(F.min("rep").alias("top"))
        self.verdicts = stored(every.join(tops, "component").select("node", "n_links", "top"), f"{self.path}/verdicts")

    def _rows(self) -> DataFrame:
        rows = self.sketches.where("node IS NOT NULL").select("doc_id", "key", "node").join(self.verdicts, "node")
        bare = self.sketches.where("node IS NULL").select("doc_id", "key")  # apart, or their nulls would meet in one task
        rows = rows.unionByName(bare, allowMissingColumns=True)
        own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        return rows.select("doc_id", "key", F.coalesce("top", own).alias("top"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    def classes(self) -> DataFrame:
        """doc_id, class_id (the least doc_id of its class), n_links (other documents with a similarity of 0.8 or more)."""
        return self._rows().select("doc_id", F.col("top.doc_id").alias("class_id"), "n_links")

    def survivors(self) -> DataFrame:
        """The rows of docs that are the first of their class, with the columns of docs."""
        kept = self._rows().where(F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("key") == F.col("top.key"))).select(F.col("doc_id").alias("_qx_keep"), F.col("key").alias("_qx_keep_key")).distinct()
        docs = self.docs.select(F.struct(*(F.col(f"`{c}`") for c in self.docs.columns)).alias("_qx_row"), F.col("doc_id").cast("long").alias("_qx_id"), row_key(F.col("doc_id"), text_of()).alias("_qx_key"))
        met = docs.join(kept, F.col("_qx_id").eqNullSafe(F.col("_qx_keep")) & (F.col("_qx_key") == F.col("_qx_keep_key")), "left_semi")
        first = met.withColumn("_qx_nth", F.row_number().over(Window.partitionBy("_qx_id", "_qx_key").orderBy("_qx_key"))).where("_qx_nth = 1")
        return first.select("_qx_row.*")
