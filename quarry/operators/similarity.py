"""Similarity join by winnowed fingerprints: seeds, candidate pairs, verified pairs, fragments, families."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import kernels
from quarry.operators.components import connected_components
from quarry.plans.stages import run_dir, stored

MOST_REGIONS, LEAST_SEEDS, STRONG, BROAD, BROAD_TOKENS = 30, 2, 0.85, 0.70, 120
#: Tokens that are fingerprinted at a time: what stays in a processor's cache.
TOKENS = 20_000
#: Regions in pairs whose keys are broadcast, so that only their tokens move; more are joined by a shuffle.
FEW = 200_000
#: Regions and characters of a block, of which two are compared in a task; links of a graph that is gathered.
BLOCK, BLOCK_CHARS, LINKS = 512, 4_000_000, 100_000
#: Counters of a region's tokens by their hash: what two regions share is at most the sum of the lesser ones.
BINS = 256
#: Stands before 0 or 1 for itself and for the separator inside packed tokens.
MARK = "\x1e"


def fingerprints(df: DataFrame, key: str, tokens: str, k: int = kernels.K, window: int = kernels.WINDOW, separator: str = kernels.SEPARATOR) -> DataFrame:
    """key, hash, pos: the winnowed fingerprints of each row's array of tokens."""

    def winnowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pc.list_value_length(b[tokens]).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(counts)
            begin = 0
            while begin < len(counts):  # as many sequences at a time as have about TOKENS tokens
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOKENS, side="right")))
                docs, hashes, places = kernels.winnowed(b[tokens][begin:end].flatten().to_pylist(), counts[begin:end], k, window, separator)
                yield pa.record_batch([b[key].take(pa.array(docs + begin)), pa.array(hashes), pa.array(places.astype(np.int32))], [key, "hash", "pos"])
                begin = end

    return df.select(key, tokens).where(F.col(tokens).isNotNull()).mapInArrow(winnowed, f"{key} {dict(df.dtypes)[key]}, hash long, pos int")


def _paired(prints: DataFrame, key: str, wide: bool = False) -> DataFrame:
    """left, right, hash, seeds of each hash that is in 2 to MOST_REGIONS regions; of those in more, if asked for, each region as left."""
    kind = dict(prints.dtypes)[key]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, told = None, 0  # of the hash that the last batch ended with: its prints added up by region; how many were given out as a wide hash's

        def pairs(hash_: np.ndarray, own: pa.Array, n: np.ndarray, told: int) -> pa.RecordBatch:
            starts = np.flatnonzero(np.diff(hash_, prepend=hash_[:1] - 1))
            sizes = np.diff(np.append(starts, len(hash_)))
            group, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
            rare = np.flatnonzero((size >= 2) & (size <= MOST_REGIONS))
            group = group[rare]
            found = [(rare[:-d][same], rare[d:][same]) for d in range(1, MOST_REGIONS) if len(same := np.flatnonzero(group[d:] == group[:-d]))]
            one, two = (np.concatenate([x[side] for x in found] or [rare[:0]]) for side in (0, 1))
            many = np.flatnonzero((size > MOST_REGIONS) & (np.arange(len(size)) >= told)) if wide else rare[:0]
            right = own.take(pa.array(np.append(two, np.zeros(len(many), np.int64)), mask=np.arange(len(two) + len(many)) >= len(two)))
            return pa.record_batch([own.take(pa.array(np.append(one, many))), right, pa.array(hash_[np.append(one, many)]), pa.array(np.append(n[one] * n[two], n[many]))], ["left", "right", "hash", "seeds"])

        for b in batches:
            if not b.num_rows:
                continue
            hash_, own, n = b["hash"].to_numpy(), b["own"], np.ones(b.num_rows, np.int64)
            if kept:
                hash_, own, n = np.concatenate([kept[0], hash_]), pa.concat_arrays([kept[1], own]), np.concatenate([kept[2], n])
            code = own.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (hash_[1:] != hash_[:-1]) | (code[1:] != code[:-1])]))
            hash_, own, n = hash_[first], own.take(pa.array(first)), np.add.reduceat(n, first)
            last = int(np.searchsorted(hash_, hash_[-1]))
            if last:
                yield pairs(hash_[:last], own[:last], n[:last], told)
                told = 0
            if len(hash_) - last > MOST_REGIONS + 1:  # too many already; the last one stays, because its prints may go on
                keep = np.r_[last : last + MOST_REGIONS, len(hash_) - 1]
                if wide:
                    yield pairs(hash_[last:], own[last:], n[last:], told)
                told = len(keep)
            else:
                keep = np.arange(last, len(hash_))
            kept = hash_[keep], own.take(pa.array(keep)), n[keep]
        if kept:
            yield pairs(*kept, told)

    own = prints.select("hash", F.col(key).alias("own")).where("own IS NOT NULL").repartition("hash").sortWithinPartitions("hash", "own")
    return own.mapInArrow(paired, f"left {kind}, right {kind}, hash long, seeds long")


def _summed(pairs: DataFrame, hashes: bool) -> DataFrame:
    pairs = pairs.groupBy("left", "right").agg(F.sum("seeds").alias("seeds"), *([F.collect_list("hash").alias("hashes")] if hashes else []))
    return pairs.where(F.col("seeds") >= LEAST_SEEDS)


def candidate_pairs(prints: DataFrame, key: str, hashes: bool = False) -> DataFrame:
    """left, right, seeds (how many pairs of places) and, if asked for, hashes (those they share): pairs that share
    LEAST_SEEDS seeds or more of hashes that are in 2 to MOST_REGIONS regions.

    Places are never paired: a hash that is m times in one region and n times in another is m * n seeds. Each print
    shuffles once, by its hash, and a task reads its prints in order, so that of a hash of very many regions it holds no
    more than MOST_REGIONS + 1 of them; its narrow rows still meet in one task.
    """
    return _summed(_paired(prints, key), hashes)


class Pairs:
    """All pairs of different regions that share LEAST_SEEDS seeds or more, however many regions a hash is in.

    `rare` is what candidate_pairs gives, without pairs of one group: regions that hashes of over MOST_REGIONS regions
    connect are a group (`groups`: node, component), and all of its pairs are looked at, in blocks, so that no row is made
    for a pair before it is known to be wanted. Pairs with a shared hash of many regions are always of one group.
    """

    def __init__(self, prints: DataFrame, df: DataFrame, key: str, tokens: str, separator: str = kernels.SEPARATOR, hashes: bool = False, block: int = BLOCK):
        """prints: of df, whose rows have different tokens; both stored, or cheap."""
        self.df, self.key, self.tokens, self.separator = df, key, tokens, separator
        path = run_dir(df.sparkSession, "all-pairs")
        found = stored(_paired(prints, key, wide=True), f"{path}/paired")
        wide = found.where("right IS NULL")
        least = stored(wide.groupBy("hash").agg(F.min("left").alias("least")), f"{path}/least")
        links = wide.join(least, "hash").where("left != least").select("left", "least").distinct()
        self.groups = stored(connected_components(stored(links, f"{path}/links"), "left", "least", local=LINKS), f"{path}/groups")
        few = F.broadcast if self.groups.limit(FEW + 1).count() <= FEW else lambda df: df
        pairs = _summed(found.where("right IS NOT NULL"), hashes)
        for side in ("left", "right"):
            pairs = pairs.join(few(self.groups.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))), side, "left")
        self.rare = stored(pairs.where("NOT (_left <=> _right) OR _left IS NULL").drop("_left", "_right"), f"{path}/rare")
        text = packed(tokens)
        met = df.join(few(self.groups), F.col(key) == F.col("node")).select("node", "component", text.alias("text"))
        met = stored(met, f"{path}/texts")
        sizes = met.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("blocks"))
        placed = met.join(stored(sizes, f"{path}/sizes"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        placed = placed.select("node", "component", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        self.blocks = placed.select("node", "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "text").groupBy("component", "one", "two")
        self.kind = dict(df.dtypes)[key]

    def near(self) -> DataFrame:
        """left, right, similarity of near misses; tokens of any length are compared as they stand."""
        separator = self.separator

        def compared(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
            nodes, found = group["node"].to_numpy(), [(i, j, s) for i, j, s, _ in Block(group, pair[1] != pair[2], separator).near()]
            return pd.DataFrame({"left": nodes[[x[0] for x in found]], "right": nodes[[x[1] for x in found]], "similarity": [x[2] for x in found]})

        checked = verified(self.rare, self.df, self.key, self.tokens, self.separator, cells=None).where("near").select("left", "right", "similarity")
        return checked.unionByName(self.blocks.applyInPandas(_sorted_first(compared), f"left {self.kind}, right {self.kind}, similarity double"))

    def fragments(self, least: int = kernels.FRAGMENT) -> DataFrame:
        """Like fragments(), of all pairs that aren't near misses, all seeds and all matches."""
        separator = self.separator
        at = ["left_start", "left_end", "right_start", "right_end"]

        def matched(pair: tuple, group: pd.DataFrame) -> pd.DataFrame:
            nodes, rows = group["node"].to_numpy(), list(Block(group, pair[1] != pair[2], separator).fragments(least))
            return pd.DataFrame({"left": nodes[[x[0] for x in rows]], "right": nodes[[x[1] for x in rows]]} | {c: np.array([x[2 + k] for x in rows], np.int32) for k, c in enumerate(at)})

        rest = verified(self.rare, self.df, self.key, self.tokens, self.separator, cells=None).where("NOT near").select("left", "right", "hashes")
        rest = stored(rest, run_dir(self.df.sparkSession, "rest"))
        found = fragments(rest, self.df, self.key, self.tokens, least, self.separator, whole=True)
        return found.unionByName(self.blocks.applyInPandas(_sorted_first(matched), f"left {self.kind}, right {self.kind}, " + ", ".join(f"{c} int" for c in at)))


def _sorted_first(f):
    return lambda pair, group: f(pair, group.sort_values("node").reset_index(drop=True))


class Block:
    """Regions of one block, or of two, whose pairs are compared: all pairs of one, or those across two."""

    def __init__(self, group: pd.DataFrame, across: bool, separator: str):
        """group: node, block, text (see unpacked), in the order of nodes."""
        self.tokens, self.blocks, self.across = [unpacked(t) for t in group["text"]], group["block"].to_numpy(), across
        flat = [t for own in self.tokens for t in own]
        self.sizes = np.array(list(map(len, self.tokens)), np.int64)
        codes: dict[str, int] = {}
        coded = np.array([codes.setdefault(t, len(codes)) for t in flat], np.int64)
        self.flat, self.ends = coded, np.cumsum(self.sizes)
        ends, begin, parts = self.ends, 0, []
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOKENS, side="right")))
            docs, hashes, places = kernels.winnowed(flat[ends[begin - 1] if begin else 0 : ends[end - 1]], self.sizes[begin:end], separator=separator)
            parts.append((docs + begin, hashes, places))
            begin = end
        self.docs, self.hashes, self.places = (np.concatenate([p[k] for p in parts]) for k in range(3))

    def seeds(self) -> np.ndarray:
        """For each two regions, how many pairs of places of equal hashes they have."""
        n = len(self.tokens)
        _, ids = np.unique(self.hashes, return_inverse=True)
        key, times = np.unique(ids * n + self.docs, return_counts=True)
        ids, docs = key // n, key % n
        shared = np.bincount(ids)[ids] >= 2
        _, ids = np.unique(ids[shared], return_inverse=True)
        docs, times = docs[shared], times[shared]
        total = np.zeros((n, n), np.float32)
        starts = np.searchsorted(ids, np.arange(0, int(ids[-1]) + 2048 if len(ids) else 0, 2048))
        for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(ids)), strict=True)):
            part = np.zeros((n, 2048), np.float32)
            part[docs[a:b], ids[a:b] - 2048 * k] = times[a:b]
            total += part @ part.T
        return total

    def candidates(self, seeds: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.tokens)):
            wanted = seeds[i, i + 1 :] >= least
            if self.across:
                wanted &= self.blocks[i + 1 :] != self.blocks[i]
            if wanted.any():
                yield i, np.flatnonzero(wanted) + i + 1

    def near(self, seeds: np.ndarray | None = None) -> Iterator[tuple[int, int, float, None]]:
        """i, j, similarity of near misses. Pairs that can't be ones by their lengths, or by how often they have which tokens, are not compared."""
        n, sizes = len(self.tokens), self.sizes
        counts = np.bincount(np.repeat(np.arange(n), sizes) * BINS + self.flat % BINS, minlength=n * BINS).reshape(n, BINS).astype(np.int32)
        coded = [x.tolist() for x in np.split(self.flat, self.ends[:-1])]
        for i, other in self.candidates(self.seeds() if seeds is None else seeds, LEAST_SEEDS):
            small, both = np.minimum(sizes[other], sizes[i]), sizes[other] + sizes[i]
            wanted = np.where(small >= BROAD_TOKENS, BROAD, STRONG) * both / 2 - 1e-6
            other, wanted, small = other[small >= wanted], wanted[small >= wanted], small[small >= wanted]
            other = other[np.minimum(counts[other], counts[i]).sum(axis=1) >= wanted]
            if not len(other):
                continue
            masks = kernels.masks(coded[i])
            for j in other.tolist():
                s = 2 * kernels.lcs_length(coded[i], coded[j], masks) / (len(coded[i]) + len(coded[j]))
                if s >= STRONG or (min(len(coded[i]), len(coded[j])) >= BROAD_TOKENS and s >= BROAD):
                    yield i, j, s, None

    def fragments(self, least: int) -> Iterator[tuple]:
        """i, j and a match's places. A common run of `least` tokens has so many windows of k-grams, and a seed in each, which so many windows in a row may share."""
        windows = least - kernels.K + 1 - kernels.WINDOW + 1
        seeds = self.seeds()
        near = {(i, j) for i, j, *_ in self.near(seeds)}
        bounds = np.searchsorted(self.docs, np.arange(len(self.tokens) + 1))
        coded = np.split(self.flat, self.ends[:-1])
        prints = [(self.hashes[a:b], self.places[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, other in self.candidates(seeds, max(LEAST_SEEDS, -(-windows // kernels.WINDOW))):
            for j in other.tolist():
                if (i, j) not in near:
                    yield from ((i, j, *m) for m in kernels.all_matches(coded[i], coded[j], prints[i], prints[j], least=least))


def with_tokens(pairs: DataFrame, df: DataFrame, key: str, tokens: str) -> DataFrame:
    left, right = (df.select(F.col(key).alias(side), F.col(tokens).alias(f"{side}_tokens")) for side in ("left", "right"))
    return pairs.join(left, "left").join(right, "right")


def with_packed(pairs: DataFrame, df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Like with_tokens, with the tokens as one string (see unpacked), a third of an array's size; only rows that are in a
    pair move. pairs is read several times: give a stored table."""
    ids = pairs.select(F.col("left").alias(key)).unionByName(pairs.select(F.col("right").alias(key))).distinct()
    met = df.join(F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids, key, "left_semi")
    return with_tokens(pairs, met.select(key, packed(tokens).alias(tokens)), key, tokens)


def packed(tokens: str) -> Column:
    """An array of tokens as one string."""
    plain = F.transform(tokens, lambda x: F.replace(F.replace(x, F.lit(MARK), F.lit(f"{MARK}0")), F.lit(kernels.SEPARATOR), F.lit(f"{MARK}1")))
    return F.array_join(plain, kernels.SEPARATOR)


def unpacked(text: str) -> list[str]:
    """Tokens (never empty ones) from a string of them."""
    own = text.split(kernels.SEPARATOR) if text else []
    return [x.replace(f"{MARK}1", kernels.SEPARATOR).replace(f"{MARK}0", MARK) for x in own] if MARK in text else own


def verified(pairs: DataFrame, df: DataFrame, key: str, tokens: str, separator: str = kernels.SEPARATOR, cells: int | None = kernels.CELLS) -> DataFrame:
    """pairs (stored) with similarity, near: ordered similarity of each pair, and whether it makes them near misses. cells: see sequence_similarity."""
    own = pairs.columns

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for one, two in zip(b["left_tokens"], b["right_tokens"], strict=True):
                one, two = unpacked(one.as_py()), unpacked(two.as_py())
                if one == two:
                    found.append((1.0, True))
                    continue
                big = cells is not None and len(one) * len(two) > cells
                prints = [{h for h, _ in kernels.winnow(x, separator=separator)} for x in (one, two)] if big else (set(), set())
                s = kernels.sequence_similarity(one, two, kernels.dice(*prints), cells)
                found.append((s, s >= STRONG or (min(len(one), len(two)) >= BROAD_TOKENS and s >= BROAD)))
            more = [pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.bool_())]
            yield pa.record_batch([*(b[c] for c in own), *more], [*own, "similarity", "near"])

    columns = ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes)
    return with_packed(pairs, df, key, tokens).select(*own, "left_tokens", "right_tokens").mapInArrow(compared, f"{columns}, similarity double, near boolean")


def seeds_at(left: list[str], right: list[str], hashes: Iterable[int], separator: str, most: int | None = kernels.SEEDS) -> list[tuple[int, int]]:
    """The first pairs of places of shared hashes, in order: as many as a search for matches looks at (None: all)."""
    wanted = set(hashes)
    one, two = (sorted({(i, h) for h, i in kernels.winnow(x, separator=separator) if h in wanted}) for x in (left, right))
    places: dict[int, list[int]] = {}
    for i, h in two:
        places.setdefault(h, []).append(i)
    return list(islice(((i, j) for i, h in one for j in places.get(h, ())), most))


def fragments(pairs: DataFrame, df: DataFrame, key: str, tokens: str, least: int = kernels.FRAGMENT, separator: str = kernels.SEPARATOR, whole: bool = False) -> DataFrame:
    """left, right, left_start, left_end, right_start, right_end: maximal common runs of tokens of each pair (left, right, hashes; stored).

    whole: of all seeds, and all of them, not only of the first kernels.SEEDS and the first kernels.MATCHES.
    """

    def whole_matches(one: list[str], two: list[str], hashes: list[int]) -> list[tuple[int, int, int, int]]:
        codes: dict[str, int] = {}
        left, right = (np.array([codes.setdefault(t, len(codes)) for t in x], np.int64) for x in (one, two))
        own, other = ((h[met], p[met]) for h, p in (kernels.winnowed(x, np.array([len(x)]), separator=separator)[1:] for x in (one, two)) for met in [np.isin(h, hashes)])
        return kernels.all_matches(left, right, own, other, least=least)

    kind = dict(df.dtypes)[key]
    columns = [("left", kind), ("right", kind), *((c, "int") for c in ("left_start", "left_end", "right_start", "right_end"))]

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places = [], []
            for n, (hashes, one, two) in enumerate(zip(b["hashes"], b["left_tokens"], b["right_tokens"], strict=True)):
                one, two = unpacked(one.as_py()), unpacked(two.as_py())
                found = whole_matches(one, two, hashes.as_py()) if whole else kernels.maximal_matches(one, two, seeds_at(one, two, hashes.as_py(), separator), least=least)
                rows += [n] * len(found)
                places += found
            at = pa.array(rows, pa.int32())
            yield pa.record_batch([b["left"].take(at), b["right"].take(at), *(pa.array([p[k] for p in places], pa.int32()) for k in range(4))], [c for c, _ in columns])

    met = with_packed(pairs.select("left", "right", "hashes"), df, key, tokens)
    return met.select("left", "right", "hashes", "left_tokens", "right_tokens").mapInArrow(matched, ", ".join(f"{c} {k}" for c, k in columns))


def near_families(pairs: DataFrame) -> DataFrame:
    """family, members, similarity (the mean over its pairs) of verified near pairs (left, right, similarity)."""
    groups = connected_components(pairs, "left", "right")
    means = pairs.join(groups, F.col("left") == F.col("node")).groupBy("component").agg(F.avg("similarity").alias("similarity"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    return sizes.join(means, "component").select(F.col("component").alias("family"), "members", "similarity")
