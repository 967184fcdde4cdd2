"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of its runs of MINIMISER words. Windows in a row
that share a minimiser travel together, as one packed string of their words, to the bucket of that minimiser; equal
windows have equal minimisers, so each bucket can count its windows by itself, by sorting them. What it finds to occur
twice or more goes back to the documents as positions, and the words that they cover go.

Packed strings are blobs: a map task sends a bucket the distinct strings of a batch of documents once, compressed, with
how often and where each occurs in the batch. A minimiser that is very frequent in a bounded sample of documents is
hot: a bucket of such would gather what many documents put around a shared passage. Its windows travel singly, each to
the bucket of its own hash. The list of hot minimisers only decides how windows travel, never what is counted.

Texts are counted first, and there are as many buckets as keep one to BUCKET_BYTES of them on average, whatever the input.
Buckets sort 64-bit hashes of windows; windows with equal hashes are then compared word by word, so counts are exact.

Defined results: words are what white space separates, unchanged; null text has none; a text of fewer than WINDOW
words keeps all; repeated rows repeat each other's windows, so all their windows go; a null doc_id stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import row_key, run_dir, stored, text_of
from quarry.llm.ngram_join import mixed
from quarry.llm.token_store import sliced
from quarry.llm.words import gathered

WINDOW, MINIMISER = 35, 4
#: Buckets for each shuffle partition, at least; bytes of text for each bucket, at most; bytes of text in a batch.
BUCKETS, BUCKET_BYTES, BATCH = 8, 16_000_000, 12_000_000
#: Documents in the sample for hot minimisers, about, and the share of a sample's super-k-mers that makes one hot.
SAMPLE, HOT = 4096, 1 / 2000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of texts in one row, separated by single spaces."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at, known = coded.indices.to_numpy(), coded.dictionary
        sizes = pc.binary_length(known).to_numpy().astype(np.int64)
        if len(known) and not sizes.all():  # white space at an end of a text makes an empty word there
            full = sizes[at] > 0
            counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
            at = at[full]
        self.counts, self.ids = counts, at
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known.cast(pa.binary()).to_pylist()), np.uint64, len(known))
        self.hashes = hashes[at]
        self.ends = np.cumsum(sizes[at] + 1)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), known.cast(pa.large_binary()).take(pa.array(at))), pa.scalar(b" ", pa.large_binary())) if len(at) else None
        self.buffer = joined[0].as_py() + b" " if joined is not None else b""
        self.docs = np.repeat(np.arange(len(counts)), counts)
        self.firsts = np.cumsum(counts) - counts

    def text(self, first: int, last: int) -> bytes:
        """Words from first, before last."""
        begin = int(self.ends[first - 1]) if first else 0
        return self.buffer[begin : int(self.ends[last - 1]) - 1]


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many words: a polynomial of the words' hashes, by doubling."""
    out, have, powers = np.zeros(max(0, len(hashes) - words + 1), np.uint64), 0, [(1, hashes)]
    power = _ODD
    factors = [power]
    while powers[-1][0] * 2 <= words:
        n, run = powers[-1]
        powers.append((2 * n, run[:-n] * factors[-1] + run[n:]) if len(run) > n else (2 * n, run[:0]))
        factors.append(np.multiply(factors[-1:], factors[-1:])[0])
    for (n, run), factor in zip(reversed(powers), reversed(factors), strict=True):
        if words - have >= n:
            out = out * factor + run[have : have + len(out)]
            have += n
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])


def windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start (in the row of all words), and their minimisers."""
    n = len(words.hashes)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding_min(rolled(words.hashes, MINIMISER), window - MINIMISER + 1)
    starts = np.flatnonzero(words.docs[: n - window + 1] == words.docs[window - 1 :])
    return starts, least[starts]


def super_kmers(words: Words, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and routing hash of each super-k-mer; windows of hot minimisers come singly."""
    starts, least = windows(words, window)
    if not len(starts):
        return starts, starts, least
    single = np.isin(least, hot)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1) | single[1:]
    at = np.flatnonzero(new)
    route = least[at]
    if single.any():
        route = np.where(single[at], rolled(words.hashes, window)[starts[at]], route)
    return starts[at], np.diff(at, append=len(starts)), route


def packed(strings: list[bytes]) -> bytes:
    """Strings of words by a line each, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(strings))


def repeats(strings: list[bytes], copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The string and the window in it of each window that occurs twice or more, given how often each string occurs."""
    words = Words(pa.array(strings, pa.binary()).cast(pa.string()))
    hashes = rolled(words.hashes, window)
    starts = np.flatnonzero(words.docs[: len(hashes)] == words.docs[window - 1 :]) if len(hashes) else np.empty(0, np.int64)
    own = hashes[starts]
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = np.zeros(len(order), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:].copy()
    weight = copies[words.docs[starts]]
    found = weight > 1  # the string itself occurs again
    maybe = order[same]
    if len(maybe):  # equal hashes: sorted by their words
        rows = words.ids[starts[maybe][:, None] + np.arange(window)]
        ranks = np.lexsort(rows.T[::-1])
        lines = rows[ranks]
        equal = (lines[1:] == lines[:-1]).all(axis=1)
        twice = np.zeros(len(maybe), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        found[maybe[ranks[twice]]] = True
    hit = np.flatnonzero(found)
    docs = words.docs[starts[hit]]
    return docs, starts[hit] - words.firsts[docs]


def _rows(docs: DataFrame) -> DataFrame:
    """id is 0 for a null doc_id; their keys differ."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), row_key(F.col("doc_id"), text_of()).alias("key"), text_of().alias("text"))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch["text"].cast(pa.binary()).to_pylist()


def hot_minimisers(docs: DataFrame, n_docs: int, window: int, sample: int = SAMPLE) -> np.ndarray:
    """Minimisers of a share of HOT or more of a sample's super-k-mers: 1 / HOT at most."""
    share = min(1.0, sample / max(1, n_docs))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in sliced(b["text"], BATCH):
                _, _, route = super_kmers(Words(texts), window, np.empty(0, np.uint64))
                values, counts = np.unique(route, return_counts=True)
                yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["minimiser", "n"])

    picked = _rows(docs).select("text", F.rand(6).alias("dice")).where(F.col("dice") < share).select("text")
    counts = stored(picked.mapInArrow(counted, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")), f"{run_dir(docs.sparkSession, 'hot')}/counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = [r["minimiser"] for r in counts.where(F.col("n") >= max(32, total * HOT)).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id (doc_id, or 0), key (see row_key), starts (little-endian 32-bit word numbers): windows of each document that occur elsewhere, too."""
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    hot = spark.sparkContext.broadcast(hot_minimisers(docs, size["docs"], window))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = np.uint64(max(parts * BUCKETS, -(-size["bytes"] // BUCKET_BYTES)))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in sliced(b["text"], BATCH):
                words = Words(texts)
                first, n, route = super_kmers(words, window, hot.value)
                to = (mixed(route) % buckets).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
                begins = np.where(first > 0, words.ends[np.maximum(first - 1, 0)], 0)
                ends = words.ends[first + n + window - 2] - 1
                local = words.docs[first]
                offset = first - words.firsts[local]
                ids, keys = b["id"][begin : begin + len(texts)], b["key"][begin : begin + len(texts)]
                for group in np.split(order, cuts[1:]) if len(order) else []:
                    lines = [words.buffer[s:e] for s, e in zip(begins[group].tolist(), ends[group].tolist(), strict=True)]
                    place: dict[bytes, int] = {}
                    which = np.array([place.setdefault(x, len(place)) for x in lines], np.int32)
                    used, row = np.unique(local[group], return_inverse=True)
                    refs = np.stack([which, row.astype(np.int32), offset[group].astype(np.int32)], axis=1)
                    yield pa.record_batch(
                        [pa.array([int(to[group[0]])], pa.int64()), pa.array([packed(list(place))]), pa.array([zstandard.compress(refs.astype("<i4").tobytes(), 1)]), pa.array([ids.take(pa.array(used)).to_pylist()], pa.list_(pa.int64())), pa.array([keys.take(pa.array(used)).to_pylist()], pa.list_(pa.int64()))],
                        ["bucket", "strings", "refs", "ids", "keys"],
                    )

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        strings: dict[bytes, int] = {}
        which, docs_at, offsets, doc_ids, keys = [], [], [], [], []
        for blob, packed_refs, ids, own_keys in zip(group["strings"], group["refs"], group["ids"], group["keys"], strict=True):
            lines = zstandard.decompress(blob).split(b"\n")
            own = np.array([strings.setdefault(x, len(strings)) for x in lines], np.int64)
            refs = np.frombuffer(zstandard.decompress(packed_refs), "<i4").reshape(-1, 3)
            which.append(own[refs[:, 0]])
            docs_at.append(refs[:, 1].astype(np.int64) + len(doc_ids))
            offsets.append(refs[:, 2])
            doc_ids += list(ids)
            keys += list(own_keys)
        which, docs_at, offsets = np.concatenate(which), np.concatenate(docs_at), np.concatenate(offsets)
        copies = np.bincount(which, minlength=len(strings))
        string, inside = repeats(list(strings), copies, window)
        if not len(string):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "key": pd.Series([], dtype="int64"), "starts": pd.Series([], dtype=object)})
        per = np.bincount(string, minlength=len(strings))
        begin = np.cumsum(per) - per
        n = per[which]
        starts = np.repeat(offsets, n) + gathered(inside, begin[which], n)
        owner = np.repeat(docs_at, n)
        order = np.argsort(owner, kind="stable")
        owner, starts = owner[order], starts[order].astype("<i4")
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        at = owner[cuts]
        blobs = [s.tobytes() for s in np.split(starts, cuts[1:])]
        return pd.DataFrame({"id": [doc_ids[i] for i in at], "key": [keys[i] for i in at], "starts": blobs})

    kinds = "bucket long, strings binary, refs binary, ids array<long>, keys array<long>"
    found = _rows(docs).mapInArrow(mapped, kinds).groupBy("bucket").applyInPandas(counted, "id long, key long, starts binary")
    return found


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words that stay, joined by one space) for each row of docs."""
    path = run_dir(docs.sparkSession, "substring-dedup")
    found = stored(repeated_windows(docs, window), f"{path}/windows")
    each = found.groupBy(F.col("id").alias("its_id"), F.col("key").alias("its_key")).agg(F.collect_list("starts").alias("starts"))
    met = _rows(docs).join(each, (F.col("id") == F.col("its_id")) & (F.col("key") == F.col("its_key")), "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, removed, texts = [], [], []
            for text, starts in zip(_texts(b), b["starts"].to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if starts:
                    at = np.unique(np.frombuffer(b"".join(starts), "<i4"))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, np.minimum(at + window, len(words)), -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    removed.append(int(len(keep) - len(words)))
                else:
                    removed.append(0)
                counts.append(len(words) + removed[-1])
                texts.append(b" ".join(words))
            yield pa.record_batch([b["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return met.mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")
