"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: one feature for each hashed word (its share of the words, damped), and one-hot bins of
structure statistics of the whole text (length, letters, capitals, digits, symbols, word lengths, repeated words and
lines) and of its n_chars column. The machine adds pairwise interactions of rank FACTORS to a linear model; all pairs
are summed in linear time, as half of the square of the sum less the sum of the squares, factor by factor.

It is fitted on the driver on at most `sample` labelled rows (SAMPLE by default), the ones whose hashed doc_id is
least; only rows whose crc32(doc_id as text) mod 3 isn't 1 are fitted on. Every text is scored whole, in Arrow batches.

Defined results: null text is empty text, and is scored like any other; null n_chars has a bin of its own; a null
doc_id is never fitted on and isn't held out; labels that disagree count by their majority; without any label of
either kind the score is the share of good labels, 0.5 if there are none; repeated rows score alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of

BUCKETS, BINS, FACTORS, SAMPLE = 1 << 16, 16, 8, 8192
STATISTICS = ("chars", "words", "word_length", "letters", "capitals", "digits", "symbols", "marks", "distinct", "top_word", "lines", "distinct_lines", "capital_words", "n_chars")
FEATURES = BUCKETS + BINS * len(STATISTICS)
#: What a byte counts as: 1 lower-case or other letter, 2 capital, 3 digit, 4 white space, 5 mark of prose, 6 symbol.
_KINDS = np.full(256, 1, np.uint8)
_KINDS[:128] = 6
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58] = 2, 1, 3
_KINDS[[9, 10, 11, 12, 13, 32]] = 4
_KINDS[[ord(c) for c in ".,;:'\"-()?"]] = 5


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Each from 0 to 1."""
    kinds = np.bincount(_KINDS[np.frombuffer(text.encode(errors="surrogatepass"), np.uint8)], minlength=7)
    n, chars = max(1, len(words)), max(1, int(kinds.sum()))
    lines = text.split("\n")
    grown = lambda x: min(1.0, np.log1p(x) / 14)
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        grown(len(text)), grown(len(words)), min(1.0, len(text) / n / 20), kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[6] / chars, kinds[5] / chars,
        len(counts) / n, top / n, min(1.0, len(lines) / n), len(set(lines)) / len(lines), sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        1.0 if n_chars is None else 0.9 * grown(max(0, n_chars)),
    ]


def features(texts: list[str], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and value of each entry that isn't 0; a feature may occur more than once."""
    sizes, keys, values, crc = [], [], [], zlib.crc32
    for text, n in zip(texts, n_chars, strict=True):
        words = text.split()
        counts = Counter(words)
        total = max(1, len(words))
        found = np.fromiter((crc(w.encode(errors="surrogatepass")) for w in counts), np.int64, len(counts)) % BUCKETS
        shares = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / total)
        stats = np.array(_statistics(text, words, counts, n))
        bins = BUCKETS + BINS * np.arange(len(stats)) + np.minimum(BINS - 1, (stats * BINS).astype(np.int64))
        keys += (found, bins)
        values += (shares.astype(np.float32), np.full(len(bins), 0.5, np.float32))
        sizes.append(len(found) + len(bins))
    if not sizes:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(keys), np.concatenate(values)


def raw_scores(model: Model, docs: np.ndarray, keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The machine's sum of each of n documents, before the logistic function."""
    out = model.bias + np.bincount(docs, model.linear[keys] * values, n)
    for f in range(model.factors.shape[1]):
        part = model.factors[keys, f] * values
        out += 0.5 * (np.bincount(docs, part, n) ** 2 - np.bincount(docs, part * part, n))
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: np.ndarray, keys: np.ndarray, values: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss; kinds of labels weigh alike by the square root of their shares. docs ascend."""
    n = len(labels)
    good = float(labels.mean()) if n else 0.5
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS))
    bias = 0.0 if good in (0, 1) and not n else float(np.log((good + 1e-3) / (1 - good + 1e-3)))
    if not 0 < good < 1 or not n:
        return Model(bias, linear, np.zeros_like(factors))
    g_linear, g_factors, g_bias = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6
    starts = np.searchsorted(docs, np.arange(n + 1))
    weigh = np.where(labels == 1, np.sqrt(0.5 / good), np.sqrt(0.5 / (1 - good)))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            own = order[k : k + batch]
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in own])
            d, j, x = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own]), keys[at], values[at].astype(np.float64)
            vx = factors[j] * x[:, None]
            sums = np.stack([np.bincount(d, vx[:, f], len(own)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(d, (vx * vx).sum(axis=1), len(own))
            score = bias + np.bincount(d, linear[j] * x, len(own)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (logistic(score) - labels[own]) * weigh[own] / len(own)
            unique, back = np.unique(j, return_inverse=True)
            e = error[d]
            step = np.bincount(back, e * x, len(unique)) + decay * linear[unique]
            g_linear[unique] += step * step
            linear[unique] -= rate * step / np.sqrt(g_linear[unique])
            pair = (e * x)[:, None] * (sums[d] - vx)
            step2 = np.stack([np.bincount(back, pair[:, f], len(unique)) for f in range(FACTORS)], axis=1) + decay * factors[unique]
            g_factors[unique] += step2 * step2
            factors[unique] -= 0.5 * rate * step2 / np.sqrt(g_factors[unique])
            g_bias += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(g_bias)
    return Model(float(bias), linear.astype(np.float32), factors.astype(np.float32))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _inputs(docs: DataFrame) -> list:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return ["doc_id", text_of().alias("text"), n_chars.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(*_inputs(docs)).join(F.broadcast(chosen), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, j, x = features(b["text"].to_pylist(), b["n_chars"].to_pylist())
            at = np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(a)) for a in (j.astype(np.int32), x)]
            yield pa.record_batch([b["doc_id"], b["label"], *lists], ["doc_id", "label", "keys", "values"])

    types = dict(texts.dtypes)
    rows = texts.mapInArrow(vectors, f"doc_id {types['doc_id']}, label int, keys array<int>, values array<float>").dropDuplicates(["doc_id"])
    got = rows.toArrow().sort_by("doc_id")
    keys, values = (got[c].combine_chunks() for c in ("keys", "values"))  # flat arrays, never Python lists of their entries
    sizes = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    labels_ = got["label"].to_numpy().astype(np.float64)
    return fit(np.repeat(np.arange(len(sizes)), sizes), keys.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy(), labels_)


def scored(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, score for each row of docs. keep: the rows of docs themselves in a struct `row` instead of doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = b["text"].to_pylist(), b["n_chars"].to_pylist()
            got = [np.empty(0)]
            for k in range(0, len(texts), 256):
                got.append(logistic(raw_scores(shared.value, *features(texts[k : k + 256], sizes[k : k + 256]), len(texts[k : k + 256]))))
            yield pa.record_batch([b[name], pa.array(np.concatenate(got), pa.float64())], [name, "score"])

    name = "row" if keep else "doc_id"
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_inputs(docs)[1:]) if keep else docs.select(*_inputs(docs))
    return rows.mapInArrow(scores, f"{name} {rows.schema[name].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    return scored(docs, train(docs, labels, sample)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score 0.5 or more, with the columns of docs."""
    return scored(docs, train(docs, labels, sample), keep=True).where("score >= 0.5").select("row.*")
