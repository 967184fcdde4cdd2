"""Token ids of a corpus in a binary format: one id array, and Elias-Fano coded document boundaries.

A shard is a byte string: header, Elias-Fano code of the document boundaries (0 and the end of each document in the
shard's id array), Elias-Fano code of the ascending doc_ids, and the ids, 16 bits each where the vocabulary allows it,
else 32. Random access to a document takes two selects, and readers get a run of documents from two selects at its
ends: no table of offsets is ever made. Shards are written through Spark's own writer and committer
(a column of bytes in Parquet), so that they go to any file system Spark can write and a lost executor's task is
simply run again. No task holds more than one shard of SHARD_IDS ids, and one document, besides its sort.

Documents are in ascending doc_id order: partitions by range, shards by their number in a partition. Ids before a
partition are sums of the partitions' totals (a row for each write partition, whose number is a setting).

Defined results: null text is an empty document (its end id alone); null doc_ids come last; repeated rows are
documents of their own, ordered by text; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import text_of
from quarry.llm.elias_fano import EliasFano
from quarry.llm.words import encoder

MAGIC, SHARD_IDS, SLICE_CHARS = b"QEF1", 4_000_000, 2_000_000
#: Of texts that are encoded at once: the more there are, the fewer of their chunks are new or looked up again.
ENCODED_CHARS = 6_000_000
_HEAD = struct.Struct("<4sBxxxQQQ")  # magic, bytes an id, documents, of them without a doc_id, ids
SCHEMA = "part int, shard int, base long, n_docs long, n_ids long, payload binary"


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """doc_ids ascending, None last."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
    head = _HEAD.pack(MAGIC, width, len(doc_ids), len(doc_ids) - len(known), len(ids))
    return b"".join((head, EliasFano.of(ends).to_bytes(), EliasFano.of(known).to_bytes(), ids.astype(f"<u{width}").tobytes()))


class Shard:
    """A shard's documents, each at its offset."""

    def __init__(self, payload: bytes):
        data = memoryview(payload)
        magic, width, self.n, self.n_null, n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"not a shard: {bytes(magic)!r}")
        self.bounds, size = EliasFano.from_bytes(data[_HEAD.size :])
        self.keys, more = EliasFano.from_bytes(data[_HEAD.size + size :])
        self.ids = np.frombuffer(data[_HEAD.size + size + more :], f"<u{width}", n_ids)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the i-th document, by select."""
        return self.keys[i] if i < self.n - self.n_null else None, self.ids[self.bounds[i] : self.bounds[i + 1]]

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Of the documents from i, before j."""
        known = self.n - self.n_null
        return [*self.keys.between(min(i, known), min(j, known)).tolist(), *[None] * (j - max(i, min(j, known)))]


def sliced(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about so many bytes, and where each begins."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + chars)))
        yield begin, texts[begin:end]
        begin = end


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode the texts of docs, end_id after each, and write them to path."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, number, coder = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        keys: list[int | None] = []
        runs: list[np.ndarray] = []
        lengths: list[int] = []
        held, width = 0, coder.id_bytes(end_id)

        def flushed() -> pa.RecordBatch:
            payload = shard_bytes(keys, np.array(lengths, np.int64), np.concatenate(runs), width)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "base": base, "n_docs": len(keys), "n_ids": held, "payload": payload}], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        end = np.array([end_id], np.uint32)
        for b in batches:
            ids = b["doc_id"].to_pylist()
            for begin, texts in sliced(b["text"], ENCODED_CHARS):
                for k, got in enumerate(coder.ids(texts), begin):
                    keys.append(ids[k])
                    runs += (got, end)
                    lengths.append(len(got) + 1)
                    held += len(got) + 1
                    if held >= shard_ids:
                        yield flushed()
                        base, number, keys, runs, lengths, held = base + held, number + 1, [], [], [], 0
        if keys:
            yield flushed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_last()
    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange(n, order).sortWithinPartitions(order, "text")
    ordered.mapInArrow(shards, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of each document in path."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b["base"].to_pylist(), b["payload"], strict=True):
                shard = Shard(payload.as_buffer())
                for i in range(0, shard.n, 1024):
                    j = min(shard.n, i + 1024)
                    bounds, keys = shard.bounds.between(i, j + 1), shard.doc_ids(i, j)
                    ids = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    ends = ((bounds - bounds[0]) * 4).astype(np.int32)
                    blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), blobs], ["doc_id", "start", "n_tokens", "ids"])

    placed = stored.join(F.broadcast(parts), F.col("part") == F.col("of_part")).select((F.col("base") + F.col("before")).alias("base"), "payload")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
