"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Pieces are dealt over partitions by hash and packed there by best-fit decreasing. Dual-feasible functions give each
partition a lower bound of its number of bins: a partition that meets it is certified. Partitions with a gap, and the
loosest bins of the others while all together have a gap to the bound of the whole, give their documents up; these are
dealt anew, over partitions of as many pieces as before, so that documents of different partitions meet, and packed
again. No partition grows with the input: there are ROUNDS rounds at most, fewer if one partition holds what is left or
the bound of the whole is met, and the last one keeps its bins as they are. Only lengths travel in these rounds.

Defined results: null text is an empty document (its end id alone); a document of more than `size` ids is cut into
pieces of `size` ids, the last one shorter; no other document is cut; repeated rows are documents of their own; a null
doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import run_dir, stored, text_of
from quarry.llm.token_store import sliced
from quarry.llm.words import encoder

SIZE = 4096
#: Pieces in a partition of a round, about; and bins that a certified partition gives up, at most.
PIECES, LOOSE, ROUNDS = 100_000, 64, 6


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and what is left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: a bin with r left
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            r, b = size, len(room)
            room.append(size)
        bins[i], offsets[i] = b, size - r
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            rooms |= 1 << (r - n)
    return bins, offsets, np.array(room, np.int64)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing of counts[n] pieces of length n has fewer bins. Integer arithmetic throughout."""
    n = np.arange(len(counts), dtype=np.int64)
    total = lambda weights, one: -(-int((counts * weights).sum()) // one)
    best = total(n, size)
    for k in range(1, 21):  # u(k): x to floor((k + 1) x) / k, unless (k + 1) x is whole
        whole = n * (k + 1) % size == 0
        best = max(best, total(np.where(whole, n * (k + 1) * k, n * (k + 1) // size * size * (k + 1)), size * (k + 1) * k))
    many, much = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * n)
    for e in range(1, size // 2 + 1):  # those above size - e take a bin each, those below e take no room
        best = max(best, int(many[size - e + 1]) + -(-int(much[size - e] - much[e - 1]) // size))
    return best


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """uid, doc_id, piece, start, length, ids (little-endian, unsigned, 16 bits each where the vocabulary allows it, else 32), ids_crc32 (of the ids in 32 bits)."""
    end = np.array([end_id], np.uint32)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, coder = TaskContext.get().partitionId() << 36, encoder(tokenizer)
        kind = f"<u{coder.id_bytes(end_id)}"
        for b in batches:
            doc_ids = b["doc_id"].to_pylist()
            for begin, texts in sliced(b["text"]):
                rows: list[list] = [[] for _ in range(7)]
                for k, got in enumerate(coder.ids(texts), begin):
                    ids = np.concatenate([got, end]).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), size)):
                        part = ids[start : start + size]
                        for column, value in zip(rows, (uid, doc_ids[k], piece, start, len(part), part.astype(kind).tobytes(), zlib.crc32(part.tobytes())), strict=True):
                            column.append(value)
                        uid += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(pieces, "uid long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def _packer(size: int, turn: int, last: bool):
    def packed(group: pd.DataFrame) -> pd.DataFrame:
        own = group["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(own, size)
        gap = len(room) - lower_bound(np.bincount(own, minlength=size + 1), size)
        loose = np.flatnonzero(room > 0)
        if not gap:
            loose = loose[np.argsort(-room[loose], kind="stable")[:LOOSE]]
        held = np.ones(len(room), bool)
        held[loose] = last
        ids = (turn << 56) + (int(group["bucket"].iloc[0]) << 24) + bins
        return pd.DataFrame({"uid": group["uid"], "length": own, "sequence_id": ids, "offset": offsets, "held": held[bins]})

    return packed


def place(lengths: DataFrame, size: int = SIZE, pieces: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """uid, sequence_id, offset for lengths' uid and length."""
    path = run_dir(lengths.sparkSession, "packing")
    n = lengths.count()
    parts, turn, settled = -(-n // pieces) or 1, 0, None
    whole = np.zeros(size + 1, np.int64)
    for row in lengths.groupBy("length").count().collect():  # a row for each length up to size
        whole[row["length"]] = row["count"]
    bound, used, left = lower_bound(whole, size), 0, lengths

    while True:
        last = parts == 1 or turn == rounds - 1
        dealt = left.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)).cast("long").alias("bucket"))
        done = stored(dealt.groupBy("bucket").applyInPandas(_packer(size, turn, last), "uid long, length long, sequence_id long, offset long, held boolean"), f"{path}/{turn}")
        held = done.where("held").select("uid", "sequence_id", "offset")
        in_held = held.where("offset = 0").count()
        all_bins = used + done.where("offset = 0").count()
        if last or all_bins <= bound:  # nothing can be better
            final = done.select("uid", "sequence_id", "offset")
            return final if settled is None else settled.unionByName(final)
        used += in_held
        settled = held if settled is None else settled.unionByName(held)
        left = done.where("not held").select("uid", "length")
        parts, turn = max(1, -(-left.count() // pieces)), turn + 1


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset: a row for each piece."""
    pieces = stored(tokenized(docs, tokenizer, end_id, size), f"{run_dir(docs.sparkSession, 'pieces')}/pieces")
    return pieces.join(place(pieces.select("uid", "length"), size), "uid").drop("uid")
