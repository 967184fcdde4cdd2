"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes each normalised text and counts the cells of a blocked Bloom filter; cells that were hit at least
twice become bitmaps. Pass two asks those bitmaps: a row with a cell that was hit once is certainly unique and passes
straight through; only the possibly repeated rows shuffle, to be grouped by their exact SHA-256.

The bitmaps are broadcast. Their size has a bound, `2 ** max_filter_bits` bits (32 MB by default). Beyond the number
of rows that this serves well, more unique rows take the shuffle; results stay the same.

Defined results: null text is empty text; empty texts equal each other; a null doc_id sorts after all others; of
repeated rows (same doc_id, equal text) one stays; an empty table gives an empty result. Other columns are untouched,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, run_dir, stored, text_of

#: Bits in one block: the size of a bitmap of Spark's bitmap functions.
BLOCK_BITS = 32768
CELLS_PER_ROW = 2


def normalised(column: str = "text") -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text_of(column), SPACE, " ")


def _cells(sha: Column, blocks: int) -> tuple[Column, Column, Column]:
    h = F.xxhash64(sha)
    block = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).cast("int")
    return block, h.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int"), F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")


def _bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(bitmap.substr((F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.expr("1") == F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1))


class ExactDedup:
    """`decisions()` says for each row what becomes of it; `survivors()` gives the rows of docs that stay."""

    def __init__(self, docs: DataFrame, bits_per_row: int = 16, max_filter_bits: int = 28):
        spark, self.docs = docs.sparkSession, docs
        self.path = run_dir(spark, "exact-dedup")
        self.prints = stored(docs.select(F.col("doc_id"), F.unhex(F.sha2(normalised(), 256)).alias("sha")), f"{self.path}/prints")
        rows = self.prints.count()
        bits = min(max_filter_bits, max(20, math.ceil(math.log2(max(1, rows * bits_per_row)))))
        self.blocks = 2**bits // BLOCK_BITS
        block, one, two = _cells(F.col("sha"), self.blocks)
        cells = self.prints.select(F.explode(F.array_distinct(F.array(*(block.cast("long") * BLOCK_BITS + c for c in (one, two))))).alias("cell"))
        repeated = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        self.bitmaps = stored(
            repeated.groupBy((F.col("cell") / BLOCK_BITS).cast("int").alias("block")).agg(F.bitmap_construct_agg((F.col("cell") % BLOCK_BITS)).alias("bitmap")),
            f"{self.path}/bitmaps",
        )
        seen = self._asked(self.prints).where("_qx_maybe").select("doc_id", "sha")
        self.groups = stored(seen.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), f"{self.path}/groups")

    def _asked(self, df: DataFrame) -> DataFrame:
        """df, which has sha, with _qx_maybe: false only if the row's hash occurs once."""
        block, one, two = _cells(F.col("sha"), self.blocks)
        bitmaps = F.broadcast(self.bitmaps.select(F.col("block").alias("_qx_block"), F.col("bitmap").alias("_qx_bitmap")))
        asked = df.join(bitmaps, block == F.col("_qx_block"), "left")
        maybe = F.coalesce(_bit(F.col("_qx_bitmap"), one) & _bit(F.col("_qx_bitmap"), two), F.lit(False))
        return asked.withColumn("_qx_maybe", maybe).drop("_qx_block", "_qx_bitmap")

    def decisions(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
        asked = self._asked(self.prints)
        alone = asked.where(~F.col("_qx_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        nth = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("doc_id"))
        maybe = asked.where("_qx_maybe").withColumn("_qx_nth", nth).join(self.groups, "sha")
        grouped = maybe.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_qx_nth") == 1)).alias("kept"), "sha")
        return alone.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")

    def survivors(self) -> DataFrame:
        """The rows of docs that stay, with the columns of docs. Texts of certainly unique rows don't shuffle, and copies
        of one text spread out by doc_id."""
        docs = self.docs.select(F.struct(*(F.col(f"`{c}`") for c in self.docs.columns)).alias("_qx_row"), F.col("doc_id").alias("_qx_id"), F.unhex(F.sha2(normalised(), 256)).alias("sha"))
        asked = self._asked(docs)
        alone = asked.where(~F.col("_qx_maybe")).select("_qx_row")
        keepers = self.groups.select(F.col("sha").alias("_qx_sha"), F.col("keep_id").alias("_qx_keep"))
        maybe = asked.where("_qx_maybe").join(keepers, (F.col("sha") == F.col("_qx_sha")) & F.col("_qx_id").eqNullSafe(F.col("_qx_keep")), "left_semi")
        nth = F.row_number().over(Window.partitionBy("sha", "_qx_id").orderBy("_qx_id"))
        maybe = maybe.withColumn("_qx_nth", nth).where("_qx_nth = 1").select("_qx_row")
        return alone.unionByName(maybe).select("_qx_row.*")
