"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification.

Words are runs of letters and digits in lower case. A window has as many words as a benchmark item, or is the whole
document if that is shorter. Each has a 64-bit SimHash of its words. Fingerprints are cut into RADIUS + 1 blocks, and
items are indexed by the values of their blocks: two fingerprints that differ in at most RADIUS bits agree in a whole
block, so looking each block up finds every item within the radius. A document looks up its own items only (those that
share enough shingles with it; see below), so that no block is a hot key of all windows. No radius is safe at 0.8, so
windows beyond it of those items are verified as well: the fingerprints decide no row. Verification is exact, by the
similarity of the five-word shingles weighted by their occurrences: the sum of the smaller weights by the sum of the
larger ones.

Windows start where a shingle of the document that an item also has would be in that item's window (aligned), or so
that such a shingle is the last in them. Any other window can move left to one of the latter without losing a shared
shingle, so none is more similar. No window can be similar without sharing four in five of the item's shingles:
documents with fewer drop out before their windows are cut, and windows with too few shared places are not cut. All of it is DataFrame functions. The benchmark's
shingles are broadcast only if there are at most BROADCAST of them, counted first; else they are joined by shuffles.

Defined results: null text has no words and matches nothing, as a document or as an item; an item of fewer than five
words is one shingle; a null doc_id or item_id is reported as null; repeated rows give the pair once;
different texts of one item_id are each looked for, and the best window of any is reported; of equally similar windows
the first aligned one is reported, or the first if none is aligned; empty tables give an empty result; other columns
are untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import row_key, run_dir, stored, text_of

WORDS, BITS, RADIUS, BROADCAST = 5, 64, 12, 500_000
_EDGES = [round(k * BITS / (RADIUS + 1)) for k in range(RADIUS + 2)]


def words_of(column: str = "text") -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text_of(column)), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles_of(hashes: Column, size: int = WORDS) -> Column:
    """The hash of each `size` consecutive words, given the words' hashes; of all of them if there are fewer but some."""
    n = F.size(hashes)
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), *(F.element_at(hashes, i + k) for k in range(size))))


def simhash(hashes: Column) -> Column:
    """Bit b is set if most words' hashes have it set."""
    bit = lambda h, b: F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int")
    votes = lambda b: F.aggregate(hashes, F.lit(0), lambda sum_, h: sum_ + bit(h, b) * 2 - 1)
    put = lambda b: F.when(votes(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda all_, b: all_.bitwiseOR(put(b)))


def blocks_of(fingerprint: Column) -> Column:
    """(block, value) of each block of a fingerprint."""
    cut = lambda a, b: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit(2 ** (b - a) - 1))
    return F.array(*(F.struct(F.lit(k).alias("block"), cut(a, b).alias("value")) for k, (a, b) in enumerate(zip(_EDGES[:-1], _EDGES[1:], strict=True))))


def similarity(one: Column, two: Column) -> Column:
    """Of two arrays of shingles, weighted by occurrence."""
    count = lambda all_, x: F.size(F.filter(all_, lambda y: y == x))
    both = F.aggregate(F.array_distinct(one), F.lit(0), lambda sum_, x: sum_ + F.least(count(one, x), count(two, x)))
    both = F.when(F.size(F.array_distinct(one)) == F.size(one), F.size(F.array_intersect(one, two))).otherwise(both)
    return both / (F.size(one) + F.size(two) - both)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, key (see row_key), item_id, start_word, similarity, near (whether the index found it): the best window of
    each document and item, at 0.8 or more."""
    path = run_dir(docs.sparkSession, "decontaminate")
    items = benchmark.select("item_id", _hashed(words_of()).alias("item_words")).where(F.size("item_words") > 0).dropDuplicates(["item_id", "item_words"])
    items = items.withColumn("item_key", F.xxhash64("item_words")).withColumn("n_item", F.size("item_words")).withColumn("size", F.least(F.lit(WORDS), "n_item"))
    shingled = F.coalesce(*(F.when(F.col("size") == k, shingles_of(F.col("item_words"), k)) for k in range(1, WORDS + 1)))
    items = stored(items.withColumn("item_shingles", shingled).withColumn("item_print", simhash(F.col("item_words"))), f"{path}/items")
    about = items.groupBy("size").agg(F.sum(F.size("item_shingles")).alias("n")).collect()  # at most WORDS rows
    place = items.select("item_id", "item_key", "n_item", "size", F.size("item_shingles").alias("n_shingles"), F.posexplode("item_shingles").alias("offset", "shingle"))
    if sum(r["n"] for r in about) <= BROADCAST:
        place = F.broadcast(place)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), text_of()).alias("key"), words_of().alias("words"))
    hashed = texts.select("doc_id", "key", _hashed(F.col("words")).alias("hashes"))
    hits = []
    for size in sorted(r["size"] for r in about) or [WORDS]:
        at = hashed.select("doc_id", "key", F.size("hashes").alias("n_words"), F.posexplode(shingles_of(F.col("hashes"), size)).alias("pos", "shingle"))
        found = at.join(place.where(F.col("size") == size), "shingle")
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("n_words") - F.col("n_item")))
        hits.append(found.select("doc_id", "key", "item_id", "item_key", "n_item", "n_shingles", "offset", "pos", "n_words", start.alias("start")))
    enough = F.count_distinct("offset") * 5 >= F.first("n_shingles") * 4
    likely = reduce(DataFrame.unionByName, hits).groupBy("doc_id", "key", "item_id", "item_key", "n_item").agg(
        F.collect_set("start").alias("starts"), enough.alias("enough"), F.array_sort(F.collect_set("pos")).alias("places"), F.first("n_shingles").alias("n_shingles"), F.first("n_words").alias("n_words")
    )
    # both / (a + b - both) >= 0.8 of a and b shingles is 9 * both >= 4 * (a + b); both is at most the shared places in the window
    least = F.ceil((F.least("n_shingles", F.col("n_words") - F.col("n_item") + F.col("n_shingles")) + F.col("n_shingles")) * 4 / 9).cast("int")
    last = F.filter("places", lambda p, i: (i + 1 >= F.col("least")) & (F.get("places", i + 1 - F.col("least")) > p - F.col("n_shingles")))
    likely = likely.where("enough").withColumn("least", least)
    others = F.transform(last, lambda p: F.greatest(F.lit(0), p - F.col("n_shingles") + 1))
    likely = likely.select(F.col("doc_id").alias("its_id"), F.col("key").alias("its_key"), "item_id", "item_key", "n_item", F.col("starts").alias("aligned"), F.array_union("starts", others).alias("starts"))
    likely = stored(likely, f"{path}/likely")

    tried = likely.groupBy("its_id", "its_key", "n_item").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    met = texts.join(tried, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")))
    windows = met.select("doc_id", "key", "n_item", "words", F.explode("starts").alias("start_word"))
    windows = windows.select("doc_id", "key", "n_item", "start_word", _hashed(F.slice("words", F.col("start_word") + 1, F.col("n_item"))).alias("hashes")).distinct()
    windows = stored(windows.withColumn("fingerprint", simhash(F.col("hashes"))), f"{path}/windows")
    asked = windows.select("doc_id", "key", "n_item", "start_word", "fingerprint", F.explode(blocks_of(F.col("fingerprint"))).alias("b")).select("*", "b.block", "b.value").drop("b")
    prints = items.select(F.col("item_id").alias("its_item"), F.col("item_key").alias("its_words"), "item_print")
    own = likely.drop("starts").join(prints, F.col("item_id").eqNullSafe(F.col("its_item")) & (F.col("item_key") == F.col("its_words")))
    index = own.select("its_id", "its_key", "item_id", "item_key", F.col("n_item").alias("of_size"), "aligned", "item_print", F.explode(blocks_of(F.col("item_print"))).alias("b")).select("*", F.col("b.block").alias("of_block"), F.col("b.value").alias("of_value")).drop("b")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key")) & (F.col("n_item") == F.col("of_size")) & (F.col("block") == F.col("of_block")) & (F.col("value") == F.col("of_value"))
    near = asked.join(index, same).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.withColumn("aligned", F.array_contains("aligned", F.col("start_word")))
    far = likely.select(F.col("its_id").alias("doc_id"), F.col("its_key").alias("key"), F.explode("starts").alias("start_word"), "n_item", "item_id", "item_key", "aligned")
    far = far.withColumn("aligned", F.array_contains("aligned", F.col("start_word")))
    near = near.select("doc_id", "key", "start_word", "n_item", "item_id", "item_key", "aligned", F.lit(True).alias("near")).unionByName(far.withColumn("near", F.lit(False)))
    near = near.groupBy("doc_id", "key", "start_word", "n_item", "item_id", "item_key").agg(F.max("aligned").alias("aligned"), F.max("near").alias("near"))
    known = items.select(F.col("item_id").alias("its_item"), F.col("item_key").alias("its_words"), "size", "item_shingles")
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")) & (F.col("start_word") == F.col("w_start")) & (F.col("n_item") == F.col("w_n"))
    cut = windows.select(F.col("doc_id").alias("w_id"), F.col("key").alias("w_key"), F.col("start_word").alias("w_start"), F.col("n_item").alias("w_n"), "hashes")
    pairs = near.join(cut, same).join(known, F.col("item_id").eqNullSafe(F.col("its_item")) & (F.col("item_key") == F.col("its_words")))
    shingled = F.coalesce(*(F.when(F.col("size") == k, shingles_of(F.col("hashes"), k)) for k in range(1, WORDS + 1)))
    verified = pairs.select("doc_id", "key", "item_id", "start_word", "aligned", "near", similarity(shingled, F.col("item_shingles")).alias("similarity")).where("similarity >= 0.8")
    best = verified.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("similarity", "aligned", (-F.col("start_word")).alias("back"), "near")).alias("best"))
    return best.select("doc_id", "key", "item_id", (-F.col("best.back")).alias("start_word"), F.col("best.similarity").alias("similarity"), F.col("best.near").alias("near"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs with no item in them, with the columns of docs."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_qx_found"), F.col("key").alias("_qx_found_key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_qx_row"), F.col("doc_id").cast("long").alias("_qx_id"), row_key(F.col("doc_id"), text_of()).alias("_qx_key"))
    kept = rows.join(found, F.col("_qx_id").eqNullSafe(F.col("_qx_found")) & (F.col("_qx_key") == F.col("_qx_found_key")), "left_anti")
    return kept.select("_qx_row.*")
