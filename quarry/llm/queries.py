"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quarry.llm import decontaminate, html_text, packing, quality, secrets, substring_dedup, token_store
from quarry.llm.chat_collapse import collapse_and_render
from quarry.llm.common import run_dir
from quarry.llm.exact_dedup import ExactDedup
from quarry.llm.ngram_join import NgramJoin


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.classify(documents, labels)


def op2_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(turn, 9223372036854775807) AS ord, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
     r AS (SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
                  md5(string_agg(role || chr(31) || text || chr(30), '') OVER w) AS h
           FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY ord, role, text ROWS UNBOUNDED PRECEDING)),
     whole AS (SELECT n, h, min(conv_id) AS conv_id FROM r WHERE n = total GROUP BY n, h),
     kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.n < r.total AND r.n = whole.n AND r.h = whole.h))
SELECT t.conv_id, t.ord // 256 AS part, kept.n AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY ord, role, text) AS text
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactDedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).decisions()


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.contaminated(documents, benchmark).select("doc_id", "item_id", "start_word", "similarity")


#: Every window of each document that shares a shingle with an item, without fingerprints; of equally similar ones those
#: first that a shared shingle's place in the item gives. Items have five words or more in these tables.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
     dw AS (SELECT doc_id, len(w) AS n, w, unnest(range(len(w) - 4)) AS pos FROM d WHERE len(w) >= 5),
     ds AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS g FROM dw),
     bw AS (SELECT item_id, len(w) AS size, w, unnest(range(len(w) - 4)) AS off FROM b WHERE len(w) >= 5),
     bs AS (SELECT item_id, size, off, array_to_string(w[off + 1 : off + 5], ' ') AS g FROM bw),
     bc AS (SELECT item_id, size, g, count(*) AS c FROM bs GROUP BY ALL),
     hit AS (SELECT DISTINCT doc_id, item_id, size, n, greatest(0, least(pos - off, n - size)) AS start FROM ds JOIN bs USING (g)),
     met AS (SELECT DISTINCT doc_id, item_id, size, n, least(size, n) AS long FROM hit),
     win AS (SELECT doc_id, item_id, size, long, unnest(range(greatest(0, n - size) + 1)) AS start FROM met),
     wc AS (SELECT doc_id, item_id, size, long, start, g, count(*) AS c FROM win JOIN ds USING (doc_id) WHERE pos BETWEEN start AND start + long - 5 GROUP BY ALL),
     m AS (SELECT doc_id, item_id, start, any_value(size) - 4 + any_value(long) - 4 AS total, sum(least(wc.c, bc.c)) AS shared FROM wc JOIN bc USING (item_id, size, g) GROUP BY ALL),
     s AS (SELECT doc_id, item_id, start, hit.start IS NULL AS shifted, CAST(shared AS DOUBLE) / CAST(total - shared AS DOUBLE) AS similarity FROM m LEFT JOIN hit USING (doc_id, item_id, start))
SELECT doc_id, item_id, CAST(arg_min(start, (-similarity, shifted, start)) AS INTEGER) AS start_word, max(similarity) AS similarity
FROM s WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, where the machine keeps it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_dir(spark, 'token-store')}/shards"
    token_store.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return token_store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(spark.read.parquet(f"{sf_dir}/documents.parquet")).classes()


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.BlobLedger(spark, f"{run_dir(spark, 'secret-ledger')}/ledger")
    found = ledger.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds, base = tuple(r.name for r in secrets.RULES), tuple(r.name for r in secrets.BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(secrets.listed(F.col("spans"), base), 256).alias("base_sha256"), secrets.listed(F.col("spans"), kinds).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_chat_collapse": op2_chat_collapse,
        "op3_decontaminate": op3_decontaminate,
        "op4_token_store": op4_token_store,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_packing": op7_packing,
        "op8_ngram_join": op8_ngram_join,
        "op9_html_text": op9_html_text,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_collapse": OP2_SQL, "op3_decontaminate": OP3_SQL, "op5_exact_dedup": OP5_SQL}
