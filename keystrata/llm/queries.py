"""The registered queries of the corpus operators, over whole tables, and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import best_fit, decontaminate, exact_dedup, near_dedup, ngram_lm, packing, secrets, sharding, token_counts, toxicity
from keystrata.llm.common import cut, fresh_path, table
from keystrata.llm.tokens import vocabulary

#: The tokenizer of the packing queries.
WORD_BPE = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), capacity=4096, closing_id=2)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), capacity=4096, closing_id=2, uri=fresh_path(spark, "matrices"))


#: Words of a context plus one. A third word would make the counts outgrow the disk that a run may use (README).
LM_ORDER = 2


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.where(~ngram_lm.held_out("doc_id")).select("text"), order=LM_ORDER)
    scored = ngram_lm.score_documents(docs, model)
    return scored.withColumn("held_out", ngram_lm.held_out("doc_id")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=Fraction(85, 100)).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
     pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
     links AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
     reach(doc_id, low) AS (SELECT doc_id, doc_id FROM documents
                            UNION SELECT e.y, r.low FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) e ON e.x = r.doc_id WHERE r.low < e.y),
     comp AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id),
     class AS (SELECT y AS doc_id, min(x) AS class_id FROM links WHERE same GROUP BY y)
SELECT comp.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, comp.doc_id = component_id AS kept, coalesce(class_id, comp.doc_id) AS class_id
FROM comp LEFT JOIN n ON n.doc_id = comp.doc_id LEFT JOIN class ON class.doc_id = comp.doc_id
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8), least_items=2)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     ns AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
     m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
     hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(it.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
     g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text before and after three edits: words put in front, a stretch in the middle replaced, the end cut off."""
    import public_tokenizers

    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    edit = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("text"))
    mid = F.floor(n / 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("edits", F.array(edit(F.lit(0), F.lit(0), "Edited: "), edit(mid, mid + 40, " (cut) "), edit(n - 40, n, "")))
    return token_counts.count_with_edits(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, edits_col="edits")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    scored = toxicity.score_documents(docs, machine)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    out = sharding.shard_by_bytes(cut(rows, "sizes"), "doc_id", "size", shards=16, ties=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by half bytes, low half first; the sixteen numbers are its table (fixed values). A row lies right of a splitter if
#: half of its own bytes do.
OP9_SQL = r"""
WITH b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
     crc AS (SELECT doc_id, size, CAST(xor(4294967295, list_reduce(list_transform(range(0, 2 * (size - 1)), lambda i: CAST(strpos('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1 AS BIGINT)),
                    lambda a, x: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, x) & 15) + 1]), CAST(4294967295 AS BIGINT))) AS BIGINT) AS text_crc32 FROM b),
     c AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id) AS BIGINT) - size AS below, CAST(sum(size) OVER () AS BIGINT) AS total FROM crc),
     s AS (SELECT *, CAST(len(list_filter(range(1, 16), lambda j: 2 * (total * j // 16) <= 2 * below + size)) AS INTEGER) AS shard FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_best_fit": op2_best_fit,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_secrets": op10_secrets,
}

SQL: dict[str, str] = {
    "op4_near_dedup": OP4_SQL,
    "op9_sharding": OP9_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
}
