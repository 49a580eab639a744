"""The queries op1_... to op10_... and `pipeline` over the tables of a folder, for the driver's contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import op1_packing, op2_toxicity, op3_lattice, op4_word_bpe, op5_simhash, op6_token_counts, op7_warc, op8_line_dedup, op9_chat, op10_topk

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_word_bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op2_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op2_toxicity.score(docs, op2_toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_lattice.link_vectors(_table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op5_simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines and n_dropped (lines with words), text without the dropped lines."""
    return op8_line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return op9_chat.digests(turns.unionByName(extra))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_topk.top_k(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity_scores,
    "op3_lattice_near_dedup": op3_lattice_near_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_token_counts": op6_token_counts_query,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_line_dedup": op8_line_dedup_query,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_exact_top_k": op10_exact_top_k,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_lattice_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
        reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id)
        SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
        FROM v JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) c ON c.id = v.vec_id
        LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = v.vec_id""",
    "op7_warc_round_trip": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
                list_aggregate(list_transform(range(8), lambda i: translate(to_base(('0x' || substr(h, 5 * i + 1, 5))::BIGINT, 32, 4),
                  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), 'string_agg', '') AS payload_digest FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op9_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<part>', '\p')) AS n,
                lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AS same FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n + CASE WHEN same THEN 6 ELSE 14 + length(role) END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
