"""The registered queries ``opN_<name>``, each over its whole table, and their SQL.

A query calls its operator with production parameters and selects the columns
that are compared; the operators return more than that.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordpair.llm import (collocations, conversation_repair, exact_dedup, language, mixing, ngram_join,
                          oracles, packing, secret_scan, token_counts, token_files, toxicity,
                          vector_dedup, warc)
from wordpair.llm.store import new_folder

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3, seed=0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of operator 1 that SQL can repeat: sizes and targets."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3, seed=0)
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_classes(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                      F.col("toxic_score").alias("score"),
                      (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=1)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_classes(_table(spark, sf_dir, "documents"), words=5, percent=75)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(_table(spark, sf_dir, "documents"),
                                         new_folder(spark, "tokens"), WORD_BPE, end_id=2)
    return token_files.checksums(token_files.read_token_files(spark, path))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 3) != 1))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                      "lang_pred", F.col("lang_score").alias("score"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.audit_conversations(conversation_repair.damage(rows), rows)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases, words = collocations.phrase_counts(_table(spark, sf_dir, "documents"), longest=3, least=10)
    return collocations.collocations(phrases, words, top=2000, shortest=2, inside_percent=50)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mixing, mixing_targets, op2_exact_dedup, op3_vector_dedup, op4_toxicity, op5_warc, op6_token_counts,
    op7_packing, op8_ngram_join, op9_token_files, op10_language,
    op11_conversation_repair, op12_collocations, op13_secret_scan)}

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
          FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op3_vector_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (
          SELECT a.vec_id AS x, b.vec_id AS y
          FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_inner_product(a.e, b.e)
                / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
        reach AS (
          SELECT vec_id AS a, vec_id AS b FROM v
          UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least.component_id,
               v.vec_id = least.component_id AS kept
        FROM v JOIN least ON v.vec_id = least.a LEFT JOIN degree d ON d.x = v.vec_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex,
                     min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                        CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS INTEGER)
                              >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')
                 AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d""",
    "op8_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i
                FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
          SELECT o.x, o.y
          FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
                FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
                GROUP BY ALL) o
          JOIN n nx ON nx.doc_id = o.x JOIN n ny ON ny.doc_id = o.y
          WHERE 100 * o.o >= 75 * (nx.n + ny.n - o.o)),
        reach AS (
          SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id""",
    "mixing_targets": oracles.mixing_targets(),
    "op11_conversation_repair": oracles.conversation_repair(),
    "op12_collocations": oracles.collocations(),
    "op13_secret_scan": oracles.secret_scan_sql(),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
