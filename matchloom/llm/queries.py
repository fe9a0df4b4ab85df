"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import bpe_stream, html_extract, media_audio, ngram_join, packing, pii, quality_rules, substring_dedup, token_store, warc
from matchloom.llm.common import small_batches, stored, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_store.token_round_trip(spark, table(spark, sf_dir, "documents"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip_digest(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_columns(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op7_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.media_digest(media_audio.store_media(spark, table(spark, sf_dir, "documents")))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_round_trip(spark, table(spark, sf_dir, "pages"))


def op9_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return stored(spark, packing.packed_digest(packing.pack_documents(table(spark, sf_dir, "documents"))), "pieces")


QUERIES = {"op1_token_store": op1_token_store, "op2_bpe_stream": op2_bpe_stream, "op3_ngram_jaccard_join": op3_ngram_jaccard_join, "op4_substring_dedup": op4_substring_dedup, "op5_quality_rules": op5_quality_rules, "op6_html_text": op6_html_text, "op7_telephony_media": op7_telephony_media, "op8_warc_segments": op8_warc_segments, "op9_skip_chain_pii": op9_skip_chain_pii, "op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
        both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
    """,
    "op4_substring_dedup": r"""
        WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
        h AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(list_slice(words, i, i + 34), ' ')) AS h FROM p JOIN w USING (doc_id)),
        again AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1),
        gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h JOIN again USING (h)),
        word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
    """,
    "op8_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d),
        r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to FROM m)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
        FROM r
    """,
}
