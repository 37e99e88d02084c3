"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm import ann, bpe, packing, quality, secrets, set_join, suffix_dedup, toxicity, url_filter, warc
from funnelspark.llm.workspace import Workspace


#: Verdict, host and path of the rules that op5 is given.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_bytes", "kept_text")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_documents(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Workspace(spark, "warc").write(warc.archives(_table(spark, sf_dir, "pages")), "archives")
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d*)$", 1).try_cast("long")
    return warc.read(archives, payloads=False).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=("doc_id",))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_packing": op3_packing,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_url_filter": op5_url_filter,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
}

#: The others order by hashes, iterate or learn: tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), l AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
        ), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
        ), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x
        ), k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
        FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.x = d.doc_id""",
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT h, min(page_id) AS low FROM p GROUP BY h
        ), c AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i) AS digest
            FROM (SELECT h, unnest(range(32)) AS i FROM f) GROUP BY h)
        SELECT page_id, octet_length(b) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to
        FROM p JOIN f USING (h) JOIN c USING (h)""",
}
