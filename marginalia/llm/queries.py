"""The queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.byte_bpe import encode_digests
from marginalia.llm.importance import importance_resample
from marginalia.llm.jaccard_join import jaccard_join
from marginalia.llm.language_id import fit_language_id, identify
from marginalia.llm.line_crf import fit_line_crf, score_quality
from marginalia.llm.line_dedup import line_dedup
from marginalia.llm.mixing import mix
from marginalia.llm.public_vocab import default_path
from marginalia.llm.quality_rules import quality_rules
from marginalia.llm.secret_scan import secret_scan
from marginalia.llm.sql import IMPORTANCE_RESAMPLING, LINE_DEDUP, MIXING_TARGETS, NGRAM_JACCARD_JOIN, QUALITY_BASE_COUNTS, SECRET_BASE_SPANS, VECTOR_CODES
from marginalia.llm.token_counts import token_counts
from marginalia.llm.url_filter import url_filter
from marginalia.llm.vector_codes import compress_vectors
from marginalia.llm.vp_search import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(of: str, by: int):
    return F.crc32(F.col(of).cast("string")) % by


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model of the labels outside a held-out fifth."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0)
    scored = score_quality(docs, fit_line_crf(docs, labels))
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and their decoding, as digests."""
    return encode_digests(_table(spark, sf_dir, "documents"), default_path("byte_bpe_multi_50k.tiktoken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents by source weights."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts(_table(spark, sf_dir, "documents"))


# The rules of op7.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(_table(spark, sf_dir, "pages"), rules)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documents by sets of 4-word shingles at a Jaccard similarity of 0.85."""
    out = jaccard_join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the rows outside a held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    model = fit_language_id(docs.where(_remainder("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser fertility and verdict of every document."""
    return quality_rules(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by their likeness to the benchmark."""
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer codes of every vector."""
    return compress_vectors(_table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds."""
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that do not depend on compression."""
    return op2_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 before any rounding."""
    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that need no vocabulary."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scans": op2_secret_scans,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_url_filters": op7_url_filters,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}
#: Columns of op2, op5 and op10 that SQL can express, as queries of their own.
PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"secret_base_spans": secret_base_spans, "mixing_targets": mixing_targets, "quality_base_counts": quality_base_counts}
ORACLES: dict[str, str] = {
    "op8_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op11_importance_resampling": IMPORTANCE_RESAMPLING,
    "op12_vector_codes": VECTOR_CODES,
    "op13_line_dedup": LINE_DEDUP,
    "secret_base_spans": SECRET_BASE_SPANS,
    "mixing_targets": MIXING_TARGETS,
    "quality_base_counts": QUALITY_BASE_COUNTS,
    "op3_nearest_neighbours": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
                   FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_url_filters": """
        WITH q AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
             r AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM q),
             rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
             hits AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) AS n
                      FROM r JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT r.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM r LEFT JOIN hits ON r.page_id = hits.page_id AND n = 1""",
}
