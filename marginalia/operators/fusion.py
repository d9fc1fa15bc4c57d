"""Fusion, provenance, guards and reranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.numbers import summary_stage
from marginalia.operators.retrieval import DIGITS, bm25, trigram_cosine

RRF_K = 60
PER_STAGE = 3


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion (5.2) of (query_id, stage, id, rank).

    Result: (query_id, id, score, stages, stage_ranks, rank), best first, ties by id.
    """
    fused = ranked.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_set("stage")).alias("stages"), F.map_from_entries(F.collect_list(F.struct("stage", "rank"))).alias("stage_ranks")
    )
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def hybrid(corpus: DataFrame, queries: DataFrame, k: int = 8, *, allowed: Column | None = None) -> DataFrame:
    """Trigram cosine and BM25, each over-fetched threefold, fused (11.5).

    ``allowed`` filters the corpus before both rankings, so that texts that may not be
    returned crowd nobody out. Result: rrf columns and ``stage``.
    """
    if allowed is not None:
        corpus = corpus.where(allowed)
    dense = trigram_cosine(corpus, queries, k * PER_STAGE).select("query_id", "id", "rank", F.lit("vector").alias("stage"))
    lexical = bm25(corpus, queries, k * PER_STAGE).select("query_id", "id", "rank", F.lit("bm25").alias("stage"))
    return rrf(dense.unionByName(lexical)).where(F.col("rank") <= k).withColumn("stage", summary_stage(F.col("stages")))


def guard_after_fusion(fused: DataFrame, level: Column, allowed: list[str] | None, k: int) -> DataFrame:
    """Drop candidates of other levels after fusion, then cut (3.17, 7.4). None: no filter; an empty list drops all."""
    kept = fused if allowed is None else fused.where(level.isin(allowed))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", place).where(F.col("rank") <= k)


def reciprocal_rank_only(ranked: DataFrame) -> DataFrame:
    """One stage alone scores 1 / rank (6.2)."""
    return ranked.withColumn("score", F.round(F.lit(1.0) / F.col("rank"), DIGITS))


def keep_max(candidates: DataFrame, keys: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """Of each key the row of the highest score, ties to the one seen first (6.3)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), pos)
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_seen(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Of each key the first row (6.4)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where("__n = 1").drop("__n")


def authority_rerank(candidates: DataFrame, authority: Column, by: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """Place by authority rank, then score, stable (7.8): adds ``place``."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(authority, F.desc(score), pos)))


def scripted_rerank(candidates: DataFrame, key: str, order: list, pos: str = "pos", by: list[str] | None = None) -> DataFrame:
    """Listed keys first in the given order, the rest as they were (7.9): adds ``place``, within each value of ``by``."""
    listed = list(dict.fromkeys(order))
    at = F.array_position(F.array(*map(F.lit, listed)), F.col(key)) if listed else F.lit(0)
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.when(at > 0, at).otherwise(F.lit(len(listed) + 1)), pos)))


def relevance_rerank(candidates: DataFrame, relevance: str, authority: Column, by: list[str], pos: str = "pos") -> DataFrame:
    """Outside relevance first, authority on ties, unscored rows last as they were (7.11)."""
    order = [F.col(relevance).desc_nulls_last(), F.when(F.col(relevance).isNotNull(), authority), F.col(pos)]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def tag_survivors(stages: Column) -> Column:
    """Stage tags with the mark of a rerank survivor, sorted (8.9)."""
    return F.array_sort(F.array_union(stages, F.array(F.lit("rerank-survivor"))))
