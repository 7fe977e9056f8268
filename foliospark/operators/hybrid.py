"""Fusion of dense and lexical results: normalisation, merge, section policies, hybrid ranks and reranking."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..session import maybe_broadcast
from . import lexical


def normalized(score: Column, by: list[str]) -> Column:
    """Min-max within the group; all NULL gives 0, a single value gives 1 to every row, a NULL among others gives 0."""
    w = W.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high.isNull(), 0.0).when(low == high, 1.0).when(score.isNull(), 0.0).otherwise((score - low) / (high - low))


def merge(dense: DataFrame, lex: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of (keys, dense_rank, dense_similarity, dense_norm) and (keys, bm25_rank, bm25_score, bm25_norm); the norms of an absent side are 0. Rows with a NULL key are left out."""
    has = " and ".join(f"{k} is not null" for k in keys)
    both = dense.where(has).join(lex.where(has), keys, "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("dense_norm", "bm25_norm")})


def fused(merged: DataFrame, query: str, section: str, alpha: float) -> DataFrame:
    """Raw score, penalty, hybrid score and rank; ties keep the dense order, then the lexical one."""
    raw = F.round(alpha * F.col("dense_norm") + (1 - alpha) * F.col("bm25_norm"), 6)
    out = merged.withColumn("raw", raw).withColumn("penalty", S.section_penalty(F.col(section), F.col(query)))
    out = out.withColumn("hybrid_score", F.round(F.col("raw") * F.col("penalty"), 6))
    order = W.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "id")
    return out.withColumn("rank", F.row_number().over(order))


def exercise_filtered(ranked: DataFrame, query: str, section: str, at_least: int = 1, by: list[str] | None = None) -> DataFrame:
    """Without exercise sections, unless the query asks for practice or too few rows would be left. Ranks keep their gaps."""
    exercise = S.is_exercise(F.col(section))
    left = F.sum(F.when(~exercise, 1).otherwise(0)).over(W.partitionBy(*(by or ["query_id"])))
    return ranked.withColumn("_left", left).where(S.is_practice(F.col(query)) | ~exercise | (F.col("_left") < at_least)).drop("_left")


def first(ranked: DataFrame, k: int) -> DataFrame:
    """O3: the first k of what is left, by rank."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def term_share(query: Column, text: Column) -> Column:
    """The offline reranker: the share of the query's different terms that the text holds."""
    asked = F.array_distinct(lexical.terms(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, lexical.terms(text))) / F.size(asked)).otherwise(0.0)


def rerank(ranked: DataFrame, query: str, text: str, k: int, scorer=term_share) -> DataFrame:
    """Scored again, ranked by that score with ties in the old order. dense_rank and dense_similarity become the incoming rank and similarity. A blank query keeps the old order."""
    out = ranked.withColumns({"dense_rank": F.col("rank"), "dense_similarity": F.col("similarity"), "rerank_score": F.when(F.trim(query) != "", F.round(scorer(F.col(query), F.coalesce(text, F.lit(""))), 6))})
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "dense_rank")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(dense: DataFrame, lex: DataFrame, details: DataFrame, queries: DataFrame, k: int, alpha: float = 0.6) -> DataFrame:
    """Dense (query_id, id, rank, similarity) and lexical (query_id, id, rank, score) top lists into one of k.

    details: (id, section, ...) of all rows; queries: (query_id, query).
    """
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("similarity").alias("dense_similarity")).withColumn("dense_norm", F.round(normalized(F.col("dense_similarity"), ["query_id"]), 6))
    b = lex.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score")).withColumn("bm25_norm", F.round(normalized(F.col("bm25_score"), ["query_id"]), 6))
    merged = merge(d, b, ["query_id", "id"]).join(details, "id").join(maybe_broadcast(queries), "query_id")
    return first(exercise_filtered(fused(merged, "query", "section", alpha), "query", "section"), k)
