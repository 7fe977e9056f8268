"""Evaluation of retrieval pipelines: scores, grouped means, differences from dense, changes of the first result."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S


def query_scores(results: DataFrame, chunks: DataFrame, queries: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """(by, retrieval_score) of the first k results of each list against the query's keywords.

    results: by (with query_id), result_rank, chunk_id; chunks: chunk_id, chunk_text; queries: query_id, keywords.
    """
    first = results.where(F.col("result_rank") <= k).join(chunks, "chunk_id", "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("result_rank", "chunk_id", F.coalesce("chunk_text", F.lit("")).alias("t")))), lambda x: x.t), " ")
    lists = first.groupBy(*by).agg(text.alias("text"))
    return lists.join(queries, "query_id").select(*by, S.keyword_score(F.col("text"), F.col("keywords")).alias("retrieval_score"))


def summary(scores: DataFrame, value: str = "retrieval_score") -> DataFrame:
    """(grp, pipeline, queries, mean, delta): means by pipeline over all queries and by group, with the difference from dense.

    Every pair of group and pipeline has a row; a mean over nothing is NULL. scores: query_id, pipeline, value.
    """
    rows = scores.withColumn("grp", S.query_group(F.col("query_id")))
    means = rows.groupingSets([[F.col("pipeline")], [F.col("grp"), F.col("pipeline")]], "grp", "pipeline").agg(F.count("*").alias("queries"), F.avg(value).alias("mean")).withColumn("grp", F.coalesce("grp", F.lit("all")))
    spark = scores.sparkSession
    grid = spark.createDataFrame([(g, p) for g in ("all", "semantic", "lexical") for p in S.PIPELINES], "grp string, pipeline string")
    full = grid.join(F.broadcast(means), ["grp", "pipeline"], "left")
    dense = full.where("pipeline = 'dense'").select("grp", F.col("mean").alias("dense_mean"))
    out = full.join(F.broadcast(dense), "grp")
    return out.select("grp", "pipeline", F.coalesce("queries", F.lit(0)).alias("queries"), F.round("mean", 6).alias("mean"), F.when(F.col("pipeline") != "dense", F.round(F.col("mean") - F.col("dense_mean"), 6)).alias("delta"))


def top_changes(results: DataFrame, by: list[str]) -> DataFrame:
    """(pipeline, lists, changed): in how many lists the first result differs from dense; lists without one of dense don't count.

    results: by, pipeline, result_rank, chunk_id.
    """
    top = results.groupBy(*by, "pipeline").agg(F.min_by("chunk_id", F.struct("result_rank", "chunk_id")).alias("top"))
    dense = top.where("pipeline = 'dense' and top is not null").select(*by, F.col("top").alias("dense_top"))
    both = top.where("pipeline <> 'dense'").join(dense, by)
    return both.groupBy("pipeline").agg(F.count("*").alias("lists"), F.count_if(~F.col("top").eqNullSafe(F.col("dense_top"))).alias("changed"))


def timing_rollup(timings: DataFrame, by: str, seconds: str) -> DataFrame:
    """Count, sum and mean of the seconds."""
    return timings.groupBy(by).agg(F.count(seconds).alias("n"), F.round(F.sum(seconds), 3).alias("total_s"), F.round(F.avg(seconds), 6).alias("mean_s"))


def winner(scores: DataFrame, config: str, value: str, order: Column) -> DataFrame:
    """The configuration with the highest mean, the first of equal ones."""
    means = scores.groupBy(config).agg(F.round(F.avg(value), 6).alias("mean"), F.min(order).alias("_o"))
    return means.agg(F.max_by(config, F.struct("mean", -F.col("_o"))).alias("winner"), F.max("mean").alias("mean"))
