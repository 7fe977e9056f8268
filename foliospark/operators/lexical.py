"""BM25 over many queries at once: index statistics, scores and top-k.

The query terms, few by nature and checked, are sent to the corpus, whose texts are read once; only lengths and matching tokens go on.
If they aren't few the terms are joined instead. Blank queries find nothing; NULL texts are documents without terms.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import maybe_broadcast, written

K1, B = 1.5, 0.75
#: Most different query terms that are sent to the texts.
ASKED = 10_000
#: Words that are no terms.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def terms(c: Column) -> Column:
    """Lower-case runs of at least two letters, digits or underscores that aren't stop words, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: ~t.isin(*STOP_WORDS))


def postings(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): the index, one row for each document and term."""
    docs = corpus.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return docs.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (n, avgdl)."""
    return corpus.select(F.size(terms(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def matched(asked: DataFrame, corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, hits) of every document, in one pass over the texts: its length and those of its terms that are asked for. asked: (term). Repeated rows of an id count once."""
    docs = corpus.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t"))
    few = asked.select("term").distinct().limit(ASKED + 1).collect()
    if len(few) <= ASKED:
        given = [r.term for r in few]
        hits = F.filter("t", lambda x: x.isin(*given)) if given else F.array().cast("array<string>")
        return written(docs.select("id", F.size("t").alias("dl"), hits.alias("hits")).dropDuplicates(["id"]))
    once = written(docs.dropDuplicates(["id"]))
    found = once.select("id", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id").agg(F.collect_list("term").alias("hits"))
    return written(once.select("id", F.size("t").alias("dl")).join(found, "id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>"))))


def asked_terms(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query_id, term, times)."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def scores(asked: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of every document that holds a term of the query; a term counts as often as the query has it. docs: as matched gives them."""
    tf = docs.select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = maybe_broadcast(tf.groupBy("term").agg(F.count("*").alias("df")))
    stats = F.broadcast(docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(df, "term").crossJoin(stats).select("id", "term", weight.alias("w"))
    return weighted.join(maybe_broadcast(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("times")), 6).alias("score"))


def topk(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, id_col: str, text_col: str, k: int) -> DataFrame:
    """O2: (query_id, id, score, rank); documents without a term of the query fill up to k with score 0, least id first."""
    asked = asked_terms(queries, query_id, query_text)
    docs = matched(asked, corpus, id_col, text_col)
    return ranked(queries, query_id, scores(asked, docs), docs.select("id"), k)


def ranked(queries: DataFrame, query_id: str, hits: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The best k of hits (query_id, id, score) for each query, filled up with the least of ids at score 0."""
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).drop("rank")
    # k of the least ids are enough to fill any query: at most k - 1 of them are hits
    fill = ids.where("id is not null").orderBy("id").limit(k)
    padded = queries.select(F.col(query_id).alias("query_id")).crossJoin(F.broadcast(fill)).withColumn("score", F.lit(0.0))
    both = best.unionByName(padded).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
