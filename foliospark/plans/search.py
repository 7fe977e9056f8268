"""The search service and the query pipeline, over many queries at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scoring as S
from ..operators import answers, dense, embedding, hybrid, lexical, listing
from ..operators.lexical_index import LexicalIndex
from ..session import maybe_broadcast, written


def clamped(top_k: int, filtered: bool) -> tuple[int, int]:
    """How many are returned, and how many are fetched; five times as many with filters."""
    k = max(1, min(int(top_k), 50))
    return k, k * 5 if filtered else k


def formatted(results: DataFrame) -> DataFrame:
    """Results (query_id, rank, id, chunk_text, metadata, score) as they are returned."""
    m = F.col("metadata")
    return results.select(
        "query_id", "rank", F.col("id").alias("chunk_id"), "chunk_text", F.coalesce(m.file_name, m.title).alias("source"), m.file_path.alias("source_path"), m.source_type.alias("source_type"),
        m.course.alias("course"), P.week(m.file_path).alias("week"), m.section.alias("section"), S.search_page(m.page_start, m.page_end).alias("page"), "score",
    )


def retrieve(queries: DataFrame, chunks: DataFrame, lexical_corpus: DataFrame, k: int, alpha: float, use_hybrid: bool = True, model=embedding.hashed_vector, index: LexicalIndex | None = None) -> DataFrame:
    """(query_id, query, id, rank, similarity, hybrid_score, chunk_text, metadata, section) of the best k.

    Lexical retrieval sees lexical_corpus only, so that its statistics are those of a filtered corpus, or a saved index of it; dense
    retrieval sees all chunks. Both pass over the texts once and only keep ids; text and metadata are fetched for the winners.
    """
    asked = queries.withColumn("v", model(F.col("query"))).where("v is not null")
    near = written(dense.topk(asked, embedding.embed(chunks.select("chunk_id", "chunk_text"), "chunk_text", model), "query_id", "v", "chunk_id", "embedding", k))
    ids = near.select("id")
    if use_hybrid:
        lex = index.search(queries, "query_id", "query", k) if index else lexical.topk(queries, lexical_corpus, "query_id", "query", "chunk_id", "chunk_text", k)
        lex = written(lex)
        ids = ids.unionAll(lex.select("id"))
    won = chunks.withColumnRenamed("chunk_id", "id").join(maybe_broadcast(ids.distinct()), "id", "left_semi").dropDuplicates(["id"])
    details = maybe_broadcast(won.select("id", "metadata.section", "chunk_text", "metadata"))
    if not use_hybrid:
        return near.join(details, "id").join(maybe_broadcast(queries), "query_id").withColumn("hybrid_score", F.lit(None).cast("double"))
    return hybrid.hybrid(near, lex, details, queries, k, alpha).withColumn("similarity", F.col("dense_similarity"))


def search(queries: DataFrame, chunks: DataFrame, course: str | None = None, week: str | None = None, top_k: int = 8, candidates: int | None = None, use_hybrid: bool = True, use_reranker: bool = True, alpha: float = 0.6, model=embedding.hashed_vector, scorer=hybrid.term_share, index: LexicalIndex | None = None) -> DataFrame:
    """The results of every query that isn't blank, in a course and week if given.

    Course and week filter the corpus before lexical retrieval and the results after fusion. candidates: how many are fetched without filters.
    index: a saved index of all chunks, used where nothing filters them.
    """
    k, fetch = clamped(top_k, bool(course or week))
    fetch = max(fetch, candidates or 0)
    asked = queries.where(F.trim("query") != "")
    corpus = listing.matching(chunks, course, week)
    rows = retrieve(asked, chunks, corpus, fetch, alpha, use_hybrid, model, None if course or week else index)
    rows = dense.topk_per_course(listing.matching(rows, course, week), F.lit(True), fetch) if course or week else rows
    if use_reranker:
        rows = hybrid.rerank(rows, "query", F.col("chunk_text"), k, scorer).withColumn("score", F.col("rerank_score"))
    else:
        rows = hybrid.first(rows, k).withColumn("score", F.coalesce("hybrid_score", "similarity"))
    return formatted(rows)


def answer(queries: DataFrame, chunks: DataFrame, k: int = 4, candidates: int = 12, alpha: float = 0.6, use_reranker: bool = True, model=answers.first_sentence, prompt: bool = False) -> DataFrame:
    """(query_id, answer): retrieval, reranking of the candidates, and an answer with its sources."""
    rows = retrieve(queries.where(F.trim("query") != ""), chunks, chunks, candidates if use_reranker else k, alpha)
    if use_reranker:
        rows = hybrid.rerank(rows, "query", F.col("chunk_text"), k)
    return answers.answers(queries, rows.withColumn("chunk_id", F.col("id")), "query_id", "query", model, prompt)


def health(chunks: DataFrame) -> dict:
    """Status and count; an error becomes a status, not an exception."""
    try:
        return {"status": "ok", "chunks": chunks.count(), "warnings": []}
    except Exception as e:  # noqa: BLE001
        return {"status": "error", "chunks": None, "warnings": [str(e)[:500]]}
