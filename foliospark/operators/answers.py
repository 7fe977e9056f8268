"""Context blocks, prompts, answers and citations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T

SEPARATOR = "\n\n" + "-" * 80 + "\n\n"
#: What is said without context and without an answer.
NO_CONTEXT = "I do not have enough context to answer."
NO_ANSWER = "I was unable to generate an answer."
#: G1, in our own words.
INSTRUCTIONS = "You help students. Use the given context only and say so if it is not enough. Be short and direct; lists are welcome. Leave out damaged fragments of text. Give no sources: they are added to your answer."


def context_blocks(results: DataFrame, by: str) -> DataFrame:
    """(by, context), the results of each query as labelled blocks in rank order.

    results: by, rank, chunk_id, chunk_text, metadata struct.
    """
    m = lambda field, other: F.coalesce(F.col(f"metadata.{field}"), F.lit(other))
    name, section = m("file_name", "unknown file"), m("section", "unknown section")
    pages = S.page_range(F.col("metadata.page_start"), F.col("metadata.page_end"))
    fields = [("Rank", F.col("rank").cast("string")), ("File", name), ("Title", m("title", "unknown title")), ("Course", m("course", "unknown course")), ("Source Type", m("source_type", "unknown source type")), ("Chapter", m("chapter", "unknown chapter")), ("Section", section), ("Pages", pages), ("Chunk ID", F.col("chunk_id")), ("Citation", F.concat(name, F.lit(", "), section, F.lit(", pages "), pages))]
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])
    body = F.concat(head, F.lit("\n\nText:\n"), F.coalesce("chunk_text", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", body.alias("body"))))
    block = F.transform(ordered, lambda x, i: T.strip(F.concat(F.lit("[Context Block "), (i + 1).cast("string"), F.lit("]\n"), x.body)))
    return results.groupBy(by).agg(F.array_join(block, SEPARATOR).alias("context"))


def user_message(query: Column, context: Column) -> Column:
    """G3."""
    return T.strip(F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), query))


def citations(results: DataFrame, by: str, most: int = 3) -> DataFrame:
    """(by, sources): the different citations of the first results, in order."""
    line = S.citation(F.col("metadata.file_name"), F.col("metadata.section"), F.col("metadata.page_start"), F.col("metadata.page_end"))
    rows = results.select(by, "rank", "chunk_id", line.alias("line"))
    ordered = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "line"))), 1, most), lambda x: x.line)
    return rows.groupBy(by).agg(F.array_join(F.array_distinct(ordered), "\n").alias("sources"))


def first_sentence(text: Column) -> Column:
    """G4, offline: the first sentence of a text."""
    return F.get(T.sentences(text), F.lit(0))


def answers(queries: DataFrame, results: DataFrame, query_id: str, query: str, model=first_sentence, prompt: bool = False) -> DataFrame:
    """(query_id, answer) of every query that isn't blank.

    model: the answer from the text of the first result; with prompt, from INSTRUCTIONS and the user message with the context of all
    results (G1-G3), as a chat model takes them: model(system, user), two columns into one.
    """
    asked = queries.where(F.trim(query) != "").select(query_id, F.col(query).alias("_query"))
    joined = asked.join(citations(results, query_id), query_id, "left")
    if prompt:
        joined = joined.join(context_blocks(results, query_id), query_id, "left")
        given = model(F.lit(INSTRUCTIONS), user_message(F.col("_query"), F.col("context")))
    else:
        joined = joined.join(results.groupBy(query_id).agg(F.min_by("chunk_text", F.struct("rank", "chunk_id")).alias("text")), query_id, "left")
        given = model(F.col("text"))
    said = S.strip_sources(given)
    out = F.when(F.col("sources").isNull(), NO_CONTEXT).when(F.coalesce(said, F.lit("")) == "", NO_ANSWER).otherwise(F.concat(T.strip(said), F.lit("\n\nSources:\n"), F.col("sources")))
    return joined.select(query_id, out.alias("answer"))
