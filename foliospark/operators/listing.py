"""Listings and statistics of indexed documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def matching(df: DataFrame, course: str | None = None, week: str | None = None, prefix: str = "metadata") -> DataFrame:
    """P10: rows of a course and a week, without case; a missing course matches none."""
    m = lambda c: F.col(f"{prefix}.{c}" if prefix else c)
    if course:
        df = df.where(F.lower(m("course")) == course.lower())
    if week:
        df = df.where(F.lower(P.week(m("file_path"))) == week.lower())
    return df


def documents(chunks: DataFrame, course: str | None = None, week: str | None = None) -> DataFrame:
    """A row for each source with the attributes of its first chunk and its number of chunks. chunks: chunk_id, metadata."""
    m = F.col("metadata")
    rows = matching(chunks, course, week).select(P.source_id(m.document_id, m.file_path, m.file_name, m.title).alias("source_id"), "chunk_id", m.chunk_index.alias("at"), F.struct(m.title.alias("title"), m.course.alias("course"), P.week(m.file_path).alias("week"), m.source_type.alias("source_type"), m.file_path.alias("source_path"), m.file_name.alias("file_name")).alias("x"))
    out = rows.groupBy("source_id").agg(F.min_by("x", F.struct("at", "chunk_id")).alias("x"), F.count("*").alias("chunk_count"))
    return out.select("source_id", "x.*", "chunk_count").orderBy(F.coalesce("course", F.lit("")), F.coalesce("week", F.lit("")), F.coalesce("title", "file_name", F.lit("")), "source_id")


def stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, sources, courses and weeks (sorted, different, not empty)."""
    m = F.col("metadata")
    rows = chunks.select(P.source_id(m.document_id, m.file_path, m.file_name, m.title).alias("s"), F.nullif(m.course, F.lit("")).alias("c"), P.week(m.file_path).alias("w"))
    return rows.agg(F.count("*").alias("chunk_count"), F.count_distinct("s").alias("source_count"), F.array_sort(F.collect_set("c")).alias("courses"), F.array_sort(F.collect_set("w")).alias("weeks"))
