"""Ingestion as one plan: files, skip, clean, chunk, embed, publish, manifest."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import chunking, embedding, manifest, store
from ..operators.pages import page_markdown
from ..session import maybe_broadcast, written
from ..sources import files as S


def cleaned(docs: DataFrame) -> DataFrame:
    """V14, first half: documents with their clean text."""
    return docs.withColumn("cleaned_text", T.clean(F.col("raw_text")))


def chunked(docs: DataFrame, target: int = 900, overlap: int = 75) -> DataFrame:
    """Chunk records (chunk_id, chunk_text, document_id, metadata) of clean documents."""
    rows = chunking.chunk_documents(docs, "document_id", "cleaned_text", "source_type", target, overlap)
    about = docs.select("document_id", "file_name", F.col("path").alias("file_path"), F.col("source_type").alias("doc_type"), "course", "title")
    rows = rows.join(about, "document_id")
    metadata = F.struct("document_id", "file_name", "file_path", F.coalesce("source_type", "doc_type").alias("source_type"), "course", "title", "chapter", "section", "sections", "chunk_index", "total_chunks", "page_start", "page_end", "unit_count", "chunk_text_length")
    return rows.select("chunk_id", "chunk_text", "document_id", metadata.alias("metadata"))


def extracted(todo: DataFrame, parser=None) -> DataFrame:
    """(document_id, raw_text, error) of files to be read: texts as they are, PDFs through the parser, page-marked Markdown and the quality gate."""
    read = S.texts(todo).withColumn("error", F.when(F.col("raw_text").isNull(), "The file is no UTF-8 text."))
    pdf = todo.where(P.extension(F.col("path")) == ".pdf").select(P.document_id(F.col("path")).alias("document_id")).distinct()
    if parser is None:
        return read.unionByName(pdf.select("document_id", F.lit(None).cast("string").alias("raw_text"), F.lit("No parser for PDF files is given.").alias("error")))
    pages = page_markdown(S.layout_items(todo, parser)).withColumnRenamed("markdown", "raw_text")
    gate = P.quality(F.col("raw_text"))["passed"]
    why = F.when(F.col("raw_text").isNull(), "No text was extracted.").when(~gate, "The extracted text is of poor quality.")
    return read.unionByName(pdf.join(pages, "document_id", "left").withColumn("error", why).withColumn("raw_text", F.when(F.col("error").isNull(), F.col("raw_text"))))


def ingest(spark: SparkSession, found: DataFrame, collection: store.Collection, manifest_path: str, force: bool = False, target: int = 900, overlap: int = 75, model=embedding.hashed_vector, parser=None) -> DataFrame:
    """One batch of files (as sources.files.files gives them) into the collection; returns (path, status, chunks_created, error) of every file.

    Unchanged files are skipped. A file that can't be read or has no chunk fails, says why, and keeps its old chunks. The chunks are
    published together, then the manifest, each whole; a job that dies between the two is run again and replaces the same chunks by the same.
    parser: of PDF files, see sources.files.layout_items; without one they fail.
    """
    listed = written(found.drop("content"))
    known = S.read_manifest(spark, manifest_path)
    todo = listed if force else written(manifest.changed_files(listed, known))
    about = written(S.described(todo.select("path", "file_hash", "file_size")))
    contents = found.select("path", "content").join(maybe_broadcast(todo.select("path")), "path", "left_semi")
    read = written(extracted(contents, parser))
    docs = about.join(read, "document_id", "left")
    chunks = written(embedding.embed(chunked(cleaned(docs.where("raw_text is not null")), target, overlap), "chunk_text", model))
    made = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("chunks_created"))
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    ok = F.col("chunks_created") > 0
    out = docs.join(made, "document_id", "left").select(
        "path", "document_id", "file_name", F.col("path").alias("file_path"), "file_hash", "file_size", "source_type", "raw_source_type", "course", "title", F.coalesce("chunks_created", F.lit(0)).alias("chunks_created"), when.alias("ingested_at"),
        F.when(ok, "success").otherwise("failed").alias("status"), F.when(~F.coalesce(ok, F.lit(False)), F.coalesce("error", F.lit("The text gives no chunk."))).alias("error"),
    )
    out = written(out)
    if not chunks.isEmpty():
        collection.replace(chunks.select(*collection.read().columns))
    if not out.isEmpty():
        S.write_manifest(manifest.upserted(known, out, ["ingested_at"]), manifest_path)
    skipped = listed.join(about.select("path"), "path", "left_anti").select("path", F.lit("skipped").alias("status"), F.lit(0).alias("chunks_created"), F.lit(None).cast("string").alias("error"))
    return out.select("path", "status", "chunks_created", "error").unionByName(skipped)
