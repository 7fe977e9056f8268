"""Files in and out: discovery, texts, chunk and query files, manifests, fingerprints, safe deletion."""

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import paths as P
from ..operators.store import Versions
from ..session import file_system

#: What is ingested.
EXTENSIONS = (".pdf", ".txt", ".md")
TEXT_EXTENSIONS = (".txt", ".md")

METADATA = t.StructType([t.StructField(n, k) for n, k in (("document_id", t.StringType()), ("file_name", t.StringType()), ("file_path", t.StringType()), ("source_type", t.StringType()), ("course", t.StringType()), ("title", t.StringType()), ("chapter", t.StringType()), ("section", t.StringType()), ("sections", t.ArrayType(t.StringType())), ("chunk_index", t.IntegerType()), ("total_chunks", t.IntegerType()), ("page_start", t.IntegerType()), ("page_end", t.IntegerType()), ("unit_count", t.IntegerType()), ("chunk_text_length", t.IntegerType()))])
CHUNK = t.StructType([t.StructField("chunk_id", t.StringType()), t.StructField("chunk_text", t.StringType()), t.StructField("metadata", METADATA)])
RECORD = t.StructType([t.StructField(n, t.StringType()) for n in ("path", "document_id", "file_name", "file_path", "file_hash")] + [t.StructField("file_size", t.LongType())] + [t.StructField(n, t.StringType()) for n in ("source_type", "raw_source_type", "course", "title")] + [t.StructField("chunks_created", t.IntegerType()), *[t.StructField(n, t.StringType()) for n in ("ingested_at", "status", "error")]])


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, file_hash, file_size, content) of supported files that aren't hidden."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return supported(read.load(path))


def supported(found: DataFrame) -> DataFrame:
    """The supported ones among files as Spark's binaryFile source gives them, by their path in POSIX form; an extension's case doesn't matter."""
    rows = found.select(P.posix(F.regexp_replace("path", "^file:/+", "/")).alias("path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), "content")
    return rows.where(~P.file_name(F.col("path")).startswith(".") & P.extension(F.col("path")).isin(*EXTENSIONS))


def described(found: DataFrame) -> DataFrame:
    """Files with what their path tells."""
    p = F.col("path")
    return found.withColumns({"document_id": P.document_id(p), "file_name": P.file_name(p), "title": P.title(p), "course": P.course(p), "raw_source_type": P.raw_source(p), "source_type": P.ingest_source_type(P.raw_source(p)), "file_type": P.extension(p)})


def texts(found: DataFrame) -> DataFrame:
    """(document_id, raw_text) of text files, read as UTF-8; NULL if they aren't."""
    rows = found.where(P.extension(F.col("path")).isin(*TEXT_EXTENSIONS))
    return rows.select(P.document_id(F.col("path")).alias("document_id"), F.try_validate_utf8(F.col("content").cast("string")).alias("raw_text"))


def layout_items(found: DataFrame, parser) -> DataFrame:
    """Layout items (document_id, item_pos, page_no, label, text) of PDF files. parser: a function of an iterator of Arrow batches
    (document_id, content), as mapInArrow takes; none is built in."""
    pdf = found.where(P.extension(F.col("path")) == ".pdf").select(P.document_id(F.col("path")).alias("document_id"), "content")
    return pdf.mapInArrow(parser, "document_id string, item_pos int, page_no int, label string, text string")


def pages_between(items: DataFrame, first: int, last: int) -> DataFrame:
    """The items of a page range, both ends included."""
    if first < 1 or first > last:
        raise ValueError("a page range starts at 1 or more and does not end before it starts")
    return items.where(F.col("page_no").between(first, last))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of all JSON files of a folder; files that are no JSON are skipped, chunk_file_warnings names them."""
    return spark.read.schema(CHUNK).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def chunk_file_warnings(spark: SparkSession, path: str) -> DataFrame:
    """(file, warning) of the files that chunk_files skips, and of those that hold no list of records."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.trim("value").alias("value"))
    kind = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    broken = F.try_parse_json("value").isNull()
    return text.withColumn("_kind", kind).where(broken | ~F.col("value").startswith("[")).select("file", F.when(broken, "not JSON").otherwise("no list of records").alias("warning"))


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, query, expected_keywords) of a file with a list of queries, or with one under 'queries'."""
    item = "struct<id:string,query:string,expected_keywords:array<string>>"
    text = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", f"struct<queries:array<{item}>>")["queries"], F.from_json("value", f"array<{item}>"))
    return text.select(F.posexplode(items).alias("pos", "q")).select("pos", "q.*")


def filtered_queries(queries: DataFrame, group: str | None = None, most: int | None = None) -> DataFrame:
    """Of a group, then the first ones in file order."""
    from ..functions.scoring import query_group

    rows = queries.where(query_group(F.col("id")) == group) if group else queries
    return rows.orderBy("pos").limit(most) if most else rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as last published, an empty one where there is none. One that can't be read is an error: taking it for empty would ingest everything again."""
    at = Versions(spark, path).latest()[1].get("folder")
    return spark.read.schema(RECORD).parquet(f"{path}/{at}") if at else spark.createDataFrame([], RECORD)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Publishes the rows as the whole manifest, all at once; the version before stays until the next one."""
    spark = rows.sparkSession
    versions = Versions(spark, path)
    number, about = versions.latest()
    at = uuid.uuid4().hex
    rows.select(*RECORD.names).write.parquet(f"{path}/{at}")
    versions.publish(number, {"folder": at, "before": about.get("folder")})
    if about.get("before"):
        fs, p = file_system(spark, f"{path}/{about['before']}")
        fs.delete(p, True)
    versions.forget()


def write_documents(df: DataFrame, path: str, by: str = "document_id", folders: int = 64) -> None:
    """K1-K4: rows as Parquet in folders by hash of their document; an empty table writes nothing."""
    if not df.isEmpty():
        df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(folders)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """K1, K13."""
    df.write.mode("overwrite").json(path)


def fingerprint(rows: DataFrame, buckets: int = 1024) -> DataFrame:
    """one row (files, fingerprint) over (path, file_hash, file_size); any change of any file changes it.

    Each file has a digest; the digests of a bucket, by hash of the path, are added up in four parts, and only the buckets' sums are put in order and digested.
    """
    line = F.concat_ws("|", "path", F.coalesce("file_hash", F.lit("")), F.col("file_size").cast("string"))
    digest = F.sha2(line, 256)
    part = lambda k: F.conv(F.substring(digest, 1 + 13 * k, 13), 16, 10).cast("decimal(38,0)")
    sums = rows.select(F.pmod(F.conv(F.left(digest, F.lit(4)), 16, 10).cast("int"), F.lit(buckets)).alias("bucket"), *[part(k).alias(f"p{k}") for k in range(4)])
    sums = sums.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)])
    each = F.concat_ws("|", "bucket", "n", "p0", "p1", "p2", "p3")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", each.alias("line")))), lambda x: x.line)
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sha2(F.array_join(ordered, "\n"), 256).alias("fingerprint"))


def safe_to_delete(path: str, project: str, raw: str) -> bool:
    """Not the root, the home folder, the project or a folder above it, what is in the project but not below its data folder, nor anything of the raw files."""
    if not str(path).strip():
        return False
    try:
        target, root, sources, home = (Path(p).expanduser().resolve() for p in (path, project, raw, Path.home()))
    except (OSError, RuntimeError):
        return False
    if target in (Path(target.anchor), home, root, sources) or target in root.parents or sources in target.parents:
        return False
    return root not in target.parents or root / "data" in target.parents


def reset(targets: list[str], project: str, raw: str) -> list[str]:
    """Deletes all targets, or none if one of them isn't safe to delete."""
    unsafe = [p for p in targets if not safe_to_delete(p, project, raw)]
    if unsafe:
        raise ValueError(f"not safe to delete: {unsafe}")
    gone = []
    for p in map(Path, targets):
        if p.is_dir():
            shutil.rmtree(p)
            gone.append(str(p))
        elif p.exists():
            p.unlink()
            gone.append(str(p))
    return gone
