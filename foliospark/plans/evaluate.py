"""Evaluation runs: four pipelines over all queries, their summary, the saved run, and a test of two chunk sizes."""

import json
import subprocess
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import answers, chunking, evaluation, hybrid
from ..session import settled, stage_mark, written
from . import search

LABELS = {"dense": "Dense", "dense_reranker": "Dense + Reranker", "hybrid": "Hybrid", "hybrid_reranker": "Hybrid + Reranker"}


def pipeline_keys(value: str | None) -> list[str]:
    """Names from a list with commas, in the fixed order, without repeats; spaces, + and - are read as underscores."""
    if not value or not value.strip() or value.strip().lower() == "all":
        return list(S.PIPELINES)
    asked = {"_".join(x.lower().replace("+", " ").replace("-", " ").replace("_", " ").split()) for x in value.split(",") if x.strip()}
    asked = {"dense_reranker" if x == "dense_rerank" else "hybrid_reranker" if x == "hybrid_rerank" else x for x in asked}
    unknown = asked - set(S.PIPELINES)
    if unknown:
        raise ValueError(f"unknown pipelines: {sorted(unknown)}")
    return [p for p in S.PIPELINES if p in asked]


def run_id(now: datetime, name: str | None = None) -> str:
    """F21."""
    slug = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in (name or "").lower()).split())
    return now.strftime("%Y-%m-%d_%H%M%S") + (f"_{slug}" if slug else "")


def git_state(folder: str = ".") -> dict:
    """branch, commit and whether there are changes; 'unknown' and None where git can't tell."""

    def said(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=2)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    dirty = said("status", "--porcelain")
    return {"branch": said("rev-parse", "--abbrev-ref", "HEAD") or "unknown", "commit": said("rev-parse", "HEAD") or "unknown", "dirty": None if dirty is None else bool(dirty)}


def results(queries: DataFrame, chunks: DataFrame, pipelines: list[str], k: int = 3, candidates: int = 8, alpha: float = 0.6) -> DataFrame:
    """(query_id, pipeline, result_rank, chunk_id, chunk_text, metadata) of every query in every pipeline."""
    asked = queries.select(F.col("id").alias("query_id"), "query")
    out = None
    for p in pipelines:
        again = p.endswith("reranker")
        rows = search.retrieve(asked, chunks, chunks, candidates if again else k, alpha, p.startswith("hybrid"))
        rows = hybrid.rerank(rows, "query", F.col("chunk_text"), k) if again else hybrid.first(rows, k)
        part = rows.select("query_id", F.lit(p).alias("pipeline"), F.col("rank").alias("result_rank"), F.col("id").alias("chunk_id"), "chunk_text", "metadata")
        out = part if out is None else out.unionByName(part)
    return out


def records(found: DataFrame, queries: DataFrame, mode: str = "retrieval") -> DataFrame:
    """A row for each query and pipeline with scores, top chunk ids and top sources; in full mode also an answer and its score."""
    by = ["query_id", "pipeline"]
    q = queries.select(F.col("id").alias("query_id"), F.col("expected_keywords").alias("keywords"))
    scores = evaluation.query_scores(found.drop("chunk_text", "metadata"), found.select("chunk_id", "chunk_text").dropDuplicates(["chunk_id"]), q, by)
    m = F.col("metadata")
    top = F.sort_array(F.collect_list(F.struct("result_rank", "chunk_id", F.struct(m.document_id.alias("document_id"), m.file_name.alias("file_name"), m.course.alias("course"), m.section.alias("section"), m.page_start.alias("page_start"), m.page_end.alias("page_end")).alias("source"))))
    lists = found.groupBy(*by).agg(F.slice(top, 1, 3).alias("top")).select(*by, F.filter(F.transform("top", lambda x: x.chunk_id), lambda c: c.isNotNull()).alias("top_chunk_ids"), F.transform("top", lambda x: x.source).alias("top_sources"))
    out = scores.join(lists, by).withColumn("grp", S.query_group(F.col("query_id")))
    if mode != "full":
        return out.withColumns({"answer": F.lit(None).cast("string"), "generation_score": F.lit(None).cast("double")})
    lists_id = F.concat_ws("/", "query_id", "pipeline")
    said = answers.answers(queries.select(F.col("id").alias("query_id"), "query").crossJoin(found.select("pipeline").distinct()).select(lists_id.alias("list"), "query"), found.select(lists_id.alias("list"), F.col("result_rank").alias("rank"), "chunk_id", "chunk_text", "metadata"), "list", "query")
    return out.withColumn("list", lists_id).join(said, "list", "left").join(q, "query_id").withColumn("generation_score", S.keyword_score(F.col("answer"), F.col("keywords"))).drop("list", "keywords")


def run(queries: DataFrame, chunks: DataFrame, pipelines: str | None = None, mode: str = "retrieval", group: str | None = None, most: int | None = None, name: str | None = None, folder: str = ".") -> tuple[DataFrame, DataFrame, dict]:
    """Records, summary, and what is known of the run."""
    if mode not in ("retrieval", "full") or group not in (None, "semantic", "lexical"):
        raise ValueError("mode is retrieval or full, group is semantic or lexical")
    keys = pipeline_keys(pipelines)
    asked = queries.where(S.query_group(F.col("id")) == group) if group else queries
    asked = asked.orderBy("pos" if "pos" in asked.columns else "id").limit(most) if most else asked
    rows = records(results(asked, chunks, keys), asked, mode)
    about = {"run_id": run_id(datetime.now(), name), "schema": "1.1", "git": git_state(folder), "options": {"mode": mode, "group": group, "limit": most, "pipelines": [LABELS[k] for k in keys]}}
    return rows, evaluation.summary(rows), about


def artifact(rows: DataFrame, about: dict) -> DataFrame:
    """The records with the run's id and description, ready for write_json."""
    return rows.withColumns({"run_id": F.lit(about["run_id"]), "run": F.lit(json.dumps(about))})


def compare_chunkings(docs: DataFrame, queries: DataFrame, doc_col: str, text_col: str, configs: tuple = ((700, 50), (900, 75)), k: int = 3) -> DataFrame:
    """(config, chunks, retrieval, winner) of each (target, overlap), by the mean keyword coverage of hybrid retrieval.

    The documents are cut once, into a stored table with the chunks of all configs; what is stored on the way is deleted in the end.
    """
    since = stage_mark()
    made = written(chunking.chunk_generic_sizes(docs, doc_col, text_col, configs).select("at", "document_id", "chunk_id", "chunk_text", "section"))
    lacking = {c: F.lit(None).cast(t) for c, t in (("file_name", "string"), ("file_path", "string"), ("source_type", "string"), ("course", "string"), ("title", "string"), ("chapter", "string"), ("page_start", "int"), ("page_end", "int"))}
    asked = queries.select(F.col("id").alias("query_id"), F.col("expected_keywords").alias("keywords"))
    out = None
    for at, (target, overlap) in enumerate(configs):
        own = made.where(F.col("at") == at)
        # an id that occurs twice counts once in retrieval, so the texts need no shuffle
        chunks = own.withColumns(lacking).select("chunk_id", "chunk_text", "document_id", F.struct("document_id", "file_name", "file_path", "source_type", "course", "title", "chapter", "section", "page_start", "page_end").alias("metadata"))
        found = written(results(queries, chunks, ["hybrid"], k).drop("metadata"))
        scores = evaluation.query_scores(found.drop("chunk_text"), found.select("chunk_id", "chunk_text").dropDuplicates(["chunk_id"]), asked, ["query_id", "pipeline"])
        row = scores.agg(F.coalesce(F.round(F.avg("retrieval_score"), 6), F.lit(0.0)).alias("retrieval")).crossJoin(own.agg(F.count("*").alias("chunks"))).select(F.lit(f"{target}/{overlap}").alias("config"), F.lit(at).alias("at"), "chunks", "retrieval")
        out = row if out is None else out.unionByName(row)
    out = written(out)
    best = out.agg(F.max_by("config", F.struct("retrieval", -F.col("at"))).alias("best"))
    return settled(out.crossJoin(F.broadcast(best)).select("config", "chunks", "retrieval", (F.col("config") == F.col("best")).alias("winner")), since)
