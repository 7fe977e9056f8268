"""python -m foliospark ingest|query|evaluate: the flows on the command line."""

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    """V16, V17."""
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="files into the collection")
    source = i.add_mutually_exclusive_group(required=True)
    source.add_argument("--file")
    source.add_argument("--dir")
    i.add_argument("--recursive", action="store_true")
    i.add_argument("--force", action="store_true", help="ingest unchanged files too")
    i.add_argument("--reset", action="store_true", help="empty the collection first")
    q = sub.add_parser("query", help="answer one query")
    q.add_argument("-q", "--query", required=True)
    q.add_argument("--top-k", type=int)
    q.add_argument("--dense", action="store_true")
    q.add_argument("--no-reranker", action="store_true")
    q.add_argument("--preview", action="store_true", help="show the results, not an answer")
    e = sub.add_parser("evaluate", help="score the pipelines")
    e.add_argument("--queries", required=True)
    e.add_argument("--pipelines")
    e.add_argument("--mode", choices=("retrieval", "full"), default="retrieval")
    e.add_argument("--group", choices=("semantic", "lexical"))
    e.add_argument("--limit", type=int)
    e.add_argument("--name")
    return p


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.store import Collection
    from .plans import evaluate, ingest, search
    from .plans.schema import EMBEDDED
    from .sources import config, files

    a = parser().parse_args(args)
    settings = config.load(a.config)
    spark = SparkSession.builder.appName("foliospark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    paths, r = settings["paths"], settings["retrieval"]
    collection = Collection(spark, str(paths.get("persist_dir", "data/processed/collection")), EMBEDDED)
    manifest = str(paths.get("manifest_path", "data/manifest"))
    if a.command == "ingest":
        if a.reset:
            collection.reset()
        found = files.files(spark, a.file or a.dir, a.recursive)
        out = ingest.ingest(spark, found, collection, manifest, a.force or a.reset, settings["chunking"]["target_size"], settings["chunking"]["overlap_size"])
        out.groupBy("status").agg(F.count("*").alias("files"), F.sum("chunks_created").alias("chunks")).show()
        out.where("error is not null").select("path", "error").orderBy("path").show(100, truncate=False)
        return 0
    chunks = collection.read().select("chunk_id", "chunk_text", "document_id", "metadata")
    if a.command == "query":
        asked = spark.createDataFrame([("q", a.query)], "query_id string, query string")
        k = a.top_k or r["top_k"]
        if a.preview:
            search.search(asked, chunks, top_k=k, candidates=r["candidate_k"], use_hybrid=not a.dense, use_reranker=not a.no_reranker, alpha=r["hybrid_alpha"]).select("rank", "source", "section", "page", "score", F.left("chunk_text", F.lit(r["preview_chars"])).alias("preview")).orderBy("rank").show(truncate=False)
        else:
            print(search.answer(asked, chunks, k, r["candidate_k"], r["hybrid_alpha"], not a.no_reranker).first().answer)
        return 0
    rows, summary, about = evaluate.run(files.eval_queries(spark, a.queries), chunks, a.pipelines, a.mode, a.group, a.limit, a.name)
    summary.orderBy("grp", "pipeline").show(50)
    target = paths.get("eval_results_dir")
    if target:
        files.write_json(evaluate.artifact(rows, about), f"{target}/{about['run_id']}_eval_run.json")
    return 0


if __name__ == "__main__":
    sys.exit(main())
