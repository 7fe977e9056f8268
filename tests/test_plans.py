import json

import pytest

from foliospark.operators import answers, evaluation, listing, store
from foliospark.plans import ingest, registry, search
from foliospark.sources import config, files
from foliospark.streaming import ingest as stream

SMALL = "/root/testdata/sf0.001"
COLUMNS = "chunk_id string, chunk_text string, document_id string, metadata struct<document_id:string,file_name:string,file_path:string,source_type:string,course:string,title:string,chapter:string,section:string,sections:array<string>,chunk_index:int,total_chunks:int,page_start:int,page_end:int,unit_count:int,chunk_text_length:int>, embedding array<double>, embedding_model string"


def folder(tmp_path):
    for path, text in {"raw/notes/ANLP/week_1/a.md": "# Least squares\n\nLeast squares fits a line. It is old.", "raw/textbooks/STAT/b.txt": "## Chapter 1 Bias\n\nBias and variance. They trade off.", "raw/notes/empty.md": "  ", "raw/.hidden.md": "x", "raw/notes/x.png": "x"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "raw")


def test_ingest_twice_then_changed(spark, tmp_path):
    raw = folder(tmp_path)
    c, manifest = store.Collection(spark, f"file://{tmp_path}/c", COLUMNS), f"file://{tmp_path}/manifest"
    out = {r.path.rsplit("/", 1)[1]: (r.status, r.chunks_created) for r in ingest.ingest(spark, files.files(spark, raw), c, manifest).collect()}
    assert out == {"a.md": ("success", 1), "b.txt": ("success", 1), "empty.md": ("failed", 0)}
    rows = {r.metadata.file_name: r.metadata for r in c.read().collect()}
    assert rows["a.md"].course == "ANLP" and rows["b.txt"].source_type == "textbook_pdf" and rows["a.md"].section == "Least squares"
    again = {r.path.rsplit("/", 1)[1]: r.status for r in ingest.ingest(spark, files.files(spark, raw), c, manifest).collect()}
    assert again == {"a.md": "skipped", "b.txt": "skipped", "empty.md": "failed"} and c.count() == 2
    (tmp_path / "raw/notes/ANLP/week_1/a.md").write_text("# New\n\nOther text now.")
    ingest.ingest(spark, files.files(spark, raw), c, manifest).collect()
    assert {r.chunk_text for r in c.read().where("document_id is not null").collect()} == {"# New\n\nOther text now.", "Bias and variance. They trade off."}


def test_every_file_has_an_outcome(spark, tmp_path):
    import pyarrow as pa

    raw = tmp_path / "raw/textbooks/STAT"
    raw.mkdir(parents=True)
    for name, body in (("a.pdf", b"good"), ("B.PDF", b"bad"), ("n.md", b"Some words here."), ("z.txt", b"\xff\xfe")):
        (raw / name).write_bytes(body)
    take = lambda rows: {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in rows.collect()}
    found = lambda: files.files(spark, str(tmp_path / "raw"))
    c, m = store.Collection(spark, f"file://{tmp_path}/c", COLUMNS), f"file://{tmp_path}/m"
    none = "No parser for PDF files is given."
    assert take(ingest.ingest(spark, found(), c, m)) == {"a.pdf": ("failed", none), "B.PDF": ("failed", none), "n.md": ("success", None), "z.txt": ("failed", "The file is no UTF-8 text.")}

    def parser(batches):
        for b in batches:
            rows = [(i, k, 3 + k, "text", "A long enough sentence about the bias and the variance of models. " * 4) for i, body in zip(b["document_id"].to_pylist(), b["content"].to_pylist()) if body == b"good" for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["document_id", "item_pos", "page_no", "label", "text"])

    assert take(ingest.ingest(spark, found(), c, m, parser=parser)) == {"a.pdf": ("success", None), "B.PDF": ("failed", "No text was extracted."), "n.md": ("skipped", None), "z.txt": ("failed", "The file is no UTF-8 text.")}
    pages = {(r.metadata.page_start, r.metadata.source_type) for r in c.read().where("metadata.file_name = 'a.pdf'").collect()}
    assert min(p for p, _ in pages) == 3 and {t for _, t in pages} == {"textbook_pdf"}
    assert {r.error for r in files.read_manifest(spark, m).where("status = 'failed'").collect()} == {"No text was extracted.", "The file is no UTF-8 text."}


def test_a_job_that_dies_is_run_again(spark, tmp_path, monkeypatch):
    raw = folder(tmp_path)
    c, m = store.Collection(spark, f"file://{tmp_path}/c", COLUMNS), f"file://{tmp_path}/m"

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(files, "write_manifest", dies)
        with pytest.raises(OSError):
            ingest.ingest(spark, files.files(spark, raw), c, m)
    assert c.count() == 2 and files.read_manifest(spark, m).count() == 0
    out = {r.status for r in ingest.ingest(spark, files.files(spark, raw), c, m).collect()}
    assert out == {"success", "failed"} and c.count() == 2


def test_stream(spark, tmp_path):
    raw = folder(tmp_path)
    c = store.Collection(spark, f"file://{tmp_path}/c", COLUMNS)
    for _ in range(2):
        q = stream.start(spark, raw, c, f"file://{tmp_path}/m", f"file://{tmp_path}/cp")
        q.awaitTermination(120)
    assert c.count() == 2


def test_search_and_answer(spark):
    chunks = registry._chunks(spark, SMALL)
    q = spark.createDataFrame([("q1", "drop the variance of the kernel"), ("q2", " ")], "query_id string, query string")
    rows = search.search(q, chunks, top_k=3).collect()
    assert {r.query_id for r in rows} == {"q1"} and sorted(r["rank"] for r in rows) == [1, 2, 3]
    course = rows[0].course
    only = search.search(q, chunks, course=course.lower(), top_k=3, use_reranker=False).collect()
    assert {r.course for r in only} == {course}
    assert search.search(q, chunks, course="none such").count() == 0
    assert search.clamped(99, True) == (50, 250) and search.clamped(0, False) == (1, 1)
    text = search.answer(q, chunks).collect()
    assert [r.query_id for r in text] == ["q1"] and "\n\nSources:\n- " in text[0].answer
    assert search.health(chunks)["status"] == "ok"


def test_answers_without_context(spark):
    q = spark.createDataFrame([("q", "x")], "query_id string, query string")
    none = spark.createDataFrame([], "query_id string, rank int, chunk_id string, chunk_text string, metadata struct<file_name:string,section:string,page_start:int,page_end:int>")
    assert answers.answers(q, none, "query_id", "query").first().answer == answers.NO_CONTEXT


def test_a_chat_model_gets_the_prompt(spark):
    from pyspark.sql import functions as F

    q = spark.createDataFrame([("q", "What is it?"), ("b", " ")], "query_id string, query string")
    rows = spark.createDataFrame([("q", k, f"c{k}", f"text {k}", ("f.pdf", "S", 1, 1, "T", "C", "x", "1")) for k in (1, 2)], "query_id string, rank int, chunk_id string, chunk_text string, metadata struct<file_name:string,section:string,page_start:int,page_end:int,title:string,course:string,source_type:string,chapter:string>")
    said = answers.answers(q, rows, "query_id", "query", lambda system, user: F.concat(F.left(system, F.lit(17)), F.lit("/"), user), prompt=True).collect()
    assert len(said) == 1 and said[0].answer.startswith("You help students/Context:\n[Context Block 1]") and "text 2" in said[0].answer and "Question:\nWhat is it?" in said[0].answer and said[0].answer.endswith("- f.pdf, S, pages 1")


def test_citations_are_distinct(spark):
    rows = spark.createDataFrame([("q", k, f"c{k}", "t", ("f.pdf", "S", 1, 1) if k != 3 else (None, None, None, None)) for k in (1, 2, 3, 4)], "query_id string, rank int, chunk_id string, chunk_text string, metadata struct<file_name:string,section:string,page_start:int,page_end:int>")
    assert answers.citations(rows, "query_id").first().sources == "- f.pdf, S, pages 1\n- unknown file, unknown section, pages unknown"


def test_listing_filters(spark):
    chunks = registry._chunks(spark, SMALL)
    all_ = listing.documents(chunks).count()
    course = listing.documents(chunks).where("course is not null").first().course
    assert 0 < listing.documents(chunks, course=course.lower()).count() < all_
    assert listing.documents(chunks, week="week_99").count() == 0


def test_summary_has_all_groups(spark):
    s = spark.createDataFrame([("lexical_1", "dense", 0.5), ("lexical_1", "hybrid", 0.75)], "query_id string, pipeline string, retrieval_score double")
    rows = {(r.grp, r.pipeline): r for r in evaluation.summary(s).collect()}
    assert len(rows) == 12 and rows["semantic", "dense"]["mean"] is None and rows["all", "hybrid"].delta == 0.25 and rows["lexical", "dense"].delta is None


def test_files(spark, tmp_path):
    item = {"id": "lexical_1", "query": "q", "expected_keywords": ["a"]}
    for name, body in (("list.json", [item, {"id": "s2"}]), ("object.json", {"queries": [item, {"id": "s2"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        rows = files.eval_queries(spark, str(tmp_path / name))
        assert [(r.pos, r.id) for r in rows.orderBy("pos").collect()] == [(0, "lexical_1"), (1, "s2")]
        assert files.filtered_queries(rows, "semantic", 5).count() == 1
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks/a.json").write_text(json.dumps([{"chunk_id": "c", "chunk_text": "t", "metadata": {"course": "X"}}], indent=1))
    (tmp_path / "chunks/bad.json").write_text("{not json")
    assert [r.metadata.course for r in files.chunk_files(spark, str(tmp_path / "chunks")).where("chunk_id is not null").collect()] == ["X"]
    (tmp_path / "chunks/one.json").write_text(json.dumps({"chunk_id": "d"}))
    assert {tuple(r) for r in files.chunk_file_warnings(spark, str(tmp_path / "chunks")).collect()} == {("bad.json", "not JSON"), ("one.json", "no list of records")}
    assert files.read_manifest(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        files.pages_between(rows, 3, 2)


def test_fingerprint_changes(spark):
    rows = [("a", "h", 1), ("b", None, 2)]
    of = lambda r: files.fingerprint(spark.createDataFrame(r, "path string, file_hash string, file_size long")).first().fingerprint
    assert of(rows) == of(rows[::-1]) != of([("a", "h2", 1), rows[1]])


def test_deletion_is_safe(tmp_path):
    root = tmp_path / "project"
    raw = root / "data/raw"
    raw.mkdir(parents=True)
    inside = root / "data/out"
    inside.mkdir()
    ok = lambda p: files.safe_to_delete(str(p), str(root), str(raw))
    assert ok(inside) and ok(tmp_path / "elsewhere")
    assert not any(map(ok, ("/", "~", "", root, root.parent, root / "src", root / "data", raw, raw / "x")))
    with pytest.raises(ValueError):
        files.reset([str(inside), str(raw)], str(root), str(raw))
    assert inside.exists() and files.reset([str(inside)], str(root), str(raw)) == [str(inside)]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("paths:\n  chunk_dir: data/x\nretrieval:\n  top_k: 9\n")
    c = config.load(str(tmp_path / "c.yaml"), str(tmp_path), {"RAG_CHUNK_DIR": "y", "RAG_RERANKER_MODEL": "m"})
    assert c["paths"]["chunk_dir"] == tmp_path / "y" and c["retrieval"]["top_k"] == 9 and c["retrieval"]["bm25_k"] == 8 and c["models"]["reranker"] == "m"
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none"))
    (tmp_path / "bad.yaml").write_text("- a")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.yaml"))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_saved_index(spark, tmp_path):
    from foliospark.operators import lexical
    from foliospark.operators.lexical_index import LexicalIndex

    docs = spark.createDataFrame([("a", "steady rivers carve"), ("b", "quiet harbour"), ("c", None)], "id string, t string")
    q = spark.createDataFrame([("q", "rivers carve")], "query_id string, query string")
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    assert index.search(q, "query_id", "query", 2).count() == 0 and index.ensure(docs.where("false"), "id", "t", "f") == "empty"
    assert [index.ensure(docs, "id", "t", f) for f in ("f", "f", "g")] == ["built", "kept", "built"]
    key = lambda df: sorted((r.id, r.score, r["rank"]) for r in df.collect())
    assert key(index.search(q, "query_id", "query", 3)) == key(lexical.topk(q, docs, "query_id", "query", "id", "t", 3))
    for f in next((tmp_path / "i").glob("*/stats")).iterdir():
        f.unlink()
    assert index.ensure(docs, "id", "t", "g") == "built"


def test_evaluation_run(spark):
    from datetime import datetime

    from foliospark.plans import evaluate

    assert evaluate.pipeline_keys("hybrid, Dense+Reranker,hybrid") == ["dense_reranker", "hybrid"] and len(evaluate.pipeline_keys(None)) == 4
    with pytest.raises(ValueError):
        evaluate.pipeline_keys("sparse")
    assert evaluate.run_id(datetime(2024, 1, 2, 3, 4, 5), " My Run! ") == "2024-01-02_030405_my-run"
    assert evaluate.git_state("/")["branch"] == "unknown" and set(evaluate.git_state()) == {"branch", "commit", "dirty"}
    q = spark.read.parquet(f"{SMALL}/queries.parquet").limit(4)
    rows, summary, about = evaluate.run(q, registry._chunks(spark, SMALL), "dense,hybrid", "full", None, 2)
    got = evaluate.artifact(rows, about).collect()
    assert len(got) == 4 and all(r.answer and 0 <= r.generation_score <= 1 and len(r.top_chunk_ids) == 3 for r in got)
    assert summary.count() == 12


def test_service_and_command_line(spark, tmp_path):
    from foliospark.__main__ import parser
    from foliospark.plans.service import Service
    from foliospark.sources.log import logger

    s = Service(spark, lambda: registry._chunks(spark, SMALL))
    assert s.health_check()["status"] == "ok" and s.collection_stats()["rows"][0]["chunk_count"] > 0
    assert s.search_notes(" ")["warnings"] and len(s.search_notes("the kernel variance", top_k=2)["rows"]) == 2
    assert s.list_indexed_documents(course="none")["rows"] == []
    broken = Service(spark, lambda: 1 / 0)
    assert broken.health_check()["status"] == "error" and broken.collection_stats()["warnings"]
    assert parser().parse_args(["query", "-q", "x"]).query == "x"
    with pytest.raises(SystemExit):
        parser().parse_args(["ingest"])
    log = logger("foliospark.test", str(tmp_path / "x/a.log"))
    assert logger("foliospark.test") is log and len(log.handlers) == 2


def test_two_chunkings_cut_the_documents_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from foliospark.operators import chunking
    from foliospark.plans import evaluate

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs = docs.unionAll(spark.createDataFrame([("blank", " \n\n\t"), ("none", None), ("## head", "## Only a heading"), ("twice", "Twice given. " * 90), ("twice", "Twice given. " * 90)], "doc_id string, text string"))
    q = spark.read.parquet(f"{SMALL}/queries.parquet")
    sizes = ((700, 50), (900, 75))
    got = evaluate.compare_chunkings(docs.select("doc_id", counted("text").alias("text")), q, "doc_id", "text", sizes).collect()
    assert read.value == docs.count()
    scores = []
    for r, (target, overlap) in zip(got, sizes):
        made = chunking.chunk_generic(docs, "doc_id", "text", target, overlap)
        lacking = [F.lit(None).cast("string").alias(c) for c in ("file_name", "course", "page_start", "page_end")]
        chunks = made.dropDuplicates(["chunk_id"]).select("chunk_id", "chunk_text", F.struct("document_id", "section", *lacking).alias("metadata"))
        rows = evaluate.records(evaluate.results(q, chunks, ["hybrid"]), q)
        scores.append(rows.agg(F.round(F.avg("retrieval_score"), 6)).first()[0])
        assert (r.config, r.chunks, r.retrieval) == (f"{target}/{overlap}", made.count(), scores[-1])
    assert [r.winner for r in got] == [scores[0] >= scores[1], scores[1] > scores[0]]
