import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import dense, embedding, hybrid, lexical, store
from foliospark.operators import manifest as M

DATA = "/root/testdata/sf0.01"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "least squares regression squares"), ("b", "nearest neighbour"), ("c", "bias and variance regression"), ("d", None)], "id string, text string")
    asked = spark.createDataFrame([("q", "least squares Regression"), ("e", " ")], "qid string, q string")
    rows = lexical.topk(asked, docs, "qid", "q", "id", "text", 3).collect()
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in rows}
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    w = lambda tf, dl: tf / (tf + 1.5 * (0.25 + 0.75 * dl / (9 / 4)))
    assert got["q", 1] == ("a", round(idf(1) * w(1, 4) + idf(1) * w(2, 4) + idf(2) * w(1, 4), 6))
    assert got["q", 2][0] == "c" and got["q", 3] == ("b", 0.0)
    assert [got["e", k] for k in (1, 2, 3)] == [("a", 0.0), ("b", 0.0), ("c", 0.0)]


def test_dense_and_its_index(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))] + [(400, None), (401, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id % 20 = 0 and size(v) = 8")
    found = {(r.query_id, r["rank"]): r.id for r in dense.topk(q, df, "id", "v", "id", "v", 5).collect()}
    m = np.array([v for _, v in rows[:400]])
    for i in range(0, 400, 20):
        best = sorted(range(400), key=lambda j: (round(((m[i] - m[j]) ** 2).sum(), 6), j))[:5]
        assert [found[i, k] for k in range(1, 6)] == best
    assert dense.topk(q.where("false"), df, "id", "v", "id", "v", 5).count() == 0


def test_index_recall(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.id) for r in dense.topk(q, e, "vec_id", "embedding", "vec_id", "embedding", 8).collect()}
    near = {(r.query_id, r.id) for r in dense.CellIndex(e, "vec_id", "embedding").topk(q, "vec_id", "embedding", 8).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_filter_stays_above_the_ranking(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 2) for i in range(10)], "id long, v array<double>, label int")
    ranked = dense.topk(df.where("id = 0"), df, "id", "v", "id", "v", 4).join(df.select("id", "label"), "id")
    assert [r.id for r in dense.topk_per_course(ranked, F.col("label") == 1, 9).orderBy("rank").collect()] == [1, 3]


def test_normalisation(spark):
    df = spark.createDataFrame([("empty", None), ("same", 2.0), ("same", None), ("spread", 1.0), ("spread", 3.0), ("spread", None)], "g string, s double")
    rows = df.select("g", "s", hybrid.normalized(F.col("s"), ["g"]).alias("n")).collect()
    assert sorted((r.g, r.n) for r in rows) == [("empty", 0.0), ("same", 1.0), ("same", 1.0), ("spread", 0.0), ("spread", 0.0), ("spread", 1.0)]


def test_fusion_and_policies(spark):
    d = spark.createDataFrame([("q", "a", 1, 0.9, 1.0), ("q", "b", 2, 0.5, 0.0), ("q", None, 3, 0.1, 0.0)], "query_id string, id string, dense_rank int, dense_similarity double, dense_norm double")
    b = spark.createDataFrame([("q", "b", 1, 7.0, 1.0), ("q", "c", 2, 3.0, 0.0)], "query_id string, id string, bm25_rank int, bm25_score double, bm25_norm double")
    merged = hybrid.merge(d, b, ["query_id", "id"])
    about = spark.createDataFrame([("a", "Exercises"), ("b", "Overview"), ("c", None)], "id string, section string")
    rows = hybrid.fused(merged.join(about, "id").withColumn("query", F.lit("what is it")), "query", "section", 0.6)
    got = {r.id: (r.hybrid_score, r["rank"]) for r in rows.collect()}
    assert got == {"b": (0.4, 1), "a": (0.15, 2), "c": (0.0, 3)}
    kept = [(r.id, r["rank"]) for r in hybrid.exercise_filtered(rows, "query", "section").orderBy("rank").collect()]
    assert kept == [("b", 1), ("c", 3)]  # ranks keep gaps
    assert hybrid.exercise_filtered(rows.where("id = 'a'"), "query", "section").count() == 1  # falls back
    assert hybrid.exercise_filtered(rows.withColumn("query", F.lit("a quiz")), "query", "section").count() == 3


def test_rerank(spark):
    rows = spark.createDataFrame([("q", "least squares", "x", 1, 0.5, "nothing"), ("q", "least squares", "y", 2, None, "least squares here"), ("q", "least squares", "z", 3, 0.1, None)], "query_id string, query string, id string, rank int, similarity double, text string")
    got = [(r.id, r["rank"], r.dense_rank, r.rerank_score) for r in hybrid.rerank(rows, "query", F.col("text"), 2).orderBy("rank").collect()]
    assert got == [("y", 1, 2, 1.0), ("x", 2, 1, 0.0)]
    blank = hybrid.rerank(rows.withColumn("query", F.lit(" ")), "query", F.col("text"), 3).orderBy("rank").collect()
    assert [r.id for r in blank] == ["x", "y", "z"]


def test_embedding(spark):
    df = spark.createDataFrame([("a", "Some words some"), ("b", "of the"), ("c", " "), ("d", None)], "id string, t string")
    rows = {r.id: r.embedding for r in embedding.embed(df, "t").collect()}
    assert set(rows) == {"a", "b"} and rows["b"] is None and abs(sum(x * x for x in rows["a"]) - 1) < 1e-12
    valid = spark.createDataFrame([("a", "t", [1.0], None), ("b", "t", None, "x"), ("", "t", [1.0], "x"), ("c", "t", [], "x")], "id string, t string, v array<double>, course string")
    assert [tuple(r) for r in embedding.valid_vectors(valid, "id", "t", "v", ["course"]).select("id", "course").collect()] == [("a", "")]


def test_manifest(spark):
    m = spark.createDataFrame([("p1", "h1", "success", 1), ("p2", "h2", "failed", 1), ("p3", None, "success", 1)], "path string, file_hash string, status string, n int")
    f = spark.createDataFrame([("p1", "h1"), ("p1", "other"), ("p2", "h2"), ("p3", None), ("p4", "h4")], "path string, file_hash string")
    assert {(r.path, r.file_hash) for r in M.changed_files(f, m).collect()} == {("p1", "other"), ("p2", "h2"), ("p3", None), ("p4", "h4")}
    new = spark.createDataFrame([("p1", "x", "failed", 2), ("p2", "h2", "skipped", 2), ("p5", "h5", "success", 2)], "path string, file_hash string, status string, n int")
    assert {(r.path, r.status) for r in M.upserted(m, new, ["n"]).collect()} == {("p1", "failed"), ("p2", "failed"), ("p3", "success"), ("p5", "success")}


def test_changes_touch_their_buckets_and_appear_whole(spark, tmp_path):
    c = store.Collection(spark, f"file://{tmp_path}/c", "chunk_id string, document_id string, n int", buckets=8)
    row = lambda *r: spark.createDataFrame(r, c.schema)
    c.add(row(*[(f"c{i}", f"d{i}", 1) for i in range(20)]))
    number, before = c.versions.latest()
    c.replace(row(("new", "d3", 2)))
    after = c.versions.latest()[1]
    assert sum(before["folders"].get(b) != f for b, f in after["folders"].items()) == 1
    # a writer that died before its version file changes nothing; one that was overtaken gets an error
    c._write(row(("lost", "d3", 9)))
    assert c.count() == 20 and {r.n for r in c.read().where("document_id = 'd3'").collect()} == {2}
    with pytest.raises(RuntimeError):
        c.versions.publish(number, {"folders": {}})
    assert c.count() == 20


def test_index_reads_visited_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 20
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id in (0, 13, 38)")
    index = dense.CellIndex(df, "id", "v", cells=12)
    got = {(r.query_id, r.id) for r in index.topk(q, "id", "v", 5, visits=1).collect()}
    exact = {(r.query_id, r.id) for r in dense.topk(q, df, "id", "v", "id", "v", 5).collect()}
    assert len(got & exact) / len(exact) >= 0.9
    near = np.argsort(((np.array([rows[i][1] for i in (0, 13, 38)])[:, None] - index.centres[None]) ** 2).sum(axis=2), axis=1)[:, :1]
    assert index.rows(np.unique(near)).count() < 600
    assert dense.topk(q, df.unionAll(df), "id", "v", "id", "v", 5).select("query_id", "id").distinct().count() == 15


def test_collection(spark, tmp_path):
    c = store.Collection(spark, f"file://{tmp_path}/c", "chunk_id string, document_id string, n int")
    assert c.count() == 0
    row = lambda *r: spark.createDataFrame(r, c.schema)
    c.add(row(("a", "d1", 1), ("b", "d1", 1), ("c", "d2", 1)))
    c.add(row(("a", "d1", 9), ("d", "d3", 1)))
    assert {(r.chunk_id, r.n) for r in c.read().collect()} == {("a", 1), ("b", 1), ("c", 1), ("d", 1)}
    c.replace(row(("z", "d1", 2)))
    c.delete(row(("x", "d2", 0)))
    assert {r.chunk_id for r in c.read().collect()} == {"z", "d"}
    assert c.vacuum() > 0 and c.vacuum() == 0 and c.count() == 2
    c.reset()
    assert c.count() == 0
