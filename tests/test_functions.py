import pytest
from pyspark.sql import functions as F

from foliospark.functions import paths as P
from foliospark.functions import scoring as S


@pytest.mark.parametrize("path, course, source", [("workspace/raw/lectures/ANLP/n.pdf", "ANLP", "lectures"), ("workspace/raw/lectures/n.pdf", None, "lectures"), ("workspace/other/n.pdf", None, None), ("raw/n.pdf", None, None), ("", None, None), (None, None, None)])
def test_paths(one, path, course, source):
    assert (one(P.course, path), one(P.raw_source, path)) == (course, source)


@pytest.mark.parametrize("path, week", [("x/WEEK-3/a.md", "week_03"), ("x/ week11 /b.md", "week_11"), ("week_123/x", "week_123"), ("weekly/x", None), (None, None)])
def test_week(one, path, week):
    assert one(P.week, path) == week


def test_source_types_differ(one):
    assert [one(P.ingest_source_type, x) for x in (" Lectures ", "papers", "odd", None)] == ["lecture_pdfs", "research_paper", "odd", "generic_text"]
    assert [one(P.chunk_source_type, x) for x in ("lecture", "papers", "TEXTBOOK", None, "")] == ["lecture_pdfs", "generic_text", "textbook_pdf", "generic_text", "generic_text"]


def test_ids(one):
    assert one(P.document_id, "a/b.md") == "doc_" + __import__("hashlib").sha256(b"a/b.md").hexdigest()[:12]
    assert one(lambda a, b: P.generic_chunk_id(a, b, F.lit(3)), "d", "t") == "chunk_" + __import__("hashlib").sha256(b"d|t|3").hexdigest()[:12]
    assert one(lambda a, b: P.textbook_chunk_id(a, F.lit(3), b), "d", "t") == "chunk_" + __import__("hashlib").sha1(b"d_3_t").hexdigest()[:12]


def test_quality(one):
    passed = lambda t: one(lambda c: P.quality(c)["passed"], t)
    good = "\n".join(["A line of plain words that goes on for a while and says a few things about nothing at all."] * 3)
    assert passed(good) and not passed(good[:150]) and not passed("") and not passed(None)
    assert not passed("123 456 7890\n" * 30) and not passed(good.replace("\n", " "))
    assert one(lambda c: P.quality(c)["warn_short_lines"], "short a\n" * 40)


@pytest.mark.parametrize("a, b, generator, service", [(None, None, "unknown", None), ("", "", "unknown", None), ("3", "3", "3", "3"), ("3", "5", "3-5", "3-5"), ("3", None, "3-None", "3"), (None, "4", "None-4", "None-4")])
def test_pages(one, a, b, generator, service):
    assert (one(S.page_range, a, b), one(S.search_page, a, b)) == (generator, service)


def test_sections(one):
    assert [one(S.is_exercise, x) for x in ("Exercises", "Chapter 2 Exercises", " conceptual ", "Regression Problems", None)] == [True, True, True, False, False]
    penalty = lambda s, q: one(S.section_penalty, s, q)
    assert [penalty("Applied", "what is x"), penalty("Lab: setup", "what is x"), penalty("Label", None), penalty("Applied", "practice x"), penalty(None, "x")] == [0.25, 0.85, 0.85, 1.0, 1.0]


def test_scores(one):
    assert one(S.first_score, None, "0.5", "0.7") == 0.5 and one(S.first_score, "n/a", "0.7") is None
    assert one(lambda t: S.keyword_score(t, F.array(F.lit("AB"), F.lit("zz"))), "xaby") == 0.5
    assert one(lambda t: S.keyword_score(t, F.array().cast("array<string>")), None) == 0.0
    assert [one(S.query_group, x) for x in ("lexical_01", "q1")] == ["lexical", "semantic"]
    assert [one(S.slug, x) for x in (" My Run #1! ", "!!", None)] == ["my-run-1", None, None]
    assert one(S.strip_sources, "Answer \nSources:\n- a") == "Answer" and one(S.strip_sources, "kept ") == "kept "


def test_slugs_of_all_titles(spark, tmp_path):
    from foliospark.plans import registry

    titles = ["Ünïcode Café 12 and more", "Введение в ML", "机器学习", "İx", "Plain Title", "Plain Title", " !! ", None]
    spark.createDataFrame([(t,) for t in titles], "title string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.title: (r.slug, r.preview) for r in registry.QUERIES["slug"](spark, str(tmp_path)).collect()}
    assert got == {titles[0]: ("n-code-caf-12-and-more", "Ünïcode Café"), titles[1]: ("ml", "Введение в M"), titles[2]: (None, titles[2]), "İx": ("i-x", "İx"), "Plain Title": ("plain-title", "Plain Title"), " !! ": (None, " !! "), None: (None, None)}
