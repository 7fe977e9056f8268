"""Section policies, scores, page ranges, citations and evaluation measures as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip

#: Fixed values.
PRACTICE_TERMS = ("exercise", "practice", "problem", "homework", "quiz", "conceptual", "applied", "question", "questions")
EXERCISE_NAMES = ("conceptual", "applied", "exercises", "exercise", "problems")
EXERCISE_PARTS = ("conceptual", "applied", "exercises", "exercise")
PIPELINES = ("dense", "dense_reranker", "hybrid", "hybrid_reranker")


def _any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def is_practice(query: Column) -> Column:
    """P12."""
    return F.coalesce(_any(F.lower(query), PRACTICE_TERMS), F.lit(False))


def section_name(c: Column) -> Column:
    """F11."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), rf"{WS}+", " ")


def is_exercise(section: Column) -> Column:
    """P13."""
    s = section_name(section)
    return s.isin(*EXERCISE_NAMES) | s.startswith("exercises") | s.endswith("exercises")


def section_penalty(section: Column, query: Column) -> Column:
    """F12."""
    s = F.lower(F.coalesce(section, F.lit("")))
    return F.when(is_practice(query), 1.0).when(_any(s, EXERCISE_PARTS), 0.25).when(s.contains("lab"), 0.85).otherwise(1.0)


def similarity(distance: Column) -> Column:
    """F10."""
    return 1 / (1 + distance)


def first_score(*texts: Column) -> Column:
    """the first that isn't NULL, as a number; NULL if it is none."""
    return F.coalesce(*texts).try_cast("double")


def page_range(start: Column, end: Column) -> Column:
    """both empty, equal, or a-b with a missing one spelled out."""
    a, b = start.cast("string"), end.cast("string")
    empty = lambda c: c.isNull() | (c == "")
    return F.when(empty(a) & empty(b), "unknown").when(a.eqNullSafe(b), a).otherwise(F.concat_ws("-", F.coalesce(a, F.lit("None")), F.coalesce(b, F.lit("None"))))


def search_page(start: Column, end: Column) -> Column:
    """F15."""
    a, b = F.nullif(start.cast("string"), F.lit("")), F.nullif(end.cast("string"), F.lit(""))
    return F.when(a.isNull() & b.isNull(), None).when(b.isNull() | (a == b), a).otherwise(page_range(start, end))


def keyword_score(text: Column, keywords: Column) -> Column:
    """F16: the share of keywords that are in the text without case; 0 without keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
    return F.when(F.size(keywords) > 0, hit / F.size(keywords)).otherwise(0.0)


def query_group(query_id: Column) -> Column:
    """F18."""
    return F.when(query_id.startswith("lexical_"), "lexical").otherwise("semantic")


def format_score(c: Column) -> Column:
    """F19."""
    return F.coalesce(F.format_string("%.2f", c), F.lit("N/A"))


def slug(c: Column) -> Column:
    """F20."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), r"^-+|-+\z", ""), F.lit(""))


def strip_sources(answer: Column) -> Column:
    """what a model adds as sources is cut off."""
    out = answer
    for mark in ("\nSources:", "\nSource:"):
        out = F.when(out.contains(mark), strip(F.substring_index(out, mark, 1))).otherwise(out)
    return out


def citation(name: Column, section: Column, start: Column, end: Column) -> Column:
    named = lambda c, other: F.coalesce(c, F.lit(other))
    return F.concat(F.lit("- "), named(name, "unknown file"), F.lit(", "), named(section, "unknown section"), F.lit(", pages "), page_range(start, end))
