"""What paths and metadata tell: ids, titles, courses, source types, weeks, and the extraction quality of a text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, canonical, strip

#: Aliases of source types at ingestion. Other names stay as they are.
INGEST_ALIASES = {
    "lecture_pdfs": "lecture_pdfs", "lecture_pdf": "lecture_pdfs", "lectures": "lecture_pdfs",
    "textbooks": "textbook_pdf", "textbook": "textbook_pdf", "textbook_pdfs": "textbook_pdf", "textbook_pdf": "textbook_pdf",
    "youtube": "youtube_transcript", "youtube_transcripts": "youtube_transcript", "transcripts": "youtube_transcript",
    "notes": "personal_notes", "personal_notes": "personal_notes", "markdown_notes": "personal_notes",
    "research_papers": "research_paper", "papers": "research_paper",
}
#: Names of source types at chunking. Other names are generic text.
CHUNK_ALIASES = {
    "lecture_pdfs": ("lecture_pdf", "lecture_pdfs", "lecture"),
    "youtube_transcript": ("youtube", "youtube_transcript", "yt_transcript"),
    "textbook_pdf": ("textbook", "textbook_pdf"),
    "personal_notes": ("notes", "personal_notes", "markdown_notes"),
    "research_paper": ("paper", "research_paper", "academic_paper"),
}


def _below_raw(path: Column, steps: int) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    at = F.array_position(parts, "raw").cast("int") + steps
    # the last part is the file
    return F.when((F.array_position(parts, "raw") > 0) & (at < F.size(parts)), F.try_element_at(parts, at))


def course(path: Column) -> Column:
    """Two below the folder raw."""
    return _below_raw(path, 2)


def raw_source(path: Column) -> Column:
    """The folder below raw."""
    return _below_raw(path, 1)


def ingest_source_type(c: Column) -> Column:
    """P4a."""
    key = F.lower(strip(c))
    table = F.create_map(*[F.lit(x) for pair in INGEST_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key, F.lit("generic_text"))


def chunk_source_type(c: Column) -> Column:
    """P4b."""
    key = strip(F.lower(c))
    out = F.lit("generic_text")
    for name, aliases in CHUNK_ALIASES.items():
        out = F.when(key.isin(*aliases), name).otherwise(out)
    return out


def posix(path: Column) -> Column:
    """F5."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def document_id(path: Column) -> Column:
    """F2."""
    return F.concat(F.lit("doc_"), F.left(F.sha2(path, 256), F.lit(12)))


def generic_chunk_id(doc: Column, text: Column, index: Column) -> Column:
    """F3."""
    return F.concat(F.lit("chunk_"), F.left(F.sha2(F.concat_ws("|", doc, text, index.cast("string")), 256), F.lit(12)))


def textbook_chunk_id(doc: Column, index: Column, text: Column) -> Column:
    """F4."""
    return F.concat(F.lit("chunk_"), F.left(F.sha1(F.concat_ws("_", doc, index.cast("string"), text)), F.lit(12)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title(path: Column) -> Column:
    """the file name without its last extension."""
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*\z", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)\z", 1))


def week(path: Column, given: Column | None = None) -> Column:
    """F8: the week given, else the first part of the path that names one."""
    parts = F.transform(F.split(path, "/"), lambda x: F.replace(F.lower(strip(x)), F.lit("-"), F.lit("_")))
    first = F.get(F.filter(parts, lambda x: x.rlike(r"^week_?[0-9]+\z")), F.lit(0))
    inferred = F.when(first.isNotNull(), F.format_string("week_%02d", F.regexp_extract(first, "[0-9]+", 0).cast("int")))
    return inferred if given is None else F.coalesce(F.nullif(given, F.lit("")), inferred)


def source_id(doc: Column, path: Column, name: Column, title_: Column) -> Column:
    """F9."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (doc, path, name, title_)], F.lit("unknown_source"))


#: Characters that are no sign of a bad extraction.
COMMON_SYMBOLS = r".,;:!?()\[\]{}+\-=*/%$#@&'\"“”‘’<>|\\"


def quality(c: Column) -> dict[str, Column]:
    """P5: the measures of an extracted text, whether it passes, and what is only warned of."""
    text = strip(c)
    n = F.length(text)
    share = lambda pattern: F.try_divide(F.length(F.regexp_replace(text, pattern, "")), n)
    rows = F.filter(F.transform(F.split(canonical(text), "\n", -1), strip), lambda x: x != "")
    letters, odd = share(r"[^\p{L}]"), share(rf"[\p{{L}}\p{{N}} \t\n\r\x0b\x0c{COMMON_SYMBOLS}]")
    spaces = share(r"[^ \t\n\r\x0b\x0c]")
    length = F.try_divide(F.length(F.array_join(rows, "")), F.size(rows))
    ok = (n >= 200) & (letters >= 0.45) & (odd <= 0.15) & (F.size(rows) >= 3)
    return {"chars": n, "letter_ratio": letters, "odd_ratio": odd, "lines": F.size(rows), "passed": F.coalesce(ok, F.lit(False)), "warn_space": F.coalesce(spaces > 0.55, F.lit(False)), "warn_short_lines": F.coalesce(length < 15, F.lit(False))}


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "F", "WS")]
