"""Text cleaning, blocks, headings and sentences as column expressions. The tags name the operators of the survey.

White space is the ASCII kind plus what Python's splitlines takes as line ends; every function maps NULL to NULL unless said otherwise.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WS = r"[ \t\n\r\x0b\x0c]"
LIST_ITEM = r"^([-*] |[0-9]+\.([ \t]|\z))"
PUNCTUATION_ONLY = r"^[!-/:-@\[-`{-~]+\z"
IMAGE_LINE = r"(?i)^(<!--[ \t]*image[ \t]*-->|\[image\])\z"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def canonical(c: Column) -> Column:
    """Line ends as single newlines, none at the end."""
    return F.regexp_replace(F.regexp_replace(c, LINE_END, "\n"), r"\n\z", "")


def lines(c: Column) -> Column:
    return F.split(canonical(c), "\n", -1)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once, also where f uses it inside of lambdas."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def weird_capitals(c: Column) -> Column:
    """A small letter before a capital, or a word with a capital after its first character that isn't all capitals."""
    mixed = F.exists(F.split(c, rf"{WS}+"), lambda w: F.substring(w, 2, 1 << 20).rlike("[A-Z]") & w.rlike("[a-z]"))
    return c.rlike("[a-z][A-Z]") | mixed


def remove_html_comments(c: Column) -> Column:
    """Comments within a line."""
    return F.regexp_replace(c, r"<!--[^\n]*?-->", "")


def remove_image_lines(c: Column) -> Column:
    """T2."""
    kept = F.filter(lines(c), lambda x: ~strip(x).rlike(IMAGE_LINE))
    return F.regexp_replace(_joined(kept), r"\n{3,}", "\n\n")


def rstrip_lines(c: Column) -> Column:
    """T3."""
    return F.regexp_replace(canonical(c), r"[ \t]+(\n|\z)", "$1")


def normalize_whitespace(c: Column) -> Column:
    """T4."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\t", " "), " +", " "), r"\n{3,}", "\n\n"))


def space_markdown_headers(c: Column) -> Column:
    """T5: a space after the marks of a heading."""
    return F.regexp_replace(canonical(c), r"(^|\n)(#{1,6})([^\s#])", "$1$2 $3")


def rejoin_wrapped_lines(c: Column) -> Column:
    """A line goes on with the next one unless either is blank or a list item, or it ends a sentence or opens a list.

    Each line only needs the one before it, so this is a map over the lines and no fold.
    """

    def alone(x: Column) -> Column:
        return (x == "") | x.rlike(LIST_ITEM)

    def joined(clean: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            prev = F.get(clean, i - 1)
            mark = F.when(i == 0, "").when(alone(x) | alone(prev) | prev.rlike(r"[.:?!]\z"), "\n").otherwise(" ")
            return F.concat(mark, x)

        return F.array_join(F.transform(clean, one), "")

    return F.when(c.isNotNull(), let(F.transform(lines(c), strip), joined))


def drop_noise_lines(c: Column) -> Column:
    """Lines of punctuation only, with comments left, or of one long camel-case token; blank lines become empty."""

    def noise(s: Column) -> Column:
        return s.rlike(PUNCTUATION_ONLY) | s.contains("<!--") | (~s.contains(" ") & (F.length(s) > 15) & weird_capitals(s))

    kept = F.filter(lines(c), lambda x: ~let(strip(x), noise))
    return _joined(F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x)))


def clean(c: Column) -> Column:
    """All steps in order; NULL becomes the empty text."""
    out = F.coalesce(c, F.lit(""))
    for step in (remove_html_comments, remove_image_lines, rstrip_lines, normalize_whitespace, space_markdown_headers, rejoin_wrapped_lines, drop_noise_lines):
        out = step(out)
    return out


def blocks(c: Column) -> Column:
    """The parts between blank lines, stripped, without empty ones. Their ends are stripped anyway, so only blanks before a line end go before."""
    parts = F.split(F.regexp_replace(F.regexp_replace(c, LINE_END, "\n"), r"[ \t]+\n", "\n"), r"\n[ \t\n]*\n", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def page_blocks(c: Column) -> Column:
    """Blocks of a page with their white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t]*\n[ \t]*", "\n")
    parts = F.transform(F.split(text, r"\n\n+", -1), lambda x: strip(F.regexp_replace(x, rf"{WS}+", " ")))
    return F.filter(parts, lambda x: x != "")


def is_heading(block: Column) -> Column:
    """The first rule that applies decides; long blocks without a mark in front, most of all, need no other."""
    return let(strip(block), _is_heading)


def _is_heading(s: Column) -> Column:
    single = ~s.rlike(WS)
    return (
        F.when((F.length(s) > 75) & ~s.startswith("#"), False)
        .when((s == "") | s.contains("<!--"), False)
        .when(single & (weird_capitals(s) | (F.length(s) > 15)), False)
        .when(s.rlike(r"^#{1,6}[ \t\n]"), True)
        .when(s.rlike(r"^([0-9]+[.)]|[-*])[ \t\n]") | (F.length(s) > 75) | s.rlike(r"[.?!;:]\z"), False)
        .otherwise(True)
    )


def normalize_heading(block: Column) -> Column:
    """Without heading marks anywhere."""
    return F.regexp_replace(strip(F.regexp_replace(block, r"#{1,6}[ \t\n\r\x0b\x0c]", "")), " +", " ")


def is_textbook_heading(block: Column) -> Column:
    """P16."""
    s = strip(F.regexp_replace(block, rf"{WS}+", " "))
    marked = s.rlike(r"^#{1,6} +[^ ]") | s.rlike(r"(?i)^(chapter|ch\.) +[0-9]+( +.+)?\z") | s.rlike(r"^[0-9]+(\.[0-9]+)*\.? +[A-Z][A-Za-z0-9,()\-:;? ]+\z")
    return (F.length(s) <= 140) & (s != "") & marked


def normalize_textbook_heading(block: Column) -> Column:
    """T22."""
    return strip(F.regexp_replace(F.regexp_replace(strip(block), rf"^#{{1,6}}{WS}+", ""), rf"{WS}+", " "))


def is_chapter(heading: Column) -> Column:
    """P17."""
    return heading.rlike(r"(?i)^(chapter|ch\.)[ \t]+[0-9]+")


def sentences(c: Column) -> Column:
    """Cut after . ! ? where white space and an ASCII capital follow."""
    parts = F.split(c, rf"(?<=[.!?]){WS}+(?=[A-Z])", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


#: Abbreviations that a name, a number or a reference follows, so that no sentence ends with them.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St Rev Gen Hon Fig Figs Eq Eqs Sec Secs Ch Vol No Nos pp cf vs viz approx al e.g i.e Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()


def book_sentences(c: Column) -> Column:
    """Of a text in one line, cut after . ! ? and closing marks where a capital follows, maybe behind opening marks; not after an abbreviation or an initial."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    end = rf"(?<=[.!?][\"')\]”’»]{{0,3}})(?<!(?<![\p{{L}}\p{{N}}])(?:{short}|\p{{Lu}})\.) (?=[\"'(\[“‘«]{{0,2}}\p{{Lu}})"
    flat = strip(F.regexp_replace(c, rf"{WS}+", " "))
    return F.filter(F.transform(F.split(flat, end, -1), strip), lambda x: x != "")


def char_overlap(c: Column, n: int) -> Column:
    """The last n characters from their first space on; the whole text if n is 0 or reaches over it."""
    if n <= 0:
        return c
    tail = F.right(c, F.lit(n))
    at = F.instr(tail, " ")
    return F.when(F.length(c) <= n, c).when(at > 0, strip(F.substring(tail, at, F.lit(n)))).otherwise(tail)


def preview(c: Column, n: int) -> Column:
    """F23."""
    return F.left(c, F.lit(n))
