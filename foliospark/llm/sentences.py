"""Sentence boundaries across languages and scripts, by a pushdown automaton.

The automaton reads the marks of a text in order. Its stack holds the quotations and brackets that are open; only marks read
with an empty stack can end a sentence, so quoted speech stays in the sentence that holds it. A full stop is judged by
what stands before it, read backwards through tries of abbreviations, and by what follows; a number that opens a list line
ends nothing. Line breaks are white space.

Defined cases: NULL and blank texts have no sentences; a text without any mark is one sentence; an opening mark that
is never closed is ignored; repeated rows of an id count once. Texts are taken whole; positions count code points.
"""

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import strip

#: Abbreviations that never end a sentence: titles, references, units of measure, and others that need a word after them.
BEFORE = "mr mrs ms dr prof st sr sra srta rev gen hon fig figs eq eqs sec secs ch vol no nos pp p approx vs cf e.g i.e viz al jan feb mar apr jun jul aug sep sept oct nov dec abb tab bzw nr ca vgl z.b d.h u.a s dipl ing núm pág aprox cap ej p.ej art chap m mme mlle éd env рис табл проф г гг в до н т.е т.к т.н им ул стор см р рр мал акад т.зв п د أ م डॉ श्री प्रो ดร ศ รศ ผศ"
#: Abbreviations that end one if a capital or an opening quotation follows.
MAYBE = "etc a.m p.m u.s u.k e.u inc ltd co jr usw etw т.д т.п и.т.д н.э др тощо і.т.д"
#: German words after an ordinal number.
ORDINAL_NEXT = regex.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Kapitel|Klasse|Mai)\b")

OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", '"': '"', "‹": "›"}
CLOSERS = set("”“»」』)）]\"›")
#: Closing marks right behind the mark that ends a sentence.
TRAILING = set("”»」』)）]›’")
MARKS = regex.compile(r"[.…]+|[!?؟]+|[。！？।॥]+|[“”„«»‹›「」『』()（）\[\]\"]|(?:ครับ|ค่ะ)(?![\p{L}\p{M}])")
SPACE = regex.compile(r"\s*")
UPPER_OR_OPEN = regex.compile(r"[\"“„«‹「『(（\[¡¿]*[\p{Lu}\p{Lt}]|[\"“„«‹「『¡¿]")
#: Words such as k-means or pH, which keep their small letter at the start of a sentence.
SYMBOL_WORD = regex.compile(r"\p{Ll}-\p{Ll}|\p{Ll}\p{Lu}")
#: A letter that is one part of an abbreviation of several, as in d. h.
SINGLE, SINGLE_NEXT = regex.compile(r"(?:^|[^\p{L}\p{N}\p{M}])\p{L}$"), regex.compile(r"\p{L}\.")
LIST_NUMBER = regex.compile(r"(?:^|\n)[ \t]*\d{1,3}$")


def _trie(words: str) -> dict:
    root: dict = {}
    for w in words.split():
        at = root
        for ch in reversed(w):
            at = at.setdefault(ch, {})
        at["end"] = True
    return root


NEVER_END, MAY_END = _trie(BEFORE), _trie(MAYBE)


def _before(text: str, dot: int, trie: dict) -> bool:
    """Whether an abbreviation of the trie ends at the full stop. Inner full stops may be followed by white space; case doesn't matter."""
    at, i = trie, dot - 1
    while True:
        if "end" in at and (i < 0 or not (text[i].isalnum() or text[i] == ".")):
            return True
        if i < 0:
            return False
        ch = text[i].lower()
        if ch in at:
            at = at[ch]
        elif ch.isspace() and "." in at:
            pass
        else:
            return False
        i -= 1


def _full_stop(text: str, start: int, end: int, first: int) -> bool:
    """Whether the run of full stops at start:end ends the sentence that began at first."""
    n = len(text)
    after = SPACE.match(text, end).end()
    if after >= n:
        return True
    spaced = after > end
    capital = UPPER_OR_OPEN.match(text, after) is not None
    if text[start] == "…" or end - start > 1:
        return spaced and capital
    prev = text[start - 1] if start else ""
    nxt = text[end]
    if not spaced:
        # 3.14, notes.v2.txt, U.S.; but tidal.The and 46.The
        if not capital or nxt in "([":
            return False
        word = regex.search(r"[\p{L}\p{N}.]+$", text[max(0, start - 30) : start])
        word = word.group() if word else ""
        return len(word) > 1 and (word[-1].islower() or word[-1].isdigit()) and "." not in word.rstrip("0123456789.") and not _before(text, start, NEVER_END)
    if prev.isdigit():
        if ORDINAL_NEXT.match(text, after):
            return False
        head = text[max(first, start - 4) : start]
        return not (head.isdigit() and first >= start - 4 and LIST_NUMBER.search(text[max(0, start - 8) : start]))
    if prev.isupper() and (start < 2 or not (text[start - 2].isalnum() or text[start - 2] == ".")):
        return False  # an initial
    if _before(text, start, NEVER_END) or SINGLE.search(text[max(0, start - 2) : start]) and SINGLE_NEXT.match(text, after):
        return False
    if _before(text, start, MAY_END):
        return capital or SYMBOL_WORD.match(text, after) is not None
    return True


def _closed(text: str) -> dict[int, int]:
    """Where each opening mark closes, in one pass. A closing mark takes the last open mark of its kind; what is open inside it is stray, as is what never closes."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # open marks by what closes them
    for m in MARKS.finditer(text):
        ch, at = m.group(), m.start()
        if waiting[ch]:
            while True:
                close, begin = stack.pop()
                waiting.subtract(close)
                if ch in close:
                    break
            out[begin] = at
        elif ch in OPENERS and (ch != '"' or at + 1 < len(text) and not text[at + 1].isspace()):
            stack.append((OPENERS[ch], at))
            waiting.update(OPENERS[ch])
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, without the white space around it."""
    out: list[tuple[int, int]] = []
    n = len(text)
    first = SPACE.match(text).end()
    closed = _closed(text)
    stack: list[int] = []  # where the open marks close
    inner = -1  # where the last mark read inside the stack ended
    until = 0

    def ends(at: int) -> None:
        nonlocal first
        if at > first:
            out.append((first, at))
            first = SPACE.match(text, at).end()

    for m in MARKS.finditer(text):
        at, end = m.span()
        if at < until:
            continue
        ch = m.group()
        if stack and at == stack[-1]:
            stack.pop()
            if stack:
                continue
            if inner >= 0 and not text[inner:at].strip():
                # speech that ended with a mark: the sentence goes on unless a capital follows
                after = SPACE.match(text, end).end()
                if after < n and after > end and UPPER_OR_OPEN.match(text, after):
                    ends(end)
            inner = -1
        elif at in closed:
            stack.append(closed[at])
        elif ch in OPENERS:
            continue
        elif ch in CLOSERS:
            continue
        elif stack:
            inner = end
        else:
            if ch[0] in ".…":
                # in scripts without spaces an ellipsis only interrupts
                if not _full_stop(text, at, end, first):
                    continue
            elif ch[0] in "!?؟":
                if end < n and text[end] in ",;:،，、":
                    continue
            while end < n and text[end] in TRAILING:
                end += 1
            until = end
            ends(end)
    if first < n:
        tail = len(text.rstrip())
        if tail > first:
            out.append((first, tail))
    return out


def _split(batches, texts_out: bool):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        cuts = [sentences(t) if t else [] for t in texts]
        row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        flat = [(i, k, a, b) for i, c in enumerate(cuts) for k, (a, b) in enumerate(c)]
        columns = [batch.column("id").take(pa.array(row)), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.int64()), pa.array([f[3] for f in flat], pa.int64())]
        names = ["id", "sentence_no", "start_pos", "end_pos"]
        if texts_out:
            columns.append(pa.array([texts[i][a:b] for i, _, a, b in flat], pa.string()))
            names.append("sentence")
        yield pa.RecordBatch.from_arrays(columns, names)


def split_sentences(df: DataFrame, id_col: str, text_col: str, texts: bool = True) -> DataFrame:
    """(id, sentence_no, start_pos, end_pos, sentence): the sentences of every text in order; positions in the text as stored."""
    kind = df.select(id_col).schema[0].dataType.simpleString()
    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (strip(F.col("text")) != ""))
    shape = f"id {kind}, sentence_no int, start_pos long, end_pos long" + ", sentence string" * texts
    return given.mapInArrow(partial(_split, texts_out=texts), shape).dropDuplicates(["id", "start_pos"])
