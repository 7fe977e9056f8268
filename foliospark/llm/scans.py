"""Repairing text from scanned pages: broken words, misread characters, running headers, page numbers, line breaks.

The collection's own words are the vocabulary, all that occur twice. A Levenshtein automaton whose edits are what scanners confuse
(for words with odd characters any other edit as well) is intersected with the vocabulary's trie, which finds every
candidate in reach; a candidate has to be far more common than the word itself. The trie is cut by length and end letters into
shards, one task each, and a word is sent to every shard that its edits can reach. Of several candidates the one that most often
follows the word before it is taken, then the cheapest and the most common. Page furniture is removed and lines are joined first.

A running header is a line that prints a place in the document (a numbered part, a title with its course), or that stands beside the
number of its own page on several pages of a document; it is then one without the number too.

Defined cases: NULL and blank texts have no noise and are returned as they are; a chunk without page_start has no page number
of its own to find; a missing page_end is page_start; repeated rows of an id count once. Texts are taken whole.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, maybe_broadcast, written

#: Words of the vocabulary in a shard; a larger one is split by hash.
SHARD = 200_000
#: How much more common than a word of plain letters its correction has to be.
RATIO = 10
#: What is read, and what it may stand for.
CONFUSED = [("1", "l"), ("1", "i"), ("0", "o"), ("|", "l"), ("|", "i"), ("@", "a"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("c", "e"), ("b", "h"), ("m", "rn"), ("d", "cl"), ("li", "h"), ("h", "li"), ("tl", "d"), ("f", "t"), ("n", "ri"), ("nn", "m")]
ODD = r"[0-9|@ſﬁﬂ]"
#: A word as a scanner may give it. The bars of tables and links stand beside space or another mark.
SCANNED = r"[\p{L}\p{M}\p{N}@|ﬁﬂ]+"
TOKEN = regex.compile(SCANNED)
HYPHENS = r"\-\u2010\u2011\u00AD\u00AC\u2027\u2043"
BROKEN = regex.compile(rf"([\p{{L}}\p{{M}}\p{{N}}@|]+)[{HYPHENS}][ \t]*\r?\n[ \t]*(?=\p{{L}}|[01|@ſ]\p{{L}})([\p{{L}}\p{{M}}\p{{N}}@|]+)")
#: A line that ends with a hyphen; without one nothing is looked for in BROKEN's slower way.
CUT = regex.compile(rf"[{HYPHENS}][ \t]*\r?\n")
COURSE = r"(?:[A-Z]{2,4}\s?\d{2,4}|[Rr]eader|READER)"
HEADERS = [
    regex.compile(rf"\p{{Lu}}.{{2,}}?(?:,| —| –| ·| \|)\s+{COURSE}"),
    regex.compile(r"(?:Chapter|Unit|Part|Lecture|Section|CHAPTER|UNIT|PART)\s+\d{1,3}\s*[|·:—–-]?\s+\p{Lu}[^.!?;]*[^.!?;:,\s]"),
    regex.compile(r"\d{1,3}\s*[·|]\s*\p{Lu}[^.!?;]*[^.!?;:,\s]"),
    regex.compile(r"\d{1,3}\.\s+\p{Lu}\w*(?:[ ]\w+){0,7}"),
]
PAGE = regex.compile(r"(?P<n>\d{1,4})|[-–—]\s*(?P<n>\d{1,4})\s*[-–—]|\[\s*p\.\s*(?P<n>\d{1,4})\s*\]|p\.\s?(?P<n>\d{1,4})|Page\s+(?P<n>\d{1,4})|(?P<n>\d{1,4})\s*/\s*\d{1,4}|\(?(?P<r>[ivxlc]+)\)?", regex.I)
SPACED = regex.compile(r"\S(?: +\S){4,}")
#: A number of up to four digits or in Roman numerals at either end of a line; of digits only where letters were spaced.
ENDS = (regex.compile(r"^(\d{1,4}|\(?[ivxlc]+\)?)[ \t]{2,}(?=\S)"), regex.compile(r"(?<=\S)[ \t]{2,}(\d{1,4}|\(?[ivxlc]+\)?)$"))
CLOSE_ENDS = (regex.compile(r"^(\d{1,4}) (?=\S)"), regex.compile(r"(?<=\S) (\d{1,4})$"))
#: What every header shows at an end or by its spacing; most lines do not and are looked at no further.
MAYBE = regex.compile(r"[\d(ivxlc]|Chapter|Unit|Part|Lecture|Section|CHAPTER|UNIT|PART|\S \S \S "), regex.compile(r"(?:[\divxlc)]|[Rr]eader|READER| \S)$")
#: What a header never ends with.
SENTENCE_ENDS = tuple(".!?;:,…。！？，、；：।؟")


def build_trie(words: dict[str, int]) -> dict:
    """Nested dicts by character; '' holds the count of a word that ends here, None the largest count below."""
    root: dict = {None: 0}
    for word, count in words.items():
        at = root
        at[None] = max(at[None], count)
        for ch in word:
            at = at.setdefault(ch, {None: 0})
            at[None] = max(at[None], count)
        at[""] = count
    return root


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _wrong, _right in CONFUSED:
    _BY_FIRST.setdefault(_wrong[0], []).append((_wrong, _right))


def candidates(word: str, trie: dict, least: int, edits: int = 2, generic: bool = False) -> dict[str, tuple[int, int]]:
    """All words of the trie of at least this count within so many edits: {word: (cost, count)}.

    Reading one thing for another that scanners confuse costs 1; with generic, any other substitution, insertion or
    deletion costs 2. The states are sets of places in the word by trie node, kept with their least cost.
    """
    found: dict[str, tuple[int, int]] = {}
    n = len(word)
    seen: dict[tuple[int, int], int] = {}
    stack = [(0, trie, 0, "")]
    while stack:
        i, node, cost, so_far = stack.pop()
        key = (i, id(node))
        if seen.get(key, 99) <= cost:
            continue
        seen[key] = cost
        if i == n:
            count = node.get("", 0)
            if cost and count >= least and so_far != word and found.get(so_far, (99,))[0] > cost:
                found[so_far] = (cost, count)
        else:
            ch = word[i]
            child = node.get(ch)
            if child is not None and child[None] >= least:
                stack.append((i + 1, child, cost, so_far + ch))
            if cost < edits:
                for wrong, right in _BY_FIRST.get(ch, ()):
                    if word.startswith(wrong, i):
                        to = node
                        for r in right:
                            to = to.get(r)
                            if to is None or to[None] < least:
                                break
                        else:
                            stack.append((i + len(wrong), to, cost + 1, so_far + right))
        if generic and cost + 2 <= edits:
            if i < n:
                stack.append((i + 1, node, cost + 2, so_far))
            for ch, child in node.items():
                if ch and child[None] >= least:
                    stack.append((i, child, cost + 2, so_far + ch))
                    if i < n and ch != word[i]:
                        stack.append((i + 1, child, cost + 2, so_far + ch))
    return found


#: A word of the vocabulary.
LETTERS = regex.compile(r"[\p{L}\p{M}--[ſﬁﬂ]]+", regex.V1)


def _odd(word: str) -> bool:
    """Letters with a few characters among them that no word has."""
    odd = len(regex.findall(ODD, word))
    letters = len(regex.findall(r"[\p{L}--[ſﬁﬂ]]", word, flags=regex.V1))
    return odd > 0 and letters >= 1 and not regex.fullmatch(r"\p{L}*\d{2,}|\d+\p{L}{1,2}|\p{L}{1,3}\d+|\|?\p{L}{1,2}\|?", word)


def _counted(batches):
    """Different words of each batch with their counts."""
    for batch in batches:
        got = pc.value_counts(batch.column("words").flatten())
        yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "count"])


def _reach(word: str) -> tuple[int, int]:
    """How much shorter and longer two confusions can make a word."""
    deltas = [len(right) - len(wrong) for wrong, right in CONFUSED if wrong in word]
    return 2 * min(0, *deltas, 0), 2 * max(0, *deltas, 0)


def _routed(batches):
    """The shards of words by count, and the suspects sent to each: (key, kind, word, count), kind 0 for the vocabulary, 1 for a suspect's confusions, 2 for any edit of it, 3 for one that is misread even without a candidate."""
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for word, count in zip(batch.column("word").to_pylist(), batch.column("count").to_pylist()):
            n, odd = len(word), _odd(word)
            if count >= 2 and LETTERS.fullmatch(word):
                out += [(f"F{word[0]}{n}", 0, word, count), (f"L{word[-1]}{n}", 0, word, count)]
            if odd or n > 2:
                low, high = _reach(word)
                if any(wrong in word for wrong, _ in CONFUSED):
                    first = {word[0]} | {right[0] for wrong, right in _BY_FIRST.get(word[0], ()) if word.startswith(wrong)}
                    out += [(f"F{c}{m}", 1, word, count) for c in first for m in range(max(1, n + low), n + high + 1)]
            if odd:
                if n > 4 and not word[-1].isdigit():
                    # an edit of the first letter leaves the last one as it is
                    out += [(key, 2, word, count) for m in (n - 1, n, n + 1) for key in (f"F{word[0]}{m}", f"L{word[-1]}{m}")]
                bare = word.strip("|")
                letters, digits = sum(ch.isalpha() for ch in bare), len(regex.findall(r"\d", bare))
                if letters >= 5 and regex.search(rf"\p{{Ll}}{ODD}\p{{Ll}}|[ſﬁﬂ]", bare) and digits * 3 <= letters and not regex.search(r"\d\d", bare) and "|" not in bare:
                    out.append(("", 3, word, count))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["key", "kind", "word", "count"])


def _misreads(batches, ratio: int):
    """Candidates of the suspects, from rows that come sorted by shard and kind. Only one shard's trie is held."""
    shard, words, trie = None, {}, None
    for batch in batches:
        out: list[tuple[str, str, int, int, int]] = []
        for key, salt, kind, word, count in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "kind", "word", "count"))):
            if (key, salt) != shard:
                shard, words, trie = (key, salt), {}, None
            if kind == 0:
                words[word] = count
                continue
            if not words:
                continue
            trie = build_trie(words) if trie is None else trie
            odd = _odd(word)
            least = max(5, count) if kind == 2 else 2 if odd else max(5, ratio * count)
            out.extend((word, right, cost, n, kind) for right, (cost, n) in candidates(word, trie, least, generic=kind == 2).items())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32()))], ["word", "right", "cost", "count", "kind"])


def _roman(text: str) -> int:
    values = [dict(i=1, v=5, x=10, l=50, c=100)[ch] for ch in text.lower().strip("()")]
    return sum(-v if v < max(values[k + 1 :], default=0) else v for k, v in enumerate(values))


def _on_page(digits: str, start: int | None, end: int | None) -> bool:
    """Whether a printed number is of the chunk's pages. Roman numerals of front matter may be one ahead."""
    if start is None:
        return False
    end = max(start, start if end is None else end)
    return start <= int(digits) <= end if digits.isdigit() else start <= _roman(digits) <= end + 1


def _cut(line: str, ends) -> tuple[str, list[str]]:
    """A line without the numbers at its ends, and those numbers."""
    numbers = []
    for end in ends:
        m = end.search(line)
        if m:
            numbers.append(m[1])
            line = line[: m.start()] + line[m.end() :]
    return line, numbers


def _parts(line: str) -> list[tuple[str, list[str]]]:
    """What a line is without the numbers at its ends, and those numbers; also with its letters set close, if they are spaced."""
    out = [_cut(line, ENDS)]
    close = lambda x: regex.sub(r" {2,}", " ", regex.sub(r"(?<=\S) (?=\S)", "", x))
    if len(out[0][0]) > 8 and SPACED.fullmatch(out[0][0]):
        out.append((close(out[0][0]), out[0][1]))
    if len(line) > 8 and SPACED.fullmatch(line):
        out += [(close(line), []), _cut(close(line), CLOSE_ENDS)]
    return out


def form(body: str) -> str:
    """A header's letters, without case."""
    return regex.sub(r"[^\p{L}\p{M}]", "", body.lower())


def furniture(line: str, start: int | None, end: int | None, running=()) -> tuple[bool, bool]:
    """Whether a line is a running header, and whether it prints a page number of the chunk. running: forms of the document's headers."""
    line = line.strip()
    if not line:
        return False, False
    page = PAGE.fullmatch(line) if len(line) <= 24 else None
    if page:
        return False, _on_page(page["n"] or page["r"], start, end)
    if line.endswith(SENTENCE_ENDS) or not (running or MAYBE[0].match(line) or MAYBE[1].search(line, max(0, len(line) - 8))):
        return False, False
    hits = [numbers for body, numbers in _parts(line) if any(h.fullmatch(body) for h in HEADERS) or running and form(body) in running]
    return bool(hits), any(_on_page(g, start, end) for numbers in hits for g in numbers)


def _numbered(batches):
    """Lines beside the number of their own page: document, form, page."""
    for batch in batches:
        docs, forms, pages = [], [], []
        for n, (lines, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lines", "page_start", "page_end")))):
            for line in lines:
                body, numbers = _parts(line.strip())[0]
                if any(g.isdigit() and _on_page(g, start, end) for g in numbers) and regex.match(r"\p{Lu}|\p{Lo}", body) and not body.endswith(SENTENCE_ENDS) and "\t" not in body and form(body):
                    docs.append(n)
                    forms.append(form(body))
                    pages.append(int(next(g for g in numbers if g.isdigit())))
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(docs, pa.int64())), pa.array(forms, pa.string()), pa.array(pages, pa.int32())], ["doc", "form", "page"])


def _plain(word: str) -> set[str]:
    """What a word with odd characters may be."""
    word = word.lower().replace("0", "o").replace("@", "a").replace("ſ", "s").replace("ﬁ", "fi").replace("ﬂ", "fl")
    return {regex.sub(r"[1|]", x, word) for x in "li"}


def pair_key(left: str, right: str) -> str:
    return f"{left.lower()}-{right.lower()}"


def _compounds(left: str, right: str) -> list[str]:
    """The words with a hyphen that two parts at a line end may be."""
    return sorted(f"{a}-{b}" for a in _plain(left) for b in _plain(right))


def _unfurnished(text: str, start: int | None, end: int | None, running) -> tuple[str, set[str]]:
    """The text without page furniture, and the kinds that were in it."""
    kinds, kept = set(), []
    for line in text.replace("\r\n", "\n").split("\n"):
        header, page = furniture(line, start, end, running)
        kinds |= {"header"} if header else set()
        kinds |= {"page_number"} if page else set()
        if not (header or page):
            kept.append(line.rstrip())
    return "\n".join(kept), kinds


def _found(batches, chains: bool):
    """Furniture and broken words of each text: (id, noise, pair, compounds), the last two for words at a line end only. With chains, also the pairs that appear once others are joined."""
    for batch in batches:
        out: list[tuple[int, str, str | None, list[str] | None]] = []
        for n, (text, start, end, running) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "page_start", "page_end", "running")))):
            # a word may be cut by furniture
            text, kinds = _unfurnished(text, start, end, running or ())
            out += [(n, k, None, None) for k in sorted(kinds)]
            forms = [text] if CUT.search(text) else []
            if chains and forms:
                forms += [BROKEN.sub(r"\1\2", text), BROKEN.sub(r"\1-\2", text)]
            pairs = {(m[1], m[2]) for t in forms for m in BROKEN.finditer(t) if regex.search(r"\p{L}", m[1])}
            out += [(n, "hyphenation", pair_key(*p), _compounds(*p)) for p in sorted(pairs)]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([o[0] for o in out], pa.int64())), *[pa.array([o[k] for o in out], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.list_(pa.string())))]], ["id", "noise", "pair", "compounds"])


def flow(text: str, start: int | None, end: int | None, running, kept) -> str:
    """Continuous paragraphs without page furniture, their words whole. kept: pairs that are written with a hyphen."""
    text = _unfurnished(text, start, end, running)[0]
    for _ in range(2 if CUT.search(text) else 0):
        text = BROKEN.sub(lambda m: m[1] + m[2] if regex.search(r"\p{L}", m[1]) and pair_key(m[1], m[2]) not in kept else m[1] + "-" + m[2], text)
    if "\n" not in text:
        return text.strip()
    paragraphs = [regex.sub(r"[ \t]*\n(?![ \t]*(?:[-*•]|\d{1,3}[.)])\s)", " ", p).strip() for p in regex.split(r"\n[ \t]*\n", text)]
    return "\n\n".join(p for p in paragraphs if p)


def correct(text: str, fixes: dict[tuple[str, str], str]) -> str:
    """The text with words corrected. fixes: by word before and word, '' at the start."""
    before = ""

    def fix(m):
        nonlocal before
        low = m[0].lower()
        right = fixes.get((before, low))
        before = low
        if not right:
            return m[0]
        begins = m[0][0].isdigit() and text[: m.start()].rstrip()[-1:] in ("", ".", "!", "?")
        return right.upper() if m[0].isupper() and len(m[0]) > 1 else right[0].upper() + right[1:] if m[0][0].isupper() or begins else right

    return TOKEN.sub(fix, text)


def _flowed(batches, kept: set[str] | None):
    """kept: for all texts; None if each row brings its own."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("text", "page_start", "page_end", "running")]
        own = batch.column("kept").to_pylist() if kept is None else [kept] * batch.num_rows
        out = [flow(t, a, b, r or (), k or ()) if t.strip() else t for t, a, b, r, k in zip(*cols, own)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])


def _corrected(batches):
    for batch in batches:
        fixes = [{(f["prev"], f["word"]): f["right"] for f in own} for own in batch.column("fixes").to_pylist()]
        out = [correct(t, f) for t, f in zip(batch.column("text").to_pylist(), fixes)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "repaired"])


def _followed(batches, rights: set[str], wrongs: set[str]):
    """Words with the word before each, '' at the start of a text: of rights how often in the batch, under no id; of wrongs where."""
    for batch in batches:
        column = batch.column("words")
        lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
        coded = column.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        before = np.concatenate(([len(names)], code[:-1])) if len(code) else code
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(names)
        pair = before * (len(names) + 1) + code
        right, wrong = (np.array([w in wanted for w in names], bool)[code] if len(code) else np.zeros(0, bool) for wanted in (rights, wrongs))
        counted, times = np.unique(pair[right], return_counts=True)
        where = np.unique(np.stack((row[wrong], pair[wrong])), axis=1)
        at, both = np.concatenate((np.zeros(len(counted), np.int64), where[0])), np.concatenate((counted, where[1]))
        none = np.arange(len(both)) < len(counted)
        words = pa.array([*names, ""], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(at, mask=none)), words.take(pa.array(both // (len(names) + 1))), words.take(pa.array(both % (len(names) + 1))), pa.array(np.concatenate((times, np.ones(len(where[0]), np.int64))))],
            ["id", "prev", "word", "times"],
        )


def scanned_words(text: Column) -> Column:
    """Words in lower case, with those cut at a line end made whole."""
    whole = F.when(text.contains("\n"), F.regexp_replace(text, rf"(?<=[\p{{L}}])[{HYPHENS}][ \t]*\r?\n[ \t]*(?=\p{{L}})", "")).otherwise(text)
    return F.regexp_extract_all(F.lower(whole), F.lit(SCANNED), F.lit(0))


class ScanRepair:
    """Noise of the chunks given, with their own words as the vocabulary."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, page_start: Column, page_end: Column, document: Column | None = None, ratio: int = RATIO):
        """document: whose pages the chunks are; without it every chunk is a document."""
        self.kind = df.select(id_col).schema[0].dataType.simpleString()
        doc = F.col(id_col).cast("string") if document is None else document.cast("string")
        self.base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), page_start.cast("int").alias("page_start"), page_end.cast("int").alias("page_end"), doc.alias("doc")).where("id is not null")
        self.texts = self.base.where("text is not null").select("id", scanned_words(F.col("text")).alias("words"))
        counted = self.texts.select("words").mapInArrow(_counted, "word string, count long")
        types = counted.groupBy("word").agg(F.sum("count").alias("count")).where(F.length("word") > 1)
        routed = types.mapInArrow(_routed, "key string, kind int, word string, count long").persist(StorageLevel.MEMORY_AND_DISK)
        large = routed.where("kind = 0").groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")).where("shards > 1")
        sent = routed.where("kind < 3").join(maybe_broadcast(large), "key", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        salts = F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("shards")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))
        sent = sent.withColumn("salt", F.explode(salts)).repartition("key", "salt").sortWithinPartitions("key", "salt", "kind", "word")
        got = sent.select("key", "salt", "kind", "word", "count").mapInArrow(partial(_misreads, ratio=ratio), "word string, right string, cost int, count long, kind int")
        bare = routed.where("kind = 3").select("word", F.lit(None).cast("string").alias("right"), F.lit(0).alias("cost"), F.lit(0).cast("long").alias("count"), "kind")
        every = got.unionAll(bare).groupBy("word", "right").agg(F.min("cost").alias("cost"), F.max("count").alias("count"), F.min("kind").alias("kind")).persist(StorageLevel.MEMORY_AND_DISK)
        # a word's confusions come before its other edits, these before none at all
        best = every.groupBy("word").agg(F.min("kind").alias("kind"))
        self.misread = every.join(maybe_broadcast(best), ["word", "kind"], "left_semi").select("word", "right", "cost", "count").persist(StorageLevel.MEMORY_AND_DISK)
        inside = self.base.where(F.col("text").contains("-")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}-])\p{L}+(?:-\p{L}+)+"), F.lit(0))).alias("compound"))
        self.compounds = inside.groupBy("compound").agg(F.count("*").alias("n")).where("n >= 2").select("compound")

    def running(self) -> DataFrame:
        """(doc, running): the forms of the lines that stand beside the number of their own page on several pages of a document."""
        numbered = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*([0-9]{1,4}[ \t]{2,}\S.*|\S.*[ \t]{2,}[0-9]{1,4})[ \t]*$"), F.lit(1))
        paged = F.col("page_start").isNotNull() & F.col("doc").isNotNull() & F.col("text").rlike(r"[0-9][ \t]{2}|[ \t]{2}[0-9]")
        lines = self.base.where(paged).select("doc", "page_start", "page_end", numbered.alias("lines")).where(F.size("lines") > 0)
        forms = lines.mapInArrow(_numbered, "doc string, form string, page int").groupBy("doc", "form").agg(F.count_distinct("page").alias("pages")).where("pages >= 2")
        return forms.groupBy("doc").agg(F.collect_list("form").alias("running"))

    def _lined(self) -> tuple[DataFrame, Column]:
        """(id, text, page_start, page_end, running) of all rows, and which of them may hold furniture or broken lines: a header never ends as a sentence does."""
        ends = "".join(SENTENCE_ENDS)
        may = F.coalesce(F.col("text").contains("\n") | ~F.col("text").rlike(rf"[{ends}]\s*\z"), F.lit(False))
        return self.base.join(maybe_broadcast(self.running()), "doc", "left").drop("doc"), may

    def noise(self) -> DataFrame:
        """(id, noise): the kinds of noise of each chunk."""
        wrong = self.misread.select("word").distinct()
        # rows of one id may be repeated, so its words are counted within each row
        held = self.texts.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.explode("words").alias("word")).join(maybe_broadcast(wrong), "word", "left_semi")
        misread = held.groupBy("id", "row").agg(F.count("*").alias("n")).where("n >= 3").select("id", F.lit("misread").alias("noise"))
        rows, may = self._lined()
        found = rows.where(may).mapInArrow(partial(_found, chains=False), f"id {self.kind}, noise string, pair string, compounds array<string>").persist(StorageLevel.MEMORY_AND_DISK)
        broken = found.where("pair is not null").join(maybe_broadcast(self._hyphenated(found)), "pair", "left_anti")
        return misread.unionAll(found.where("pair is null").select("id", "noise")).unionAll(broken.select("id", "noise")).distinct()

    def _hyphenated(self, found: DataFrame) -> DataFrame:
        """(pair): the pairs at line ends that are written with a hyphen elsewhere."""
        pairs = found.where("pair is not null").select("pair", F.explode("compounds").alias("compound")).distinct()
        return pairs.join(self.compounds, "compound", "left_semi").select("pair").distinct()

    def _followed(self, texts: DataFrame, rights: DataFrame, wrongs: DataFrame) -> DataFrame:
        """(id, prev, word, times): how often each of rights follows each word, under no id, and where each of wrongs stands. Both are sent to the tasks if they are few."""
        few = [df.distinct().limit(BROADCAST_ROWS + 1).collect() for df in (rights, wrongs)]
        if max(map(len, few)) <= BROADCAST_ROWS:
            return texts.mapInArrow(partial(_followed, rights={r[0] for r in few[0]}, wrongs={r[0] for r in few[1]}), f"id {self.kind}, prev string, word string, times long")
        pairs = F.arrays_zip(F.concat(F.array(F.lit("")), F.expr("slice(words, 1, greatest(size(words) - 1, 0))")).alias("prev"), F.col("words").alias("word"))
        each = texts.where(F.size("words") > 0).select("id", F.explode(pairs).alias("p")).select("id", "p.prev", "p.word")
        counts = each.join(rights.toDF("word").distinct(), "word", "left_semi").select(F.lit(None).cast(self.kind).alias("id"), "prev", "word", F.lit(1).cast("long").alias("times"))
        return counts.unionAll(each.join(wrongs.toDF("word").distinct(), "word", "left_semi").select("id", "prev", "word", F.lit(1).cast("long").alias("times")))

    def flowed(self) -> DataFrame:
        """(id, text): every text in continuous paragraphs without page furniture, its words whole but not yet corrected; rows may be repeated."""
        rows, may = self._lined()
        cut = rows.where(may & F.col("text").rlike(rf"[{HYPHENS}][ \t]*\r?\n")).mapInArrow(partial(_found, chains=True), f"id {self.kind}, noise string, pair string, compounds array<string>").where("pair is not null").persist(StorageLevel.MEMORY_AND_DISK)
        hyphenated = self._hyphenated(cut).persist(StorageLevel.MEMORY_AND_DISK)
        few = hyphenated.limit(BROADCAST_ROWS + 1).collect()
        shape = f"id {self.kind}, text string"
        lined = rows.where(may)
        if len(few) <= BROADCAST_ROWS:
            out = lined.mapInArrow(partial(_flowed, kept={r.pair for r in few}), shape)
        else:
            kept = cut.join(hyphenated, "pair", "left_semi").groupBy("id").agg(F.collect_set("pair").alias("kept"))
            out = lined.join(kept, "id", "left").mapInArrow(partial(_flowed, kept=None), shape)
        plain = self.base.where(~may).select("id", F.when(~F.col("text").rlike(r"\S"), F.col("text")).otherwise(F.regexp_replace("text", r"^\s+|\s+\z", "")).alias("text"))
        return out.unionAll(plain)

    def repaired(self) -> DataFrame:
        """(id, repaired): the text of every chunk as continuous paragraphs."""
        flowed, misread = written(self.flowed()), written(self.misread)
        texts = flowed.where("text is not null").select("id", F.regexp_extract_all(F.lower("text"), F.lit(SCANNED), F.lit(0)).alias("words"))
        best = F.max("count").over(W.partitionBy("word"))
        # far rarer candidates are mostly misread themselves: they come last where context doesn't decide
        choice = misread.where("right is not null").withColumn("likely", F.col("count") * RATIO >= best).persist(StorageLevel.MEMORY_AND_DISK)
        many = choice.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word")
        open_ = choice.join(maybe_broadcast(many), "word", "left_semi")
        met = written(self._followed(texts, open_.select("right"), choice.select("word")))
        follows = met.where("id is null").groupBy("prev", F.col("word").alias("right")).agg(F.sum("times").alias("times"))
        first = choice.groupBy("word").agg(F.max_by("right", F.struct("likely", -F.col("cost"), "count", "right")).alias("right"))
        decided = follows.join(maybe_broadcast(open_), "right").groupBy("prev", "word").agg(F.max_by("right", F.struct("times", "likely", -F.col("cost"), "count", "right")).alias("by_context"))
        occurs = met.where("id is not null").select("id", "prev", "word").distinct().join(maybe_broadcast(first), "word").join(decided, ["prev", "word"], "left")
        fixes = occurs.groupBy("id").agg(F.collect_list(F.struct("prev", "word", F.coalesce("by_context", "right").alias("right"))).alias("fixes"))
        rows = flowed.join(fixes, "id", "left").dropDuplicates(["id"])
        fixed = rows.where("fixes is not null").mapInArrow(_corrected, f"id {self.kind}, repaired string")
        return fixed.unionAll(rows.where("fixes is null").select("id", F.col("text").alias("repaired")))
