"""Evaluation passages inside corpus texts, word for word or re-parameterised.

Words are canonicalised: numbers, names and units become typed placeholders. Windows of canonical words are hash-joined
with those of the passages; a joined window is verbatim where its slots hold the same words too, and a passage is
re-parameterised where its slots map one to one onto others throughout a run, the windows of one offset between the two.
Windows of hardly anything but slots are met word for word only.

The passages are the stated side: their windows go to the tasks in blocks of bounded size, each passage whole in one block, and a text
is judged in the task that reads it, so nothing but findings is ever shuffled.

Defined cases: NULL texts and ids take no part; texts under the window length hold nothing; repeated rows count once;
invisible characters are removed before words are read; empty tables give empty results. Texts are taken whole.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import INVISIBLE, WORD, ragged, shingles

#: Windows of passages that are sent to the tasks at once; with more, the corpus is read once for each such block.
BLOCK_WINDOWS = 500_000
#: Most different words of all passages together.
PASSAGE_WORDS = 4_000_000
#: Words outside slots that a window needs to be met as a template.
LEAST_LITERAL = 3
#: Units of measure in the languages with units in words; those of other languages are ordinary words.
UNITS = ["percent", "units", "unit", "seconds", "second", "minutes", "minute", "hours", "hour", "days", "rows", "readings", "kg", "km", "cm", "mm", "ms", "unités", "einheiten", "unidades", "messungen"]
NUMBER, NAME, UNIT = (np.uint64(k) for k in (3, 5, 7))


def coded_words(text: Column) -> Column:
    """Of each word a hash without case whose two lowest bits say whether it has capitals and whether it starts with a digit."""
    found = F.regexp_extract_all(F.regexp_replace(text, INVISIBLE, ""), F.lit(WORD), F.lit(0))

    def code(w: Column) -> Column:
        low = F.lower(w)
        bits = F.when(low != w, 1).otherwise(0) + F.when(F.ascii(w).between(48, 57), 2).otherwise(0)
        return F.xxhash64(low).bitwiseAND(F.lit(-4)) + bits

    return F.transform(found, code)


class Canon:
    """Canonical words and windows of batches of coded words. names, plain, units: ascending hashes."""

    def __init__(self, n: int, plain: np.ndarray, names: np.ndarray, units: np.ndarray):
        self.n, self.plain, self.names, self.units = n, plain, names, units

    def windows(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of every window its template and verbatim hashes, row and start; and of every word its hash and whether it is a slot."""
        word = values & ~np.uint64(3)

        def among(x, s):
            return s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x if len(s) else np.zeros(len(x), bool)

        number = (values & np.uint64(2)) > 0
        unit = ~number & among(word, self.units)
        name = ~number & ~unit & (among(word, self.names) | ((values & np.uint64(1)) > 0) & ~among(word, self.plain))
        slot = number | unit | name
        canon = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, word)))
        template, row = shingles(canon, offsets, self.n)
        exact, _ = shingles(word, offsets, self.n)
        start = np.flatnonzero((np.arange(len(values)) + self.n) <= np.repeat(offsets[1:], np.diff(offsets))) if len(values) else np.empty(0, np.int64)
        total = np.concatenate(([0], np.cumsum(~slot)))
        literal = total[start + self.n] - total[start]
        return np.where(literal < LEAST_LITERAL, exact, template), exact, row, start, literal, word, slot


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of n groups has."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[first], minlength=n)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each item by equal keys, and an item of each group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _any(group: np.ndarray, flag: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, weights=flag, minlength=n) > 0


def _judged(batches, canon: Canon, block: dict, least: int):
    """What each text holds of the passages of a block."""
    for batch in batches:
        values, offsets = ragged(batch.column("w"))
        template, exact, row, start, literal, word, _ = canon.windows(values, offsets)
        low, high = np.searchsorted(block["template"], template), np.searchsorted(block["template"], template, "right")
        count = high - low
        k = np.repeat(np.arange(len(count)), count)
        b = np.repeat(low, count) + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
        at, item, place = row[k], block["item"][b], start[k] - offsets[row[k]]
        pair, lead = _grouped(at, item)
        n = len(lead)
        # a copy that repeats itself meets its passage at other shifts too, where it is no template
        where, _ = _grouped(at, item, place)
        copied = _any(where, exact[k] == block["exact"][b], len(k))[where]
        run, head = _grouped(at, item, place - block["place"][b])
        i, pos = np.nonzero(block["slot"][b])
        x, y, own = word[start[k[i]] + pos], block["word"][b[i], pos], run[i]
        each, first = _grouped(own, x, y)
        m = np.bincount(own[first], minlength=len(head))
        consistent = (m == _distinct(own, x, len(head))) & (m == _distinct(own, y, len(head)))
        most = np.zeros(len(head), np.int64)
        np.maximum.at(most, run, literal[k])
        shown = (consistent & ~_any(run, copied, len(head)) & (most >= least))[run]
        top = np.zeros(n, np.int64)
        np.maximum.at(top, pair, literal[k])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(at[lead])), block["ids"].take(pa.array(item[lead])), pa.array(_distinct(pair[copied], exact[k][copied], n).astype(np.int32)), pa.array(_distinct(pair, template[k], n).astype(np.int32)),
                pa.array(top.astype(np.int32)), pa.array(_any(pair, consistent[run], n)), pa.array(_distinct(pair[shown], template[k][shown], n).astype(np.int32)),
            ],
            ["doc", "item", "verbatim", "windows", "literal", "consistent", "reparameterised"],
        )


class LeakageSearch:
    """Passages against a corpus, by runs of window words."""

    def __init__(self, passages: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 13, block: int = BLOCK_WINDOWS):
        self.window, self.block = window, block
        base = passages.select(F.col(id_col).alias("id"), coded_words(F.col(text_col)).alias("w")).where("id is not null and w is not null").distinct()
        # how the passages write their words: always with capitals, or also without
        seen = base.select(F.explode("w").alias("c")).where(F.col("c").bitwiseAND(F.lit(2)) == 0).groupBy(F.col("c").bitwiseAND(F.lit(-4)).alias("word")).agg(F.min(F.col("c").bitwiseAND(F.lit(1))).alias("capital"))
        vocabulary = seen.limit(PASSAGE_WORDS + 1).collect()
        if len(vocabulary) > PASSAGE_WORDS:
            raise ValueError("more words in the passages than their bound; split the passages")
        as_hash = lambda rows: np.unique(np.array(rows, np.int64).view(np.uint64))
        names, plain = as_hash([r.word for r in vocabulary if r.capital]), as_hash([r.word for r in vocabulary if not r.capital])
        spark = passages.sparkSession
        units = as_hash([r[0] for r in spark.createDataFrame([(u,) for u in UNITS], "u string").select(F.xxhash64("u").bitwiseAND(F.lit(-4))).collect()])
        self.canon, self.base, self.kind = Canon(window, plain, names, units), base.where(F.size("w") >= window), base.schema["id"].dataType.simpleString()

    def _blocks(self):
        """The passages' windows by template, at most self.block of them at a time unless one passage alone has more."""
        held: list[tuple] = []
        size = 0
        for r in self.base.orderBy("id").toLocalIterator():
            here = len(r.w) - self.window + 1
            if held and size + here > self.block:
                yield self._packed(held)
                held, size = [], 0
            held.append((r.id, np.array(r.w, np.int64).view(np.uint64)))
            size += here
        if held:
            yield self._packed(held)

    def _packed(self, held: list[tuple]) -> dict:
        values, offsets = np.concatenate([w for _, w in held]), np.concatenate(([0], np.cumsum([len(w) for _, w in held])))
        template, exact, row, start, _, word, slot = self.canon.windows(values, offsets)
        order = np.argsort(template, kind="stable")
        at = start[order][:, None] + np.arange(self.window)
        return {"template": template[order], "exact": exact[order], "item": row[order], "place": (start - offsets[row])[order], "word": word[at], "slot": slot[at], "ids": pa.array([i for i, _ in held])}

    def search(self, corpus: DataFrame, literal: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, item, verbatim, windows, literal, consistent, reparameterised) for each document and passage with a window in common.

        verbatim: windows equal word for word; windows: windows equal as templates; literal: words outside slots in the most literal of
        them; consistent: whether the slots of any run map one to one; reparameterised: windows of the consistent runs without a
        verbatim one that have a window of at least so many literal words (more than half of a window if None).
        """
        least = self.window // 2 + 1 if literal is None else literal
        kind = corpus.select(id_col).schema[0].dataType.simpleString()
        base = corpus.select(F.col(id_col).alias("id"), coded_words(F.col(text_col)).alias("w")).where("id is not null")
        shape = f"doc {kind}, item {self.kind}, verbatim int, windows int, literal int, consistent boolean, reparameterised int"
        found = None
        for block in self._blocks():
            part = base.mapInArrow(partial(_judged, canon=self.canon, block=block, least=least), shape)
            found = part if found is None else found.unionAll(part)
        if found is None:
            return corpus.sparkSession.createDataFrame([], shape)
        return found.groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in ("verbatim", "windows", "literal", "consistent", "reparameterised")])

    def templates(self, corpus: DataFrame, literal: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, item, windows): passages that a document holds re-parameterised, with the windows of all runs that show it."""
        return self.search(corpus, literal, id_col, text_col).where("reparameterised > 0").select("doc", "item", F.col("reparameterised").alias("windows"))
