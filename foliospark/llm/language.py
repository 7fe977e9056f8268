"""Languages of documents and of stretches in them, by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a word is the sum over all
its segmentations into pieces of any length, which a forward algorithm gives for whole words, runs of scripts without spaces among
them; the pieces' probabilities come from a few rounds of expectation maximisation over a bounded sample of labelled documents, from
which documents that another language explains better are dropped. What one word can say against a language is bounded, by its
length, so that a name or a foreign word decides nothing. A Viterbi path over the words, on which a change of language costs something
(less between sentences), cuts a text into stretches.

Defined cases: NULL, empty and wordless texts have no stretch; unknown labels name no language; a language without
labelled documents is not found; repeated rows of an id count once; texts are taken whole.
"""

import base64
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import strip
from .hashing import WORD

#: The public vocabulary; its path is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents of each language that the model is fitted on at most.
SAMPLE = 100
SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
#: Characters of a word that may say MOST nats against a language; fewer of scripts without spaces. A shorter word may say as much.
SAYING, SPACELESS_SAYING = 16, 8
#: Cost of a change of language within a sentence and between sentences, and the most that one word can say, in nats.
INSIDE, BETWEEN, MOST = 14.0, 7.0, 5.0
#: Words that are scored at once, and scored words that a task remembers.
AT_ONCE, REMEMBERED = 20_000, 300_000

#: The languages by two-letter code, three-letter codes and English name.
LANGUAGES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "uk": ("ukr", "ukrainian"), "zh": ("zho", "chi", "chinese"),
    "ja": ("jpn", "japanese"), "hi": ("hin", "hindi"), "ar": ("ara", "arabic"), "th": ("tha", "thai"),
}
CODES = tuple(LANGUAGES)
#: Languages whose stretches are measured in characters.
BY_CHARACTERS = ("zh", "ja", "th")


def label_code(label: Column) -> Column:
    """The language a label names, by code, code with region or script, or name; NULL if none."""
    head = F.regexp_extract(F.lower(strip(label)), r"^([\p{L}]+)(?:[-_][\p{L}\p{N}]+)*$", 1)
    pairs = [F.lit(x) for code, names in LANGUAGES.items() for name in (code, *names) for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), head)


_vocabularies: dict = {}


def vocabulary(path: str) -> tuple[dict, int]:
    """The pieces as a trie of bytes, every single byte among them, and how many there are. A node has its piece's number under -1."""
    if path not in _vocabularies:
        with open(path, "rb") as f:
            _vocabularies[path] = piece_trie({base64.b64decode(line.split()[0]) for line in f} | {bytes([b]) for b in range(256)})
    return _vocabularies[path]


def piece_trie(pieces) -> tuple[dict, int]:
    root: dict = {}
    for number, piece in enumerate(sorted(pieces)):
        node = root
        for byte in piece:
            node = node.setdefault(byte, {})
        node[-1] = number
    return root, len(pieces)


def as_bytes(word: str) -> bytes:
    """A word as it is cut into pieces; it starts with a space in scripts that have them."""
    return word.encode() if SPACELESS.search(word) else (" " + word).encode()


def _groups(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


class Lattice:
    """All segmentations of some words: an edge for every piece at every place, between flat positions."""

    def __init__(self, words: list[bytes], root: dict):
        starts, ends, pieces = [], [], []
        base = 0
        for word in words:
            n = len(word)
            for i in range(n):
                node, j = root, i
                while j < n:
                    node = node.get(word[j])
                    if node is None:
                        break
                    j += 1
                    if -1 in node:
                        starts.append(base + i)
                        ends.append(base + j)
                        pieces.append(node[-1])
            base += n + 1
        lengths = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.last = self.first + lengths
        self.size = base
        src, dst, piece = np.array(starts, np.int64), np.array(ends, np.int64), np.array(pieces, np.int64)
        own = np.searchsorted(self.first, src, "right") - 1
        # forward: by place of the end in its word; backward: by place of the start
        order = np.lexsort((dst, dst - self.first[own])) if len(src) else np.empty(0, np.int64)
        self.src, self.dst, self.piece, self.own = src[order], dst[order], piece[order], own[order]
        level = self.dst - self.first[self.own]
        self.levels = np.append(_groups(level), len(level))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all ways to each position. logs: by piece, one column for each language."""
        out = np.full((self.size, logs.shape[1]), -np.inf)
        out[self.first] = 0
        for a, b in zip(self.levels, self.levels[1:]):
            _add(out, self.dst[a:b], out[self.src[a:b]] + logs[self.piece[a:b]])
        return out

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """The same from each position to the end."""
        out = np.full((self.size, logs.shape[1]), -np.inf)
        out[self.last] = 0
        order = np.lexsort((self.src, self.first[self.own] - self.src))
        src, dst, piece = self.src[order], self.dst[order], self.piece[order]
        level = np.append(_groups((self.src - self.first[self.own])[order]), len(order))
        for a, b in zip(level, level[1:]):
            _add(out, src[a:b], out[dst[a:b]] + logs[piece[a:b]])
        return out

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """Logarithm of each word's probability in each language."""
        return self.forward(logs)[self.last]

    def expected(self, log: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each of which occurs so many times."""
        column = log[:, None]
        alpha, beta = self.forward(column)[:, 0], self.backward(column)[:, 0]
        share = np.exp(alpha[self.src] + log[self.piece] + beta[self.dst] - alpha[self.last][self.own])
        return np.bincount(self.piece, weights=share * times[self.own], minlength=len(log))


def _add(out: np.ndarray, at: np.ndarray, logs: np.ndarray) -> None:
    """out at each position becomes the logarithm of the sum of what comes to it; equal positions stand together."""
    start = _groups(at)
    top = np.maximum.reduceat(logs, start)
    count = np.diff(np.append(start, len(at)))
    total = np.add.reduceat(np.exp(logs - np.repeat(top, count, axis=0)), start)
    out[at[start]] = top + np.log(total)


class Model:
    """Log probabilities of words by language. Picklable; keeps what it has scored."""

    def __init__(self, path: str, codes: list[str], logs: np.ndarray):
        """logs: by piece and language."""
        self.path, self.codes, self.logs = path, codes, logs
        self.seen: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def table(self, words: list[str]) -> np.ndarray:
        """How much worse each language explains each word than the best one does, at most what the word may say; a number says nothing."""
        out = np.zeros((len(words), len(self.codes)))
        if not self.codes:
            return out
        fresh = [w for w in dict.fromkeys(words) if w not in self.seen and w[0].isalpha()]
        if len(self.seen) + len(fresh) > REMEMBERED:
            self.seen.clear()
            fresh = [w for w in dict.fromkeys(words) if w[0].isalpha()]
        for at in range(0, len(fresh), AT_ONCE):
            part = fresh[at : at + AT_ONCE]
            raw = Lattice([as_bytes(w) for w in part], vocabulary(self.path)[0]).scores(self.logs)
            bound = np.array([max(1, len(w) // (SPACELESS_SAYING if SPACELESS.search(w) else SAYING)) for w in part], float)
            self.seen.update(zip(part, np.maximum(raw - raw.max(axis=1, keepdims=True), -MOST * bound[:, None])))
        for n, w in enumerate(words):
            if w[0].isalpha():
                out[n] = self.seen[w]
        return out


def fit(texts: list[tuple[str, list[str]]], path: str, rounds: int = 3) -> Model:
    """From (language, words) of sample documents. Documents better explained by another language leave the sample after a first fit."""
    root, size = vocabulary(path)
    codes = [c for c in CODES if any(code == c and any(w[0].isalpha() for w in words) for code, words in texts)]
    names = {c: sorted({w for code, words in texts if code == c for w in words if w[0].isalpha()}) for c in codes}
    lattices = {c: Lattice([as_bytes(w) for w in names[c]], root) for c in codes}

    def once(sample, rounds):
        logs = np.empty((size, len(codes)))
        for at, code in enumerate(codes):
            counts = Counter(w for own, words in sample if own == code for w in words)
            times = np.array([counts[w] for w in names[code]], float)
            log = np.full(size, -np.log(size))
            for _ in range(rounds):
                got = lattices[code].expected(log, times) + 0.02
                log = np.log(got / got.sum())
            logs[:, at] = log
        return Model(path, codes, logs)

    if not codes:
        return Model(path, [], np.zeros((0, 0)))
    first = once(texts, 2)
    clean = [(code, words) for code, words in texts if words and first.codes[int(np.argmax(first.table(words).sum(axis=0)))] == code]
    return once(clean if {c for c, _ in clean} >= set(codes) else texts, rounds)


#: Tokens: words, and the marks and line breaks between sentences.
TOKEN = WORD + r"|[.!?…।؟。！？\n\r]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _paths(scores: np.ndarray, between: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The best language of each word: Viterbi over all rows of a batch at once, position by position."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(scores), np.int16)
    if not len(scores):
        return out
    starts, sizes = offsets[:-1][order], lengths[order]
    width = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(1, width + 1), "right")  # rows with more than t words
    value = scores[starts[: alive[0]]].copy()
    stay = []
    heads = []
    for t in range(1, width):
        m = alive[t]
        at = starts[:m] + t
        value_m = value[:m]
        head = value_m.argmax(axis=1)
        change = value_m[np.arange(m), head][:, None] - np.where(between[at], BETWEEN, INSIDE)[:, None]
        keep = value_m >= change
        value[:m] = np.where(keep, value_m, change) + scores[at]
        stay.append(keep)
        heads.append(head)
    now = value.argmax(axis=1)
    state = np.zeros(alive[0], np.int64)
    for t in range(width - 1, -1, -1):
        m = alive[t]
        ending = np.arange(alive[t + 1] if t + 1 < width else 0, m)
        state[ending] = now[ending]
        out[starts[:m] + t] = state[:m]
        if t:
            rows = np.arange(m)
            kept = stay[t - 1][rows, state[:m]]
            state[:m] = np.where(kept, state[:m], heads[t - 1])
    return out


def _stretches(batches, model: Model, keep: list[str]):
    """Stretches of each text: language, words, characters, confidence, and first and last token."""
    for batch in batches:
        column = batch.column("tokens")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
        coded = column.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = np.asarray(coded.indices)
        worded = np.array([n[0].isalnum() for n in names], bool) if names else np.zeros(0, bool)
        table = np.zeros((len(names), len(model.codes)))
        if worded.any():
            table[worded] = model.table([n for n, w in zip(names, worded) if w])
        size = np.array([len(n) if w else 0 for n, w in zip(names, worded)], np.int64)
        row = np.repeat(np.arange(batch.num_rows), lengths)
        is_word = worded[code] if len(code) else np.zeros(0, bool)
        between = np.concatenate(([True], ~is_word[:-1])) if len(code) else np.zeros(0, bool)
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        code, row, between, place = code[is_word], row[is_word], between[is_word], place[is_word]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
        scores = table[code] if len(code) else np.zeros((0, max(1, len(model.codes))))
        if not model.codes or not len(code):
            continue
        path = _paths(scores, between, offsets)
        new = np.ones(len(code), bool)
        new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(code)))
        chars = np.add.reduceat(size[code], at)
        total = np.add.reduceat(scores, at, axis=0)
        own = total[np.arange(len(at)), path[at]]
        others = total.copy()
        others[np.arange(len(at)), path[at]] = -np.inf
        margin = np.clip(own - others.max(axis=1) if len(model.codes) > 1 else np.full(len(at), 9.0), -30, 30)
        kept = [batch.column(c).take(pa.array(row[at])) for c in keep]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(row[at])), *kept, pa.array((np.arange(len(at)) - np.searchsorted(row[at], row[at])).astype(np.int32)), pa.array([model.codes[k] for k in path[at]]), pa.array(count), pa.array(chars), pa.array(1 / (1 + np.exp(-margin))), pa.array(place[at].astype(np.int64)), pa.array(place[at + count - 1].astype(np.int64))],
            ["id", *keep, "stretch_no", "lang_code", "words", "characters", "confidence", "first_token", "last_token"],
        )


class LanguageSearch:
    """Fitted on the documents given, of which at most sample labelled ones of each language are looked at."""

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", path: str = VOCABULARY, sample: int = SAMPLE):
        labelled = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label_code(F.col(label_col)).alias("code")).where("id is not null and code is not null and length(text) > 200")
        rank = F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("id"), "id"))
        chosen = labelled.select("id", "code").withColumn("rank", rank).where(F.col("rank") <= sample).select("id")
        rows = labelled.join(F.broadcast(chosen), "id").select("code", tokens(F.col("text")).alias("tokens")).collect()
        self.model = fit([(r.code, [w for w in r.tokens if w[0].isalnum()]) for r in rows], path)

    def stretches(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
        """(id, *keep, stretch_no, lang_code, words, characters, confidence, first_token, last_token): consecutive stretches of each text."""
        kind = df.select(id_col).schema[0].dataType.simpleString()
        keep = keep or {}
        given = df.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in keep.items()], tokens(F.col(text_col)).alias("tokens")).where("id is not null")
        kept = "".join(f"{k} {given.schema[k].dataType.simpleString()}, " for k in keep)
        return given.mapInArrow(partial(_stretches, model=self.model, keep=list(keep)), f"id {kind}, {kept}stretch_no int, lang_code string, words long, characters long, confidence double, first_token long, last_token long")

    def languages(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, lang_code, confidence, share): the language of most of each text, by characters."""
        per = self.stretches(df, id_col, text_col).groupBy("id", "lang_code").agg(F.sum("characters").alias("n"), F.max("confidence").alias("confidence"))
        return per.groupBy("id").agg(F.max_by(F.struct("lang_code", "confidence", "n"), F.struct("n", "lang_code")).alias("best"), F.sum("n").alias("all")).select("id", "best.lang_code", "best.confidence", (F.col("best.n") / F.col("all")).alias("share"))


def long_enough(words: int = 25, characters: int = 50) -> Column:
    by_chars = F.col("lang_code").isin(*BY_CHARACTERS)
    return F.when(by_chars, F.col("characters") >= characters).otherwise(F.col("words") >= words)
