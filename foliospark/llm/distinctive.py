"""How characteristic a term is of a record: hypergeometric enrichment against the whole collection.

A record of n words is a draw without replacement from the collection's N words, K of which are the term; the score of a
term that it holds k times is the negative decimal logarithm of P(X >= k), adjusted for the false-discovery rate over all different
words of that record (Benjamini and Hochberg). A phrase takes its place among the words, so that a term has one score whatever
else is asked. Whether a term is distinctive is the tail of a draw of one record: P(X >= 1) that it holds the term.

Defined cases: NULL and blank texts hold nothing and aren't counted; repeated rows of an id count once; NULL and
blank terms are left out and repeated ones count once; empty tables give empty results.
"""

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, maybe_broadcast, strip, written
from .hashing import distinct, lists, ragged, shingles, word_hashes, words


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers above 0: Stirling's series after shifting small ones up by 8."""
    x = np.atleast_1d(np.asarray(x, float))
    small = x < 8
    z = np.where(small, x + 8, x)
    w = 1 / (z * z)
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z
    low = x[small]
    product = np.ones_like(low)
    for k in range(8):
        product *= low + k
    out[small] -= np.log(product)
    return out


def _choose(n, k):
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def upper_tail(k, n, K, N) -> np.ndarray:
    """Natural logarithm of P(X >= k) for a draw of n out of N with K marked; exact sums, all rows at once."""
    k, n, K, N = (np.asarray(v, float) for v in (k, n, K, N))
    top = np.minimum(n, K)
    low = np.maximum(0, n + K - N)
    sure = k <= low
    start = np.where(sure, np.maximum(low, np.minimum(k, top)), k)
    first = _choose(K, start) + _choose(N - K, n - start) - _choose(N, n)
    total, term, i = np.ones_like(first), np.ones_like(first), start.copy()
    while True:
        on = i < top
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(on, (K - i) * (n - i) / ((i + 1) * (N - K - n + i + 1)), 0)
        term = term * ratio
        total += term
        i += 1
        if not (on & (term > total * 1e-17)).any():
            break
    return np.where(sure, 0.0, np.minimum(first + np.log(total), 0.0))


def adjusted(log_p: np.ndarray, row: np.ndarray, member: np.ndarray | None = None) -> np.ndarray:
    """Benjamini-Hochberg within each row, on logarithms. Only members make up a row's family; the others take their place among them."""
    if not len(log_p):
        return log_p
    member = np.ones(len(log_p), bool) if member is None else member
    order = np.lexsort((~member, log_p, row))
    lp, r, own = log_p[order], row[order], member[order]
    size = np.bincount(r, weights=own)[r]
    before = np.concatenate(([0], np.cumsum(own)))
    rank = before[1:] - before[np.searchsorted(r, r)]
    q = lp + np.log(np.maximum(size, 1) / np.maximum(rank, 1))
    # the least over this and all higher ranks of the family: rows are kept apart by an offset above any value
    span = float(np.max(q) - np.min(q)) + 1
    back = np.minimum.accumulate((np.where(own, q, np.max(q)) + r * span)[::-1])[::-1] - r * span
    out = np.empty_like(back)
    out[order] = np.minimum(np.where(own, back, np.minimum(q, back)), 0.0)
    return out


def _counts(h: np.ndarray, row: np.ndarray):
    """Different (row, hash) with their counts, ascending."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def _held(batches, phrases: dict[int, np.ndarray]):
    """Of each record its word count and the given phrases it holds, with counts. phrases: by length in words, ascending hashes."""
    for batch in batches:
        values, offsets = ragged(batch.column("wh"))
        hs, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for n, wanted in phrases.items():
            h, row = shingles(values, offsets, n)
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = wanted[at] == h
            hs.append(h[hit])
            rows.append(row[hit])
        h, row, k = _counts(np.concatenate(hs), np.concatenate(rows))
        terms = lists(h, row, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), terms, pa.ListArray.from_arrays(terms.offsets, pa.array(k.astype(np.int64)))], ["id", "n", "terms", "counts"])


def _scored(batches):
    """Scores of each record's terms; inner lists are parallel."""
    for batch in batches:
        k, offsets = ragged(batch.column("counts"))
        K, _ = ragged(batch.column("totals"))
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(batch.num_rows), lengths)
        n, N = np.asarray(batch.column("n"))[row], np.asarray(batch.column("corpus"))[row]
        q = adjusted(upper_tail(k.view(np.int64), n, K.view(np.int64), N), row)
        scores = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(np.maximum(-q / np.log(10), 0.0)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("terms"), batch.column("counts"), scores], ["id", "terms", "counts", "scores"])


def _phrase_hashes(batches):
    for batch in batches:
        values, offsets = ragged(batch.column("wh"))
        lengths = np.diff(offsets)
        out = np.zeros(batch.num_rows, np.uint64)
        for n in np.unique(lengths[lengths > 0]):
            h, row = shingles(values, offsets, int(n))
            last = lengths[row] == n
            out[row[last]] = h[last]
        yield pa.RecordBatch.from_arrays([batch.column("keyword"), pa.array(out.view(np.int64)), pa.array(lengths.astype(np.int32))], ["keyword", "term", "len"])


def keyword_terms(queries: DataFrame, id_col: str, keywords_col: str) -> DataFrame:
    """(query_id, keyword, term, len): the different keywords of each query, trimmed and in lower case; term stands for the words."""
    each = queries.select(F.col(id_col).alias("query_id"), F.explode(keywords_col).alias("k")).select("query_id", F.lower(strip(F.col("k"))).alias("keyword")).where("query_id is not null and keyword <> ''").distinct()
    hashed = each.select("keyword").distinct().select("keyword", word_hashes(F.col("keyword")).alias("wh")).mapInArrow(_phrase_hashes, "keyword string, term long, len int").where("len > 0")
    return each.join(maybe_broadcast(hashed), "keyword").select("query_id", "keyword", "term", "len")


def hashed_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, wh) of every row with an id and text."""
    return df.select(F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("wh")).where(F.col("id").isNotNull() & (strip(F.col(text_col)) != ""))


def held_phrases(base: DataFrame, phrases: DataFrame, bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, term, count, df, marked) of given phrases in each record, and one row of totals (records, words).

    base: as hashed_words gives it. phrases: (term, len); they are sent to the tasks if there are at most bound of them
    (BROADCAST_ROWS), otherwise every run of words of their lengths is joined with them.
    """
    bound = BROADCAST_ROWS if bound is None else bound
    terms = phrases.select("term", "len").distinct()
    few = terms.limit(bound + 1).collect()
    kind = base.schema["id"].dataType.simpleString()
    if len(few) <= bound:
        by: dict[int, np.ndarray] = {n: np.unique(np.array([r.term for r in few if r.len == n], np.int64).view(np.uint64)) for n in {r.len for r in few}}
        held = base.mapInArrow(partial(_held, phrases=by), f"id {kind}, n long, terms array<long>, counts array<long>")
        held = held.dropDuplicates(["id"]).persist(StorageLevel.MEMORY_AND_DISK)
        rows = held.where(F.size("terms") > 0).select("id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.counts").alias("count"))
    else:
        once = base.dropDuplicates(["id"]).persist(StorageLevel.MEMORY_AND_DISK)
        lengths = [r[0] for r in terms.select("len").distinct().collect()]
        held = once.select("id", F.size("wh").cast("long").alias("n"))
        grams = once.mapInArrow(partial(_grams, lengths=lengths), f"id {kind}, term long, count long")
        rows = grams.join(terms.select("term").distinct(), "term", "left_semi").select("id", "term", "count")
    totals = held.agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("corpus"))
    stats = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("marked"))
    return rows.join(maybe_broadcast(stats), "term").select("id", "term", "count", "df", "marked"), totals


def _grams(batches, lengths: list[int]):
    """Every run of words of the given lengths in each record, with its count."""
    for batch in batches:
        values, offsets = ragged(batch.column("wh"))
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64)), *(shingles(values, offsets, n) for n in lengths)]
        h, row, k = _counts(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(k.astype(np.int64))], ["id", "term", "count"])


def _rarity(batches):
    """Each term with the natural logarithm of the chance that one record drawn from all holds it."""
    for batch in batches:
        ones = np.ones(batch.num_rows)
        got = upper_tail(ones, ones, np.asarray(batch.column("df")), np.asarray(batch.column("records")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "log_share"])


def distinctive_terms(held: DataFrame, totals: DataFrame, most_share: float) -> DataFrame:
    """(term, distinctive) of each term that is held: whether the tail of a draw of one record is at most most_share.

    The edge is decided on whole numbers, and so is what lies within the rounding of the sums beside it.
    """
    stats = held.groupBy("term").agg(F.first("df").alias("df")).crossJoin(F.broadcast(totals.select("records")))
    tail = stats.mapInArrow(_rarity, "term long, df long, records long, log_share double")
    above = F.col("log_share") - math.log(most_share)
    edge = F.col("df") <= F.lit(most_share) * F.col("records")
    return tail.select("term", F.when(F.abs(above) < 1e-3, edge).otherwise(above < 0).alias("distinctive"))


def query_keywords(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_text", query_id: str = "id", keywords: str = "expected_keywords", most_share: float = 0.02) -> DataFrame:
    """(query_id, keyword, id, count, df, distinctive): each keyword in each record that holds it.

    A keyword is distinctive if at most most_share of the records with text hold it.
    """
    terms = keyword_terms(queries, query_id, keywords)
    held, totals = held_phrases(hashed_words(chunks, id_col, text_col), terms)
    rare = distinctive_terms(held, totals, most_share)
    out = held.join(maybe_broadcast(rare), "term").join(maybe_broadcast(terms), "term")
    return out.select("query_id", "keyword", "id", "count", "df", "distinctive")


def word_totals(base: DataFrame) -> tuple[DataFrame, int, int]:
    """Of records (wh), each word's number (term, marked) over all of them, how many words there are, and how many different ones."""
    vocabulary = base.select("wh").mapInArrow(_word_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("marked")).persist(StorageLevel.MEMORY_AND_DISK)
    size, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("marked"), F.lit(0))).first()
    return vocabulary, total, size


def _sent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A vocabulary as arrays, by ascending hash."""
    got = vocabulary.toArrow()
    h, K = np.asarray(got.column("term").combine_chunks()).view(np.uint64), np.asarray(got.column("marked").combine_chunks())
    order = np.argsort(h)
    return h[order], K[order]


def _phrase_scores(batches, vocabulary: tuple[np.ndarray, np.ndarray] | None, N: int):
    """Scores of the phrases of each record, adjusted among its words. vocabulary: None if each row brings the counts of its own words."""
    for batch in batches:
        values, offsets = ragged(batch.column("wh"))
        n = np.diff(offsets)
        h, row, k = _counts(values, np.repeat(np.arange(batch.num_rows), n))
        if vocabulary is not None:
            K = vocabulary[1][np.searchsorted(vocabulary[0], h)]
        else:
            word, at = ragged(batch.column("word"))
            K = ragged(batch.column("totals"))[0].view(np.int64)[np.lexsort((word, np.repeat(np.arange(batch.num_rows), np.diff(at))))]
        terms, at = ragged(batch.column("terms"))
        own = np.repeat(np.arange(batch.num_rows), np.diff(at))
        counts, marked = (ragged(batch.column(c))[0].view(np.int64) for c in ("counts", "marked"))
        log_p = np.concatenate((upper_tail(k, n[row], K, np.full(len(k), N)), upper_tail(counts, n[own], marked, np.full(len(own), N))))
        q = adjusted(log_p, np.concatenate((row, own)), np.arange(len(log_p)) < len(k))[len(k) :]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(terms.view(np.int64)), pa.array(np.maximum(-q / np.log(10), 0.0))], ["id", "term", "score"])


def keyword_scores(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_text", query_id: str = "id", keywords: str = "expected_keywords", most_share: float = 0.02, rare: bool = False) -> DataFrame:
    """(query_id, keyword, id, count, df, score, distinctive): each keyword in each record that holds it, with its score there.

    rare: of distinctive keywords only. Their scores are the same, since a record's own words are the family they are adjusted in.
    """
    base = written(hashed_words(chunks, id_col, text_col).dropDuplicates(["id"]))
    kind = base.schema["id"].dataType.simpleString()
    terms = keyword_terms(queries, query_id, keywords)
    held, totals = held_phrases(base, terms)
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    decided = maybe_broadcast(distinctive_terms(held, totals, most_share))
    if rare:
        held = held.join(decided.where("distinctive"), "term", "left_semi")
    vocabulary, total, size = word_totals(base)
    asked = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "count", "marked"))).alias("x")).select("id", F.col("x.term").alias("terms"), F.col("x.count").alias("counts"), F.col("x.marked").alias("marked"))
    rows = base.join(asked, "id")
    shape = f"id {kind}, term long, score double"
    if size <= BROADCAST_ROWS:
        scored = rows.mapInArrow(partial(_phrase_scores, vocabulary=_sent(vocabulary), N=total), shape)
    else:
        words = rows.select("id", F.explode(F.array_distinct("wh")).alias("word")).join(vocabulary.withColumnRenamed("term", "word"), "word")
        listed = words.groupBy("id").agg(F.collect_list(F.struct("word", "marked")).alias("v")).select("id", F.col("v.word").alias("word"), F.col("v.marked").alias("totals"))
        scored = rows.join(listed, "id").mapInArrow(partial(_phrase_scores, vocabulary=None, N=total), shape)
    out = held.join(scored, ["id", "term"]).join(decided, "term").join(maybe_broadcast(terms), "term")
    return out.select("query_id", "keyword", "id", "count", "df", "score", "distinctive")


def _word_counts(batches):
    """Different words of each batch, as hashes, with their counts."""
    for batch in batches:
        values, _ = ragged(batch.column("wh"))
        term, count = np.unique(values, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count)], ["term", "n"])


def _term_scores(batches, vocabulary: tuple[np.ndarray, np.ndarray] | None, N: int):
    """Each record's different words with count and score."""
    for batch in batches:
        values, offsets = ragged(batch.column("wh"))
        names = batch.column("words").flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        order = np.lexsort((values, row))
        h, r = values[order], row[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(first)
        k = np.diff(np.append(at, len(h)))
        term, r = h[at], r[at]
        K = vocabulary[1][np.searchsorted(vocabulary[0], term)]
        q = adjusted(upper_tail(k, np.diff(offsets)[r], K, np.full(len(k), N)), r)
        ofs = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=batch.num_rows)))).astype(np.int32)
        items = pa.StructArray.from_arrays([names.take(pa.array(order[at])), pa.array(k.astype(np.int64)), pa.array(np.maximum(-q / np.log(10), 0.0))], ["term", "count", "score"])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ofs, items)], ["id", "terms"])


def term_scores(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms: array of term, count, score): every word of every record with text.

    The collection's word counts are sent to the tasks if there are few different words (checked); otherwise they
    are joined with the records' words.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    once = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (strip(F.col("text")) != "")).dropDuplicates(["id"])
    base = once.select("id", words(F.col("text")).alias("words")).select("id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    vocabulary, total, size = word_totals(base)
    shape = f"id {kind}, terms array<struct<term:string,count:bigint,score:double>>"
    if size <= BROADCAST_ROWS:
        return base.mapInArrow(partial(_term_scores, vocabulary=_sent(vocabulary), N=total), shape)
    rows = base.select("id", F.size("wh").cast("long").alias("n"), F.explode(F.arrays_zip("words", "wh")).alias("x")).groupBy("id", "n", F.col("x.wh").alias("term")).agg(F.min("x.words").alias("word"), F.count("*").alias("k"))
    listed = rows.join(vocabulary, "term").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("term", "word", "k", "marked"))).alias("x"))
    listed = listed.select("id", "n", F.lit(total).alias("corpus"), F.col("x.word").alias("terms"), F.col("x.k").alias("counts"), F.col("x.marked").alias("totals"))
    scored = listed.mapInArrow(_scored, f"id {kind}, terms array<string>, counts array<long>, scores array<double>")
    return scored.select("id", F.transform(F.arrays_zip("terms", "counts", "scores"), lambda x: F.struct(x.terms.alias("term"), x.counts.alias("count"), x.scores.alias("score"))).alias("terms"))
