"""Near-duplicate records with small edits: one-permutation hashing, banded buckets, all pairs of a bucket as candidates.

Nulls, blank and short texts (under min_words words) have no shingles and repeat nothing. Rows repeated with the
same id count once. An empty table gives an empty result. Other columns are ignored. Texts are taken whole.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .components import components
from .hashing import Scheme, distinct, fingerprints, lists, ragged, shingles, sketch_slack, word_hashes

#: Texts of a bucket up to which its pairs are written at once. The texts of a larger one are cut into blocks, which meet in tasks of their own.
HOT, BLOCK = 16, 2048
#: Texts of one batch in a bucket from which the bucket is cut into blocks before any shuffle. A bucket that holds a share of all texts
#: holds it of some batch too, so none of a hundredth of all texts or more ever comes into one task.
CROWD = 64


def _sign(batches, scheme: Scheme, shingle: int, min_words: int, crowd: int):
    for batch in batches:
        values, offsets = ragged(batch.column("wh"))
        keep = np.flatnonzero(np.diff(offsets) >= max(min_words, shingle))
        lengths = np.diff(offsets)[keep]
        where = np.repeat(offsets[:-1][keep], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        values, offsets, n = values[where], np.concatenate(([0], np.cumsum(lengths))), len(keep)
        h, row = distinct(*shingles(values, offsets, shingle))
        signature = scheme.signature(h, row, n)
        fp = (fingerprints(values, offsets) >> np.uint64(1)).view(np.int64)
        s1, s2 = scheme.sketch(signature)
        # copies within the batch send their keys and shingles once
        lead = np.zeros(n, bool)
        lead[np.unique(fp, return_index=True)[1]] = True
        keys = scheme.keys(signature)[lead].ravel().view(np.int64)
        ofs = np.concatenate(([0], np.cumsum(lead * scheme.bands))).astype(np.int32)
        inside = lead[row]
        key, times = np.unique(keys, return_counts=True)
        key = key[times >= crowd]
        crowded = pa.ListArray.from_arrays(np.where(np.arange(n + 1) > 0, len(key), 0).astype(np.int32), pa.array(key))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(keep)), pa.array(fp), pa.array(np.bincount(row, minlength=n).astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(lead), pa.ListArray.from_arrays(ofs, pa.array(keys)), crowded, lists(h[inside], row[inside], n)],
            ["id", "fp", "size", "s1", "s2", "lead", "keys", "crowded", "sh"],
        )


def _buckets(batches, hot: int, block: int):
    """From different (key, fp) in order: all pairs (a, b), a < b, of each bucket of up to hot texts; of a larger one each text with its key and block. Only the last bucket is carried on, hot texts of it at most."""

    def pairs(start: np.ndarray, count: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        left = np.repeat(start + count, count) - at - 1
        a = np.repeat(at, left)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.array(fp[a]), pa.array(fp[b])], ["key", "block", "a", "b"])

    none = np.empty(0, np.int64)
    key, fp = none, none
    seen, last = 0, (0, 0)  # of a large bucket: the texts written, the last row
    for batch in batches:
        key, fp = np.concatenate((key, np.asarray(batch.column("key")))), np.concatenate((fp, np.asarray(batch.column("fp"))))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        if seen and len(key) and (key[0], fp[0]) == last:
            fresh[0] = False
        key, fp = key[fresh], fp[fresh]
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.concatenate((start, [len(key)])))
        large, before = count > hot, np.zeros(len(start), np.int64)
        if seen and key[0] == last[0]:
            large[0], before[0] = True, seen
        many = np.repeat(large, count)
        place = (np.arange(len(key)) - np.repeat(start - before, count))[many]
        if len(place):
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array((place // block).astype(np.int32)), pa.array(fp[many]), pa.nulls(len(place), pa.int64())], ["key", "block", "a", "b"])
        done = ~large
        done[-1] = False
        yield pairs(start[done], count[done], fp)
        if large[-1]:
            seen, last = int(before[-1] + count[-1]), (key[-1], fp[-1])
            key, fp = none, none
        else:
            seen = 0
            key, fp = key[start[-1] :], fp[start[-1] :]
    if len(key):
        yield pairs(np.array([0]), np.array([len(key)]), fp)


class NearDuplicates:
    """Pairs and groups of records whose sets of word shingles have at least the given similarity (Jaccard)."""

    def __init__(self, shingle: int = 5, similarity: float = 0.8, min_words: int = 1, bands: int = 32, rows: int = 4, hot: int = HOT, block: int = BLOCK, crowd: int = CROWD):
        self.shingle, self.similarity, self.min_words, self.hot, self.block, self.crowd = shingle, similarity, min_words, hot, block, crowd
        self.scheme = Scheme(bands, rows)

    def signatures(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, fp, size, s1, s2, lead, keys, crowded, sh) for each row with enough words; fp stands for the text; crowded: keys of many texts of a batch, on its first row."""
        kind = df.select(id_col).schema[0].dataType.simpleString()
        given = df.select(F.col(id_col).alias("id"), word_hashes(F.col(text_col)).alias("wh")).where("id is not null")
        return given.mapInArrow(partial(_sign, scheme=self.scheme, shingle=self.shingle, min_words=self.min_words, crowd=self.crowd), f"id {kind}, fp long, size int, s1 long, s2 long, lead boolean, keys array<long>, crowded array<long>, sh array<long>")

    def _near(self) -> Column:
        """Whether sizes and sketches of a row's two texts allow the similarity."""
        far = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
        return (F.least("na", "nb") >= F.lit(self.similarity) * F.greatest("na", "nb")) & (far <= sketch_slack(self.similarity))

    def candidates(self, signatures: DataFrame) -> DataFrame:
        """(a, b), a < b: all pairs of different texts that share a bucket and whose sizes and sketches allow the similarity."""
        texts = signatures.where("lead").groupBy("fp").agg(F.first("size").alias("size"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
        x = texts.select(F.col("fp").alias("a"), F.col("size").alias("na"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
        y = texts.select(F.col("fp").alias("b"), F.col("size").alias("nb"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
        every = signatures.where("lead").select("fp", F.explode("keys").alias("key"))
        crowded = signatures.select(F.explode("crowded").alias("key")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        some = not crowded.isEmpty()
        known = maybe_broadcast(crowded)
        rows = (every.join(known, "key", "left_anti") if some else every).repartition("key").sortWithinPartitions("key", "fp")
        met = rows.mapInArrow(partial(_buckets, hot=self.hot, block=self.block), "key long, block int, a long, b long").persist(StorageLevel.MEMORY_AND_DISK)
        few = met.where("key is null").select("a", "b").distinct().join(x, "a").join(y, "b").where(self._near()).select("a", "b")
        # in order of a bucket, so that a text meets the blocks up to its own
        crowd = met.where("key is not null").select("key", "block", "a")
        if some:
            hot = every.join(known, "key", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
            blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / self.block).alias("blocks"))
            # fingerprints are spread evenly and not negative, so equal ranges of them are blocks in order
            at = F.least(F.floor(F.col("fp") / 2.0**63 * F.col("blocks")), F.col("blocks") - 1).cast("int")
            crowd = crowd.unionByName(hot.join(maybe_broadcast(blocks), "key").select("key", at.alias("block"), F.col("fp").alias("a")).distinct())
        left = crowd.join(x, "a")
        right = crowd.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("block"), F.col("a").alias("b")).join(y, "b")
        many = left.join(right, ["key", "block"]).where(F.col("a") < F.col("b")).where(self._near()).select("a", "b")
        return few.unionAll(many).distinct()

    def _exact(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs that reach it, by their whole sets of shingles."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        sets = signatures.where("lead").select("fp", "sh").join(maybe_broadcast(wanted), "fp", "left_semi").dropDuplicates(["fp"])
        both = F.size(F.array_intersect("x", "y"))
        joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("sh").alias("y")), "b")
        return joined.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).where(F.col("similarity") >= self.similarity)

    def text_pairs(self, signatures: DataFrame) -> DataFrame:
        """(a, b, similarity) over different texts, a < b. Every candidate is verified exactly."""
        return self._exact(self.candidates(signatures).persist(StorageLevel.MEMORY_AND_DISK), signatures)

    def pairs(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id_a, id_b): every pair of different ids, smaller first, whose texts reach the similarity; copies give all their pairs."""
        signatures = self.signatures(df, id_col, text_col).persist(StorageLevel.MEMORY_AND_DISK)
        found = self.text_pairs(signatures).select("a", "b")
        member = signatures.select("id", "fp").repartition("fp").dropDuplicates(["fp", "id"]).persist(StorageLevel.MEMORY_AND_DISK)
        x, y = member.select(F.col("id").alias("i"), F.col("fp").alias("a")), member.select(F.col("id").alias("j"), F.col("fp").alias("b"))
        other = found.join(x, "a").join(y, "b").select("i", "j")
        own = x.join(y, F.col("a") == F.col("b")).where("i < j").select("i", "j")
        return other.unionAll(own).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).where("id_a <> id_b").distinct()

    def groups(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, class_id, copies, links): each record with enough words; class_id is the least id of its group, links the number of other texts that its text reaches, copies the ids with the very same words."""
        signatures = self.signatures(df, id_col, text_col).persist(StorageLevel.MEMORY_AND_DISK)
        found = self.text_pairs(signatures).persist(StorageLevel.MEMORY_AND_DISK)
        member = signatures.select("id", "fp").repartition("fp").dropDuplicates(["fp", "id"]).persist(StorageLevel.MEMORY_AND_DISK)
        text = member.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        links = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
        # only texts with a link have a group beyond their copies
        linked = components(found).select(F.col("node").alias("fp"), "root").join(text.select("fp", "least"), "fp")
        first = linked.groupBy("root").agg(F.min("least").alias("class_id"))
        classes = linked.join(first, "root").select("fp", "class_id").join(links, "fp")
        out = member.join(text, "fp").join(classes, "fp", "left")
        return out.select("id", F.coalesce("class_id", "least").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
