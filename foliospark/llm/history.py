"""Checking new batches against everything accepted before, through a stored index of minwise band keys.

The index is a folder of Parquet tables in the shared folder that only grow, each partitioned by a hash of what it is probed by:

    bands       key, text               band keys of accepted texts
    signatures  text, doc, call, s1, s2 sketches of their signatures, and a document that has the text
    accepted    text, doc, at           accepted documents and when
    hashes      hash, at                accepted file hashes
    words       doc, call, wh, ...      hashed words of the documents seen, by chunk
    joints      doc, call, wh           those across the ends of chunks

A call signs its own documents only, appends what it accepts, and reads of the index the partitions that its keys fall in; of older
documents only the stored words of candidates are read, never their text. Calls come in arrival order, with any number of batches
each. A call that died is simply run again: what it appended is found again and changes nothing.

Defined cases: a NULL record id or batch number takes no part; a NULL or empty hash equals nothing; documents of under
min_words words repeat nothing by text; repeated rows of a chunk_id count once; ties in chunk_index go by chunk_id;
empty tables give empty results.
"""

import uuid
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import file_system, maybe_broadcast, settled, shared_dir, stage_mark, strip, written
from .hashing import Scheme, distinct, lists, mix64, ragged, shingles, sketch_slack, word_hashes

#: Chunks of a document that are put in order by one task. A document of any length is cut into such blocks.
BLOCK = 256
#: Parts that a crowded bucket's texts are spread over.
SALT = 16
#: When a record was accepted, in arrival order.
AT = "struct<batch_no:int,record_id:bigint>"


def sha256_value(c: Column) -> Column:
    """The digest however it is written: case, blanks and a leading sha256: do not matter. NULL if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"^sha-?256\s*[:=-]?\s*", ""), F.lit(""))


def is_accepted(status: Column) -> Column:
    return F.coalesce(F.lower(strip(status)) == "success", F.lit(False))


def _chunks(batches, scheme: Scheme, n: int):
    """Of each chunk its word count and the sum over its shingles; on the first row of a document in the batch, the least shingle in each bin over the batch."""
    for batch in batches:
        values, offsets = ragged(batch.column("wh"))
        lengths = np.diff(offsets)
        h, row = shingles(values, offsets, n)
        sums = _sums(h, row, len(lengths))
        doc = batch.column("doc").dictionary_encode()
        code, docs = np.asarray(doc.indices), len(doc.dictionary)
        least = lists(*_least(h, code[row], scheme), docs)
        lead = np.full(len(code), -1)
        lead[np.unique(code, return_index=True)[1]] = np.unique(code)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("chunk"), pa.array(lengths.astype(np.int64)), pa.array(sums), least.take(pa.array(lead, mask=lead < 0))], ["doc", "chunk", "n", "sum", "least"])


def _least(h: np.ndarray, own: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each owner in each bin."""
    h, own = distinct(h, own)
    bin_ = h >> scheme.shift
    first = np.ones(len(h), bool)
    first[1:] = (bin_[1:] != bin_[:-1]) | (own[1:] != own[:-1])
    return h[first], own[first]


def _sums(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Of each of n rows the sum over its shingles, modulo 2**64; rows ascend."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)))
    at = np.searchsorted(row, np.arange(n + 1))
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def _joints(batches, n: int, scheme: Scheme):
    """Shingles across the ends of chunks: of each document of the batch their sum and the least in each bin."""
    for batch in batches:
        h, row = shingles(*ragged(batch.column("wh")), n)
        doc = batch.column("doc").dictionary_encode()
        code, docs = np.asarray(doc.indices), len(doc.dictionary)
        own = code[row]
        order = np.argsort(own, kind="stable")
        sums = _sums(h[order], own[order], docs)
        yield pa.RecordBatch.from_arrays([doc.dictionary, pa.array(sums), lists(*_least(h, own, scheme), docs)], ["doc", "sum", "least"])


def _merge(batches, scheme: Scheme):
    """Signature and band keys of each document, from rows of partial minima that come sorted by document. Only the last document is carried on."""

    def signed(docs: list[str], h: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        signature = scheme.signature(h, row, len(docs))
        s1, s2 = scheme.sketch(signature)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(s1), pa.array(s2), lists(scheme.keys(signature).ravel(), np.repeat(np.arange(len(docs)), scheme.bands), len(docs))], ["doc", "s1", "s2", "keys"])

    held: str | None = None
    held_h = np.empty(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        values, offsets = ragged(batch.column("least"))
        coded = batch.column("doc").dictionary_encode()
        docs, row = coded.dictionary.to_pylist(), np.repeat(np.asarray(coded.indices).astype(np.int64), np.diff(offsets))
        if held is not None:
            if docs[0] != held:
                docs, row = [held, *docs], row + 1
            values, row = np.concatenate((held_h, values)), np.concatenate((np.zeros(len(held_h), np.int64), row))
        h, row = _least(values, row, scheme)
        last = row == len(docs) - 1
        held, held_h = docs[-1], h[last]
        if len(docs) > 1:
            yield signed(docs[:-1], h[~last], row[~last])
    if held is not None:
        yield signed([held], held_h, np.zeros(len(held_h), np.int64))


def _shingled(batches, n: int):
    for batch in batches:
        h, row = shingles(*ragged(batch.column("wh")), n)
        h, row = distinct(h, row)
        yield pa.RecordBatch.from_arrays([batch.column("version").take(pa.array(row)), pa.array(h.view(np.int64))], ["version", "h"])


class HistoryIndex:
    """The stored index at a path of the shared folder; a new one of its own if none is given."""

    SHAPES = {
        "bands": "key long, text long, part int",
        "signatures": "text long, doc string, s1 long, s2 long, call string, part int",
        "accepted": f"text long, doc string, at {AT}, part int",
        "hashes": f"hash string, at {AT}, part int",
        "words": "doc string, at int, chunk string, wh array<long>, call string, part int",
        "joints": "doc string, wh array<long>, call string, part int",
    }

    def __init__(self, spark: SparkSession, path: str | None = None, shingle: int = 5, similarity: float = 0.8, min_words: int = 1, bands: int = 32, rows: int = 4, wave: int = 8, partitions: int = 8):
        """wave: texts of a bucket that are met first; partitions: parts of each table, the same for all calls."""
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}").rstrip("/")
        self.shingle, self.similarity, self.min_words, self.wave, self.partitions = shingle, similarity, min_words, wave, partitions
        self.scheme = Scheme(bands, rows)

    # the tables

    def _part(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.partitions)).cast("int")

    def _append(self, name: str, rows: DataFrame, by: str, call: str | None = None) -> None:
        # written where the rows are: a shuffle by part would put a hot key into one task
        rows = rows.withColumn("part", self._part(by))
        rows = rows if call is None else rows.withColumn("call", F.lit(call))
        rows.write.mode("append").partitionBy(*(["part"] if call is None else ["call", "part"])).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        fs, p = file_system(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(self.SHAPES[name]).parquet(f"{self.path}/{name}") if fs.exists(p) else self.spark.createDataFrame([], self.SHAPES[name])

    def delete(self) -> None:
        fs, p = file_system(self.spark, self.path)
        fs.delete(p, True)

    # documents from chunks

    def _scan(self, chunks: DataFrame, docs: DataFrame) -> DataFrame:
        rows = chunks.select(F.col("document_id").alias("doc"), F.coalesce("metadata.chunk_index", F.lit(0)).alias("at"), F.col("chunk_id").alias("chunk"), "chunk_text").where("doc is not null")
        return rows.join(maybe_broadcast(docs), "doc", "left_semi").select("doc", "at", "chunk", word_hashes(F.col("chunk_text")).alias("wh"))

    def _joint_words(self, scanned: DataFrame) -> DataFrame:
        """(doc, wh): at the start of each chunk, the words before it in its document and its own first ones.

        A document's chunks are put in order within blocks; what the blocks end with is put in order in a second, far smaller step.
        """
        n = self.shingle - 1
        edges = [F.slice("wh", 1, n).alias("head"), F.slice("wh", F.greatest(F.lit(1), F.size("wh") - n + 1), n).alias("tail")] if n else [F.array().cast("array<long>").alias(c) for c in ("head", "tail")]
        rows = scanned.where(F.size("wh") > 0).select("doc", "at", "chunk", *edges).dropDuplicates(["doc", "chunk"]).withColumn("block", F.expr(f"at div {BLOCK}"))

        def before(col: str, w) -> Column:
            words = F.concat(*[F.coalesce(F.lag(col, k).over(w), F.array().cast("array<long>")) for k in range(n, 0, -1)])
            return F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.lit(n))

        inner = rows.withColumn("prev", before("tail", W.partitionBy("doc", "block").orderBy("at", "chunk")))
        ends = inner.groupBy("doc", "block").agg(F.max_by(F.concat("prev", "tail"), F.struct("at", "chunk")).alias("end"))
        ends = ends.withColumn("end", F.slice("end", F.greatest(F.lit(1), F.size("end") - n + 1), F.lit(n)))
        carry = ends.withColumn("carry", before("end", W.partitionBy("doc").orderBy("block"))).where(F.size("carry") > 0).select("doc", "block", "carry")
        short = F.size("prev") < n
        full = inner.where(~short).select("doc", F.concat("prev", "head").alias("wh"))
        lacking = inner.where(short).join(carry, ["doc", "block"], "left").withColumn("all", F.concat(F.coalesce("carry", F.array().cast("array<long>")), "prev"))
        lacking = lacking.select("doc", F.concat(F.slice("all", F.greatest(F.lit(1), F.size("all") - n + 1), F.lit(n)), "head").alias("wh"))
        return full.unionAll(lacking).where(F.size("wh") > n)

    def sign(self, chunks: DataFrame, docs: DataFrame, call: str) -> tuple[DataFrame, DataFrame]:
        """Signs the given documents (doc) and stores their words. Gives those with enough words, (doc, text), where text is one number
        for all documents of the same shingles, and one signature of each text, (text, doc, s1, s2, keys)."""
        self._append("words", self._scan(chunks, docs), "doc", call)
        words = self.read("words").where(F.col("call") == call)
        self._append("joints", self._joint_words(words), "doc", call)
        joints = self.read("joints").where(F.col("call") == call)
        scanned = words.select("doc", "chunk", "wh").mapInArrow(partial(_chunks, scheme=self.scheme, n=self.shingle), "doc string, chunk string, n long, sum long, least array<long>").persist(StorageLevel.MEMORY_AND_DISK)
        cross = joints.mapInArrow(partial(_joints, n=self.shingle, scheme=self.scheme), "doc string, sum long, least array<long>")
        whole = F.sum(F.col("sum").cast("decimal(38,0)"))
        own = scanned.select("doc", "chunk", "n", "sum").dropDuplicates(["doc", "chunk"]).groupBy("doc").agg(F.sum("n").alias("n"), whole.alias("own")).where(F.col("n") >= max(self.min_words, self.shingle))
        over = cross.groupBy("doc").agg(whole.alias("over"))
        modulus = F.lit(Decimal(2**64)).cast("decimal(38,0)")
        texts = written(own.join(over, "doc", "left").select("doc", F.xxhash64("n", F.pmod(F.col("own") + F.coalesce("over", F.lit(0)), modulus)).alias("text")))
        # one document stands for its text
        stand = texts.groupBy("text").agg(F.min("doc").alias("doc"))
        partial_rows = scanned.where("least is not null").select("doc", "least").unionAll(cross.select("doc", "least"))
        signed = partial_rows.repartition("doc").sortWithinPartitions("doc").mapInArrow(partial(_merge, scheme=self.scheme), "doc string, s1 long, s2 long, keys array<long>")
        return texts, written(signed.join(stand, "doc"))

    # probing

    def similar(self, asked: DataFrame, call: str) -> DataFrame:
        """(new, text): stored texts that reach the similarity with the texts of this call, (text, doc, s1, s2, keys). The earliest accepted one of each is always among them.

        In each bucket a new text first meets the bucket's few earliest accepted texts; only where none of these is similar does it
        meet the others, so a hot bucket of like texts costs little.
        """
        keyed = asked.select(F.col("text").alias("new"), F.explode("keys").alias("key")).persist(StorageLevel.MEMORY_AND_DISK)
        parts = [r[0] for r in keyed.select(self._part("key")).distinct().collect()]
        rows = self.read("bands").where(F.col("part").isin(parts)).select("key", "text")
        hits = rows.join(maybe_broadcast(keyed.select("key").distinct()), "key", "left_semi").dropDuplicates(["key", "text"]).persist(StorageLevel.MEMORY_AND_DISK)
        big = hits.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > self.wave).select("key").persist(StorageLevel.MEMORY_AND_DISK)
        hot = not big.isEmpty()
        first = hits
        if hot:
            big = maybe_broadcast(big)
            since = self.read("accepted").groupBy("text").agg(F.min("at").alias("at"))
            crowd = hits.join(big, "key", "left_semi").join(since, "text").persist(StorageLevel.MEMORY_AND_DISK)
            early = crowd.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("at", "text"))).where(F.col("rank") <= self.wave).select("key", "text").persist(StorageLevel.MEMORY_AND_DISK)
            first = hits.join(big, "key", "left_anti").unionByName(early)
        met = written(keyed.join(first, "key").where("new <> text").select("key", "new", "text"))
        one = self.verified(met.select("new", "text").distinct(), asked, call)
        if not hot:
            return one
        one = written(one)
        done = met.join(one, ["new", "text"], "left_semi").select("key", "new").distinct()
        open_ = keyed.join(big, "key", "left_semi").join(done, ["key", "new"], "left_anti").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        behind = crowd.select("key", "text").join(early, ["key", "text"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALT)).cast("int"))
        rest = open_.join(behind, ["key", "salt"]).where("new <> text").select("new", "text").distinct()
        return one.unionAll(self.verified(rest, asked, call)).distinct()

    def verified(self, pairs: DataFrame, asked: DataFrame, call: str) -> DataFrame:
        """The pairs (new, text) that reach the similarity, by whole sets of shingles out of the stored words."""
        version = F.xxhash64("call", "doc")
        x = asked.select(F.col("text").alias("new"), F.col("doc").alias("dx"), F.lit(call).alias("cx"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
        # one document stands for a stored text, though several calls may have brought it
        asked_for = maybe_broadcast(pairs.select("text").distinct().withColumn("part", self._part("text")))
        stored = self.read("signatures").join(asked_for, ["part", "text"], "left_semi").groupBy("text").agg(F.min(F.struct("call", "doc", "s1", "s2")).alias("s"))
        y = stored.select("text", F.col("s.doc").alias("dy"), F.col("s.call").alias("cy"), F.col("s.s1").alias("b1"), F.col("s.s2").alias("b2"))
        far = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
        near = pairs.join(x, "new").join(y, "text").where(far <= sketch_slack(self.similarity))
        near = written(near.select("new", "text", "dx", "cx", "dy", "cy", F.xxhash64("cx", "dx").alias("x"), F.xxhash64("cy", "dy").alias("y")))
        wanted = near.select(F.explode(F.array(F.struct(F.col("dx").alias("doc"), F.col("cx").alias("call")), F.struct(F.col("dy").alias("doc"), F.col("cy").alias("call")))).alias("v")).select("v.*").distinct().withColumn("part", self._part("doc"))
        stored = self.read("words").select("part", "doc", "call", "wh").unionByName(self.read("joints").select("part", "doc", "call", "wh"))
        words = stored.join(maybe_broadcast(wanted), ["part", "doc", "call"], "left_semi").select(version.alias("version"), "wh")
        sets = words.mapInArrow(partial(_shingled, n=self.shingle), "version long, h long").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        sizes = sets.groupBy("version").agg(F.count("*").alias("size"))
        both = near.select("new", "text", "x", "y").join(sets.select(F.col("version").alias("x"), "h"), "x").join(sets.select(F.col("version").alias("y"), "h"), ["y", "h"]).groupBy("new", "text", "x", "y").agg(F.count("*").alias("both"))
        both = both.join(sizes.select(F.col("version").alias("x"), F.col("size").alias("nx")), "x").join(sizes.select(F.col("version").alias("y"), F.col("size").alias("ny")), "y")
        return both.where(F.col("both") / (F.col("nx") + F.col("ny") - F.col("both")) >= self.similarity).select("new", "text")

    # calls

    def _records(self, records: DataFrame) -> DataFrame:
        rows = records.where("record_id is not null and batch_no is not null").select(F.struct(F.col("batch_no").cast("int").alias("batch_no"), F.col("record_id").cast("bigint").alias("record_id")).alias("at"), F.col("document_id").alias("doc"), sha256_value(F.col("file_hash")).alias("hash"), is_accepted(F.col("status")).alias("ok"))
        return rows.distinct().persist(StorageLevel.MEMORY_AND_DISK)

    def _add(self, rec: DataFrame, chunks: DataFrame) -> tuple[str, DataFrame, DataFrame]:
        """Signs the records' documents and appends what is accepted; gives the name of the call, (doc, text) and the signatures."""
        call = uuid.uuid4().hex
        texts, signed = self.sign(chunks, rec.where("doc is not null").select("doc").distinct(), call)
        by_hash = rec.where("ok and hash is not null").groupBy("hash").agg(F.min("at").alias("at"))
        self._append("hashes", by_hash, "hash")
        accepted = written(rec.where("ok and doc is not null").groupBy("doc").agg(F.min("at").alias("at")).join(texts, "doc").select("text", "doc", "at"))
        # only texts that no earlier call accepted bring keys
        fresh = accepted.select("text", self._part("text").alias("part")).distinct().join(self.read("accepted").select("part", "text").distinct(), ["part", "text"], "left_anti").drop("part")
        fresh = written(signed.join(fresh, "text"))
        self._append("bands", fresh.select(F.explode("keys").alias("key"), "text"), "key")
        self._append("signatures", fresh.select("text", "doc", "s1", "s2"), "text", call)
        self._append("accepted", accepted, "text")
        return call, texts, signed

    def ingest(self, records: DataFrame, chunks: DataFrame, history: int = 0) -> DataFrame:
        """(record_id, earlier_record_id) of the records given: the first accepted record before it that it repeats, else NULL. What is accepted is appended.

        records: as in the manifest, none of them before a record of an earlier call; those of batches up to history (none by default, as
        batch numbers start at 1) are appended without a check. chunks: those of the records' documents are read, others left alone.
        """
        since = stage_mark()
        every = self._records(records)
        call, texts, signed = self._add(every, chunks)
        rec = every.where(F.col("at.batch_no") > history)
        hashed = rec.where("hash is not null").withColumn("part", self._part("hash")).select("part", "hash", "at")
        by_hash = self.read("hashes").join(maybe_broadcast(hashed.select("part", "hash").distinct()), ["part", "hash"], "left_semi").groupBy("hash").agg(F.min("at").alias("first"))
        hit = hashed.join(by_hash, "hash").where("first < at").select("at", "first")

        asked = rec.select("at", "doc").join(texts, "doc").persist(StorageLevel.MEMORY_AND_DISK)
        similar = written(self.similar(signed.join(asked.select("text").distinct(), "text", "left_semi"), call))
        wanted = asked.select("text").unionAll(similar.select("text")).distinct().withColumn("part", self._part("text"))
        stored = self.read("accepted").join(maybe_broadcast(wanted), ["part", "text"], "left_semi").groupBy("text", "doc").agg(F.min("at").alias("first"))
        # the two earliest accepted documents of each text: one of them is another document than the record's own
        early = written(stored.withColumn("rank", F.row_number().over(W.partitionBy("text").orderBy("first"))).where("rank <= 2").drop("rank"))
        same = asked.join(early.select("text", "first", F.col("doc").alias("other")), "text").where("other <> doc and first < at").select("at", "first")
        best = similar.join(early.groupBy("text").agg(F.min("first").alias("first")), "text").groupBy("new").agg(F.min("first").alias("first")).withColumnRenamed("new", "text")
        near = asked.join(best, "text").where("first < at").select("at", "first")
        found = hit.unionAll(same).unionAll(near).groupBy("at").agg(F.min("first").alias("first"))
        out = rec.select("at").distinct().join(found, "at", "left").select("at.record_id", F.col("first.record_id").alias("earlier_record_id"))
        out = settled(out, since)
        return out


def check(manifest: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """(record_id, earlier_record_id) of every record of a later batch (1 and up), in one call to an index of its own that is deleted afterwards."""
    index = HistoryIndex(manifest.sparkSession, **options)
    out = index.ingest(manifest, chunks)
    index.delete()
    return out
