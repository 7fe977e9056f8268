"""Mixing sources to target shares of a token budget, by weighted sampling without replacement.

Every document gets the exponential key -ln(u) / w of Efraimidis and Spirakis, u from a hash of its id and w its quality
weight. A source contributes complete epochs while its budget holds one, at most max_repeats in all; what is left of the budget is
filled in key order. Only the key interval in which a budget ends is ever sorted.

Defined cases: sources are read without case and outer blanks; documents of no target source, of NULL source or NULL id take
no part; NULL and empty texts have size 0; a source without documents has size 0, and all of it is taken at once; a NULL share or
number of repeats is 0; ties of the key go by id; empty tables give empty plans, and shares of 0.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import maybe_broadcast, strip, written

#: Public byte-level vocabulary for many languages; its path is a parameter of everything below.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Key intervals per source.
INTERVALS = 1024

_encodings: dict = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _sizes(batches, path: str):
    enc = encoding(path)
    for batch in batches:
        ids = [enc.encode_ordinary(t) if t else [] for t in batch.column("text").to_pylist()]
        # variety of tokens, on logarithms so that long texts aren't held poorer than short ones
        quality = [np.log1p(len(set(x))) / np.log1p(len(x)) if x else 0.0 for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(np.array([len(x) for x in ids], np.int64)), pa.array(np.array(quality, float))], ["id", "source", "tokens", "quality"])


class Mixture:
    def __init__(self, documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER, seed: int = 42, budget: int | None = None):
        """budget: the size of the mix in tokens; the size of all documents of the target sources if None."""
        from functools import partial

        self.seed, self.budget = seed, budget
        self.targets = targets.select(F.lower(strip(F.col("source"))).alias("source"), F.col("source").alias("given"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).where("source is not null")
        self.kind = documents.select(id_col).schema[0].dataType.simpleString()
        named = documents.select(F.col(id_col).alias("id"), F.lower(strip(F.col(source_col))).alias("source"), F.col(text_col).alias("text")).where("id is not null").join(maybe_broadcast(self.targets.select("source").distinct()), "source", "left_semi")
        self.sized = named.select("id", "source", "text").mapInArrow(partial(_sizes, path=tokenizer), f"id {self.kind}, source string, tokens long, quality double").persist(StorageLevel.MEMORY_AND_DISK)

    def sizes(self) -> DataFrame:
        """(source, given, target_share, max_repeats, tokens, total): a row for each target source."""
        own = self.sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        rows = self.targets.join(own, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        total = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
        return rows.crossJoin(F.broadcast(total))

    def _budgets(self) -> DataFrame:
        size = F.lit(self.budget) if self.budget is not None else F.col("total")
        s = self.sizes().withColumn("wanted", F.floor(F.col("target_share") * size))
        epochs = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("wanted") / F.col("tokens")), F.col("max_repeats"))).otherwise(F.col("max_repeats"))
        s = s.withColumn("epochs", epochs)
        return s.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("wanted") - F.col("epochs") * F.col("tokens")).otherwise(0))

    def plan(self) -> DataFrame:
        """(id, source, tokens, copies): how often each document is taken; documents not taken have no row."""
        budgets = maybe_broadcast(self._budgets().select("source", "epochs", "rest"))
        u = (F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        keyed = self.sized.join(budgets, "source").withColumn("key", -F.log(u) / F.greatest("quality", F.lit(1e-6)))
        keyed = keyed.withColumn("slice", F.floor(INTERVALS * (1 - F.exp(-F.col("key") * 0.7))).cast("int"))
        sums = keyed.groupBy("source", "slice").agg(F.sum("tokens").alias("within"))
        before = sums.withColumn("before", F.sum("within").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
        placed = keyed.join(maybe_broadcast(before), ["source", "slice"])
        full = placed.where(F.col("before") + F.col("within") <= F.col("rest")).withColumn("extra", F.lit(1))
        ends = placed.where((F.col("before") + F.col("within") > F.col("rest")) & (F.col("before") <= F.col("rest")))
        running = F.sum("tokens").over(W.partitionBy("source", "slice").orderBy("key", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
        ends = ends.withColumn("extra", (F.col("before") + running <= F.col("rest")).cast("int"))
        none = placed.where(F.col("before") > F.col("rest")).withColumn("extra", F.lit(0))
        all_ = full.unionByName(ends).unionByName(none)
        return all_.select("id", "source", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, share, tokens, documents, epochs, short): what the plan reaches, for every target source.

        short: the plan takes all documents of the source max_repeats times, and they come to less than its share of the budget.
        """
        got = written(self.plan().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.count("*").alias("documents")))
        size = F.lit(self.budget) if self.budget is not None else F.col("total")
        rows = self._budgets().withColumn("size", size).select("source", "given", "target_share", "max_repeats", "epochs", "size").join(F.broadcast(got), "source", "left").withColumns({"got": F.coalesce("got", F.lit(0)), "documents": F.coalesce("documents", F.lit(0))})
        total = got.agg(F.sum("got").alias("all"))
        short = (F.col("epochs") >= F.col("max_repeats")) & (F.col("got") < F.col("target_share") * F.col("size"))
        share = F.when(F.col("all") > 0, F.col("got") / F.col("all")).otherwise(0.0)
        return rows.crossJoin(F.broadcast(total)).select(F.col("given").alias("source"), "target_share", share.alias("share"), F.col("got").alias("tokens"), "documents", F.col("epochs").cast("int").alias("epochs"), short.alias("short"))
