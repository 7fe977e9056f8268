"""A saved BM25 index: postings, statistics and a fingerprint of what it was built from.

Its tables are written to a new folder, which a numbered version file then names, so that a reader never sees half an index and
always has one. Texts are read once; postings are clustered by term, so a query reads the row groups of its own terms only.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system, maybe_broadcast
from . import lexical
from .store import Versions

VERSION = 1


class LexicalIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path)
        self._held: tuple | None = None

    def _folder(self) -> str | None:
        at = self.versions.latest()[1].get("folder")
        return at and f"{self.path}/{at}"

    def build(self, corpus: DataFrame, id_col: str, text_col: str, fingerprint: str | None = None, parts: int = 8) -> bool:
        """Writes the index; an empty corpus writes nothing and gives False."""
        if corpus.limit(1).count() == 0:
            return False
        number, about = self.versions.latest()
        at = uuid.uuid4().hex
        new = f"{self.path}/{at}"
        fs, p = file_system(self.spark, new)
        try:
            corpus.select(F.col(id_col).alias("id"), lexical.terms(F.col(text_col)).alias("t")).write.parquet(f"{new}/docs")
            docs = self.spark.read.parquet(f"{new}/docs")
            posts = docs.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
            posts.repartitionByRange(parts, "term").sortWithinPartitions("term", "id").write.parquet(f"{new}/postings")
            self.spark.read.parquet(f"{new}/postings").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{new}/terms")
            docs.select("id").where("id is not null").write.parquet(f"{new}/ids")
            stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
            stats.withColumns({"fingerprint": F.lit(fingerprint).cast("string"), "version": F.lit(VERSION)}).coalesce(1).write.parquet(f"{new}/stats")
            fs.delete(file_system(self.spark, f"{new}/docs")[1], True)
            self.versions.publish(number, {"folder": at})
        except Exception:
            fs.delete(p, True)
            raise
        if about.get("folder"):
            fs.delete(file_system(self.spark, f"{self.path}/{about['folder']}")[1], True)
        self._held = None
        return True

    def about(self) -> dict | None:
        """K9: (n, avgdl, fingerprint, version) of the index on disk, None if there is none that can be read."""
        try:
            return json.loads(self.spark.read.parquet(f"{self._folder()}/stats").select(F.to_json(F.struct("*"))).first()[0])
        except Exception:  # noqa: BLE001
            return None

    def ensure(self, corpus: DataFrame, id_col: str, text_col: str, fingerprint: str) -> str:
        """Uses the index if it was built from the same files, else builds it: 'kept', 'built' or 'empty'."""
        about = self.about()
        if about and about.get("fingerprint") == fingerprint and about.get("version") == VERSION:
            return "kept"
        return "built" if self.build(corpus, id_col, text_col, fingerprint) else "empty"

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
        """As lexical.topk, from the saved tables. The index opened last is held."""
        about = self.about()
        if about is None:
            return self.spark.createDataFrame([], f"query_id {queries.select(query_id).schema[0].dataType.simpleString()}, id string, score double, rank int")
        key = self._folder()
        if self._held is None or self._held[0] != key:
            self._held = (key, *(self.spark.read.parquet(f"{key}/{t}") for t in ("postings", "terms", "ids")))
        _, posts, terms, ids = self._held
        asked = maybe_broadcast(lexical.asked_terms(queries, query_id, query_text).join(terms, "term"))
        idf = F.log(1 + (about["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") / (F.col("tf") + lexical.K1 * (1 - lexical.B + lexical.B * F.col("dl") / about["avgdl"]))
        hits = posts.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight * F.col("times")), 6).alias("score"))
        return lexical.ranked(queries, query_id, hits, ids, k)
