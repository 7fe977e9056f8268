"""A collection of embedded chunks as a versioned table: insert, delete, replace, truncate, count.

Rows lie in buckets by hash of their document; a version is a small numbered file that names the folders of each bucket, and the
highest number is the current one. A change writes the buckets it touches and then its version file, which appears whole by a rename that
fails if the number is taken: readers see all of a change or nothing of it, a job that dies leaves the old version in place, and of
two writers at once one gets an error.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_system


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows without those whose key is among the keys."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of each key in new are replaced by the new ones."""
    return deleted(rows, new, key).unionByName(new, allowMissingColumns=True)


def inserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K5: new rows whose key isn't there yet are added."""
    return rows.unionByName(new.dropDuplicates([key]).join(rows.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


class Versions:
    """Numbered files of a folder, each published whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> tuple[int, dict]:
        """The highest number and what it says; 0 and nothing if there is none."""
        numbers = self.numbers()
        if not numbers:
            return 0, {}
        fs, p = file_system(self.spark, f"{self.path}/versions/{numbers[-1]:012d}")
        stream = fs.open(p)
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, after: int, what: dict) -> int:
        """Makes the next number say this; an error if another writer was faster."""
        number = after + 1
        fs, p = file_system(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        _, to = file_system(self.spark, f"{self.path}/versions/{number:012d}")
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise RuntimeError(f"version {number} of {self.path} was published by another writer")
        return number

    def forget(self) -> None:
        """Deletes all numbers but the highest."""
        for n in self.numbers()[:-1]:
            fs, p = file_system(self.spark, f"{self.path}/versions/{n:012d}")
            fs.delete(p, False)


class Collection:
    """S17, S18, K5, U5-U7, A3 on a folder that the whole cluster sees."""

    def __init__(self, spark: SparkSession, path: str, schema, by: str = "document_id", buckets: int = 64):
        """by: the column whose hash is a row's bucket; buckets: how many there are, fixed when the collection is first written."""
        self.spark, self.path, self.schema, self.by, self.buckets = spark, path.rstrip("/"), schema, by, buckets
        self.versions = Versions(spark, path)

    def _bucket(self):
        return F.coalesce(F.pmod(F.xxhash64(self.by), F.lit(self.buckets)), F.lit(0)).cast("int")

    def _rows(self, folders: dict[str, list[str]], buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{f}" for b, own in sorted(folders.items()) if buckets is None or b in buckets for f in own]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.versions.latest()[1].get("folders", {}))

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """The folders that the rows were written to, by bucket."""
        at = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/{at}")
        fs, p = file_system(self.spark, f"{self.path}/{at}")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {n.removeprefix("bucket="): [f"{at}/{n}"] for n in names if n.startswith("bucket=")}

    def _change(self, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrites the buckets that the keys fall in, all if the key is another column."""
        number, about = self.versions.latest()
        folders = about.get("folders", {})
        touched = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()} if key == self.by else set(folders)
        made = self._write(change(self._rows(folders, [b for b in folders if b in touched])))
        return self.versions.publish(number, {"folders": {b: f for b, f in folders.items() if b not in touched} | made})

    def add(self, new: DataFrame, key: str = "chunk_id") -> int:
        """Rows whose key isn't there yet, beside the others: nothing is rewritten."""
        number, about = self.versions.latest()
        folders = about.get("folders", {})
        made = self._write(new.dropDuplicates([key]).join(self._rows(folders).select(key).distinct(), key, "left_anti"))
        return self.versions.publish(number, {"folders": {b: folders.get(b, []) + made.get(b, []) for b in {*folders, *made}}})

    def delete(self, keys: DataFrame, key: str = "document_id") -> int:
        return self._change(keys, key, lambda rows: deleted(rows, keys, key))

    def replace(self, new: DataFrame, key: str = "document_id") -> int:
        return self._change(new, key, lambda rows: replaced(rows, new, key))

    def reset(self) -> int:
        """U6."""
        return self.versions.publish(self.versions.latest()[0], {"folders": {}})

    def count(self) -> int:
        """A3."""
        return self.read().count()

    def vacuum(self) -> int:
        """Deletes what the current version doesn't name; returns how many folders."""
        named = {f for own in self.versions.latest()[1].get("folders", {}).values() for f in own}
        gone = 0
        fs, p = file_system(self.spark, f"{self.path}/data")
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            for bucket in fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in named:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        self.versions.forget()
        return gone


def missing_as_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})
