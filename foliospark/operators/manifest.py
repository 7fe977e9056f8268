"""The ingestion manifest as a table keyed by path: skipping unchanged files, upserts, batch summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def succeeded(status: Column) -> Column:
    return F.coalesce(status == "success", F.lit(False))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, file_hash, ...) whose path and hash aren't in the manifest with success. A NULL hash is never unchanged."""
    done = manifest.where(succeeded(F.col("status")) & F.col("file_hash").isNotNull()).select("path", "file_hash").distinct()
    return files.join(done, ["path", "file_hash"], "left_anti")


def upserted(manifest: DataFrame, outcomes: DataFrame, order: list[str]) -> DataFrame:
    """U8: the last record of each path; skipped files don't touch theirs. order: columns by which the later of two is known."""
    rows = manifest.withColumn("_new", F.lit(0)).unionByName(outcomes.where(~F.col("status").eqNullSafe("skipped")).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(rows, "path", ["_new", *order]).drop("_new")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. The window's groups hold the versions of one key only, and are cut to one row before the shuffle."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def batch_summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """A5: how many were processed, skipped and failed, and the chunks of those processed."""
    ok = succeeded(F.col("status"))
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("chunks_created"))), F.lit(0)).alias("chunks"),
    )
