"""Continuous ingestion: each micro-batch of new files goes through the batch plan, with the manifest as its memory.

The file source knows paths, the manifest knows contents: a file that arrives again unchanged is skipped, a changed one replaces its
chunks. A micro-batch that is run again after a failure finds its files in the manifest, so nothing is counted twice.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Collection
from ..plans.ingest import ingest
from ..sources.files import supported


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)


def start(spark: SparkSession, path: str, collection: Collection, manifest_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Ingests what is there and stops, or goes on with processing_time='10 seconds'."""
    every = options.pop("processing_time", None)

    def batch(df: DataFrame, _: int) -> None:
        ingest(df.sparkSession, supported(df), collection, manifest_path, **options)

    writer = stream_files(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
