"""Schemas of stored tables."""

from pyspark.sql import types as T

from ..sources.files import CHUNK, METADATA

#: An embedded chunk.
EMBEDDED = T.StructType([CHUNK["chunk_id"], CHUNK["chunk_text"], T.StructField("document_id", T.StringType()), T.StructField("metadata", METADATA), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedding_model", T.StringType())])
