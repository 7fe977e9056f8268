"""Embedding of texts, with a deterministic offline model: a hashed term-frequency vector of unit length.

A real model is passed as a function from a text column to a vector column, such as a pandas UDF that loads its weights once
per worker; everything else stays as it is.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexical

DIMENSIONS = 64


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _unit_counts(terms: pa.Array) -> pa.Array:
    """Counts of the terms by hash bucket as vectors of unit length, a whole batch at once; NULL for an empty list. A term is hashed once a batch."""
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    lengths = np.asarray(terms.value_lengths().fill_null(0), np.int64)
    coded = terms.flatten().dictionary_encode()
    buckets = np.array([int(hashlib.md5(t.encode(), usedforsecurity=False).hexdigest()[:7], 16) % DIMENSIONS for t in coded.dictionary.to_pylist()], np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths) * DIMENSIONS + buckets[np.asarray(coded.indices)]
    counts = np.bincount(at, minlength=len(lengths) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(float)
    norm = np.sqrt((counts**2).sum(axis=1))
    kept = norm > 0
    offsets = np.concatenate(([0], np.cumsum(kept * DIMENSIONS))).astype(np.int32)
    values = (counts[kept] / norm[kept, None]).ravel()
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~kept, False)), pa.array(values))


def hashed_vector(text: Column) -> Column:
    """Counts of the text's terms by hash bucket, divided by their length; NULL for a text without terms."""
    return _unit_counts(lexical.terms(text))


def valid_chunks(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text isn't blank."""
    return df.where(F.col(text_col).rlike(r"[^ \t\n\r\x0b\x0c]"))


def embed(df: DataFrame, text_col: str, model=hashed_vector, name: str = "hashed-64") -> DataFrame:
    """The rows with text, with their vector and the model's name."""
    return valid_chunks(df, text_col).withColumns({"embedding": model(F.col(text_col)), "embedding_model": F.lit(name)})


def valid_vectors(df: DataFrame, id_col: str, text_col: str, vector: str, metadata: list[str]) -> DataFrame:
    """Rows with id, text and a vector that isn't empty; missing metadata become empty strings."""
    kept = df.where(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "") & F.col(text_col).isNotNull() & (F.size(vector) > 0))
    return kept.withColumns({m: F.coalesce(F.col(m).cast("string"), F.lit("")) for m in metadata})
