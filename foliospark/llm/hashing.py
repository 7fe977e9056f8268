"""Words, shingles and one-permutation minwise signatures over Arrow batches.

The JVM reads words and hashes each to 64 bits; Python only sees arrays of integers and works on whole
batches with numpy, never row by row.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters and digits; combining marks belong to their letter, underscores separate.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
#: Soft hyphen, zero-width characters, word joiner, byte order mark.
INVISIBLE = r"[\u00AD\u200B-\u200F\u2060\uFEFF]"

U = np.uint64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of integer lists; a NULL list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    values = np.asarray(column.flatten()).astype(np.int64, copy=False).view(U)
    return values, np.concatenate(([0], np.cumsum(lengths)))


def shingles(values: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n consecutive words. Rows of under n words have none."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    if len(values) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    last = len(values) - n + 1
    h = np.zeros(last, U)
    for k in range(n):
        h = mix64(h * U(0x9E3779B97F4A7C15) + values[k : k + last] + U(k + 1))
    within = row[:last] == row[n - 1 :]
    return h[within], row[:last][within]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different hashes, ascending."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number per row that depends on its words and their order."""
    lengths = np.diff(offsets)
    place = np.arange(len(values)) - np.repeat(offsets[:-1], lengths)
    each = mix64(values + mix64((place + 1).astype(U) * U(0x9E3779B97F4A7C15)))
    total = np.concatenate((np.zeros(1, U), np.cumsum(each, dtype=U)))
    return mix64(total[offsets[1:]] - total[offsets[:-1]] + mix64(lengths.astype(U)))


class Scheme:
    """bands x rows bins of one-permutation hashing, filled by optimal densification.

    A pair of similarity s shares a band key with probability 1 - (1 - s**rows)**bands.
    """

    def __init__(self, bands: int = 32, rows: int = 4):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        if self.bins & (self.bins - 1) or self.bins < 64:
            raise ValueError("bands x rows must be a power of two of at least 64")
        self.shift = U(64 - self.bins.bit_length() + 1)

    def signature(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """n x bins: the least hash in each bin. h and row ascend as distinct() leaves them.

        An empty bin takes the value of a bin found by a hash of its own number and the attempt, the same
        for all rows, until that bin is not empty. Rows without hashes get zeros.
        """
        out = np.zeros((n, self.bins), U)
        full = np.zeros((n, self.bins), bool)
        bin_ = (h >> self.shift).astype(np.int64)
        first = np.ones(len(h), bool)
        first[1:] = (bin_[1:] != bin_[:-1]) | (row[1:] != row[:-1])
        out[row[first], bin_[first]] = h[first]
        full[row[first], bin_[first]] = True
        some = full.any(axis=1)
        r, b = np.nonzero(~full & some[:, None])
        attempt = 0
        while len(r):
            attempt += 1
            at = (mix64((b + attempt * self.bins).astype(U)) % U(self.bins)).astype(np.int64)
            hit = full[r, at]
            out[r[hit], b[hit]] = out[r[hit], at[hit]]
            r, b = r[~hit], b[~hit]
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """n x bands keys; the band is part of its key."""
        part = signature.reshape(len(signature), self.bands, self.rows)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=U), part.shape[:2]).copy()
        for k in range(self.rows):
            key = mix64(key * U(0x9E3779B97F4A7C15) + part[:, :, k])
        return key

    def sketch(self, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One bit of each of 128 bins, as two numbers. A bin agrees with probability (1 + similarity) / 2."""
        take = np.resize(np.arange(self.bins), 128)
        bits = (mix64(signature[:, take]) & U(1)).astype(np.uint8)
        packed = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)
        return packed[:, 0].copy(), packed[:, 1].copy()


def sketch_slack(similarity: float) -> int:
    """Differing sketch bits up to which a pair may still reach the similarity: four deviations of a short text above what is expected."""
    return int(64 * (1 - similarity) + 26)


def lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n rows as lists; rows ascend."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))
