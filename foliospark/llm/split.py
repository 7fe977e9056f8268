"""Cutting oversized texts into overlapping pieces by content-defined chunking.

A rolling hash over the last characters marks landmarks; the strongest landmark of the allowed window is snapped to
the nearest natural boundary in it. Both depend only on nearby text, so an edit alters only the pieces around it.

Defined cases: NULL and blank texts give no piece; a text within the size gives one; a text without any natural
boundary is cut at the landmark, never before a combining mark. Repeated rows count once by id. Texts are taken whole.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import strip

#: Places where text may be cut, the most natural first. A match ends where the next piece may begin.
BOUNDARIES = [regex.compile(p) for p in (r"\n[ \t]*\n\s*", r"(?:[.!?…।؟][\"'”’»)\]]*\s+|[。！？][」』”’]*|(?:ครับ|ค่ะ)\s*)", r"\n\s*", r"[;:,،；：，、]\s*", r"\s+")]
#: Characters the rolling hash covers.
REACH = 32


def _landmarks(text: str) -> np.ndarray:
    """The rolling hash that ends at each character."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    h = np.zeros(len(code), np.uint64)
    for k in range(min(REACH, len(code))):
        h[k:] += code[: len(code) - k] << np.uint64(k)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pieces(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Start and end of each piece of a text. A piece starts overlap characters before the end of the one before it."""
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    strength = _landmarks(text)
    places = [np.array([m.end() for m in p.finditer(text)], np.int64) for p in BOUNDARIES]
    out, start = [], 0
    while n - start > size:
        low, high = start + least, start + size
        mark = low + int(np.argmax(strength[low - 1 : high])) if high > low else high
        end = 0
        for at in places:
            at = at[np.searchsorted(at, low) : np.searchsorted(at, high, "right")]
            if len(at):
                end = int(at[np.argmin(np.abs(at - mark))])
                break
        if not end:
            end = mark
            while end > low and regex.match(r"\p{M}", text[end]):
                end -= 1
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def _split(batches, size: int, overlap: int, least: int):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        cuts = [pieces(t or "", size, overlap, least) for t in texts]
        row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        kept = [batch.column(i).take(pa.array(row)) for i in range(batch.num_columns - 1)]
        flat = [(i, k, a, b) for i, c in enumerate(cuts) for k, (a, b) in enumerate(c)]
        new = [pa.array([f[k] for f in flat], pa.int32()) for k in (1, 2, 3)] + [pa.array([texts[i][a:b] for i, _, a, b in flat], pa.string())]
        yield pa.RecordBatch.from_arrays(kept + new, batch.schema.names[:-1] + ["piece_no", "start_pos", "end_pos", "piece_text"])


def split_oversized(df: DataFrame, id_col: str, text_col: str, keep: dict | None = None, size: int = 900, overlap: int = 75, least: int = 300) -> DataFrame:
    """(id, *keep, piece_no, start_pos, end_pos, piece_text): every text without outer white space, in pieces of at most size characters.

    keep: columns that each piece carries, by name. Positions count code points of the stripped text.
    """
    if not 0 <= overlap < least <= size:
        raise ValueError("0 <= overlap < least <= size")
    given = df.select(F.col(id_col).alias(id_col), *[c.alias(k) for k, c in (keep or {}).items()], strip(F.col(text_col)).alias("text")).where(F.col("text") != "")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    once = given.withColumn("_long", F.char_length("text") > size)
    # only the long ones go through Python
    short = once.where(~F.col("_long")).select(*given.columns[:-1], F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), F.char_length("text").alias("end_pos"), F.col("text").alias("piece_text"))
    long = once.where("_long").drop("_long").mapInArrow(partial(_split, size=size, overlap=overlap, least=least), ", ".join(fields) + ", piece_no int, start_pos int, end_pos int, piece_text string")
    return short.unionAll(long).dropDuplicates([id_col, "piece_no"])
