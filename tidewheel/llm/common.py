"""Text buffers as numpy arrays, shared by the Arrow functions of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.scratch import cut

#: Bytes of text that one vectorised step handles; a longer single text is one step.
STEP_BYTES = 2_000_000


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (lo, hi) whose texts hold about ``limit`` bytes; a range has one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (one at least) of an odd base modulo 2**64, and those of its inverse."""
    rows = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, 1), b, np.uint64)
        p[0] = 1
        rows.append(np.multiply.accumulate(p))
    return rows[0], rows[1]


def ranked(values: DataFrame, column: str) -> DataFrame:
    """Add ``rank``, from 0, by code point with null last: a sort into ranges, and the sizes of the ranges before."""
    placed = cut(values.orderBy(F.col(column).isNull(), column).withColumn("place", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    return placed.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + at).drop("place", "part", "before")
