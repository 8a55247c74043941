"""Media columns: byte payloads held as coefficients of progressive JPEGs, and their decoded tensors.

A payload is UTF-8 text padded with zero bytes to a positive multiple of 64. Each
64 bytes are one block: byte minus 128 is a coefficient, in zigzag order, so the
file keeps the payload without loss while its pixels are whatever these
coefficients look like. The number of payload blocks is in the file's comment.
Reading back goes from the stored file alone: its scans are accumulated into
coefficients, which give the payload, and transformed into the tensor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewheel.llm import jpeg
from tidewheel.llm.common import buffers, steps

BLOCK = 64
#: Payload bytes coded in one go; a longer single text is coded alone.
BATCH_BYTES = 1_000_000
SCHEMA = "n_bytes long, media binary, payload binary, height int, width int, tensor binary, feature string"


def store(texts: list[np.ndarray]) -> list[bytes]:
    """The progressive JPEG of each text's payload."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
    layout = jpeg.Layout.of(*jpeg.grid(blocks))
    coef = np.zeros((int(layout.first[-1]), BLOCK), np.int16)
    for t, n, a in zip(texts, blocks, layout.first, strict=False):
        own = np.zeros(n * BLOCK, np.uint8)
        own[: len(t)] = t
        coef[a : a + n] = own.reshape(-1, BLOCK).astype(np.int16) - 128
    return jpeg.encode(coef, layout, [b"blocks=%d" % n for n in blocks])


def load(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and RGB tensor (height, width, 3) of each file."""
    coef, layout, heads = jpeg.decode(files)
    tensors = jpeg.pixels(coef, layout, heads)
    out = []
    for h, a, tensor in zip(heads, layout.first, tensors, strict=False):
        n = int(h.note.removeprefix(b"blocks="))
        out.append(((coef[a : a + n] + 128).astype(np.uint8).tobytes(), tensor))
    return out


def feature(tensor: np.ndarray) -> str:
    """Size, and mean and deviation of each colour, as text."""
    flat = tensor.reshape(-1, 3).astype(np.float64)
    return f"{tensor.shape[0]}x{tensor.shape[1]};" + ";".join(f"{m:.2f}/{d:.2f}" for m, d in zip(flat.mean(0), flat.std(0), strict=True))


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = [("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("tensor", pa.binary()), ("feature", pa.string())]
    for batch in batches:
        kind = pa.schema([("doc_id", batch.column(0).type), *made])
        data, offsets = buffers(batch.column(1))
        for lo, hi in steps(offsets, BATCH_BYTES):
            files = store([data[a:b] for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)])
            back = load(files)
            cols = [batch.column(0).slice(lo, hi - lo), np.diff(offsets[lo : hi + 1]), files, [p for p, _ in back], [t.shape[0] for _, t in back], [t.shape[1] for _, t in back], [t.tobytes() for _, t in back], [feature(t) for _, t in back]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the stored file, and what reading it gives.

    Columns: doc_id, n_bytes (of the text), media (the file), payload, height,
    width, tensor (uint8, height x width x 3), feature. Null and empty texts have
    one block of zeros; equal texts give equal values; repeated rows are kept;
    a doc_id of any type, null too, passes. Other columns are not read. Memory follows the longest
    single text.
    """
    return docs.select("doc_id", "text").mapInArrow(_convert, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
