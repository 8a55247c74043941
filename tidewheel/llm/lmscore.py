"""Cross-entropy difference between a target and a background n-gram model.

Both models count the same tokens, the bytes of UTF-8 text, with one vocabulary,
the same orders 1 to ``ORDER``, tables and interpolation weights; they differ in
the rows counted: the background counts every row, the target the rows marked as
such. n-grams are counted under their own bytes, none share a count: the table of
``ORDER``-grams lies in the shared folder and grows with the corpus, and shorter
n-grams are sums of it. Each task sums its own counts before anything is shuffled.
A text's loss at a byte follows from the ``ORDER``-gram that ends there, so the
losses of all of them are shared with the executors in blocks, of which a task
holds one at a time. A document's score is its mean loss in bits per byte under
the target minus that under the background: the lower, the more it is like the
target.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import buffers, steps
from tidewheel.scratch import cut

ORDER = 4
#: Bits of each order's key: the n-gram's own bytes.
SLOT_BITS = (8, 16, 24, 32)
#: Shares of the uniform law and of orders 1 to 4.
WEIGHTS = (0.02, 0.08, 0.2, 0.3, 0.4)
#: n-grams whose losses a task holds at once.
BLOCK_GRAMS = 1 << 22
#: Distinct n-grams that a counting task holds before it hands on what it has.
HELD_GRAMS = 1 << 20

Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each byte, its last byte lowest, and each byte's place in its text.

    Bytes before the start of a text count as 0.
    """
    raw = data[offsets[0] : offsets[-1]].astype(np.uint32)
    sizes = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = raw.copy()
    for k in range(1, ORDER):
        prior = np.zeros_like(raw)
        prior[k:] = raw[:-k] if k < len(raw) else prior[k:]
        prior[place < k] = 0
        gram |= prior << np.uint32(8 * k)
    return gram, place


def _merged(parts: list[Counts]) -> Counts:
    """Counts of several tables as one, by key."""
    key, n, aimed = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n[order], first), np.add.reduceat(aimed[order], first)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per n-gram of one partition of (text, target)."""

    def flush(key: np.ndarray, n: np.ndarray, aimed: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(key), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(key[part].astype(np.int64)), pa.array(n[part]), pa.array(aimed[part])], ["gram", "background", "target"])

    held: list[Counts] = []
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        marks = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for lo, hi in steps(offsets):
            own, _ = grams(data, offsets[lo : hi + 1])
            if not len(own):
                continue
            key, n = np.unique(own, return_counts=True)
            part, m = np.unique(own[np.repeat(marks[lo:hi], np.diff(offsets[lo : hi + 1]))], return_counts=True)
            aimed = np.zeros_like(n)
            aimed[np.searchsorted(key, part)] = m
            held.append((key, n, aimed))
            if sum(len(h[0]) for h in held) > HELD_GRAMS:
                held = [_merged(held)]
                if len(held[0][0]) > HELD_GRAMS // 2:
                    yield from flush(*held.pop())
    if held:
        yield from flush(*_merged(held))


def count(docs: DataFrame) -> DataFrame:
    """(gram, background, target): how often each ORDER-gram ends in all rows, and in target rows, of ``docs`` (text, target)."""
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_counter, "gram long, background long, target long")
    return cut(parts.groupBy("gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "grams")


def loss_table(counts: DataFrame) -> DataFrame:
    """(gram, background, target, first_background, first_target): bits at the last byte of each ORDER-gram, and where it starts a text.

    A shorter n-gram's count is the sum over the n-grams that end with it; its
    context is the n-gram before it. A text's first byte has no context: the orders
    above the first give their share to how many texts open so, of all texts.
    """
    models = ("background", "target")
    gram = F.col("gram")
    out = counts.select("gram", *[F.col(m).alias(f"n{ORDER}_{m}") for m in models])
    for k in range(1, ORDER):
        mask = (1 << SLOT_BITS[k - 1]) - 1
        shorter = counts.groupBy(gram.bitwiseAND(F.lit(mask)).alias("_key")).agg(*[F.sum(m).alias(m) for m in models])
        for name, key in (("n", gram), ("c", F.shiftrightunsigned(gram, 8))):
            side = shorter.select("_key", *[F.col(m).alias(f"{name}{k}_{m}") for m in models])
            side = F.broadcast(side) if k < 3 else side  # 65,536 rows at most
            out = out.join(side, key.bitwiseAND(F.lit(mask)) == F.col("_key"), "left").drop("_key")
    opens = gram < 256  # nothing before the byte
    sums = counts.agg(*[F.sum(m).alias(m) for m in models], *[F.sum(F.when(opens, F.col(m))).alias(f"first_{m}") for m in models]).first()
    bits = {}
    for m in models:
        n = [F.coalesce(f"n{k}_{m}", F.lit(0)) for k in range(1, ORDER + 1)]
        base = F.lit(WEIGHTS[0] / 256) + F.lit(WEIGHTS[1] / max(sums[m] or 0, 1)) * n[0]
        p, start = base, base + F.lit(sum(WEIGHTS[2:]) / max(sums[f"first_{m}"] or 0, 1)) * F.when(opens, n[-1]).otherwise(0)
        for k in range(1, ORDER):
            p = p + WEIGHTS[k + 1] * n[k] / F.greatest(F.coalesce(f"c{k}_{m}", F.lit(0)), n[k], F.lit(1))
        bits |= {m: (-F.log2(p)).cast("float"), f"first_{m}": (-F.log2(start)).cast("float")}
    return out.select("gram", *[bits[c].alias(c) for c in (*models, *[f"first_{m}" for m in models])])


def loss_blocks(table: DataFrame, limit: int = BLOCK_GRAMS) -> Iterator[Counts]:
    """The table as (sorted keys, background, target) arrays, in blocks of about ``limit`` n-grams."""
    parts = -(-table.count() // limit)
    for k in range(parts):
        part = table if parts == 1 else table.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k)
        got = part.select("gram", "background", "target").toArrow()
        key = got["gram"].to_numpy()
        order = np.argsort(key)
        yield key[order].astype(np.uint32), got["background"].to_numpy()[order], got["target"].to_numpy()[order]


def losses(data: np.ndarray, offsets: np.ndarray, blocks: Iterable[Counts], first: np.ndarray) -> np.ndarray:
    """Mean loss in bits per byte of each text, background then target; 0 for an empty text. ``first`` has the losses of each first byte."""
    sizes = np.diff(offsets)
    out = np.zeros((2, len(sizes)))
    some = np.flatnonzero(sizes)
    out[:, some] = first[:, data[offsets[:-1][some]]]
    for key, *bits in blocks:
        if not len(key):
            continue
        for lo, hi in steps(offsets):
            gram, place = grams(data, offsets[lo : hi + 1])
            at = np.minimum(np.searchsorted(key, gram), len(key) - 1)
            there = np.flatnonzero((key[at] == gram) & (place > 0))
            owner = np.repeat(np.arange(hi - lo), sizes[lo:hi])[there]
            for m in (0, 1):
                out[m, lo:hi] += np.bincount(owner, bits[m][at[there]], hi - lo)
    return out / np.maximum(sizes, 1)


def _one_by_one(shared: list[Broadcast]) -> Iterator[Counts]:
    """The values of ``shared``; where there are several, each is let go before the next is read from disk."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            vars(b).pop("_value", None)


def with_target_scores(docs: DataFrame, targets: DataFrame, block: int = BLOCK_GRAMS) -> DataFrame:
    """Add ``lm``: struct(n_tokens, target_loss, background_loss, score) for every whole text.

    ``targets`` holds the doc_id of the target rows; repeated ids count once, null
    ids never match. Null and empty texts add nothing and get zeros. Repeated rows
    count, and are scored, each. Without target rows the target model is its uniform
    share alone. Other columns pass; one named ``lm`` is replaced.
    """
    marks = targets.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    # one plan at every size: sort-merge, whose disk use follows the input; sharing the ids while they are few would give way to it later
    marked = docs.select("doc_id", "text").join(marks.hint("merge"), F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("target"))
    table = cut(loss_table(count(marked)), "losses")
    first = np.zeros((2, 256))
    for r in table.where("gram < 256").select("gram", "first_background", "first_target").collect():
        first[:, r[0]] = r[1:]
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in loss_blocks(table, block)]
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score")]])

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        background, target = losses(data, offsets, _one_by_one(shared), first)
        return pa.StructArray.from_arrays([pa.array(np.diff(offsets)), pa.array(target), pa.array(background), pa.array(target - background)], kind.fieldNames())

    return docs.withColumn("lm", score("text"))
