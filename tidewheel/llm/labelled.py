"""Bounded samples of labelled documents for training, drawn without shuffling any text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.scratch import cut

#: Bound on the labelled rows, and on the bytes of text, that a fit takes.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 20_000_000
#: Rows of the sampled label table at most; the table is shared with the executors.
KEY_BITS = 31


def held_out(doc_id: str = "doc_id"):
    """True for rows that training must not see: crc32 of doc_id as text, modulo 3, is 1. Null counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _order():
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << KEY_BITS))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of a bounded hash sample of both classes, in a fixed order, and the share of label 1 among all eligible rows.

    Only rows outside the held-out third count, with a label of 0 or 1 and a
    doc_id, which may be of any simple type. Each class gives up to half of
    ``rows``. A doc_id that has several labels is left out where they differ; of
    several texts of one the one of the smallest hash counts. The label table is
    sampled by a hash threshold first, so what is shared with the executors has
    about ``rows`` rows. One job reads ``docs`` and leaves the sample as a table; of
    it, texts that ``size`` has no more room for, in the order of the hash, are left
    out whole.
    """
    spark = docs.sparkSession
    known = labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", "y")
    known = known.where(~held_out()).withColumn("h", _order())
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = []
    for y, n in sorted(counts.items()):
        edge = (1 << KEY_BITS) if n <= rows // 2 else int((1 << KEY_BITS) * (rows // 2) / n)
        # the share of its class's threshold at which a row comes in
        picked.append(known.where((F.col("y") == y) & (F.col("h") < edge)).select(F.col("doc_id").cast("string").alias("key"), "y", (F.col("h") / edge).alias("at")))
    if not picked:
        return [], 0.0
    sample = picked[0]
    for more in picked[1:]:
        sample = sample.unionByName(more)
    ids = spark.createDataFrame([tuple(r) for r in sample.collect()], "key string, y int, at double")
    texts = docs.select(F.col("doc_id").cast("string").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc") == F.col("key"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    found = cut(texts.groupBy("key", "y", "at").agg(one["text"].alias("text")), "sample")
    fits, used = [], 0
    for r in sorted(found.select("at", "key", F.octet_length("text").alias("size")).collect()):
        if used + r["size"] <= size:
            fits.append((r.key,))
            used += r["size"]
    chosen = found.join(F.broadcast(spark.createDataFrame(fits, "key string")), "key", "left_semi").select("at", "key", "text", "y")
    return [(r.text, int(r.y)) for r in sorted(chosen.collect())], counts.get(1, 0) / sum(counts.values())
