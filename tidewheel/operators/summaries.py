"""Summaries of a slate: which are due, in which batches, whose they are, and what a reader missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import extractive_summary

#: Items of one request to a summariser, lines of a briefing, and days away from which one is due.
BATCH, BRIEFING_LINES, BRIEFING_DAYS = 6, 60, 3
VERSION = 1


def signature(backend: str = "extractive", model: str = "", address: str = "", bio: str = "", keywords: tuple[str, ...] = ()) -> Column:
    """Hash of all that may change a summary: the item's texts, who writes it, and for whom.

    Reads title, abstract, source and section; null counts as empty. Model and address
    count only for writers that have them, so a change of an unused setting keeps summaries.
    """
    writer = [str(VERSION), backend, model if backend != "extractive" else "", address if backend in ("api", "anthropic") else "", bio, "\x1f".join(keywords)]
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "source", "section")]
    return F.sha2(F.concat_ws("\x1e", *parts, *[F.lit(w) for w in writer]), 256)


def due(slate: DataFrame, stored: DataFrame, sign: Column) -> DataFrame:
    """Rows of a slate whose stored summary (item_id, summary, summary_signature) is missing, blank or of another signature."""
    have = stored.where(F.trim("summary") != "").select("item_id", F.col("summary_signature").alias("signature"))
    return slate.withColumn("signature", sign).join(have, ["item_id", "signature"], "left_anti")


def batched(rows: DataFrame, by: str = "digest_id", size: int = BATCH) -> DataFrame:
    """Add ``batch``: rows of each digest by item_id, ``size`` to a request."""
    at = F.row_number().over(Window.partitionBy(by).orderBy("item_id")) - 1
    return rows.withColumn("batch", F.floor(at / size).cast("int"))


def with_provenance(rows: DataFrame, written: DataFrame, backend: str) -> DataFrame:
    """(item_id, summary, summary_backend): what ``backend`` wrote (item_id, summary), else the extract, named as the fallback that it is.

    A batch that failed, ran out of time or left an item out has no or a blank
    summary there; with the extractive backend the extract is no fallback.
    """
    done = written.where(F.trim("summary") != "").groupBy("item_id").agg(F.max("summary").alias("_s"))
    extract = extractive_summary(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    own, other = F.col("_s").isNotNull(), "extractive" if backend == "extractive" else "extractive_fallback"
    return rows.join(done, "item_id", "left").select("item_id", F.when(own, F.col("_s")).otherwise(extract).alias("summary"), F.when(own, backend).otherwise(other).alias("summary_backend"))


def store(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items with the summaries, signatures and backends of ``done`` (item_id, summary, summary_signature, summary_backend) in place of theirs."""
    columns = ["summary", "summary_signature", "summary_backend"]
    new = done.select("item_id", F.struct(*columns).alias("_new"))
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c) if c in items.columns else F.lit(None).cast("string"))
    return items.join(new, "item_id", "left").withColumns({c: value(c) for c in columns}).drop("_new")


def briefing(slate: DataFrame, days_away: int) -> DataFrame:
    """(digest_id, listing): a line per item, ``BRIEFING_LINES`` by position at most, to tell a returning reader what they missed; no rows after a short gap."""
    line = F.concat(F.lit("- "), F.trim(F.coalesce("title", F.lit(""))), F.lit(" ("), F.trim(F.coalesce("source", F.lit(""))), F.lit(")"))
    rows = slate if days_away >= BRIEFING_DAYS else slate.limit(0)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("digest_id").orderBy("position", "item_id"))).where(F.col("_n") <= BRIEFING_LINES)
    lines = F.array_sort(F.collect_list(F.struct("_n", line.alias("line"))))
    return first.groupBy("digest_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("listing"))


def mark_sent(digests: DataFrame, digest_id: str, at: Column) -> DataFrame:
    """Digests with one marked as sent."""
    return digests.withColumn("sent_at", F.when(F.col("digest_id") == digest_id, at).otherwise(F.col("sent_at")))


def was_sent(digests: DataFrame, digest_id: str) -> bool:
    """Whether a digest has a time of sending."""
    return not digests.where((F.col("digest_id") == digest_id) & F.col("sent_at").isNotNull()).isEmpty()
