"""Aggregates for reports: overview, health, coverage, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.scores import reading_minutes


def source_mix(items: DataFrame, by: str = "source", top: int = 6) -> DataFrame:
    """The most frequent values of a column."""
    return items.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(top)


def reading_time(items: DataFrame, text: str = "text") -> DataFrame:
    """One row: items, words, minutes."""
    sums = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+"))), F.lit(0)).cast("long").alias("words"))
    return sums.select("items", "words", reading_minutes(F.col("words"), F.col("items")).alias("minutes"))


def weekly_health(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(source, items_7d, failures_7d, last_error) of the last days; runs have source, recorded_at, run_id, items, ok, error."""
    now = runs.where((F.col("recorded_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("recorded_at") <= as_of))
    failed = ~F.col("ok")
    return now.groupBy("source").agg(F.sum("items").cast("long").alias("items_7d"), F.count_if(failed).alias("failures_7d"), F.max_by(F.when(failed, F.col("error")), F.when(failed & F.col("error").isNotNull(), F.struct("recorded_at", "run_id"))).alias("last_error"))


def trim_snapshots(snapshots: DataFrame, as_of: Column, days: int = 7, most: int = 7) -> DataFrame:
    """The newest snapshots of the last days."""
    return snapshots.where(F.col("recorded_at") >= as_of - F.make_dt_interval(F.lit(days))).orderBy(F.desc("recorded_at"), F.desc("run_id")).limit(most)


def facet_recency(impressions: DataFrame, before: Column, days: int = 7, least: float = 0.0) -> DataFrame:
    """(facet, last_seen) of viewed, selected research in the latest run of each digest before a time."""
    from tidewheel.operators.latest import latest_run

    rows = latest_run(impressions).where("viewed and selected and section = 'research' and primary_facet is not null")
    rows = rows.where((F.col("created_at") < before) & (F.col("created_at") >= before - F.make_dt_interval(F.lit(days))) & (F.col("primary_score") >= least))
    return rows.groupBy(F.lower(F.trim(F.col("primary_facet").cast("string"))).alias("facet")).agg(F.max("created_at").alias("last_seen"))


def coverage(pool: DataFrame, interests: list[str]) -> DataFrame:
    """Per interest: digests that had an eligible item, digests that selected one, and the fraction.

    ``pool`` has digest_id, interest, eligible, selected. Interests are a bounded list, so every one gets a row.
    """
    each = pool.where(F.col("interest").isin(interests)).groupBy("digest_id", "interest").agg(F.max("eligible").alias("e"), F.max(F.col("eligible") & F.col("selected")).alias("c"))
    sums = each.groupBy("interest").agg(F.count_if("e").alias("eligible"), F.count_if("c").alias("covered"))
    base = pool.sparkSession.createDataFrame([(i,) for i in interests], "interest string")
    out = base.join(sums, "interest", "left").select("interest", F.coalesce("eligible", F.lit(0)).alias("eligible"), F.coalesce("covered", F.lit(0)).alias("covered"))
    return out.withColumn("fraction", F.when(F.col("eligible") > 0, F.col("covered") / F.col("eligible")))


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def feeds_by_section(feeds: DataFrame) -> DataFrame:
    """(section, feeds, skipped): sorted feed names of each section; feeds of other kinds are counted only."""
    rss = F.col("kind") == "rss"
    return feeds.groupBy("section").agg(F.array_join(F.array_sort(F.collect_set(F.when(rss, F.col("name")))), ",").alias("feeds"), F.count_if(~rss).alias("skipped"))


def group_max(df: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """The row of each key at its largest timestamp."""
    w = Window.partitionBy(key).orderBy(F.desc(stamp), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
