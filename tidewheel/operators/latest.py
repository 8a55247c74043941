"""Latest-row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, nulls first; ties are broken by the order's later columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_value(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key, aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_run(impressions: DataFrame) -> DataFrame:
    """All impressions of each digest's latest run."""
    runs = impressions.groupBy("digest_id").agg(F.max_by("run_id", F.struct("created_at", "impression_id")).alias("run_id"))
    return impressions.join(runs, ["digest_id", "run_id"], "left_semi")


def last_seen(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """Group maximum of a timestamp."""
    return df.groupBy(key).agg(F.max(stamp).alias("last_seen"))


def least_recently_shown(keys: DataFrame, shown: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n keys shown longest ago, never shown first; ties by a seeded hash."""
    last = last_seen(shown, key, "shown_at")
    draw = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    return keys.join(last, key, "left").orderBy(F.col("last_seen").asc_nulls_first(), draw).limit(n)


def days_since(df: DataFrame, stamp: str, as_of) -> DataFrame:
    """Whole days since the last timestamp; -1 without any."""
    return df.agg(F.max(stamp).alias("t")).select(F.coalesce(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("t")) / 86400), F.lit(-1)).cast("long").alias("days"))


def chronological_split(df: DataFrame, stamp: str, key: str, fraction: float = 0.75) -> DataFrame:
    """Add ``is_train``: the first rows by (time, key), at least one left for the test.

    Positions come from counts per day, then row numbers inside a day, so no window holds all rows.
    """
    day = F.to_date(stamp)
    counts = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    places = places.withColumnRenamed("_day", "_d")
    out = df.withColumn("_day", day).join(places, F.col("_day").eqNullSafe(F.col("_d"))).drop("_d")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy(stamp, key))
    cut = F.least(F.bround(F.col("_all") * F.lit(fraction)), F.col("_all") - 1)
    return out.withColumn("is_train", place <= cut).drop("_day", "_before", "_all")
