"""Candidate pools: time windows, exclusions, gates, retention."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel.functions import phrases, quality, terms, text
from tidewheel.operators.latest import latest

DEADLINE = ["opportunity", "event", "opportunities", "events"]


def recent_items(items: DataFrame, as_of: Column, days: int, section: str = "section", published: str = "published_at", fetched: str = "fetched_at") -> DataFrame:
    """Items of the window: deadline sections by fetch time, others by publication (a day ahead at most), undated ones by fetch time."""
    cut = as_of - F.make_dt_interval(F.lit(days))
    p, f = F.col(published), F.col(fetched)
    return items.where((F.col(section).isin(DEADLINE) & (f >= cut)) | ((p >= cut) & (p <= as_of + F.make_dt_interval(F.lit(1)))) | (p.isNull() & (f >= cut)))


def enabled_sections(items: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Items of sections with a cap above 0; research always."""
    return items.where(F.col("section").isin(["research"] + [s for s, c in caps.items() if c > 0]))


def exclude_reviewed(items: DataFrame, votes: DataFrame, key: str = "item_id") -> DataFrame:
    """Items whose latest vote is missing or +1."""
    bad = latest(votes, [key], ["created_at", "vote_id"]).where("value != 1")
    return items.join(bad.select(key), key, "left_anti")


def exclude_shown(items: DataFrame, slates: DataFrame, impressions: DataFrame, changes: DataFrame, since: Column, key: str = "item_id") -> DataFrame:
    """Items not shown since a time, by slate or viewed impression; changed after their last showing, they return.

    ``slates`` and ``impressions`` have (key, shown_at), ``changes`` (key, observed_at).
    """
    shown = slates.select(key, "shown_at").unionByName(impressions.select(key, "shown_at")).where(F.col("shown_at") >= since).groupBy(key).agg(F.max("shown_at").alias("shown_at"))
    changed = changes.groupBy(key).agg(F.max("observed_at").alias("observed_at"))
    stale = shown.join(changed, key, "left").where(F.col("observed_at").isNull() | (F.col("observed_at") <= F.col("shown_at")))
    return items.join(stale.select(key), key, "left_anti")


def exclude_ids(items: DataFrame, known: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that are not in a set."""
    return items.join(known.select(key).distinct(), key, "left_anti")


def restrict_ids(items: DataFrame, wanted: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that are in a set."""
    return items.join(wanted.select(key).distinct(), key, "left_semi")


def add_carryover(pool: DataFrame, items: DataFrame, pins: DataFrame, digest_id: str, key: str = "item_id") -> DataFrame:
    """The pool and behind it items pinned by other digests that it lacks."""
    pinned = items.join(pins.where(F.col("pinned_digest_id") != digest_id).select(key).distinct(), key, "left_semi")
    return pool.unionByName(pinned.join(pool.select(key), key, "left_anti").select(pool.columns))


def skip_reason() -> Column:
    """Why an item must not be ranked at all, else null; reads title, abstract, section, source."""
    title, body = F.trim(F.coalesce(F.col("title"), F.lit(""))), text.item_text(F.col("title"), F.col("abstract"))
    research = F.lower(F.col("section")) == "research"
    marked = lambda c, patterns: reduce(or_, [c.rlike(p) for p in patterns])
    opinion = terms.term_counts(body)["commentary"] > 0
    news = (text.novelty(body, F.col("source"), F.col("title")) >= 0.24) | (terms.term_counts(body)["method"] > 0)
    return F.when(title == "", "empty").when(research & F.lower(title).isin(L.SKIP_TITLES), "masthead").when(research & marked(body, phrases.FRONT_MATTER), "cover").when(research & marked(title, phrases.NOT_RESEARCH), "not_research").when(research & opinion & ~news, "commentary")


def quality_gate(items: DataFrame, least_rows: int = 10) -> DataFrame:
    """Add ``drop_reason``: the first failing rule, null for items that pass; pools of few rows pass whole."""
    title, good = F.trim(F.coalesce(F.col("title"), F.lit(""))), quality.tier_by_name(F.col("source"), F.col("section")).isin("top", "high", "strong")
    rule = F.when((F.length(title) < 15) & ~good, "short_title").when(title.rlike(phrases.BLOCKED_TITLES), "blocked_title").otherwise(F.coalesce(skip_reason(), F.when((F.lower(F.col("section")) == "research") & (F.length(F.coalesce(F.col("abstract"), F.lit(""))) < 30) & ~good, "short_abstract")))
    few = items.limit(least_rows).count() < least_rows
    return items.withColumn("drop_reason", F.lit(None).cast("string") if few else rule)


def off_topic(items: DataFrame, floors: tuple[float, float, float, float] = (0.65, 0.45, 0.58, 0.58)) -> DataFrame:
    """Items that clear their section's topic floor; those without a topic score pass."""
    research, news, calls, events = floors
    t, neg, conf = F.col("topic_score"), F.coalesce(F.col("negative"), F.lit(0.0)), F.col("confidence")
    sec = F.lower(F.col("section"))
    ok = F.when(t.isNull(), True).when(sec == "research", t + quality.venue_credit(F.col("source"), F.col("section")) - neg >= research).when(sec == "opportunities", t - neg >= calls).when(sec == "events", t - neg >= events).otherwise(F.coalesce(conf, t) >= news)
    return items.where(ok)


def keyword_search(items: DataFrame, query: str, columns: list[str], limit: int = 500) -> DataFrame:
    """Rows with the query as a case-insensitive substring of a column, newest first."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return items.where(found).orderBy(F.col("created_at").desc(), "item_id").limit(min(limit, 500))


def retained(items: DataFrame, before: Column, references: list[DataFrame], stamp: str, key: str) -> DataFrame:
    """Old rows that nothing refers to any more: what pruning deletes."""
    old = items.where(F.col(stamp) < before)
    for r in references:
        old = old.join(r.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return old


_STOP = {"en": ["the", "and", "of", "to", "in", "is", "that"], "de": ["der", "die", "und", "das", "von", "zu"], "fr": ["le", "la", "les", "de", "et", "des"], "es": ["el", "la", "de", "que", "y", "los"]}


def looks_english(body: Column) -> Column:
    """Stop-word vote among four languages; texts under 20 characters pass. An approximation: no detector is installed."""
    words = F.regexp_extract_all(F.lower(body), F.lit(r"\p{L}+"), F.lit(0))
    count = lambda lang: F.size(F.filter(words, lambda w: w.isin(_STOP[lang])))
    return (F.length(F.coalesce(body, F.lit(""))) < 20) | (count("en") >= F.greatest(*[count(x) for x in ("de", "fr", "es")]))


def supply(items: DataFrame, top_research: int) -> DataFrame:
    """One row on whether enough was fetched: items, research items, research families, ok."""
    research = F.lower(F.col("section")) == "research"
    row = items.agg(F.count("*").alias("items"), F.count_if(research).alias("research"), F.count_distinct(F.when(research, F.col("family"))).alias("families"))
    return row.withColumn("ok", (F.col("items") > 0) & (F.col("research") >= max(10, min(top_research, 15))) & (F.col("families") >= 2))


def drop_histogram(gated: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent drop reasons."""
    return gated.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "drop_reason").limit(top)


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Rows of each stage of the funnel."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def ranked_rows(df: DataFrame, by: list[Column], into: str = "pos", partition: list[str] | None = None) -> DataFrame:
    """Number rows from 1 in an order, per partition."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*by)
    return df.withColumn(into, F.row_number().over(w))
