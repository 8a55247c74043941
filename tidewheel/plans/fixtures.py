"""Concepts of the engine as views of the supplied tables, in Spark and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
SOURCES = ["nature", "science advances", "arXiv cs.LG", "bioRxiv", "OpenAlex topics", "PubMed search", "ACS Nano", "Journal of Odd Results", "ChemRxiv", "cell reports", "STAT News", "company blog", "BBC", "Review Weekly", "medRxiv", "nature methods", "arXiv physics", "small (wiley)", "press release wire", "The Lancet"]
SECTIONS = ["research", "industry", "regulatory", "world"]
#: Openings that make the lexical rules bite on invented prose.
OPENINGS = ["", "A breakthrough first-in-class approval with survival benefit", "Novel CRISPR method and assay", "Sponsored webinar: register now", "Editorial perspective", "Please subscribe or log in", "Pivotal phase 3 trial results", "A review of safety and efficacy", "Correction to an earlier paper", "Landmark result", "De novo dataset atlas", "News & views podcast"]


def as_of():
    """The reference time of all queries."""
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at) -> object:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items."""
    d = F.col("doc_id")
    opening = _pick(OPENINGS, F.floor(d / 7))
    body = F.concat(opening, F.when(opening == "", "").otherwise(". "), F.col("text"))
    df = table(spark, sf_dir, "documents").select(d.alias("item_id"), body.alias("text"), "lang", _pick(SOURCES, d).alias("source"), _pick(SECTIONS, F.floor(d / 20)).alias("section"), F.timestamp_seconds(F.lit(1704067200) + (d * 37 % 720) * 3600).alias("published_at"))
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return df.select("*", title.alias("title"), F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)").alias("abstract"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ITEMS_SQL = f"""
items0 AS (SELECT doc_id AS item_id, CASE WHEN o = '' THEN text ELSE o || '. ' || text END AS text, lang,
    {_sql_list(SOURCES)}[(doc_id % {len(SOURCES)} + 1)::INT] AS source, {_sql_list(SECTIONS)}[(doc_id // 20 % {len(SECTIONS)} + 1)::INT] AS section,
    make_timestamp((1704067200 + (doc_id * 37 % 720) * 3600) * 1000000) AS published_at
  FROM (SELECT *, {_sql_list(OPENINGS)}[(doc_id // 7 % {len(OPENINGS)} + 1)::INT] AS o FROM documents)),
items AS (SELECT *, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract FROM items0)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as graded votes."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("vote_id"), (2 * F.col("quality") - 1).alias("value"), F.when(F.col("toxic") == 1, 10).when(F.col("quality") == 1, 70).otherwise(40).alias("grade"), at.alias("created_at"))


VOTES_SQL = """
votes AS (SELECT doc_id AS item_id, doc_id AS vote_id, 2 * quality - 1 AS value,
    CASE WHEN toxic = 1 THEN 10 WHEN quality = 1 THEN 70 ELSE 40 END AS grade, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS created_at FROM labels)"""


def event_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a vote log with many votes per item (the user)."""
    value = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("vote_id"), value.alias("value"), F.col("ts").alias("created_at"), "event_type")


EVENT_VOTES_SQL = """
event_votes AS (SELECT user_id AS item_id, event_id AS vote_id,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS value, ts AS created_at, event_type FROM events),
latest_event_vote AS (SELECT * FROM event_votes QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, vote_id DESC) = 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as items with vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vectors as facets of a profile."""
    i = F.col("item_id")
    return vectors(spark, sf_dir).where("item_id < 5").select(i.alias("facet_id"), "vec", (F.lit(0.6) + i * 0.2).alias("weight"), (i * 0.2).alias("priority"))


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose item has a vote, graded in -1..1."""
    grade = (F.col("grade") - 50) / F.lit(50.0)
    return vectors(spark, sf_dir).join(votes(spark, sf_dir).select("item_id", grade.alias("grade")), "item_id").select("item_id", "vec", "grade", F.abs("grade").alias("weight"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that were viewed in the last week."""
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "view") & (F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < as_of()))
    return e.select(F.col("user_id").alias("item_id")).distinct()


VECTORS_SQL = f"""
v AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
facets AS (SELECT item_id AS facet_id, vec AS f, 0.6::DOUBLE + item_id * 0.2::DOUBLE AS weight, item_id * 0.2::DOUBLE AS priority FROM v WHERE item_id < 5),
exemplars AS (SELECT item_id AS ex_id, vec AS e, (g - 50) / 50.0::DOUBLE AS grade, abs(g - 50) / 50.0::DOUBLE AS weight FROM v
  JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 10 WHEN quality = 1 THEN 70 ELSE 40 END AS g FROM labels) ON doc_id = item_id),
shown AS (SELECT DISTINCT user_id AS item_id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF}')"""


def slates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as slates with scores and labels."""
    label = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("digest_id"), F.col("l_linenumber").cast("long").alias("item_id"), F.col("l_extendedprice").alias("score"), label.alias("label"), F.col("l_quantity").alias("quantity"))


SLATES_SQL = """
slates AS (SELECT l_orderkey AS digest_id, l_linenumber::BIGINT AS item_id, l_extendedprice AS score,
    CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END AS label, l_quantity AS quantity FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY score DESC, item_id) AS rank FROM slates)"""


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as impressions: a digest a day, runs by type."""
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("digest_id"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("run_id"), F.col("event_id").alias("impression_id"), F.col("user_id").alias("item_id"), F.col("ts").alias("created_at"), F.lit("research").alias("section"), F.col("event_type").isin("view", "click").alias("viewed"), (F.col("event_id") % 2 == 0).alias("selected"), (F.col("user_id") % 7).cast("string").alias("primary_facet"), (F.col("value") / 100).alias("primary_score"))


IMPRESSIONS_SQL = """
impressions AS (SELECT strftime(ts, '%Y-%m-%d') AS digest_id, 'r' || (event_id % 3)::VARCHAR AS run_id, event_id AS impression_id, user_id AS item_id, ts AS created_at,
    event_type IN ('view', 'click') AS viewed, event_id % 2 = 0 AS selected, (user_id % 7)::VARCHAR AS primary_facet, value / 100 AS primary_score FROM events),
last_run AS (SELECT digest_id, run_id FROM impressions QUALIFY row_number() OVER (PARTITION BY digest_id ORDER BY created_at DESC, impression_id DESC) = 1)"""


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with a base score out of their id, adjusted, with bucket and tier."""
    from tidewheel.functions import quality, text

    df = items(spark, sf_dir)
    base = F.lit(0.4) + (F.col("item_id") * 7919 % 1000) / F.lit(2000.0)
    body = text.item_text(F.col("title"), F.col("abstract"))
    score = quality.adjusted_score(base, body, F.col("title"), F.col("source"), F.col("section"))
    return df.select("item_id", "section", "source", "published_at", "title", "abstract", base.alias("base"), F.round(score, 6).alias("score"), quality.source_bucket(F.col("source"), F.col("section")).alias("bucket"), quality.tier_by_name(F.col("source"), F.col("section")).alias("tier"), text.content_type(body, F.col("section")).alias("content"))


def simple_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with a score out of their id only, for selection queries."""
    return items(spark, sf_dir).select("item_id", "section", "source", ((F.col("item_id") * 7919 % 1009) / F.lit(1009.0)).alias("score"))


SIMPLE_SQL = f"{ITEMS_SQL}, simple AS (SELECT item_id, section, source, (item_id * 7919 % 1009) / 1009.0::DOUBLE AS score FROM items)"
