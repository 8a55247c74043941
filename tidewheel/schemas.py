"""Declared schemas of the persistent tables, and their additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "items": "item_id long, source string, section string, external_id string, url string, title string, abstract string, authors string, published_at timestamp, fetched_at timestamp, metadata map<string,string>, summary string, score double, digest_id string, item_label string",
    "opportunity_snapshots": "item_id long, details map<string,string>, details_hash string, observed_at timestamp",
    "votes": "vote_id long, item_id long, value int, grade int, created_at timestamp",
    "bookmarks": "item_id long, created_at timestamp",
    "deck_days": "day string, note_ids array<string>",
    "known_items": "item_id long, created_at timestamp",
    "carryover_items": "item_id long, pinned_digest_id string, created_at timestamp",
    "item_embeddings": "item_id long, signature string, text_hash string, vec array<float>",
    "item_enrichment": "item_id long, cited_by_count int, venue_impact double, venue string, fetched_at timestamp",
    "digests": "digest_id string, item_count int, sent_at timestamp, created_at timestamp",
    "digest_item_features": "digest_id string, item_id long, final_score double, features map<string,double>",
    "digest_audits": "digest_id string, audit_type string, payload string",
    "digest_items": "digest_id string, item_id long, label string, score double",
    "impressions": "impression_id long, run_id string, digest_id string, item_id long, section string, position int, score double, selected boolean, viewed boolean, primary_facet string, primary_score double, topic_score double, created_at timestamp",
    "runs": "run_id string, stage string, status string, detail string, created_at timestamp",
}


def schema(name: str) -> T.StructType:
    """The declared schema of a table."""
    return T.StructType.fromDDL(TABLES[name])


def migrate(df: DataFrame, name: str) -> DataFrame:
    """A table of an older schema in today's: missing columns are null, others are cast; unknown ones go."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)])
