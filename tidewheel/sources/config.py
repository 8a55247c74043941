"""Configuration files as validated rows: sources, profiles, constraints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidewheel import lexicons as L
from tidewheel.operators.opportunities import ReaderConstraints
from tidewheel.operators.profile import Profile
from tidewheel.sources.feeds import PARSERS

try:
    import yaml
except ImportError:  # JSON is YAML too
    yaml = None

SOURCE_SCHEMA = "ord int, name string, kind string, section string, url string, quality_tier string, prestige double, promo_risk double, paywalled boolean"


def read_text(spark: SparkSession, path: str) -> str:
    """A small file through Spark's reader, whatever store it is in."""
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def parse(text: str) -> dict:
    """YAML, or JSON where no YAML reader is installed."""
    return (yaml.safe_load(text) if yaml else json.loads(text)) or {}


def sources(spark: SparkSession, text: str) -> DataFrame:
    """Source specifications in the order of the file; unknown sections and kinds raise."""
    rows = []
    for k, s in enumerate(parse(text).get("sources", [])):
        if s.get("section") not in L.SECTIONS:
            raise ValueError(f"unknown section {s.get('section')!r} of source {s.get('name')!r}")
        if s.get("kind", "rss") not in PARSERS:
            raise ValueError(f"unknown source kind {s.get('kind')!r}")
        number = lambda key: None if s.get(key) is None else float(s[key])  # noqa: E731, B023
        rows.append((k, s["name"], s.get("kind", "rss"), s["section"], s.get("url"), s.get("quality_tier"), number("prestige_score"), number("promo_risk"), bool(s.get("paywalled", False))))
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def reader_profile(text: str) -> Profile:
    """The reader's profile."""
    p = parse(text)
    return Profile(p.get("bio", ""), list(p.get("keywords", [])), list(p.get("context_keywords", [])), {k: float(v) for k, v in (p.get("weights") or {}).items()}, list(p.get("seed_works", [])), {k: float(v) for k, v in (p.get("priorities") or {}).items()})


def constraints(text: str) -> ReaderConstraints:
    """The reader's constraints on opportunities; texts are stripped, empty entries go."""
    p = parse(text)
    listed = lambda key: [str(x).strip() for x in p.get(key, []) or [] if str(x).strip()]
    return ReaderConstraints(listed("opportunity_types"), listed("event_types"), listed("event_formats"), listed("event_regions"), str(p.get("country", "")).strip(), str(p.get("institution_type", "")).strip(), int(p.get("minimum_lead_days", 0)), str(p.get("career_stage", "")).strip(), str(p.get("applicant_role", "")).strip())


def scoring_enabled(caps: dict[str, int], section: str) -> bool:
    """Whether a section takes part: research always, others with a cap."""
    return section == "research" or caps.get(section, 0) > 0
