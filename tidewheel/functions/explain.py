"""Explanations of a score: tags, reasons, and the payload to keep with a pick."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD = ["top", "high", "strong"]
#: Scores from which a signal is named.
NOVEL, FRESH, PROMO, ACCESS, STRONG_TOPIC, TOPIC = 0.55, 0.24, 0.35, 0.14, 0.65, 0.45


def _some(*conditions: Column, most: int | None = None) -> Column:
    found = F.array_compact(F.array(*conditions))
    return F.slice(found, 1, most) if most else found


def _source(tier: Column, good: str, preprint: str, aggregator: str, news: str) -> Column:
    return F.when(tier.isin(GOOD), good).when(tier.isin("repository", "preprint"), preprint).when(tier == "aggregator", aggregator).when(tier == "trusted-news", news)


def reason_tags(tier: Column, section: Column, novelty: Column, promo: Column, access: Column, arxiv_cs: Column) -> Column:
    """Up to five tags for readers."""
    return _some(
        _source(tier, "High-quality source", "Preprint / repository", "Aggregator source", "Trusted news"),
        F.when(novelty >= NOVEL, "High novelty").when(novelty >= FRESH, "Fresh signal"),
        F.when(F.lower(section) == "regulatory", "Regulatory update"),
        F.when(promo >= PROMO, "Promo risk"),
        F.when(access >= ACCESS, "Access friction"),
        F.when(arxiv_cs, "arXiv CS"),
        most=5,
    )


def quality_tags(tier: Column, promo: Column, access: Column, arxiv_cs: Column) -> Column:
    """Tags on the source."""
    return _some(_source(tier, "high_quality_source", "preprint_repository", "aggregator_source", "trusted_news"), F.when(promo >= PROMO, "promo_risk"), F.when(access >= ACCESS, "access_friction"), F.when(arxiv_cs, "arxiv_cs"))


def freshness_tags(novelty: Column) -> Column:
    """Tags on novelty."""
    return _some(F.when(novelty >= NOVEL, "high_novelty").when(novelty >= FRESH, "fresh_signal"))


def why_shown(topic: Column, tier: Column, novelty: Column, promo: Column, access: Column) -> Column:
    """Up to five reasons in words."""
    return _some(
        F.when(topic >= STRONG_TOPIC, "Strong topic match").when(topic >= TOPIC, "Relevant to your profile"),
        F.when(tier.isin([*GOOD, "trusted-news"]), "Reliable source"),
        F.when(novelty >= NOVEL, "High-impact new signal").when(novelty >= FRESH, "Fresh development"),
        F.when(promo >= PROMO, "Downweighted for promotional language"),
        F.when(access >= ACCESS, "Downweighted for access friction"),
        most=5,
    )


def payload(**parts: Column) -> Column:
    """JSON of named parts, numbers rounded half to even at four digits."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))


def rounded(c: Column) -> Column:
    """Four digits, half to even."""
    return F.bround(c.cast("double"), 4)
