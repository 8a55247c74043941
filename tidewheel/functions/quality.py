"""Source quality, buckets, and the quality-adjusted score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel.functions.text import clip, content_type, has_any, let, novelty, promotional


def is_arxiv_cs(source: Column) -> Column:
    """Whether a source names an arXiv computer-science feed."""
    return source.rlike(r"(?i)\barxiv[\s:_\-]*cs[\s:./\-]")


def tier_by_name(source: Column, section: Column) -> Column:
    """Quality tier that a source's name tells."""
    research = lambda s: F.when(F.contains(s, F.lit("openalex")), "aggregator").when(is_arxiv_cs(s), "repository").when(s.isin(L.TOP_TIER), "top").when(has_any(s, L.HIGH_TIER), "high").when(has_any(s, L.STRONG_TIER), "strong").when(has_any(s, L.REPOSITORIES + L.PREPRINT_SERVERS), "repository").otherwise("unknown")
    news = lambda s: F.when(has_any(s, L.CREDIBLE_NEWS), "trusted-news").when(has_any(s, ["press release", "company"]), "self-published").otherwise("news")
    return let(F.lower(F.trim(source)), lambda s: F.when(F.lower(section) == "research", research(s)).otherwise(news(s)))


def _prestige(tier: Column, source: Column) -> Column:
    return F.when(tier == "aggregator", 0.34).when((tier == "repository") & is_arxiv_cs(source), 0.48).when(tier == "top", 0.99).when(tier == "high", 0.90).when(tier == "strong", 0.76).when(tier == "repository", 0.56).when(tier == "unknown", L.DEFAULT_RESEARCH).when(tier == "trusted-news", 0.72).when(tier == "self-published", 0.42).otherwise(L.DEFAULT_NEWS)


def prestige_by_name(source: Column, section: Column) -> Column:
    """Prestige that a source's name tells."""
    return let(tier_by_name(source, section), lambda tier: _prestige(tier, source))


def promo_risk_by_name(source: Column, section: Column) -> Column:
    """Promotion risk that a source's name tells."""
    return F.when(tier_by_name(source, section) == "self-published", 0.35).otherwise(0.0)


def tier_prestige(tier: Column, section: Column) -> Column:
    """Prestige of a configured tier; null without one."""
    t = F.lower(F.trim(tier))
    out = F.when(F.lower(section) == "research", L.DEFAULT_RESEARCH).otherwise(L.DEFAULT_NEWS)
    for name, value in L.TIERS.items():
        out = F.when(t == name, value).otherwise(out)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("double")).otherwise(out)


def recognized_venue(venue: Column) -> Column:
    """The venue if its name is of a known top, high or strong journal, else null."""
    v = F.lower(F.trim(venue))
    return F.when(v.isin(L.TOP_TIER) | has_any(v, L.HIGH_TIER + L.STRONG_TIER), venue)


def source_bucket(source: Column, section: Column, low_impact: Column | None = None) -> Column:
    """Coarse class of a source for balancing; other sections are their own class."""
    sec = F.lower(section)

    def kind(x: Column) -> Column:
        s, tier = x["s"], x["tier"]
        out = F.when(is_arxiv_cs(s), "arxiv_cs").when(F.contains(s, F.lit("arxiv")) & ~F.contains(s, F.lit("chemrxiv")), "arxiv_other").when(has_any(s, ["biorxiv", "medrxiv"]), "bio_med_preprint").when(has_any(s, L.PREPRINT_SERVERS), "preprint_other")
        if low_impact is not None:
            out = out.when(F.coalesce(low_impact, F.lit(False)), "low_impact_journal")
        out = out.when(F.contains(s, F.lit("openalex")), "aggregator").when(F.contains(s, F.lit("pubmed")), "published_database").when(tier.isin("top", "high", "strong"), "published_journal").when(tier == "repository", "preprint_other")
        return out.when(_prestige(tier, s) < L.LOW_PRESTIGE, "low_impact_journal").otherwise("other_research")

    both = F.struct(F.lower(F.trim(source)).alias("s"), tier_by_name(source, section).alias("tier"))
    return F.when(sec == "research", let(both, kind)).when(F.coalesce(sec, F.lit("")) == "", "other").otherwise(sec)


PREPRINT_BUCKETS = ["arxiv_cs", "arxiv_other", "bio_med_preprint", "preprint_other"]


def venue_credit(source: Column, section: Column) -> Column:
    """Relevance credit of a good journal at the topic gate."""
    good = (F.lower(section) == "research") & tier_by_name(source, section).isin("top", "high", "strong")
    return F.when(good, F.lit(L.VENUE_CREDIT) * F.greatest(prestige_by_name(source, section) - L.LOW_PRESTIGE, F.lit(0.0))).otherwise(0.0)


def adjusted_score(base: Column, text: Column, title: Column, source: Column, section: Column, paywalled: Column | None = None, weight: float = L.RESEARCH_WEIGHT) -> Column:
    """Topic fit adjusted by venue quality, novelty and promotion, by section."""
    tier = tier_by_name(source, section)
    signals = F.struct(base.alias("base"), F.lower(section).alias("sec"), tier.alias("tier"), is_arxiv_cs(source).alias("cs"), prestige_by_name(source, section).alias("p"), novelty(text, source, title).alias("nov"), promotional(text, promo_risk_by_name(source, section)).alias("promo"), content_type(text, section).isin("editorial", "commentary").alias("opinion"), (F.when(paywalled, L.PAYWALL).otherwise(0.0) if paywalled is not None else F.lit(0.0)).alias("wall"))
    return let(signals, lambda s: clip(_adjusted(s, weight)))


def _adjusted(s: Column, weight: float) -> Column:
    base, p, nov, promo, tier = s["base"], s["p"], s["nov"], s["promo"], s["tier"]
    plain = (base >= 0.80) & (nov >= 0.50)
    research = base + F.lit(0.36 * weight) * F.greatest(p - L.LOW_PRESTIGE, F.lit(0.0)) * clip((base - 0.68) / F.lit(0.12)) + F.lit(0.08) * nov - F.lit(0.35) * promo
    research = research - F.when((p < L.LOW_PRESTIGE) & ~plain, F.lit(weight * 0.16) * clip((F.lit(0.82) - base) / F.lit(0.32)) + F.lit(0.10)).otherwise(0.0)
    cs = F.when(s["cs"], clip((F.lit(0.76) - base) / F.lit(0.20))).otherwise(0.0)
    research = research - F.when(((tier == "repository") | s["cs"]) & ~plain, F.greatest(F.lit(0.15) * clip((F.lit(0.76) - base) / F.lit(0.26)), F.lit(0.18) * cs)).otherwise(0.0)
    research = research - F.when(s["opinion"] & ~plain, 0.10).otherwise(0.0)
    news = base + F.lit(0.06) * p + F.lit(0.14) * nov - F.lit(0.45) * promo
    news = news - F.when(tier.isin("self-published", "low") & (base < 0.72), F.lit(0.12) * clip((F.lit(0.72) - base) / F.lit(0.24))).otherwise(0.0)
    news = news - F.when(s["opinion"], 0.12).otherwise(0.0) - s["wall"]
    other = base + F.lit(0.06) * p + F.lit(0.10) * nov - F.lit(0.15) * promo
    return F.when(s["sec"] == "research", research).when(s["sec"].isin("industry", "world"), news).when(s["sec"] == "regulatory", other - s["wall"]).otherwise(other)
