"""URL and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that canonical URLs drop, and more that normalised ones drop.
FEED_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
CLICK_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid"]
#: Fixed value: journal issue suffix of a title.
ISSUE_SUFFIX = r"(?i)\s*\((?:adv\.?\s*mater\.?|small|angew\.?\s*chem\.?|chem\.?\s*sci\.?|jacs|acs\s*nano|nano\s*lett\.?|science|nature)[^)]*\b\d{1,3}/\d{4}\)$"

#: The formats of identifiers.
DOI_URL, DOI_LABEL = r"(?i)^https?://(?:dx\.)?doi\.org/", r"(?i)^doi:\s*"
DOI_NATURE, DOI_SCIENCE = r"(?i)nature\.com/articles/([a-z0-9]+-[0-9]+-[0-9]+-[\da-z]+)", r"(?i)science\.org/doi/(10\.[0-9]{4,}/\S+)"
DOI, DOI_IN_URL = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b", r"(?i)(10\.\d{4,9}/[^\s?#]+)"
PMID_URL = r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)"
ARXIV = r"(?i)(?:arxiv:)?((?:\d{4}\.\d{4,5})|(?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}))(?:v\d+)?"

_HEAD = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Scheme, host, path and query of a URL without its fragment; empty where absent."""
    bare = F.regexp_replace(url, r"#.*$", "")
    scheme, host = F.lower(F.regexp_extract(bare, _HEAD, 1)), F.lower(F.regexp_extract(bare, _HEAD, 2))
    rest = F.regexp_replace(bare, _HEAD, "")
    return scheme, host, F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)


def _join(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no campaign keys, no trailing slashes; null stays null."""
    scheme, host, path, query = _parts(url)
    kept = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.lower(F.substring_index(kv, "=", 1)).isin(FEED_KEYS))
    return F.regexp_replace(_join(scheme, host, path, F.array_join(kept, "&")), r"/+$", "")


def _quoted(path: Column) -> Column:
    """Percent-decode, then encode all but unreserved characters and ``/:@``."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    out = F.url_encode(plain)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":"), ("%40", "@")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalized_url(url: Column) -> Column:
    """Canonical URL without ``www.`` and any tracking key, with decoded, sorted and re-encoded parameters."""
    canon = canonical_url(url)
    scheme, host, path, query = _parts(canon)
    pairs = F.filter(F.split(query, "&"), lambda kv: kv != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda kv: F.struct(decode(F.substring_index(kv, "=", 1)).alias("k"), F.when(F.contains(kv, F.lit("=")), decode(F.regexp_replace(kv, r"^[^=]*=", ""))).otherwise("").alias("v"))
    kept = F.filter(F.transform(pairs, pair), lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(CLICK_KEYS))
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    whole = F.regexp_replace(_join(scheme, F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(_quoted(path), r"/+$", ""), text), r"/+$", "")
    return F.when((scheme == "") | (host == ""), canon).otherwise(whole)


def canonical_doi(raw: Column) -> Column:
    """Bare lower-case DOI."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(raw), DOI_URL, ""), DOI_LABEL, ""))


def extract_doi(value: Column) -> Column:
    """The first DOI of an identifier or URL, publisher article paths included; else null."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)), DOI_URL, ""), DOI_LABEL, "")
    some = lambda c: F.nullif(F.lower(c), F.lit(""))
    tail = lambda c: F.regexp_replace(c, r"[.),;:]+$", "")
    nature = some(F.regexp_extract(text, DOI_NATURE, 1))
    science = some(tail(F.regexp_extract(text, DOI_SCIENCE, 1)))
    plain = some(tail(F.regexp_extract(text, DOI, 1)))
    bare = F.when(F.lower(text).startswith("10.") & F.contains(text, F.lit("/")), some(tail(text)))
    return F.coalesce(F.concat(F.lit("10.1038/"), nature), science, plain, bare)


def extract_pmid(url: Column, external_id: Column, source: Column) -> Column:
    """PubMed id from the URL, or a numeric external id of a PubMed source; else null."""
    return F.coalesce(F.nullif(F.regexp_extract(url, PMID_URL, 1), F.lit("")), F.when(F.contains(F.lower(source), F.lit("pubmed")) & external_id.rlike(r"^\d+$"), external_id))


def extract_arxiv(url: Column, external_id: Column, source: Column, legacy: bool = False) -> Column:
    """arXiv id from arXiv hosts, or from the external id of arXiv sources; else null.

    ``legacy`` applies the pattern to any URL, as older keys did; it makes different
    PubMed records share a key, so it is off by default.
    """
    one = lambda c: F.nullif(F.lower(F.regexp_extract(c, ARXIV, 1)), F.lit(""))
    on_host = url.rlike(r"(?i)^https?://([^/]*\.)?arxiv\.org/")
    last = F.when(on_host, F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)).otherwise(url)
    found = one(last) if legacy else F.when(on_host, one(last))
    return F.coalesce(found, F.when(F.contains(F.lower(source), F.lit("arxiv")), one(external_id)))


def derive_doi(url: Column, external_id: Column) -> Column:
    """DOI for enrichment: from the URL, else from the external id."""
    one = lambda c: F.nullif(F.lower(F.regexp_replace(F.regexp_extract(c, DOI_IN_URL, 1), r"[.,;)/]+$", "")), F.lit(""))
    return F.coalesce(one(url), one(external_id))


def safe_url(url: Column) -> Column:
    """The URL if it is http or https with a host, else ``#``."""
    return F.when(url.rlike(r"(?i)^https?://[^/?#]+"), url).otherwise(F.lit("#"))


def external_id(value: Column) -> Column:
    """First 16 hex digits of SHA-1."""
    return F.substring(F.sha1(F.coalesce(value, F.lit("")).cast("binary")), 1, 16)


def title_key(title: Column) -> Column:
    """Title without issue suffix, lower case, runs of other characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(title), ISSUE_SUFFIX, "")), r"[^a-z0-9]+", " "))


def title_bucket(ts: Column) -> Column:
    """Number of the 12-hour epoch window."""
    return F.floor(F.unix_timestamp(ts) / F.lit(43200)).cast("long")


def title_day_key(title: Column, ts: Column, back: int = 0) -> Column:
    """Key of a title in its 12-hour window; null for short titles and unknown times."""
    key = title_key(title)
    return F.when(F.length(key) >= 12, F.concat(F.lit("title_day:t12h:"), (title_bucket(ts) - back).cast("string"), F.lit(":"), key))


def candidate_keys(url: Column, external_id: Column, source: Column, title: Column, ts: Column) -> Column:
    """All identity keys of an item."""
    named = lambda name, c: F.concat(F.lit(name), c)
    norm = F.nullif(normalized_url(url), F.lit(""))
    return F.array_compact(F.array(named("doi:", F.coalesce(extract_doi(external_id), extract_doi(url))), named("pmid:", extract_pmid(url, external_id, source)), named("arxiv:", extract_arxiv(url, external_id, source)), named("url:", norm), title_day_key(title, ts), title_day_key(title, ts, 1)))
