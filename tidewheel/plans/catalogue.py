"""Named queries over the supplied tables, with the DuckDB SQL that must agree with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel.functions import explain, phrases, quality, scores, text, urls
from tidewheel.operators import candidates, decks, dedupe, digest, embedding, evaluation, feedback, latest, learning, opportunities, profile, ranking, reports, search, selection
from tidewheel.plans import fixtures as X
from tidewheel.plans.registry import ORACLE_SQL, query
from tidewheel.scratch import cut, shared_folder
from tidewheel.sources import commits, sinks

R6 = lambda c: F.round(c, 6)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(col: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(t)})" for t in terms) + ")"


def _hits(col: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({col}, {_q(t)})::INT" for t in terms) + ")"


# ---- shared SQL of the lexical rules

_BODY = "CASE WHEN abstract = '' THEN title ELSE title || ' ' || abstract END"
_LEX = f"""{X.ITEMS_SQL},
b AS (SELECT *, lower({_BODY}) AS low, lower(trim(source)) AS src FROM items),
t AS (SELECT *, regexp_matches(src, 'arxiv[\\s:_\\-]*cs[\\s:./\\-]') AS cs FROM b),
tier AS (SELECT *, CASE WHEN section = 'research' THEN
    CASE WHEN contains(src, 'openalex') THEN 'aggregator' WHEN cs THEN 'repository' WHEN src IN ({", ".join(map(_q, L.TOP_TIER))}) THEN 'top'
      WHEN {_any("src", L.HIGH_TIER)} THEN 'high' WHEN {_any("src", L.STRONG_TIER)} THEN 'strong' WHEN {_any("src", L.REPOSITORIES + L.PREPRINT_SERVERS)} THEN 'repository' ELSE 'unknown' END
    ELSE CASE WHEN {_any("src", L.CREDIBLE_NEWS)} THEN 'trusted-news' WHEN {_any("src", ["press release", "company"])} THEN 'self-published' ELSE 'news' END END AS tier FROM t),
p AS (SELECT *, CASE tier WHEN 'aggregator' THEN 0.34 WHEN 'top' THEN 0.99 WHEN 'high' THEN 0.90 WHEN 'strong' THEN 0.76 WHEN 'repository' THEN CASE WHEN cs THEN 0.48 ELSE 0.56 END
    WHEN 'unknown' THEN 0.42 WHEN 'trusted-news' THEN 0.72 WHEN 'self-published' THEN 0.42 ELSE 0.58 END::DOUBLE AS prestige, CASE WHEN tier = 'self-published' THEN 0.35 ELSE 0 END::DOUBLE AS risk,
    CASE WHEN section <> 'research' THEN section WHEN cs THEN 'arxiv_cs' WHEN contains(src, 'arxiv') AND NOT contains(src, 'chemrxiv') THEN 'arxiv_other' WHEN {_any("src", ["biorxiv", "medrxiv"])} THEN 'bio_med_preprint'
      WHEN {_any("src", L.PREPRINT_SERVERS)} THEN 'preprint_other' WHEN contains(src, 'openalex') THEN 'aggregator' WHEN contains(src, 'pubmed') THEN 'published_database'
      WHEN tier IN ('top', 'high', 'strong') THEN 'published_journal' WHEN tier = 'repository' THEN 'preprint_other' ELSE 'low_impact_journal' END AS bucket,
    {_hits("low", L.HIGH_NOVELTY)} AS hi, {_hits("low", L.MODERATE_NOVELTY)} AS mid, {_hits("low", L.PROMOTIONAL)} AS ads, {_hits("low", L.ACCESS_FRICTION)} AS walls,
    ({_any("low", L.METHOD_OR_RESULT)} OR regexp_matches(low, '[0-9]')) AS sub,
    (contains(src, 'review') OR regexp_matches(lower(title), '\\breview\\b')) AS rev,
    CASE {" ".join(f"WHEN {_any('low', terms)} THEN {_q(k)}" for k, terms in L.CONTENT_TYPES.items())} WHEN section = 'research' THEN 'research' ELSE 'article' END AS ctype FROM tier),
lex AS (SELECT *, CASE WHEN low = '' THEN 0 ELSE greatest(0, least(1, least(0.75::DOUBLE, hi * 0.24::DOUBLE) * CASE WHEN hi > 0 AND NOT sub THEN 0.5::DOUBLE ELSE 1 END + least(0.35::DOUBLE, mid * 0.08::DOUBLE) - CASE WHEN rev AND hi = 0 THEN 0.12::DOUBLE ELSE 0 END)) END AS nov,
    greatest(0, least(1, least(0.75::DOUBLE, ads * 0.22::DOUBLE) + least(0.35::DOUBLE, walls * 0.14::DOUBLE) + risk)) AS promo, 0.4::DOUBLE + (item_id * 7919 % 1000) / 2000.0::DOUBLE AS base FROM p),
adj AS (SELECT *, base >= 0.8 AND nov >= 0.5 AS exc, ctype IN ('editorial', 'commentary') AS op FROM lex),
adjusted AS (SELECT *, round(greatest(0, least(1, CASE section
   WHEN 'research' THEN base + (0.36 * 1.4)::DOUBLE * greatest(prestige - 0.5::DOUBLE, 0) * greatest(0, least(1, (base - 0.68::DOUBLE) / 0.12::DOUBLE)) + 0.08::DOUBLE * nov - 0.35::DOUBLE * promo
     - CASE WHEN prestige < 0.5 AND NOT exc THEN (1.4 * 0.16)::DOUBLE * greatest(0, least(1, (0.82::DOUBLE - base) / 0.32::DOUBLE)) + 0.1::DOUBLE ELSE 0 END
     - CASE WHEN (tier = 'repository' OR cs) AND NOT exc THEN greatest(0.15::DOUBLE * greatest(0, least(1, (0.76::DOUBLE - base) / 0.26::DOUBLE)), CASE WHEN cs THEN 0.18::DOUBLE * greatest(0, least(1, (0.76::DOUBLE - base) / 0.2::DOUBLE)) ELSE 0 END) ELSE 0 END
     - CASE WHEN op AND NOT exc THEN 0.1::DOUBLE ELSE 0 END
   WHEN 'regulatory' THEN base + 0.06::DOUBLE * prestige + 0.1::DOUBLE * nov - 0.15::DOUBLE * promo
   ELSE base + 0.06::DOUBLE * prestige + 0.14::DOUBLE * nov - 0.45::DOUBLE * promo - CASE WHEN tier IN ('self-published', 'low') AND base < 0.72 THEN 0.12::DOUBLE * greatest(0, least(1, (0.72::DOUBLE - base) / 0.24::DOUBLE)) ELSE 0 END - CASE WHEN op THEN 0.12::DOUBLE ELSE 0 END END)), 6) AS score FROM adj)"""

# ---- flagship


@query(f"""WITH {_LEX}, {X.VOTES_SQL},
n AS (SELECT a.item_id, section, source, score, coalesce(value, 0) * coalesce(abs(grade - 50) / 50.0::DOUBLE, 0) AS pref FROM adjusted a LEFT JOIN votes USING (item_id)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) - 1 AS ra, row_number() OVER (ORDER BY pref DESC, item_id) - 1 AS rb FROM n),
f AS (SELECT *, 1.0::DOUBLE / (61 + ra) + 1.0::DOUBLE / (61 + rb) AS raw FROM r),
g AS (SELECT *, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 9) AS fused FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY section, source ORDER BY fused DESC, item_id) AS own, CASE section WHEN 'research' THEN 12 WHEN 'industry' THEN 6 WHEN 'regulatory' THEN 4 ELSE 3 END AS cap FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY (own > greatest(2, ceil(cap / 3.0)))::INT, fused DESC, item_id) AS seat FROM o)
SELECT item_id, section, source, round(fused, 6) AS fused, CASE section WHEN 'research' THEN 'R' WHEN 'industry' THEN 'I' WHEN 'regulatory' THEN 'G' ELSE 'W' END || row_number() OVER (PARTITION BY section ORDER BY fused DESC, item_id)::VARCHAR AS label
FROM s WHERE seat <= cap""")
def flagship_slate(spark, d):
    """Items scored by adjusted quality, fused with votes, the labelled slate per section."""
    voted = X.votes(spark, d).select("item_id", (F.col("value") * F.abs(F.col("grade") - 50) / F.lit(50.0)).alias("_p"))
    pool = X.scored_items(spark, d).select("item_id", "section", "source", "score").join(voted, "item_id", "left").withColumn("pref", F.coalesce("_p", F.lit(0.0)))
    fused = ranking.rrf(pool, "score", "pref", "item_id").withColumn("score", F.round("fused", 9))
    caps = {s: c for s, (_, c) in L.SECTIONS.items()}
    return selection.assign_labels(selection.source_balanced(fused, caps)).select("item_id", "section", "source", R6("fused").alias("fused"), "label")


# ---- lexical scores


@query(f"WITH {_LEX} SELECT item_id, round(nov, 6) AS novelty FROM lex")
def novelty_score(spark, d):
    i = X.items(spark, d)
    return i.select("item_id", R6(text.novelty(text.item_text(F.col("title"), F.col("abstract")), F.col("source"), F.col("title"))).alias("novelty"))


@query(f"WITH {_LEX} SELECT item_id, round(promo, 6) AS promo, round(least(0.35::DOUBLE, walls * 0.14::DOUBLE), 6) AS access FROM lex")
def promo_score(spark, d):
    body = text.item_text(F.col("title"), F.col("abstract"))
    return X.items(spark, d).select("item_id", R6(text.promotional(body, quality.promo_risk_by_name(F.col("source"), F.col("section")))).alias("promo"), R6(text.access_friction(body)).alias("access"))


@query(f"WITH {_LEX} SELECT item_id, ctype FROM lex")
def content_type(spark, d):
    return X.items(spark, d).select("item_id", text.content_type(text.item_text(F.col("title"), F.col("abstract")), F.col("section")).alias("ctype"))


@query(f"WITH {_LEX} SELECT item_id, bucket, tier, prestige FROM lex")
def source_bucket(spark, d):
    s, c = F.col("source"), F.col("section")
    return X.items(spark, d).select("item_id", quality.source_bucket(s, c).alias("bucket"), quality.tier_by_name(s, c).alias("tier"), quality.prestige_by_name(s, c).alias("prestige"))


@query(f"WITH {_LEX} SELECT item_id, score FROM adjusted")
def quality_adjusted(spark, d):
    return X.scored_items(spark, d).select("item_id", "score")


@query(f"WITH {_LEX} SELECT item_id, round(CASE WHEN section = 'research' AND tier IN ('top', 'high', 'strong') THEN 0.1::DOUBLE * greatest(prestige - 0.5::DOUBLE, 0) ELSE 0 END, 6) AS credit FROM lex")
def venue_credit(spark, d):
    return X.items(spark, d).select("item_id", R6(quality.venue_credit(F.col("source"), F.col("section"))).alias("credit"))


def _matches(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {_q(p)})" for p in patterns) + ")"


@query(f"""WITH {_LEX}, g AS (SELECT *, trim(title) AS tt, tier IN ('top', 'high', 'strong') AS good, {_any("low", L.COMMENTARY)} AS opinion, (nov >= 0.24 OR {_any("low", L.METHOD_OR_RESULT)}) AS news, {_BODY} AS body FROM lex)
SELECT item_id, CASE WHEN length(tt) < 15 AND NOT good THEN 'short_title' WHEN {_matches("tt", [phrases.BLOCKED_TITLES])} THEN 'blocked_title' WHEN tt = '' THEN 'empty'
  WHEN section = 'research' AND lower(tt) IN ({", ".join(map(_q, L.SKIP_TITLES))}) THEN 'masthead'
  WHEN section = 'research' AND {_matches("body", phrases.FRONT_MATTER)} THEN 'cover'
  WHEN section = 'research' AND {_matches("tt", phrases.NOT_RESEARCH)} THEN 'not_research'
  WHEN section = 'research' AND opinion AND NOT news THEN 'commentary'
  WHEN section = 'research' AND length(abstract) < 30 AND NOT good THEN 'short_abstract' END AS drop_reason FROM g""")
def quality_gate(spark, d):
    return candidates.quality_gate(X.items(spark, d)).select("item_id", "drop_reason")


@query(f"WITH {X.ITEMS_SQL} SELECT item_id, CASE WHEN contains(lower(text), 'podcast') OR contains(lower(text), 'webinar') THEN 0.2::DOUBLE ELSE 0 END AS penalty FROM items")
def downweight(spark, d):
    return X.items(spark, d).select("item_id", text.downweight(F.col("text"), ["Podcast", "webinar"]).alias("penalty"))


@query("SELECT c_custkey, CASE WHEN len(list_intersect(regexp_extract_all(lower(c_name), '[a-z0-9]+'), ['customer', '000000042'])) = 2 OR len(list_intersect(regexp_extract_all(lower(c_name), '[a-z0-9]+'), ['customer', '000000007'])) = 2 THEN 1.0::DOUBLE ELSE 0 END AS matched FROM customer")
def author_subset(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", text.author_match(F.col("c_name"), ["Customer 000000042", "000000007, Customer", "single"]).alias("matched"))


_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


@query(rf"""WITH {X.ITEMS_SQL}, p AS (SELECT item_id, title, list_filter(list_transform(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') AS l FROM items),
s AS (SELECT item_id, title, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM p),
w AS (SELECT *, {_WORDS("s")} AS a, {_WORDS("title")} AS b, {_hits("lower(s)", L.METHOD_OR_RESULT)} + least(3, len(regexp_extract_all(s, '[0-9]'))) AS score FROM s),
k AS (SELECT * FROM w WHERE NOT (len(b) > 0 AND len(list_intersect(a, b)) / greatest(len(b), 1)::DOUBLE >= 0.72) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, length(s) DESC, i) <= 2),
t AS (SELECT item_id, string_agg(s, ' ' ORDER BY i) AS summary FROM k GROUP BY 1) SELECT item_id, coalesce(summary, '') AS summary FROM items LEFT JOIN t USING (item_id)""")
def extractive_summary(spark, d):
    return X.items(spark, d).select("item_id", text.extractive_summary(F.col("title"), F.col("abstract")).alias("summary"))


@query(r"""WITH m AS (SELECT conv_id, turn, list_filter(string_split_regex(replace(text || ' +R1 r2, - I3 +g4 x', ',', ' '), '\s+'), lambda x: x <> '') AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM m),
s AS (SELECT *, last_value(CASE WHEN w = '+' THEN 1 WHEN w = '-' THEN -1 END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sign FROM e)
SELECT conv_id, turn, upper(regexp_extract(w, '^[+\-]?([A-Za-z][0-9]+)$', 1)) AS label, CASE WHEN starts_with(w, '-') THEN -1 WHEN starts_with(w, '+') THEN 1 ELSE coalesce(sign, 1) END AS value
FROM s WHERE regexp_matches(w, '^[+\-]?[A-Za-z][0-9]+$')""")
def reply_vote_tokens(spark, d):
    said = F.concat("text", F.lit(" +R1 r2, - I3 +g4 x"))
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.vote_tokens(said)).alias("v")).select("conv_id", "turn", "v.label", "v.value")


@query("""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS w FROM documents)
SELECT doc_id, sha256(array_to_string(w, ' ')) AS text_hash FROM w""")
def inverted_index_text(spark, d):
    words = X.table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")), r"\s+")).alias("p", "w"))
    maps = words.groupBy("doc_id", "w").agg(F.array_sort(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return maps.select("doc_id", F.sha2(text.inverted_index_text(F.col("m")), 256).alias("text_hash"))


# ---- URLs and duplicates

_CANON = r"""
u0 AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
u1 AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', 1)) AS scheme, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', 2)) AS host, regexp_replace(bare, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)', '') AS rest FROM u0),
u2 AS (SELECT *, regexp_extract(rest, '^([^?]*)', 1) AS path, list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content')) AS kept FROM u1),
canon AS (SELECT page_id, scheme, host, path, kept, regexp_replace(scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '/+$', '') AS canon FROM u2)"""


@query(f"WITH {_CANON} SELECT page_id, canon FROM canon")
def url_canonical(spark, d):
    return X.table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canon"))


@query(f"""WITH {_CANON} SELECT page_id, regexp_replace(scheme || '://' || regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN len(list_filter(kept, lambda x: NOT starts_with(lower(x), 'utm_'))) > 0 THEN '?' || array_to_string(list_sort(list_filter(kept, lambda x: NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid'))), '&') ELSE '' END, '/+$', '') AS norm FROM canon""")
def url_normalized(spark, d):
    return X.table(spark, d, "pages").select("page_id", urls.normalized_url(F.col("url")).alias("norm"))


@query(f"WITH {_CANON} SELECT page_id FROM canon QUALIFY row_number() OVER (PARTITION BY canon ORDER BY page_id) = 1")
def url_dedupe(spark, d):
    return dedupe.dedupe_by_url(X.table(spark, d, "pages").select("page_id", "url"), order="page_id").select("page_id")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#]+') THEN url ELSE '#' END AS safe FROM pages")
def url_safe(spark, d):
    return X.table(spark, d, "pages").select("page_id", urls.safe_url(F.col("url")).alias("safe"))


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def _plain(html: str) -> str:
    out = rf"regexp_replace(regexp_replace({html}, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
    for name, char in _ENTITIES:
        out = f"replace({out}, {_q(name)}, {_q(char)})"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_plain('html')}) AS n_chars, sha256({_plain('html')}) AS text_hash FROM pages")
def strip_html(spark, d):
    plain = text.strip_html(F.col("html"))
    return X.table(spark, d, "pages").select("page_id", plain.alias("plain")).select("page_id", F.length("plain").alias("n_chars"), F.sha2("plain", 256).alias("text_hash"))


_KEYS = rf"""{X.ITEMS_SQL}, k AS (SELECT item_id, published_at, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', ' ', 'g')) AS key FROM items)"""


@query(f"WITH {_KEYS} SELECT item_id, epoch(published_at)::BIGINT // 43200 AS bucket, key FROM k WHERE length(key) >= 12")
def title_bucket_key(spark, d):
    key = urls.title_key(F.col("title"))
    return X.items(spark, d).where(F.length(key) >= 12).select("item_id", urls.title_bucket(F.col("published_at")).alias("bucket"), key.alias("key"))


_PAGE_DOI = "CASE page_id % 4 WHEN 0 THEN 'https://doi.org/10.1000/ABC.' || (page_id // 8)::VARCHAR WHEN 1 THEN 'doi: 10.1000/abc.' || (page_id // 8)::VARCHAR WHEN 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (40000000 + page_id)::VARCHAR || '/' ELSE 'https://arxiv.org/abs/2401.' || lpad((page_id % 50)::VARCHAR, 5, '0') || 'v2' END"


def _page_ids(spark, d):
    p = F.col("page_id")
    external = F.when(p % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC."), F.floor(p / 8).cast("string"))).when(p % 4 == 1, F.concat(F.lit("doi: 10.1000/abc."), F.floor(p / 8).cast("string"))).when(p % 4 == 2, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (40000000 + p).cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad((p % 50).cast("string"), 5, "0"), F.lit("v2")))
    return X.table(spark, d, "pages").select("page_id", external.alias("u"))


_PAGE_KEYS = f"""x AS (SELECT page_id, {_PAGE_DOI} AS u FROM pages),
keys AS (SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'pmid:' || (40000000 + page_id)::VARCHAR WHEN 3 THEN 'arxiv:2401.' || lpad((page_id % 50)::VARCHAR, 5, '0') ELSE 'doi:10.1000/abc.' || (page_id // 8)::VARCHAR END AS key FROM x)"""


@query(f"WITH {_PAGE_KEYS} SELECT page_id, key FROM keys")
def candidate_keys(spark, d):
    none = F.lit(None).cast("string")
    keys = urls.candidate_keys(F.when(F.col("page_id") % 4 > 1, F.col("u")).otherwise(""), F.when(F.col("page_id") % 4 < 2, F.col("u")).otherwise(""), F.lit("feed"), none, F.lit(None).cast("timestamp"))
    return _page_ids(spark, d).select("page_id", F.explode(keys).alias("key")).where(~F.col("key").startswith("url:"))


@query(f"WITH RECURSIVE {_PAGE_KEYS}, e AS (SELECT page_id, key FROM keys UNION ALL SELECT page_id, 'block:' || (page_id // 10)::VARCHAR FROM keys WHERE page_id % 3 = 0), reach AS (SELECT page_id AS a, page_id AS b FROM e UNION SELECT r.a, f.page_id FROM reach r JOIN e g ON g.page_id = r.b JOIN e f ON f.key = g.key) SELECT a AS page_id, min(b) AS root FROM reach GROUP BY a")
def entity_components(spark, d):
    keys = candidate_keys(spark, d)
    more = keys.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("block:"), F.floor(F.col("page_id") / 10).cast("string")).alias("key"))
    return dedupe.identity_components(keys.unionByName(more), item="page_id")


@query(f"""WITH {_LEX}, s AS (SELECT source, item_id, round(prestige + CASE bucket {" ".join(f"WHEN {_q(k)} THEN {v}" for k, v in L.BUCKET_BONUS.items())} ELSE 0 END::DOUBLE + least(0.16::DOUBLE, length(trim(abstract)) / 2400.0::DOUBLE) + least(0.04::DOUBLE, length(trim(title)) / 2500.0::DOUBLE), 9) AS score FROM lex)
SELECT source, item_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) = 1""")
def representative_pick(spark, d):
    i = X.items(spark, d).withColumn("url", F.lit("")).withColumn("score", F.round(dedupe.representative_score(), 9))
    return dedupe.representatives(i, "source", "score").select("source", "item_id", R6("score").alias("score"))


# ---- relational reads


@query(f"SELECT event_id, ts FROM events WHERE (event_type = 'purchase' AND ts >= TIMESTAMP '{X.AS_OF}' - INTERVAL 7 DAY) OR (event_type <> 'error' AND ts >= TIMESTAMP '{X.AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{X.AS_OF}' + INTERVAL 1 DAY) OR (event_type = 'error' AND ts + INTERVAL 2 DAY >= TIMESTAMP '{X.AS_OF}' - INTERVAL 7 DAY)")
def recent_items(spark, d):
    e = X.table(spark, d, "events").withColumn("section", F.when(F.col("event_type") == "purchase", "event").otherwise("research"))
    e = e.withColumn("published_at", F.when(F.col("event_type") != "error", F.col("ts"))).withColumn("fetched_at", F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts")))
    return candidates.recent_items(e, X.as_of(), 7).select("event_id", "ts")


@query(f"WITH {X.EVENT_VOTES_SQL} SELECT item_id AS user_id, vote_id AS event_id, event_type FROM latest_event_vote")
def latest_vote(spark, d):
    return latest.latest(X.event_votes(spark, d), ["item_id"], ["created_at", "vote_id"]).select(F.col("item_id").alias("user_id"), F.col("vote_id").alias("event_id"), "event_type")


@query(f"WITH {X.EVENT_VOTES_SQL} SELECT count(*) FILTER (value = 1) AS good, count(*) FILTER (value = -1) AS bad, count(*) FILTER (value = 0) AS neutral, count(*) FILTER (value <> 0) AS signed, count(*) AS total FROM latest_event_vote")
def vote_counts(spark, d):
    return feedback.vote_counts(X.event_votes(spark, d))


@query(f"WITH {X.VOTES_SQL} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM votes WHERE value <> 1)")
def exclude_reviewed(spark, d):
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    return candidates.exclude_reviewed(docs, X.votes(spark, d)).select(F.col("item_id").alias("doc_id"))


@query(f"""WITH shown AS (SELECT user_id AS doc_id, max(ts) AS t FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '{X.AS_OF}' - INTERVAL 20 DAY GROUP BY 1),
changed AS (SELECT user_id AS doc_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM shown s LEFT JOIN changed c USING (doc_id) WHERE s.doc_id = d.doc_id AND (c.t IS NULL OR c.t <= s.t))""")
def exclude_shown_resurface(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("shown_at"), F.col("ts").alias("observed_at"), "event_type")
    docs = X.table(spark, d, "documents").select("doc_id")
    return candidates.exclude_shown(docs, e.where("event_type = 'view'"), e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), X.as_of() - F.expr("INTERVAL 20 DAYS"), key="doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def exclude_known(spark, d):
    return candidates.exclude_ids(X.table(spark, d, "customer").select("c_custkey"), X.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_restrict(spark, d):
    wanted = X.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return candidates.restrict_ids(X.table(spark, d, "customer").select("c_custkey"), wanted, "c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size < 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def retention_anti(spark, d):
    part, line = X.table(spark, d, "part").select("p_partkey", "p_size"), X.table(spark, d, "lineitem")
    refs = [line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), line.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))]
    return candidates.retained(part, F.lit(25), refs, "p_size", "p_partkey").select("p_partkey")


@query(f"WITH {X.ITEMS_SQL} SELECT item_id, source FROM items WHERE contains(lower(title), 'phase') OR contains(lower(abstract), 'phase') OR contains(lower(source), 'phase') ORDER BY published_at DESC, item_id LIMIT 500")
def keyword_search(spark, d):
    i = X.items(spark, d).withColumn("created_at", F.col("published_at"))
    index = search.TrigramIndex(commits.Tables(spark, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"), ["title", "abstract", "source"])
    late = F.col("created_at") >= X.as_of() - F.expr("INTERVAL 10 DAYS")
    index.add(i.where(~late))
    index.add(i.where(late))  # a later batch
    return index.search(i, "Phase").select("item_id", "source")


@query("SELECT o_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END, o_totalprice, 0) AS score FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 30")
def fill_left_join(spark, d):
    o, line = X.table(spark, d, "orders"), X.table(spark, d, "lineitem").where("l_quantity > 30")
    j = o.join(line, o.o_orderkey == line.l_orderkey, "left")
    return j.select("o_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")), "o_totalprice", F.lit(0.0)).alias("score"))


@query("SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def group_max_selfjoin(spark, d):
    return reports.group_max(X.table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")


@query(f"WITH {X.IMPRESSIONS_SQL} SELECT digest_id, run_id, count(*) AS n, count(*) FILTER (selected) AS n_selected FROM impressions JOIN last_run USING (digest_id, run_id) GROUP BY ALL")
def latest_run(spark, d):
    return latest.latest_run(X.impressions(spark, d)).groupBy("digest_id", "run_id").agg(F.count("*").alias("n"), F.count_if("selected").alias("n_selected"))


@query(f"WITH {X.IMPRESSIONS_SQL} SELECT primary_facet AS facet, max(created_at) AS last_seen FROM impressions JOIN last_run USING (digest_id, run_id) WHERE viewed AND selected AND created_at < TIMESTAMP '{X.AS_OF}' AND created_at >= TIMESTAMP '{X.AS_OF}' - INTERVAL 7 DAY AND primary_score >= 0.2 GROUP BY 1")
def facet_recency(spark, d):
    return reports.facet_recency(X.impressions(spark, d), X.as_of(), least=0.2)


_HEALTH = "h AS (SELECT 's' || (user_id % 12)::VARCHAR AS source, ts, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 + event_id % 5 END AS items, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'e' || (event_id % 9)::VARCHAR END AS error FROM events)"


@query(f"WITH {_HEALTH} SELECT source, sum(items)::BIGINT AS items_7d, count(*) FILTER (NOT ok) AS failures_7d, arg_max(error, (ts, event_id)) FILTER (NOT ok) AS last_error FROM h WHERE ts >= TIMESTAMP '{X.AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{X.AS_OF}' GROUP BY source")
def source_health_weekly(spark, d):
    e = X.table(spark, d, "events")
    bad = F.col("event_type") == "error"
    runs = e.select(F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("source"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("run_id"), F.when(bad, 0).otherwise(1 + F.col("event_id") % 5).alias("items"), (~bad).alias("ok"), F.when(bad, F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string"))).alias("error"))
    return reports.weekly_health(runs, X.as_of())


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{X.AS_OF}' - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 7")
def health_trim(spark, d):
    e = X.table(spark, d, "events").select(F.col("ts").alias("recorded_at"), F.col("event_id").alias("run_id"))
    return reports.trim_snapshots(e, X.as_of()).select(F.col("run_id").alias("event_id"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return reports.duplicate_groups(X.table(spark, d, "documents"), "source")


@query(f"SELECT coalesce(floor((epoch(TIMESTAMP '{X.AS_OF}') - epoch(max(ts))::BIGINT) / 86400), -1)::BIGINT AS days FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def days_since_last(spark, d):
    return latest.days_since(X.table(spark, d, "events"), "ts", X.as_of())


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 6")
def digest_overview(spark, d):
    return reports.source_mix(X.table(spark, d, "documents"))


@query("SELECT count(*) AS items, sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+')))::BIGINT AS words, greatest(1, ceil((sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+'))) + 25 * count(*)) / 220.0))::BIGINT AS minutes FROM documents")
def reading_time(spark, d):
    return reports.reading_time(X.table(spark, d, "documents"))


@query(f"WITH {X.ITEMS_SQL}, {X.VOTES_SQL}, a AS (SELECT * FROM items WHERE published_at >= TIMESTAMP '{X.AS_OF}' - INTERVAL 10 DAY), b AS (SELECT * FROM a WHERE item_id NOT IN (SELECT item_id FROM votes WHERE value <> 1)), c AS (SELECT * FROM b WHERE section = 'research') SELECT 'recent' AS stage, count(*) AS n FROM a UNION ALL SELECT 'unreviewed', count(*) FROM b UNION ALL SELECT 'research', count(*) FROM c")
def funnel_counts(spark, d):
    a = X.items(spark, d).where(F.col("published_at") >= X.as_of() - F.expr("INTERVAL 10 DAYS"))
    b = candidates.exclude_reviewed(a, X.votes(spark, d))
    return candidates.stage_counts(recent=a, unreviewed=b, research=b.where("section = 'research'"))


@query(ORACLE_SQL["quality_gate"].replace("SELECT item_id, CASE WHEN length(tt)", ", d AS (SELECT item_id, CASE WHEN length(tt)", 1).replace("FROM lex)\n, d AS", "FROM lex), d AS") + ") SELECT drop_reason, count(*) AS n FROM d WHERE drop_reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, drop_reason LIMIT 5")
def drop_histogram(spark, d):
    return candidates.drop_histogram(candidates.quality_gate(X.items(spark, d)))


@query("SELECT r_name AS section, string_agg(DISTINCT n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 3 <> 0) AS feeds, count(*) FILTER (n_nationkey % 3 = 0) AS skipped FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def feeds_by_section(spark, d):
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    feeds = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("section"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "api").otherwise("rss").alias("kind"))
    return reports.feeds_by_section(feeds)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_submission(spark, d):
    return latest.latest_value(X.table(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"])


@query("WITH t AS (SELECT user_id AS key, max(ts) AS last_seen FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c_custkey AS key, last_seen FROM customer LEFT JOIN t ON c_custkey = key ORDER BY last_seen NULLS FIRST, sha256('2024-01-31:' || c_custkey::VARCHAR) LIMIT 20")
def least_recently_shown(spark, d):
    keys = X.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    shown = X.table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("shown_at"))
    return latest.least_recently_shown(keys, shown, "key", "2024-01-31", 20)


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS c FROM events) SELECT event_id, n <= least(round_even(c * 0.75, 0), c - 1) AS is_train FROM r")
def chronological_split(spark, d):
    return latest.chronological_split(X.table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "is_train")


# ---- numbers


@query(f"""WITH e AS (SELECT event_id, ['research', 'industry', 'regulatory', 'ai'][(event_id % 4 + 1)::INT] AS s, greatest(0, (epoch_us(TIMESTAMP '{X.AS_OF}') - epoch_us(ts)) / 86400e6::DOUBLE) AS d FROM events)
SELECT event_id, round(CASE s WHEN 'research' THEN CASE WHEN d < 2 THEN -0.05 ELSE least(0.08, greatest(0, (d - 2) / 28.0::DOUBLE) * 0.08::DOUBLE) END WHEN 'industry' THEN CASE WHEN d * 24 < 6 THEN -0.04 ELSE least(0.2, pow(d * 24 / 72.0::DOUBLE, 1.5) * 0.2::DOUBLE) END
 WHEN 'regulatory' THEN least(0.1, greatest(0, (d - 1) / 90.0::DOUBLE) * 0.1::DOUBLE) ELSE least(0.1, greatest(0, (d - 1.5::DOUBLE) * 0.01::DOUBLE)) END::DOUBLE, 6) AS penalty FROM e""")
def freshness_penalty(spark, d):
    section = F.element_at(F.array(*[F.lit(s) for s in ("research", "industry", "regulatory", "ai")]), (F.col("event_id") % 4 + 1).cast("int"))
    return X.table(spark, d, "events").select("event_id", R6(scores.freshness_penalty(F.col("ts"), section, X.as_of())).alias("penalty"))


@query("SELECT p_partkey, round(greatest(0, least(1, ln(1 + p_size / greatest(p_retailprice / 30.0::DOUBLE, 0.5)) / ln(16.0::DOUBLE))), 6) AS score, round(CASE WHEN p_size - 10 >= 0 THEN greatest(0, least(1, ln(1 + (p_size - 10)::DOUBLE) / ln(9.0::DOUBLE))) END, 6) AS venue FROM part")
def citation_velocity(spark, d):
    return X.table(spark, d, "part").select("p_partkey", R6(scores.citation_velocity(F.col("p_size"), F.col("p_retailprice"))).alias("score"), R6(scores.venue_quality((F.col("p_size") - 10).cast("double"))).alias("venue"))


@query("WITH m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - a) / (b - a), 6) AS norm FROM orders, m")
def minmax_norm(spark, d):
    return ranking.min_max(X.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "norm").select("o_orderkey", R6("norm").alias("norm"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS a, row_number() OVER (ORDER BY o_custkey::DOUBLE DESC, o_orderkey) - 1 AS b FROM orders),
f AS (SELECT o_orderkey, 1.0::DOUBLE / (61 + a) + 1.0::DOUBLE / (61 + b) AS raw FROM r) SELECT o_orderkey, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS fused FROM f""")
def rrf_fusion(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    return ranking.rrf(o, "o_totalprice", "c", "o_orderkey").select("o_orderkey", R6("fused").alias("fused"))


@query("SELECT round(greatest(0.55::DOUBLE, CASE WHEN count(*) >= 5 THEN quantile_cont(o_totalprice, 0.9) ELSE 0.75 END), 6) AS threshold FROM orders")
def p90_threshold(spark, d):
    return X.table(spark, d, "orders").agg(R6(F.greatest(F.lit(0.55), F.when(F.count("*") >= 5, F.percentile("o_totalprice", 0.9)).otherwise(0.75))).alias("threshold"))


@query("SELECT o_orderkey, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.00001::DOUBLE * o_totalprice - 2.0::DOUBLE))), 6) AS p FROM orders")
def calibrator_apply(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", R6(scores.calibrated(F.col("o_totalprice"), 0.00001, -2.0)).alias("p"))


@query(f"WITH {X.VOTES_SQL} SELECT item_id, CASE WHEN grade > 50 THEN 1 WHEN grade < 50 THEN -1 ELSE 0 END AS sign, round(greatest(0.05::DOUBLE, abs(grade - 50) / 50.0::DOUBLE), 6) AS weight, CASE WHEN value > 0 THEN 100 WHEN value < 0 THEN 10 ELSE 40 END AS plain FROM votes")
def grade_weights(spark, d):
    g = F.col("grade")
    return X.votes(spark, d).select("item_id", scores.grade_to_value(g).alias("sign"), R6(scores.grade_weight(g)).alias("weight"), scores.value_to_grade(F.col("value")).alias("plain"))


_ASSESS = opportunities.ReaderConstraints(opportunity_types=["grant", "award"], country="Germany", institution_type="university", minimum_lead_days=14)


@query(f"""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'open' END AS status, DATE '2024-01-31' + (o_orderkey % 60 - 10)::INT AS due,
  ['grant', 'fellowship', 'prize', NULL][(o_orderkey % 4 + 1)::INT] AS kind, ['Institutions of Higher Education', 'Unrestricted', 'Others (see text field)', 'Individuals', 'County governments'][(o_custkey % 5 + 1)::INT] AS tag, o_custkey % 7 AS t FROM orders),
r AS (SELECT *, (due - DATE '2024-01-31') AS days FROM o)
SELECT o_orderkey, CASE WHEN status = 'closed' OR days < 14 THEN false WHEN kind = 'fellowship' THEN false WHEN t = 0 THEN true WHEN tag = 'County governments' THEN false ELSE true END AS actionable,
 CASE WHEN status = 'closed' THEN 'status is closed' WHEN days < 0 THEN 'deadline has passed' WHEN days < 14 THEN 'only ' || days::VARCHAR || ' days remain; below preferred lead time' WHEN kind = 'fellowship' THEN 'type is outside preferences'
  WHEN t = 0 THEN 'verify official eligibility' WHEN tag = 'Unrestricted' THEN 'call is open to broad applicant types' WHEN tag LIKE 'Others%' THEN 'official eligibility text needs review' WHEN tag LIKE 'Inst%' THEN 'country eligibility needs review' WHEN tag = 'Individuals' THEN 'individual eligibility needs review' ELSE 'institution type is not listed' END AS reason FROM r""")
def opportunity_assess(spark, d):
    o = X.table(spark, d, "orders")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    none = F.lit(None).cast("string")
    due = F.date_add(F.lit("2024-01-31").cast("date"), (F.col("o_orderkey") % 60 - 10).cast("int"))
    tag = pick(["Institutions of Higher Education", "Unrestricted", "Others (see text field)", "Individuals", "County governments"], F.col("o_custkey"))
    tags = F.when(F.col("o_custkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(tag))
    found = opportunities.assess(_ASSESS, F.lit("2024-01-31").cast("date"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open"), due, none, pick(["grant", "fellowship", "prize", None], F.col("o_orderkey")), none, none, none, tags, none)
    return o.select("o_orderkey", found.alias("a")).select("o_orderkey", "a.actionable", "a.reason")


# ---- vectors


@query(f"WITH {X.VECTORS_SQL}, s AS (SELECT item_id, list_cosine_similarity(vec, f) * least(weight, 1) AS s FROM v, facets), l AS (SELECT item_id, list_reverse_sort(list(s)) AS l FROM s GROUP BY 1) SELECT item_id AS vec_id, round(0.7::DOUBLE * l[1] + 0.3::DOUBLE * list_avg(l[1:3]), 6) AS topic FROM l")
def multi_cosine(spark, d):
    return ranking.topic_scores(X.vectors(spark, d), X.facets(spark, d)).select(F.col("item_id").alias("vec_id"), R6("topic_score").alias("topic"))


@query(f"WITH {X.VECTORS_SQL}, s AS (SELECT item_id, list_cosine_similarity(vec, f) AS s FROM v, facets) SELECT item_id AS vec_id, round(sum(s * exp(3 * s)) / sum(exp(3 * s)), 6) AS score FROM s GROUP BY 1")
def query_aware_cosine(spark, d):
    return ranking.query_aware_scores(X.vectors(spark, d), X.facets(spark, d)).select(F.col("item_id").alias("vec_id"), R6("score").alias("score"))


@query(f"""WITH {X.VECTORS_SQL}, s AS (SELECT item_id, facet_id, priority, list_cosine_similarity(vec, f) AS s FROM v, facets), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, facet_id) AS n, max(s) OVER (PARTITION BY item_id) AS m FROM s)
SELECT item_id AS vec_id, max(CASE WHEN n = 1 AND s >= 0.32 THEN facet_id END) AS primary_facet, round(max(m), 6) AS score, CASE WHEN max(m) >= 0.32 THEN least(2, count(*) FILTER (n > 1 AND s >= m - 0.06 AND s >= 0.3)) ELSE 0 END::INT AS n_secondary, round(max(CASE WHEN n = 1 AND s >= 0.32 THEN 0.03::DOUBLE * priority ELSE 0 END), 6) AS bonus FROM r GROUP BY 1""")
def facet_attribution(spark, d):
    out = ranking.facet_attribution(X.vectors(spark, d), X.facets(spark, d))
    return out.select(F.col("item_id").alias("vec_id"), "primary_facet", R6("primary_score").alias("score"), F.size("secondaries").alias("n_secondary"), R6("priority_bonus").alias("bonus"))


@query(f"WITH {X.VECTORS_SQL}, s AS (SELECT item_id, label, max(list_cosine_similarity(vec, f) * weight) AS best FROM v, facets GROUP BY 1, 2) SELECT item_id AS vec_id, round(0.8::DOUBLE * greatest(0, best - label / 20.0::DOUBLE - 0.05::DOUBLE), 6) AS penalty FROM s")
def negative_penalty(spark, d):
    v = X.vectors(spark, d).withColumn("topic", F.col("label") / F.lit(20.0))
    return ranking.negative_penalty(v, X.facets(spark, d), "topic", 0.8, 0.05).select(F.col("item_id").alias("vec_id"), R6("penalty").alias("penalty"))


@query(f"WITH {X.VECTORS_SQL} SELECT a.item_id AS vec_id, round(max(list_cosine_similarity(a.vec, b.vec)), 6) AS max_sim FROM v a, v b WHERE a.item_id NOT IN (SELECT item_id FROM shown) AND b.item_id IN (SELECT item_id FROM shown) GROUP BY 1")
def near_dup_max(spark, d):
    v, shown = X.vectors(spark, d), X.shown(spark, d)
    return dedupe.max_similarity(v.join(shown, "item_id", "left_anti"), v.join(shown, "item_id", "left_semi")).select(F.col("item_id").alias("vec_id"), R6("max_sim").alias("max_sim"))


@query(f"WITH {X.VECTORS_SQL} SELECT a.item_id AS vec_id FROM v a, v b WHERE a.item_id NOT IN (SELECT item_id FROM shown) AND b.item_id IN (SELECT item_id FROM shown) GROUP BY 1 HAVING max(list_cosine_similarity(a.vec, b.vec)) < 0.3")
def near_dup_exclude(spark, d):
    v, shown = X.vectors(spark, d), X.shown(spark, d)
    return dedupe.exclude_recent_near_duplicates(v.join(shown, "item_id", "left_anti"), v.join(shown, "item_id", "left_semi"), 0.3).select(F.col("item_id").alias("vec_id"))


@query(f"""WITH RECURSIVE {X.VECTORS_SQL}, o AS (SELECT item_id, label, vec, row_number() OVER (PARTITION BY label ORDER BY (item_id * 7919 % 1009) DESC, item_id) AS n FROM v),
g AS (SELECT item_id, label, n, [vec] AS kept, true AS stays FROM o WHERE n = 1
  UNION ALL SELECT o.item_id, o.label, o.n, CASE WHEN list_max(list_transform(g.kept, lambda k: list_cosine_similarity(k, o.vec))) < 0.25 THEN list_append(g.kept, o.vec) ELSE g.kept END,
    list_max(list_transform(g.kept, lambda k: list_cosine_similarity(k, o.vec))) < 0.25 FROM g JOIN o ON o.label = g.label AND o.n = g.n + 1)
SELECT item_id AS vec_id FROM g WHERE stays""")
def near_dup_greedy(spark, d):
    v = X.vectors(spark, d).withColumn("section", F.col("label").cast("string")).withColumn("score", (F.col("item_id") * 7919 % 1009) / F.lit(1009.0))
    return dedupe.cap_near_duplicates(v, 0.25).select(F.col("item_id").alias("vec_id"))


@query(f"""WITH {X.VECTORS_SQL}, s AS (SELECT item_id, ex_id, grade, CASE WHEN item_id = ex_id THEN -1 ELSE list_cosine_similarity(vec, e) END AS s FROM v, exemplars), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, ex_id DESC) <= 8)
SELECT item_id AS vec_id, round(CASE WHEN sum(greatest(s, 0) ** 2) > 0 THEN sum(greatest(s, 0) ** 2 * grade) / sum(greatest(s, 0) ** 2) ELSE 0 END, 6) AS score FROM k GROUP BY 1""")
def knn_preference(spark, d):
    return ranking.preference_scores(X.vectors(spark, d), X.exemplars(spark, d)).select(F.col("item_id").alias("vec_id"), R6("preference").alias("score"))


@query(f"""WITH {X.VECTORS_SQL}, s AS (SELECT item_id, grade > 0 AS up, list_cosine_similarity(vec, e) * weight AS s FROM v, exemplars WHERE item_id <> ex_id), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id, up ORDER BY s DESC) <= 5)
SELECT item_id AS vec_id, round(avg(s) FILTER (up), 6) AS pos_aff, round(avg(s) FILTER (NOT up), 6) AS neg_aff FROM k GROUP BY 1""")
def affinity_topk(spark, d):
    e = X.exemplars(spark, d)
    out = ranking.affinities(ranking.affinities(X.vectors(spark, d), e.where("grade > 0"), "pos_aff"), e.where("grade < 0"), "neg_aff")
    return out.select(F.col("item_id").alias("vec_id"), R6("pos_aff").alias("pos_aff"), R6("neg_aff").alias("neg_aff"))


@query(f"""WITH {X.VECTORS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY ex_id DESC) - 1 AS r FROM exemplars), f AS (SELECT CASE WHEN grade > 0 THEN 0.08::DOUBLE ELSE -0.04::DOUBLE END * weight * pow(0.995::DOUBLE, r) AS f, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM n)
SELECT dim::INT AS dim, round(sum(f * x), 6) AS value FROM f GROUP BY 1""")
def rocchio_vector(spark, d):
    v = X.exemplars(spark, d).withColumns({"value": F.signum("grade"), "at": F.col("item_id").cast("double")})
    return ranking.rocchio(ranking.rank_desc(v, "at", "item_id", "recency")).select("dim", R6("value").alias("value"))


# ---- selection


@query(f"WITH {_LEX}, n AS (SELECT section, count(*) FILTER (score >= 0.65) AS n FROM adjusted GROUP BY 1) SELECT section, CASE section WHEN 'regulatory' THEN 4 WHEN 'research' THEN greatest(3, least(12, n)) WHEN 'industry' THEN greatest(3, least(6, n)) ELSE greatest(2, least(3, n)) END::BIGINT AS cap FROM n")
def dynamic_caps(spark, d):
    return selection.dynamic_caps(X.scored_items(spark, d), F.col("score") >= 0.65, {"research": (3, 12), "industry": (3, 6), "world": (2, 3)}, {"regulatory": 4})


_NEWS = f"""WITH {X.SIMPLE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY section, source ORDER BY score DESC, item_id) AS own, CASE section WHEN 'research' THEN 12 WHEN 'industry' THEN 6 WHEN 'regulatory' THEN 4 ELSE 3 END AS cap FROM simple),
s AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY (own > greatest(2, ceil(cap / 3.0)))::INT, score DESC, item_id) AS seat FROM o),
picked AS (SELECT item_id, section, source, score, row_number() OVER (PARTITION BY section ORDER BY score DESC, item_id) AS pos FROM s WHERE seat <= cap)"""


def _picked(spark, d):
    return selection.source_balanced(X.simple_scores(spark, d), {s: c for s, (_, c) in L.SECTIONS.items()})


@query(f"{_NEWS} SELECT item_id, section, pos::INT AS pos FROM picked")
def news_balanced(spark, d):
    return _picked(spark, d).select("item_id", "section", "pos")


@query()
def research_balanced(spark, d):
    pool = X.scored_items(spark, d).where("section = 'research'").select("item_id", "section", "source", "score", "bucket", "tier")
    return selection.research_balanced(pool, 12).select("item_id", "pos")


@query("WITH m AS (SELECT max(o_totalprice) AS t FROM orders) SELECT o_orderkey FROM orders, m WHERE o_totalprice >= 0.35 * t OR o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def score_cutoff(spark, d):
    return selection.score_cutoff(X.table(spark, d, "orders"), score="o_totalprice", key="o_orderkey").select("o_orderkey")


@query(f"""WITH {X.VECTORS_SQL}, s AS (SELECT item_id, 'f' || label::VARCHAR AS facet, label / 10.0::DOUBLE AS priority, 0.03::DOUBLE * label / 10.0::DOUBLE AS pb, (item_id * 7919 % 1009) / 1009.0::DOUBLE AS score, 0.4::DOUBLE + (item_id % 10) / 20.0::DOUBLE AS ps FROM v),
b AS (SELECT *, ps >= 0.65 AS ok, CASE WHEN ps >= 0.65 THEN row_number() OVER (PARTITION BY ps >= 0.65, facet ORDER BY score DESC, item_id) END AS n FROM s),
e AS (SELECT 'f' || (user_id % 7)::VARCHAR AS facet, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT item_id AS vec_id, round(CASE WHEN ok THEN pb ELSE 0 END + CASE WHEN n = 1 THEN 0.03::DOUBLE * priority * CASE WHEN t IS NULL THEN 1 ELSE least(1, greatest(0, (epoch_us(TIMESTAMP '{X.AS_OF}') - epoch_us(t)) / 86400e6::DOUBLE / 7)) END ELSE 0 END, 6) AS bonus FROM b LEFT JOIN e USING (facet)""")
def topic_preferences(spark, d):
    i = F.col("item_id")
    s = X.vectors(spark, d).select("item_id", F.lit("research").alias("section"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("primary_facet"), (F.col("label") / F.lit(10.0)).alias("priority"), (F.lit(0.03) * F.col("label") / F.lit(10.0)).alias("priority_bonus"), ((i * 7919 % 1009) / F.lit(1009.0)).alias("score"), (F.lit(0.4) + (i % 10) / F.lit(20.0)).alias("primary_score"))
    seen = X.table(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")).alias("facet"), F.col("ts").alias("last_seen"))
    return selection.topic_order(s, seen, X.as_of()).select(F.col("item_id").alias("vec_id"), R6("bonus").alias("bonus"))


@query(f"""{_NEWS}, c AS (SELECT item_id, section, score, (item_id * 31 % 97) / 97.0::DOUBLE AS u FROM simple WHERE section = 'research' AND item_id % 3 = 0 AND item_id NOT IN (SELECT item_id FROM picked) ORDER BY u DESC, score DESC, item_id LIMIT 3),
out AS (SELECT item_id FROM picked WHERE section = 'research' ORDER BY score, item_id LIMIT 3)
SELECT item_id, false AS swapped FROM picked WHERE item_id NOT IN (SELECT item_id FROM out) UNION ALL SELECT item_id, true FROM c""")
def exploration_swap(spark, d):
    cands = X.simple_scores(spark, d).withColumn("eligible", F.col("item_id") % 3 == 0).withColumn("uncertainty", (F.col("item_id") * 31 % 97) / F.lit(97.0))
    return selection.explore(_picked(spark, d).select("item_id", "section", "source", "score"), cands, 3).select("item_id", "swapped")


_MODE = f"""{_NEWS}, m AS (SELECT item_id, CASE WHEN section = 'world' THEN 'events' WHEN section = 'regulatory' THEN 'opportunities' ELSE section END AS section, score, DATE '2024-02-01' + (item_id % 30)::INT AS deadline FROM picked),
dead AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY deadline, score DESC, item_id) AS own FROM m WHERE section IN ('events', 'opportunities')),
dk AS (SELECT *, row_number() OVER (ORDER BY (own > 1)::INT, deadline, score DESC, item_id) AS n FROM dead),
rd AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, item_id) AS own FROM m WHERE section NOT IN ('events', 'opportunities')),
rk AS (SELECT *, row_number() OVER (ORDER BY (NOT (section <> 'research' AND own = 1))::INT, score DESC, item_id) AS n FROM rd)"""


@query(f"{_MODE} SELECT item_id, 'usual' AS mode FROM dk WHERE n <= 6 UNION ALL SELECT item_id, 'usual' FROM rk WHERE n <= 15 UNION ALL SELECT item_id, 'minimal' FROM dk WHERE n <= 3 UNION ALL SELECT item_id, 'minimal' FROM rd WHERE (section <> 'research' AND own = 1) OR (section = 'research' AND own <= 5)")
def reading_mode(spark, d):
    section = F.when(F.col("section") == "world", "events").when(F.col("section") == "regulatory", "opportunities").otherwise(F.col("section"))
    picked = _picked(spark, d).select("item_id", section.alias("section"), "score", F.date_add(F.lit("2024-02-01").cast("date"), (F.col("item_id") % 30).cast("int")).alias("deadline"))
    return selection.reading_mode(picked, "usual", X.as_of()).select("item_id", F.lit("usual").alias("mode")).unionByName(selection.reading_mode(picked, "minimal", X.as_of()).select("item_id", F.lit("minimal").alias("mode")))


@query(f"{_NEWS} SELECT item_id, CASE section WHEN 'research' THEN 'R' WHEN 'industry' THEN 'I' WHEN 'regulatory' THEN 'G' ELSE 'W' END || pos::VARCHAR AS label FROM picked")
def labels_assign(spark, d):
    return selection.assign_labels(_picked(spark, d)).select("item_id", "label")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'research' ELSE 'world' END AS section, l_extendedprice AS score, l_quantity > 25 AS selected FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS pos FROM p WHERE section = 'research'), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS pos FROM p WHERE section = 'world' AND selected)
SELECT l_orderkey, l_linenumber, pos::INT AS pos, selected FROM r WHERE selected OR pos <= 2 UNION ALL SELECT l_orderkey, l_linenumber, pos::INT, selected FROM o""")
def impression_positions(spark, d):
    p = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "research").otherwise("world").alias("section"), F.col("l_extendedprice").alias("score"), (F.col("l_quantity") > 25).alias("selected"))
    return selection.impression_positions(p, 2, "l_linenumber", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "pos", "selected")


@query("SELECT p_partkey FROM part WHERE p_size > 30 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 0) ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def missed_top(spark, d):
    p = X.table(spark, d, "part").withColumn("score", F.col("p_retailprice"))
    return selection.missed(p, p.where("p_partkey % 4 = 0"), F.col("p_size") > 30, key="p_partkey").select("p_partkey")


# ---- evaluation

@query(f"WITH {X.SLATES_SQL}, s AS (SELECT digest_id, sum(CASE WHEN rank <= 10 AND label > 0 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (label > 0) AS n FROM ranked GROUP BY 1) SELECT digest_id AS digest, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END, 6) AS ndcg FROM s")
def ndcg(spark, d):
    return evaluation.ndcg(X.slates(spark, d)).select(F.col("digest_id").alias("digest"), R6("ndcg").alias("ndcg"))


@query(f"WITH {X.SLATES_SQL} SELECT digest_id AS digest, round(avg((label > 0)::INT), 6) AS p FROM ranked WHERE rank <= 3 GROUP BY 1")
def precision_at_k(spark, d):
    return evaluation.precision_at(X.slates(spark, d), 3).select(F.col("digest_id").alias("digest"), R6("precision").alias("p"))


@query(f"WITH {X.SLATES_SQL}, h AS (SELECT *, sum((label > 0)::INT) OVER (PARTITION BY digest_id ORDER BY rank) AS hits FROM ranked) SELECT digest_id AS digest, round(avg(hits::DOUBLE / rank) FILTER (label > 0), 6) AS ap FROM h GROUP BY 1")
def average_precision(spark, d):
    return evaluation.average_precision(X.slates(spark, d)).select(F.col("digest_id").alias("digest"), R6("ap").alias("ap"))


@query(f"WITH {X.SLATES_SQL}, p AS (SELECT a.digest_id, avg((a.rank < b.rank)::INT) AS acc FROM ranked a JOIN ranked b ON a.digest_id = b.digest_id AND a.label > 0 AND b.label < 0 GROUP BY 1) SELECT DISTINCT s.digest_id AS digest, round(acc, 6) AS acc FROM slates s LEFT JOIN p USING (digest_id)")
def pairwise_accuracy(spark, d):
    return evaluation.pairwise_accuracy(X.slates(spark, d)).select(F.col("digest_id").alias("digest"), R6("accuracy").alias("acc"))


@query(f"WITH {X.SLATES_SQL}, l AS (SELECT quantity AS score, count(*) FILTER (label > 0) AS up, count(*) FILTER (label < 0) AS down FROM slates GROUP BY 1), w AS (SELECT *, coalesce(sum(down) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l) SELECT round((sum(up * (below + down / 2.0::DOUBLE)) / (sum(up) * sum(down)))::DOUBLE, 6) AS accuracy FROM w")
def score_pairwise(spark, d):
    return evaluation.score_pairwise_accuracy(X.slates(spark, d).withColumn("score", F.col("quantity"))).select(R6("accuracy").alias("accuracy"))


@query(f"WITH {X.SLATES_SQL} SELECT digest_id AS digest, round(CASE WHEN count(*) FILTER (quantity > 40) > 0 THEN count(*) FILTER (quantity > 40 AND rank <= 2)::DOUBLE / count(*) FILTER (quantity > 40) END, 6) AS recall FROM ranked GROUP BY 1")
def must_read_recall(spark, d):
    return evaluation.recall_at(X.slates(spark, d).withColumn("must", F.col("quantity") > 40), "must", 2).select(F.col("digest_id").alias("digest"), R6("recall").alias("recall"))


@query(" UNION ALL ".join(f"""SELECT {k} AS k, count(*) AS digests, round(avg(ndcg), 6) AS ndcg, round(avg(p), 6) AS p, round(avg(ap), 6) AS map, round(avg(acc), 6) AS acc FROM
 (WITH {X.SLATES_SQL}, h AS (SELECT *, sum((label > 0)::INT) OVER (PARTITION BY digest_id ORDER BY rank) AS ups FROM ranked),
  s AS (SELECT digest_id, sum(CASE WHEN rank <= {k} AND label > 0 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (label > 0) AS n, avg((label > 0)::INT) FILTER (rank <= {k}) AS p, avg(ups::DOUBLE / rank) FILTER (label > 0) AS ap, sum(ups) FILTER (label < 0) AS ok, count(*) FILTER (label < 0) AS m FROM h GROUP BY 1)
  SELECT CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, {k})::BIGINT + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END AS ndcg, p, ap, CASE WHEN n * m > 0 THEN ok::DOUBLE / (n * m) END AS acc FROM s)""" for k in (5, 10)))
def eval_macro(spark, d):
    out = evaluation.macro(X.slates(spark, d), (5, 10))
    return out.select("k", "digests", R6("ndcg").alias("ndcg"), R6("precision").alias("p"), R6("ap").alias("map"), R6("accuracy").alias("acc"))


@query("""WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS digest_id, 'i' || (user_id % 6)::VARCHAR AS interest, value > 5 AS e, event_type IN ('view', 'click') AS s FROM events),
g AS (SELECT digest_id, interest, bool_or(e) AS e, bool_or(e AND s) AS c FROM p GROUP BY 1, 2), n AS (SELECT unnest(['i0', 'i1', 'i2', 'i3', 'i9']) AS interest)
SELECT interest, count(*) FILTER (e) AS eligible, count(*) FILTER (c) AS covered, round(CASE WHEN count(*) FILTER (e) > 0 THEN count(*) FILTER (c)::DOUBLE / count(*) FILTER (e) END, 6) AS fraction FROM n LEFT JOIN g USING (interest) GROUP BY 1""")
def coverage_by_interest(spark, d):
    pool = X.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("digest_id"), F.concat(F.lit("i"), (F.col("user_id") % 6).cast("string")).alias("interest"), (F.col("value") > 5).alias("eligible"), F.col("event_type").isin("view", "click").alias("selected"))
    return reports.coverage(pool, ["i0", "i1", "i2", "i3", "i9"]).withColumn("fraction", R6("fraction"))


# ---- feedback and sinks

_CHIPS = "chips AS (SELECT item_id, list_filter([CASE WHEN item_id % 2 = 0 THEN 'promotional' END, CASE WHEN item_id % 3 = 0 THEN 'off_topic' END, CASE WHEN item_id % 5 = 0 THEN 'low_impact' END], lambda x: x IS NOT NULL) AS reasons FROM votes)"


def _chips(spark, d):
    i = F.col("item_id")
    some = F.array_compact(F.array(F.when(i % 2 == 0, "promotional"), F.when(i % 3 == 0, "off_topic"), F.when(i % 5 == 0, "low_impact")))
    return X.votes(spark, d).select("item_id", some.alias("reasons"))


@query(f"""WITH {_LEX}, {X.VOTES_SQL}, {_CHIPS},
pen AS (SELECT item_id, list_sum(list_transform(reasons, lambda r: CASE r WHEN 'promotional' THEN 0.14 WHEN 'off_topic' THEN 0.12 ELSE 0.1 END::DOUBLE)) AS s, list_sum(list_transform(reasons, lambda r: CASE r WHEN 'promotional' THEN 0.14 WHEN 'off_topic' THEN 0 ELSE 0.1 END::DOUBLE)) AS g FROM chips WHERE len(reasons) > 0),
exact AS (SELECT item_id, least(0.3::DOUBLE, s) AS penalty FROM pen JOIN votes USING (item_id) WHERE value < 1),
sig AS (SELECT v.item_id, value, g, pow(0.5::DOUBLE, greatest(0, (epoch_us(TIMESTAMP '{X.AS_OF}') - epoch_us(created_at)) / 86400e6::DOUBLE) / 60) AS fade, lower(trim(source)) AS src, bucket, ctype FROM votes v JOIN lex USING (item_id) LEFT JOIN pen USING (item_id)),
ab AS (SELECT *, CASE WHEN value < 1 THEN coalesce(g, 0) * fade ELSE 0 END AS a, CASE WHEN value = 1 THEN 0.14::DOUBLE * fade ELSE 0 END AS b FROM sig),
gs AS (SELECT src, greatest(0, least(0.12::DOUBLE, sum(a * 0.35::DOUBLE)) - sum(b * 0.35::DOUBLE)) AS x FROM ab GROUP BY 1), gb AS (SELECT bucket, greatest(0, least(0.06::DOUBLE, sum(a * 0.2::DOUBLE)) - sum(b * 0.2::DOUBLE)) AS x FROM ab GROUP BY 1), gc AS (SELECT ctype, greatest(0, least(0.045::DOUBLE, sum(a * 0.15::DOUBLE)) - sum(b * 0.15::DOUBLE)) AS x FROM ab GROUP BY 1),
f AS (SELECT l.item_id, coalesce(e.penalty, least(0.3::DOUBLE, coalesce(gs.x, 0) + coalesce(gb.x, 0) + coalesce(gc.x, 0))) AS penalty FROM lex l LEFT JOIN exact e USING (item_id) LEFT JOIN gs ON gs.src = l.src LEFT JOIN gb ON gb.bucket = l.bucket LEFT JOIN gc ON gc.ctype = l.ctype)
SELECT item_id, round(penalty, 6) AS penalty FROM f WHERE penalty > 0""")
def reason_penalty(spark, d):
    # read three times below; texts are scored once
    items = cut(X.scored_items(spark, d).select("item_id", "source", "bucket", "content", "published_at"), "classified")
    votes, chips = X.votes(spark, d), _chips(spark, d)
    exact, general = feedback.exact_penalties(chips, votes), feedback.general_penalties(chips, votes, items, X.as_of())
    return feedback.item_penalties(items, exact, general).select("item_id", R6("penalty").alias("penalty"))


@query("SELECT DISTINCT user_id AS item_id, sha256('{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"type\":\"' || event_type || '\"}') AS details_hash FROM events")
def snapshot_versions(spark, d):
    e = X.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("item_id"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("verified_at"), F.col("ts").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")).alias("details"), F.col("ts").alias("observed_at"))
    none = spark.createDataFrame([], "item_id long, details_hash string")
    return sinks.new_snapshots(none, rows).select("item_id", "details_hash")


@query("""WITH w AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS t, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents),
o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN source || ' (old)' ELSE source END AS source, t, CASE WHEN doc_id % 3 = 0 THEN substr(body, 1, length(body) // 2) ELSE body END AS a FROM w),
n AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN t || ' more words here' ELSE '' END AS t, CASE WHEN doc_id % 5 = 0 THEN body || ' and a note of one hundred letters that comes with the second delivery of the same item to the store of all items' ELSE body END AS a FROM w),
j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.doc_id IS NULL AS fresh, n.doc_id IS NULL AS gone, o.t AS ot, n.t AS nt, o.a AS oa, n.a AS na FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.source = n.source),
r AS (SELECT *, CASE WHEN gone THEN ot WHEN fresh OR (trim(nt) <> '' AND (trim(ot) = '' OR length(nt) > length(ot) + 5)) THEN nt ELSE ot END AS t, CASE WHEN gone THEN oa WHEN fresh OR length(na) > length(oa) + 80 THEN na ELSE oa END AS a FROM j)
SELECT doc_id, sha256(t || chr(10) || a) AS text_hash, NOT fresh AND NOT gone AND (t <> ot OR a <> oa) AS changed, fresh AS inserted FROM r""")
def upsert_enrich(spark, d):
    """All documents, stored and delivered again: some under another source, some with half a body before, some with a longer one now."""
    doc, title = F.col("doc_id"), F.split_part("text", F.lit("\n"), F.lit(1))
    docs = X.table(spark, d, "documents").select("doc_id", "source", title.alias("t"), F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)").alias("body"))
    rest = [F.lit("").alias("authors"), F.lit("").alias("url"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("summary"), F.lit(0).alias("ord")]
    half = F.when(doc % 3 == 0, F.expr("substring(body, 1, cast(length(body) div 2 as int))")).otherwise(F.col("body"))
    note = " and a note of one hundred letters that comes with the second delivery of the same item to the store of all items"
    longer = F.when(doc % 5 == 0, F.concat("body", F.lit(note))).otherwise(F.col("body"))
    moved = F.when(doc % 7 == 0, F.concat("source", F.lit(" (old)"))).otherwise(F.col("source"))
    old = docs.select(moved.alias("source"), doc.alias("external_id"), F.lit("research").alias("section"), F.col("t").alias("title"), half.alias("abstract"), *rest)
    new = docs.select("source", doc.alias("external_id"), F.lit("research").alias("section"), F.when(doc % 2 == 0, F.concat("t", F.lit(" more words here"))).otherwise("").alias("title"), longer.alias("abstract"), *rest)
    out = sinks.upsert_items(old, new)
    return out.select(F.col("external_id").alias("doc_id"), F.sha2(F.concat("title", F.lit("\n"), "abstract"), 256).alias("text_hash"), "changed", "inserted")


@query(f"WITH {X.EVENT_VOTES_SQL}, {X.VOTES_SQL}, n AS (SELECT item_id, value, created_at, 1 AS fresh FROM event_votes UNION ALL SELECT item_id, value, created_at, 0 FROM votes) SELECT item_id, arg_max(value, (created_at, fresh)) AS value FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, fresh DESC) = 1) GROUP BY 1")
def record_votes(spark, d):
    new = latest.latest(X.event_votes(spark, d), ["item_id"], ["created_at", "vote_id"]).select("item_id", "value", "created_at")
    return feedback.record_votes(X.votes(spark, d).select("item_id", "value", "created_at"), new).select("item_id", "value")


@query(f"WITH {X.IMPRESSIONS_SQL} SELECT impression_id, viewed OR (selected AND digest_id = '2024-01-10' AND run_id = (SELECT run_id FROM last_run WHERE digest_id = '2024-01-10')) AS viewed FROM impressions")
def mark_viewed(spark, d):
    return sinks.mark_viewed(X.impressions(spark, d), "2024-01-10").select("impression_id", "viewed")


# ---- learning and whole runs


def _vote_features(spark, d):
    v = X.votes(spark, d).join(X.scored_items(spark, d).select("item_id", "score", "base"), "item_id")
    return v.select("item_id", "value", "score", "base")


@query()
def pairwise_training(spark, d):
    return learning.pairwise_training(_vote_features(spark, d), ["score", "base"])


@query()
def margin_ranking(spark, d):
    rows = learning.pairwise_training(_vote_features(spark, d), ["score", "base"])
    model = learning.MarginRanker(["score", "base"]).fit(rows)
    return model.margin(X.scored_items(spark, d).select("item_id", "score", "base"))


@query(f"""WITH {_LEX}, {X.VOTES_SQL} SELECT item_id, round(nov, 6) AS novelty, round(promo, 6) AS promotional, round(least(0.35::DOUBLE, walls * 0.14::DOUBLE), 6) AS access_friction,
  round(0.5::DOUBLE * greatest(0, 1 - least(1, greatest(0, (epoch_us(TIMESTAMP '{X.AS_OF}') - epoch_us(published_at)) / 86400e6::DOUBLE) / 14)), 6) AS fresh FROM lex""")
def ranker_features(spark, d):
    """The ranker's features over all items, with one vector for all so that SQL can say the rest."""
    same = F.array(F.lit(1.0), F.lit(0.0))
    items = X.items(spark, d).withColumn("vec", same)
    one = spark.createDataFrame([(0, [0.5, 0.75**0.5], 1.0)], "facet_id long, vec array<double>, weight double")
    none = spark.createDataFrame([], "item_id long, vec array<double>, value int, weight double")
    found = learning.item_features(items, one, none, X.as_of())
    return found.select("item_id", R6("novelty").alias("novelty"), R6("promotional").alias("promotional"), R6("access_friction").alias("access_friction"), R6("fresh_cosine").alias("fresh"))


@query()
def calibrator_fit(spark, d):
    fitted = learning.fit_calibrator(_vote_features(spark, d).select("score", (F.col("value") > 0).cast("int").alias("label")))
    return spark.createDataFrame([fitted if fitted else (None, None)], "a double, b double")


@query()
def brew_digest(spark, d):
    reader = profile.Profile(bio="Self assembly of materials. Clinical trials of gene therapy.", keywords=["crispr", "novel assay"], context=["phase 3"], weights={"crispr": 1.2})
    model = embedding.fit(X.items(spark, d), "text")
    items = X.items(spark, d).withColumns({"external_id": F.lit(""), "url": F.concat(F.lit("https://example.org/"), F.col("item_id").cast("string")), "fetched_at": F.col("published_at"), "vec": model.vectors("text")}).drop("text", "lang")
    run = digest.brew(items, X.votes(spark, d), profile.facets(spark, reader, embed=model.vector), X.as_of(), digest.Settings(days=20))
    return run.slate.select("item_id", "section", "label", R6("score").alias("score"))


@query(f"""WITH {_LEX}, w AS (SELECT *, least(0.35::DOUBLE, walls * 0.14::DOUBLE) AS access FROM lex),
x AS (SELECT item_id, list_filter([CASE WHEN tier IN ('top', 'high', 'strong') THEN 'High-quality source' WHEN tier = 'repository' THEN 'Preprint / repository' WHEN tier = 'aggregator' THEN 'Aggregator source' WHEN tier = 'trusted-news' THEN 'Trusted news' END,
   CASE WHEN nov >= 0.55 THEN 'High novelty' WHEN nov >= 0.24 THEN 'Fresh signal' END, CASE WHEN section = 'regulatory' THEN 'Regulatory update' END, CASE WHEN promo >= 0.35 THEN 'Promo risk' END, CASE WHEN access >= 0.14 THEN 'Access friction' END, CASE WHEN cs THEN 'arXiv CS' END], lambda t: t IS NOT NULL)[1:5] AS tags,
  list_filter([CASE WHEN base >= 0.65 THEN 'Strong topic match' WHEN base >= 0.45 THEN 'Relevant to your profile' END, CASE WHEN tier IN ('top', 'high', 'strong', 'trusted-news') THEN 'Reliable source' END, CASE WHEN nov >= 0.55 THEN 'High-impact new signal' WHEN nov >= 0.24 THEN 'Fresh development' END,
   CASE WHEN promo >= 0.35 THEN 'Downweighted for promotional language' END, CASE WHEN access >= 0.14 THEN 'Downweighted for access friction' END], lambda t: t IS NOT NULL)[1:5] AS why FROM w)
SELECT item_id, array_to_string(tags, '; ') AS tags, array_to_string(why, '; ') AS why FROM x""")
def explain_tags(spark, d):
    body = text.item_text(F.col("title"), F.col("abstract"))
    i = X.items(spark, d)
    s, c = F.col("source"), F.col("section")
    i = i.select("item_id", "section", "source", (F.lit(0.4) + (F.col("item_id") * 7919 % 1000) / F.lit(2000.0)).alias("base"), F.round(text.novelty(body, s, F.col("title")), 9).alias("nov"), F.round(text.promotional(body, quality.promo_risk_by_name(s, c)), 9).alias("promo"), F.round(text.access_friction(body), 9).alias("access"), quality.tier_by_name(s, c).alias("tier"), quality.is_arxiv_cs(s).alias("cs"))
    tags = explain.reason_tags(F.col("tier"), c, F.col("nov"), F.col("promo"), F.col("access"), F.col("cs"))
    why = explain.why_shown(F.col("base"), F.col("tier"), F.col("nov"), F.col("promo"), F.col("access"))
    return i.select("item_id", F.array_join(tags, "; ").alias("tags"), F.array_join(why, "; ").alias("why"))


@query("""WITH n AS (SELECT n_name AS note, row_number() OVER (ORDER BY sha256('nation|v1|' || n_name)) - 1 AS k FROM nation), d AS (SELECT note, (k - (738916 * 4) % 25 + 25) % 25 AS pos FROM n) SELECT note, pos FROM d WHERE pos < 4""")
def daily_draw(spark, d):
    import datetime as dt

    notes = X.table(spark, d, "nation").select(F.col("n_name").alias("note"))
    return decks.daily_draw(notes, 4, dt.date.fromordinal(738916), "nation").select("note", F.col("at").cast("long").alias("pos"))
