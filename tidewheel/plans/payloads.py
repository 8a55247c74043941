"""Queries of sources, exports, summaries and upkeep, over payloads and tables made of the supplied ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel import schemas
from tidewheel.functions import text, urls
from tidewheel.operators import candidates, evaluation, feedback, language, learning, opportunities, ranking, replay, summaries, upkeep
from tidewheel.plans import fixtures as X
from tidewheel.plans.registry import query
from tidewheel.scratch import shared_folder
from tidewheel.sources import commits, exports, feeds, mail, sinks

R6 = lambda c: F.round(c, 6)


def _k() -> Column:
    return F.col("p_partkey")


def _str(c: Column) -> Column:
    return c.cast("string")


def _sent(parts: DataFrame, body: Column, source: str, kind: str = "json") -> DataFrame:
    return parts.select(F.lit(source).alias("source"), F.lit("research").alias("section"), body.alias(kind))


def _page(name: str, row: Column) -> Column:
    return F.to_json(F.struct(F.array(row).alias(name)))


def _day(first: str = "2024-01-01", form: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), F.col("p_size")), form)


# ---- payloads of sources

_ITEM = ["source", "external_id", "url", "title", "abstract", "authors", "published_at"]


@query("""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Nature' ELSE 'OpenAlex topics' END AS source, CASE WHEN p_partkey % 3 = 0 THEN 'W' || p_partkey ELSE '10.1000/p.' || p_partkey END AS external_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'https://openalex.org/W' ELSE 'https://doi.org/10.1000/P.' END || p_partkey AS url, p_name AS title, p_name || ' of the ' || p_type || ' of ' || p_brand AS abstract,
  'A. ' || p_brand || ', B. Other' AS authors, (DATE '2024-01-01' + p_size)::TIMESTAMP AS published_at FROM part""")
def feed_openalex(spark, d):
    parts = X.table(spark, d, "part").withColumn("w", F.split(F.concat_ws(" ", "p_name", F.lit("of the"), "p_type", F.lit("of"), "p_brand"), " "))
    at = F.transform(F.array_distinct("w"), lambda w: F.filter(F.transform(F.col("w"), lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))
    author = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    venue = F.struct(F.struct(F.when(_k() % 2 == 0, "Nature").otherwise(F.col("p_brand")).alias("display_name")).alias("source"))
    doi = F.when(_k() % 3 != 0, F.concat(F.lit("https://doi.org/10.1000/P."), _str(_k())))
    row = F.struct(F.concat(F.lit("https://openalex.org/W"), _str(_k())).alias("id"), doi.alias("doi"), F.concat(F.lit(" "), "p_name").alias("display_name"), _day().alias("publication_date"), F.map_from_arrays(F.array_distinct("w"), at).alias("abstract_inverted_index"), F.array(author(F.concat(F.lit("A. "), "p_brand")), author(F.lit("B. Other"))).alias("authorships"), venue.alias("primary_location"))
    return feeds.openalex(_sent(parts, _page("results", row), "OpenAlex topics")).select(_ITEM)


@query("""SELECT 'bioRxiv' AS source, '10.1101/x.' || p_partkey AS external_id, 'https://doi.org/10.1101/x.' || p_partkey AS url, p_name AS title, p_type AS abstract, p_brand AS authors,
  (DATE '2024-01-01' + p_size)::TIMESTAMP + INTERVAL 12 HOUR AS published_at FROM part WHERE p_size % 7 <> 0""")
def feed_preprints(spark, d):
    title = F.concat(F.when(F.col("p_size") % 7 == 0, "WITHDRAWN: ").otherwise(" "), "p_name")
    row = F.struct(F.concat(F.lit("https://doi.org/10.1101/X."), _str(_k())).alias("doi"), title.alias("title"), F.col("p_type").alias("abstract"), F.col("p_brand").alias("authors"), _day().alias("date"), F.lit("1").alias("version"))
    return feeds.preprints(_sent(X.table(spark, d, "part"), _page("collection", row), "bioRxiv")).select(_ITEM)


@query("""SELECT 'FDA' AS source, 'NDA' || p_partkey AS external_id, 'https://www.accessdata.fda.gov/scripts/cder/daf/?applno=' || p_partkey AS url, p_brand || ' - ' || p_name || '/' || p_type || ' - NDA' || p_partkey AS title,
  CASE WHEN p_size >= 20 THEN 'SUPPL AP' ELSE 'ORIG TA' END AS abstract, p_brand AS authors, (DATE '2024-01-01' + greatest(p_size, 20))::TIMESTAMP AS published_at FROM part""")
def feed_fda(spark, d):
    one = lambda status, day, kind: F.struct(F.lit(status).alias("submission_status"), day.alias("submission_status_date"), F.lit(kind).alias("submission_type"))
    row = F.struct(
        F.concat(F.lit("NDA"), _str(_k())).alias("application_number"),
        F.col("p_brand").alias("sponsor_name"),
        F.array(F.struct(F.col("p_name").alias("brand_name"))).alias("products"),
        F.struct(F.array("p_type").alias("generic_name")).alias("openfda"),
        F.array(one("TA", F.lit("20240121"), "ORIG"), one("AP", _day(form="yyyyMMdd"), "SUPPL")).alias("submissions"),
    )
    return feeds.fda(_sent(X.table(spark, d, "part"), _page("results", row), "FDA")).select(_ITEM)


@query("""SELECT 'ClinicalTrials' AS source, 'NCT' || p_partkey AS external_id, 'https://clinicaltrials.gov/study/NCT' || p_partkey AS url, p_name AS title, p_type AS abstract, p_brand AS authors,
  CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '2024-02-01' ELSE (DATE '2024-01-01' + p_size)::TIMESTAMP END AS published_at FROM part""")
def feed_trials(spark, d):
    posted = F.struct(F.when(_k() % 4 == 0, "2024-02").otherwise(_day()).alias("date"))
    named = F.struct(F.concat(F.lit("NCT"), _str(_k())).alias("nctId"), F.concat("p_name", F.lit(" ")).alias("briefTitle"), F.struct(F.col("p_brand").alias("fullName")).alias("organization"))
    row = F.struct(F.struct(named.alias("identificationModule"), F.struct(F.col("p_type").alias("briefSummary")).alias("descriptionModule"), F.struct(posted.alias("lastUpdatePostDateStruct")).alias("statusModule")).alias("protocolSection"))
    return feeds.trials(_sent(X.table(spark, d, "part"), _page("studies", row), "ClinicalTrials")).select(_ITEM)


@query("""SELECT 'G' || p_partkey AS external_id, p_name AS title, p_type AS abstract, p_brand AS authors, DATE '2024-01-21' + p_size AS deadline, 1000.0::DOUBLE + p_size AS amount_min, p_retailprice AS amount_max,
  CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS cost_sharing, 'Small business|University' AS tags FROM part WHERE DATE '2024-01-21' + p_size BETWEEN DATE '2024-01-31' AND DATE '2024-03-01'""")
def feed_grants(spark, d):
    who = F.array(*[F.struct(F.lit(x).alias("description")) for x in ("University", "Small business", "University")])
    yes = F.when(_k() % 3 == 0, "Yes").when(_k() % 3 == 1, "no").otherwise("unclear")
    row = F.struct(F.concat(F.lit("G"), _str(_k())).alias("id"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("title"), F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("description"), F.col("p_brand").alias("agency"), _day("2024-01-21", "MM/dd/yyyy").alias("closeDate"), F.concat(F.lit("$"), F.format_number(F.col("p_size") + 1000, 0)).alias("awardFloor"), _str(F.col("p_retailprice")).alias("awardCeiling"), yes.alias("costSharing"), who.alias("applicantTypes"))
    found = feeds.grants(_sent(X.table(spark, d, "part"), F.to_json(row), "Grants"), F.lit("2024-01-31").cast("date"), 30, most=2**31 - 1)
    return found.select("external_id", "title", "abstract", "authors", "details.deadline", "details.amount_min", "details.amount_max", "details.cost_sharing", F.array_join("details.eligibility_tags", "|").alias("tags"))


@query("""SELECT 'arXiv cs.LG' AS source, '2401.' || p_partkey AS external_id, 'http://arxiv.org/abs/2401.' || p_partkey || 'v2' AS url, p_name || ' by ' || p_type AS title, p_type AS abstract,
  p_brand || ', B. Other' AS authors, (DATE '2024-01-01' + p_size)::TIMESTAMP + INTERVAL 8 HOUR AS published_at FROM part""")
def feed_arxiv(spark, d):
    xml = F.format_string("<feed><entry><id>http://arxiv.org/abs/2401.%dv2</id><title>%s\n   by  %s</title><summary> %s\n</summary><published>%sT08:00:00Z</published><author><name>%s</name></author><author><name>B. Other</name></author></entry></feed>", _k(), "p_name", "p_type", "p_type", _day(), "p_brand")
    return feeds.arxiv(_sent(X.table(spark, d, "part"), xml, "arXiv cs.LG", "xml")).select(_ITEM)


@query("""SELECT 'PubMed search' AS source, p_partkey::VARCHAR AS external_id, 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey || '/' AS url, p_name AS title, 'AIM: ' || p_type || ' ' || p_brand AS abstract, p_brand || ' XY, Other B' AS authors,
  CASE p_partkey % 3 WHEN 0 THEN (DATE '2024-01-01' + p_size)::TIMESTAMP WHEN 1 THEN TIMESTAMP '2023-05-01' ELSE TIMESTAMP '2022-01-01' END AS published_at FROM part""")
def feed_pubmed(spark, d):
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    whole = F.concat(tag("Year", F.lit("2024")), tag("Month", _day(form="MMM")), tag("Day", _day(form="d")))
    when = F.when(_k() % 3 == 0, whole).when(_k() % 3 == 1, F.lit("<Year>2023</Year><Month>May</Month>")).otherwise(F.lit("<MedlineDate>2022 Winter</MedlineDate>"))
    people = F.concat(F.lit("<Author><LastName>"), "p_brand", F.lit("</LastName><Initials>XY</Initials></Author><Author><LastName>Other</LastName><Initials>B</Initials></Author>"))
    body = F.concat(F.lit('<AbstractText Label="AIM">'), "p_type", F.lit("</AbstractText><AbstractText>"), "p_brand", F.lit("</AbstractText>"))
    article = F.concat(tag("ArticleTitle", F.col("p_name")), tag("Abstract", body), tag("AuthorList", people), tag("Journal", tag("JournalIssue", tag("PubDate", when))))
    xml = tag("PubmedArticleSet", tag("PubmedArticle", tag("MedlineCitation", F.concat(tag("PMID", _str(_k())), tag("Article", article)))))
    return feeds.pubmed(_sent(X.table(spark, d, "part"), xml, "PubMed search", "xml")).select(_ITEM)


@query("""SELECT 'Feed' AS source, left(sha1('g-' || p_partkey), 16) AS external_id, 'https://example.org/A/' || p_partkey || '?id=1' AS url, p_name || ' & co' AS title, 'Text of ' || p_type AS abstract, p_brand AS authors,
  (DATE '2024-01-01' + p_size)::TIMESTAMP + INTERVAL 10 HOUR AS published_at FROM part""")
def feed_rss(spark, d):
    item = F.concat(F.lit("<item><title>"), "p_name", F.lit(" &amp; co</title><link>HTTPS://Example.org/A/"), _str(_k()), F.lit("?utm_source=x&amp;id=1#top</link><guid>g-"), _str(_k()), F.lit("</guid><description>&lt;p&gt;Text of "), "p_type", F.lit("&lt;/p&gt;&lt;script&gt;x()&lt;/script&gt;</description><dc:creator>"), "p_brand", F.lit("</dc:creator><pubDate>"), _day(form="EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT</pubDate></item>"))
    xml = F.concat(F.lit('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'), item, F.lit("</channel></rss>"))
    return feeds.rss(_sent(X.table(spark, d, "part"), xml, "Feed", "xml")).select(_ITEM)


_PLACES, _KINDS = ["Online", "Berlin (hybrid)", "Oslo"], ["Workshop", "Annual Symposium", "Gathering"]
_HELD = """e AS (SELECT p_partkey, DATE '2024-02-01' + p_size % 20 AS s, DATE '2024-02-01' + p_size % 20 + 2 AS f, DATE '2024-01-20' + p_size AS due, p_partkey % 4 AS c FROM part),
ev AS (SELECT p_partkey, s AS start, CASE WHEN p_partkey % 2 = 0 THEN f ELSE s END AS finish, CASE c WHEN 1 THEN due WHEN 3 THEN due END AS deadline, CASE c WHEN 0 THEN 'closed' WHEN 2 THEN 'unknown' ELSE 'open' END AS status,
  ['workshop', 'symposium', ''][(p_partkey % 3 + 1)::INT] AS event_type, CASE WHEN p_partkey % 5 <> 0 THEN ['online', 'hybrid', 'in_person'][(p_partkey % 3 + 1)::INT] END AS format FROM e)"""


def _events(spark, d):
    start, due = F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size") % 20), _day("2024-01-20", "d MMMM yyyy")
    end = F.date_format(F.date_add(start, 2), "d MMM yyyy")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (_k() % 3 + 1).cast("int"))
    held = F.when(_k() % 2 == 0, F.concat(F.date_format(start, "d"), F.lit(" - "), end)).otherwise(F.date_format(start, "yyyy-MM-dd"))
    place = F.when(_k() % 5 != 0, F.concat(F.lit(" Location: "), pick(_PLACES))).otherwise("")
    chance = F.when(_k() % 4 == 0, " Deadline(s): Abstract: Closed").when(_k() % 4 == 1, F.concat(F.lit(" Deadline(s): Abstract (early): 2 Jan 2024 Registration: "), due, F.lit("."))).when(_k() % 4 == 3, F.concat(F.lit(" Deadline: "), _day("2024-01-20"))).otherwise("")
    page = F.concat(F.lit("On rings. "), pick(_KINDS), F.lit(" Date: "), held, place, chance)
    return X.table(spark, d, "part").select("p_partkey", feeds.event_details(page).alias("details"))


@query(f"WITH {_HELD} SELECT * FROM ev")
def event_details(spark, d):
    e = F.col("details")
    return _events(spark, d).select("p_partkey", e["start"].alias("start"), e["end"].alias("finish"), e["deadline"].alias("deadline"), e["status"].alias("status"), e["event_type"].alias("event_type"), e["format"].alias("format"))


@query(f"WITH {_HELD} SELECT p_partkey FROM ev WHERE status <> 'closed' AND start BETWEEN DATE '2024-02-05' AND DATE '2024-02-15' AND coalesce(deadline >= DATE '2024-02-05', TRUE)")
def events_upcoming(spark, d):
    return feeds.upcoming(_events(spark, d), F.lit("2024-02-05").cast("date"), 10).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'Fixed ' || p_brand ELSE p_name END AS title FROM part")
def title_repair(spark, d):
    doi = F.concat(F.when(_k() % 2 == 0, "10.1021/").otherwise("10.1000/"), F.lit("p."), _str(_k()))
    items = X.table(spark, d, "part").select(_k().alias("p_partkey"), doi.alias("external_id"), F.col("p_name").alias("title"))
    other = X.table(spark, d, "part").where(_k() % 3 == 0).select(F.concat(F.lit("https://doi.org/"), F.upper(doi)).alias("doi"), F.concat(F.lit("<i>Fixed</i> "), "p_brand").alias("title"))
    return feeds.repair_titles(items, other).select("p_partkey", "title")


@query("SELECT c_custkey, 'venue' AS scan FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'author' FROM customer WHERE c_custkey IN (7, 42)")
def watched_scans(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("source"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("authors"))
    by = lambda df, name: df.select("c_custkey", F.lit(name).alias("scan"))
    return by(feeds.of_venues(c, ["Building", "machinery"]), "venue").unionByName(by(feeds.of_authors(c, ["Customer 000000042", "000000007, Customer", "single"]), "author"))


# ---- scores


@query(f"WITH {X.VECTORS_SQL}, r AS (SELECT vec AS q FROM v WHERE item_id = 0), s AS (SELECT item_id, item_id % 4 < 2 AS dead, (item_id * 7919 % 1009) / 1009.0::DOUBLE AS score, greatest(0, least(1, list_cosine_similarity(vec, q))) AS fit FROM v, r) SELECT item_id AS vec_id, round(CASE WHEN dead THEN fit END, 6) AS fit, round(CASE WHEN dead THEN least(1, score + 0.1::DOUBLE * fit) ELSE score END, 6) AS score FROM s")
def opportunity_nudge(spark, d):
    v = X.vectors(spark, d)
    section = F.when(F.col("item_id") % 4 == 0, "Events").when(F.col("item_id") % 4 == 1, "opportunities").otherwise("research")
    rows = v.select("item_id", "vec", section.alias("section"), ((F.col("item_id") * 7919 % 1009) / F.lit(1009.0)).alias("score"))
    reader = [float(x) for x in v.where("item_id = 0").first().vec]
    return opportunities.nudge(rows, reader).select(F.col("item_id").alias("vec_id"), R6("reader_fit").alias("fit"), R6("score").alias("score"))


_LOOKED_UP = f"p_partkey % 3 = 0 AND (p_partkey % 9 = 0 OR p_partkey % 30 <= {L.ENRICHMENT_DAYS})"


def _looked_up(spark, d):
    at = F.when(_k() % 9 != 0, X.as_of() - F.make_interval(days=(_k() % 30).cast("int")))
    return X.table(spark, d, "part").where(_k() % 3 == 0).select(_k().alias("item_id"), F.col("p_size").alias("cited_by_count"), (F.col("p_retailprice") / 300 - 3.5).alias("venue_impact"), at.alias("fetched_at"))


@query(f"""WITH p AS (SELECT *, {_LOOKED_UP} AS known, p_retailprice / 300 - 3.5::DOUBLE AS x, (p_partkey * 7919 % 1009) / 1009.0::DOUBLE AS s, CASE WHEN p_partkey % 5 = 0 THEN 30 ELSE p_size * 3 END AS days FROM part),
q AS (SELECT *, greatest(0, least(1, ln(1 + p_size / greatest(days / 30.0::DOUBLE, 0.5)) / ln(16.0::DOUBLE))) AS vel, CASE WHEN x >= 0 THEN greatest(0, least(1, ln(1 + x) / ln(9.0::DOUBLE))) END AS vq FROM p)
SELECT p_partkey, round(CASE WHEN known THEN s + 0.12::DOUBLE * vel + {L.VENUE_WEIGHT}::DOUBLE * (coalesce(vq, 0.5::DOUBLE) - 0.5::DOUBLE) ELSE s END, 6) AS score, coalesce(known AND vq < {L.LOW_VENUE}, FALSE) AS low_impact FROM q""")
def enriched_scores(spark, d):
    published = F.when(_k() % 5 != 0, X.as_of() - F.make_interval(days=(F.col("p_size") * 3).cast("int")))
    items = X.table(spark, d, "part").select(_k().alias("item_id"), published.alias("published_at"), ((_k() * 7919 % 1009) / F.lit(1009.0)).alias("score"))
    return ranking.enrich(items, _looked_up(spark, d), X.as_of()).select(F.col("item_id").alias("p_partkey"), R6("score").alias("score"), F.col("venue_low_impact").alias("low_impact"))


@query(f"SELECT '10.1000/x' || p_partkey AS doi FROM part WHERE NOT ({_LOOKED_UP}) AND p_partkey % 4 <> 3")
def enrichment_due(spark, d):
    url = F.when(_k() % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), _str(_k()), F.lit("?a=1"))).otherwise("https://example.org/a")
    external = F.when(_k() % 4 == 1, F.concat(F.lit("doi:10.1000/x"), _str(_k()), F.lit("."))).when(_k() % 4 == 2, F.concat(F.lit("10.1000/x"), _str(_k()))).otherwise("none")
    return ranking.to_enrich(X.table(spark, d, "part").select(_k().alias("item_id"), url.alias("url"), external.alias("external_id")), _looked_up(spark, d), X.as_of())


@query(f"""WITH {X.VECTORS_SQL}, {X.VOTES_SQL},
n AS (SELECT item_id, vec, value, value * greatest(0.05::DOUBLE, abs(grade - 50) / 50.0::DOUBLE) AS grade, row_number() OVER (ORDER BY created_at, vote_id) AS pos, count(*) OVER () AS c FROM votes JOIN v USING (item_id) WHERE value <> 0),
sp AS (SELECT *, pos <= least(round_even(c * 0.75, 0), c - 1) AS tr FROM n),
s AS (SELECT item_id, list_cosine_similarity(vec, f) * least(weight, 1) AS s FROM sp, facets WHERE NOT tr), l AS (SELECT item_id, list_reverse_sort(list(s)) AS l FROM s GROUP BY 1),
topic AS (SELECT item_id, 0.7::DOUBLE * l[1] + 0.3::DOUBLE * list_avg(l[1:3]) AS topic FROM l),
kn AS (SELECT a.item_id, b.grade, list_cosine_similarity(a.vec, b.vec) AS s FROM sp a, sp b WHERE NOT a.tr AND b.tr QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.item_id DESC) <= 8),
pref AS (SELECT item_id, CASE WHEN sum(greatest(s, 0) ** 2) > 0 THEN sum(greatest(s, 0) ** 2 * grade) / sum(greatest(s, 0) ** 2) ELSE 0 END AS pref FROM kn GROUP BY 1),
r AS (SELECT item_id, topic, row_number() OVER (ORDER BY topic DESC, item_id) - 1 AS a, row_number() OVER (ORDER BY pref DESC, item_id) - 1 AS b FROM topic JOIN pref USING (item_id)),
u AS (SELECT 'topic' AS ranking, item_id, topic AS score FROM r UNION ALL SELECT 'fused', item_id, 1.0::DOUBLE / (61 + a) + 1.0::DOUBLE / (61 + b) FROM r),
w AS (SELECT ranking, u.item_id, score, value, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, u.item_id) AS pos FROM u JOIN sp USING (item_id)),
acc AS (SELECT a.ranking, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END::DOUBLE) AS accuracy FROM w a JOIN w b ON a.ranking = b.ranking AND a.value > 0 AND b.value < 0 GROUP BY 1),
hd AS (SELECT ranking, sum(CASE WHEN pos <= 10 AND value > 0 THEN 1.0::DOUBLE / log2(pos + 1) ELSE 0 END) AS dcg, count(*) FILTER (value > 0) AS n, avg((value > 0)::INT) FILTER (pos <= 10) AS p FROM w GROUP BY 1)
SELECT ranking, (SELECT count(*) FROM sp WHERE tr) AS n_train, (SELECT count(*) FROM sp WHERE NOT tr) AS n_test, round(accuracy, 6) AS accuracy, round(p, 6) AS p,
  round(dcg / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 6) AS ndcg FROM acc JOIN hd USING (ranking)""")
def held_out_benchmark(spark, d):
    got = evaluation.held_out(X.vectors(spark, d).select("item_id", "vec"), X.votes(spark, d), X.facets(spark, d))
    return got.select("ranking", "n_train", "n_test", R6("accuracy").alias("accuracy"), R6("precision").alias("p"), R6("ndcg").alias("ndcg"))


# ---- replays


def _whole_items(spark, d):
    return X.items(spark, d).join(X.vectors(spark, d).select("item_id", "vec"), "item_id")


@query()
def held_out_rankers(spark, d):
    """All rankings at six splits in time."""
    got = replay.held_out(_whole_items(spark, d), X.votes(spark, d), X.facets(spark, d), X.as_of())
    return got.select("fraction", "ranking", "n_train", "n_test", "n_pairs", *[R6(c).alias(c) for c in ("accuracy", "ndcg", "precision")])


@query()
def per_facet_gate(spark, d):
    """Whether a ranker on facet cosines would replace that on the engine's features."""
    return replay.gate(replay.held_out(_whole_items(spark, d), X.votes(spark, d), X.facets(spark, d), X.as_of()))


def _vote_log(spark, d):
    """The votes and, for a third of the items, an earlier one of the other sign."""
    now = X.votes(spark, d)
    changed = now.where("item_id % 3 = 0").select("item_id", (F.col("vote_id") + 1000000000).alias("vote_id"), (-F.col("value")).alias("value"), (F.lit(100) - F.col("grade")).alias("grade"), (F.col("created_at") - F.expr("INTERVAL 12000 SECONDS")).alias("created_at"))
    return now.unionByName(changed)


@query(f"""WITH {X.VECTORS_SQL}, {X.VOTES_SQL},
log AS (SELECT item_id, vote_id, value, grade, created_at FROM votes UNION ALL SELECT item_id, vote_id + 1000000000, -value, 100 - grade, created_at - INTERVAL 12000 SECOND FROM votes WHERE item_id % 3 = 0),
ends AS (SELECT *, lead(created_at) OVER (PARTITION BY item_id ORDER BY created_at, vote_id) AS until FROM log),
known AS (SELECT v.* FROM v JOIN documents ON doc_id = item_id),
marks AS (SELECT item_id AS ex, vec AS e, value * greatest(0.05::DOUBLE, abs(grade - 50) / 50.0::DOUBLE) AS g, created_at AS since, until FROM ends JOIN known USING (item_id) WHERE value <> 0),
final AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, vote_id DESC) = 1),
j AS (SELECT item_id, item_id * 7919 % (item_id // 200 + 1) AS n FROM known UNION SELECT item_id, item_id // 200 + 1 + item_id % 3 FROM known),
slate AS (SELECT n, make_timestamp((1704067200 + n * 12000) * 1000000) AS t0, item_id FROM j),
asked AS (SELECT n, t0, item_id, vec, CASE WHEN created_at >= t0 THEN value ELSE 0 END AS label FROM slate JOIN known USING (item_id) LEFT JOIN final USING (item_id) QUALIFY max(abs(CASE WHEN created_at >= t0 THEN value ELSE 0 END)) OVER (PARTITION BY n) > 0),
size AS (SELECT n, (SELECT count(*) FROM marks WHERE since < a.t0 AND (until IS NULL OR until >= a.t0)) AS n_train FROM (SELECT DISTINCT n, t0 FROM asked) a),
s AS (SELECT n, item_id, list_reverse_sort(list(list_cosine_similarity(vec, f) * least(weight, 1))) AS l FROM asked, facets GROUP BY 1, 2),
near AS (SELECT n, item_id, g, list_cosine_similarity(vec, e) AS c FROM asked JOIN marks ON since < t0 AND (until IS NULL OR until >= t0) AND ex <> item_id QUALIFY row_number() OVER (PARTITION BY n, item_id ORDER BY list_cosine_similarity(vec, e) DESC, ex DESC) <= 8),
memory AS (SELECT n, item_id, CASE WHEN sum(greatest(c, 0) ** 2) > 0 THEN sum(greatest(c, 0) ** 2 * g) / sum(greatest(c, 0) ** 2) ELSE 0 END AS p FROM near GROUP BY 1, 2),
both_ AS (SELECT n, item_id, label, n_train, round(0.7::DOUBLE * l[1] + 0.3::DOUBLE * list_avg(l[1:3]), 12) AS topic, round(coalesce(p, 0), 12) AS p FROM asked JOIN s USING (n, item_id) JOIN size USING (n) LEFT JOIN memory USING (n, item_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY topic DESC, item_id) AS a, row_number() OVER (PARTITION BY n ORDER BY p DESC, item_id) AS b FROM both_),
u AS (SELECT n, 'topic' AS ranking, n_train, item_id, label, topic AS score FROM placed UNION ALL SELECT n, 'fused', n_train, item_id, label, CASE WHEN n_train >= 20 THEN 1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b) ELSE topic END FROM placed),
w AS (SELECT *, row_number() OVER (PARTITION BY n, ranking ORDER BY score DESC, item_id) AS pos FROM u),
acc AS (SELECT x.n, x.ranking, avg(CASE WHEN x.score > y.score THEN 1 WHEN x.score = y.score THEN 0.5 ELSE 0 END::DOUBLE) AS accuracy FROM w x JOIN w y ON x.n = y.n AND x.ranking = y.ranking AND x.label > 0 AND y.label < 0 GROUP BY 1, 2),
hd AS (SELECT n, ranking, n_train, count(*) AS n_test, count(*) FILTER (label > 0) AS ups, count(*) FILTER (label < 0) AS downs, sum(CASE WHEN pos <= 10 AND label > 0 THEN 1.0::DOUBLE / log2(pos + 1) ELSE 0 END) AS dcg, avg((label > 0)::INT) FILTER (pos <= 10) AS p FROM w GROUP BY 1, 2, 3)
SELECT n::VARCHAR AS digest_id, ranking, n_train >= 20 OR ranking = 'topic' AS learnt, n_train, n_test, ups * downs AS n_pairs, round(accuracy, 6) AS accuracy, round(p, 6) AS p,
  CASE WHEN ups > 0 THEN round(dcg / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, least(ups, 10) + 1) t(i)), 6) END AS ndcg FROM hd LEFT JOIN acc USING (n, ranking)""")
def replay_digests(spark, d):
    """Digests ranked by topic and by the memory of the votes in force at their time, held against later votes."""
    items = _whole_items(spark, d)
    i = F.col("item_id")
    numbers = F.explode(F.array_distinct(F.array((i * 7919) % (F.floor(i / 200) + 1), F.floor(i / 200) + 1 + i % 3)))
    slates = items.select("item_id", numbers.alias("n")).select(_str(F.col("n")).alias("digest_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("n") * 12000).alias("at"), "item_id")
    got = replay.replay(slates, _vote_log(spark, d), items, X.facets(spark, d), least=20).where(F.col("ranking").isin("topic", "fused"))
    return got.select("digest_id", "ranking", "learnt", "n_train", "n_test", "n_pairs", R6("accuracy").alias("accuracy"), R6("precision").alias("p"), R6("ndcg").alias("ndcg"))


# ---- exports and summaries


@query(r"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-03-01' + p_size END AS s, CASE WHEN p_partkey % 4 = 0 THEN DATE '2024-03-10' + p_size % 5 END AS e, CASE WHEN p_partkey % 6 <> 5 THEN DATE '2024-02-01' + p_size END AS due, p_name, p_type FROM part WHERE p_partkey % 7 <> 0),
q AS (SELECT *, coalesce(s, due) AS first_day, greatest(coalesce(s, due), coalesce(e, coalesce(s, due))) AS last_day FROM p)
SELECT p_partkey, first_day, last_day, sha256(array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//tidewheel//calendar//EN', 'CALSCALE:GREGORIAN', 'BEGIN:VEVENT', 'UID:tidewheel-' || p_partkey || '@localhost', 'DTSTART;VALUE=DATE:' || strftime(first_day, '%Y%m%d'),
  'DTEND;VALUE=DATE:' || strftime(last_day + 1, '%Y%m%d'), 'SUMMARY:Call\; ' || p_name || '\, part', 'DESCRIPTION:' || p_type || '\nnext', 'URL:https://example.org/' || p_partkey, 'END:VEVENT', 'END:VCALENDAR', ''], chr(13) || chr(10))) AS ics FROM q WHERE first_day IS NOT NULL""")
def calendar_rows(spark, d):
    plus = lambda first, n: F.date_add(F.lit(first).cast("date"), n)
    section = F.when(_k() % 7 == 0, "research").otherwise("events")
    items = X.table(spark, d, "part").select(_k().alias("item_id"), section.alias("section"), F.concat(F.lit("Call; "), "p_name", F.lit(", part")).alias("title"), F.concat("p_type", F.lit("\r\nnext")).alias("abstract"), F.concat(F.lit("https://example.org/"), _str(_k())).alias("url"), F.when(_k() % 2 == 0, plus("2024-03-01", F.col("p_size"))).alias("event_start"), F.when(_k() % 4 == 0, plus("2024-03-10", F.col("p_size") % 5)).alias("event_end"), F.when(_k() % 6 != 5, plus("2024-02-01", F.col("p_size"))).alias("deadline"))
    return exports.calendar(items).select(F.col("item_id").alias("p_partkey"), "first_day", "last_day", F.sha2("ics", 256).alias("ics"))


@query("""WITH s AS (SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 3 THEN 'arxiv' ELSE 'rss' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'industry' ELSE 'world' END AS section, 'http://x.org/?a=1&amp;b=' || n_nationkey AS url FROM nation)
SELECT section, count(*) FILTER (kind = 'rss') AS feeds, count(*) FILTER (kind <> 'rss') AS skipped, '<outline text="' || upper(section[1]) || section[2:] || '" title="' || upper(section[1]) || section[2:] || '">'
  || coalesce(string_agg('<outline type="rss" text="' || name || '" title="' || name || '" xmlUrl="' || url || '"/>', '' ORDER BY name) FILTER (kind = 'rss'), '') || '</outline>' AS outline FROM s GROUP BY section""")
def feed_outlines(spark, d):
    n = F.col("n_nationkey")
    section = F.when(n % 3 == 1, "industry").when(n % 3 == 2, "world")
    s = X.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(n % 4 == 3, "arxiv").otherwise("rss").alias("kind"), section.alias("section"), F.concat(F.lit("http://x.org/?a=1&b="), n.cast("string")).alias("url"))
    return exports.outlines(s)


_SIGNED = "sha256(concat_ws(chr(30), title, abstract, source, section, '1', 'extractive', '', '', 'bio', 'k1' || chr(31) || 'k2'))"


@query(f"""WITH {X.ITEMS_SQL}, due AS (SELECT item_id, lang, {_SIGNED} AS signature FROM items WHERE item_id % 2 = 1 OR item_id % 10 = 4)
SELECT item_id, signature, ((row_number() OVER (PARTITION BY lang ORDER BY item_id) - 1) // 6)::INT AS batch FROM due""")
def summary_due(spark, d):
    i, sign = X.items(spark, d), summaries.signature(bio="bio", keywords=("k1", "k2"))
    old = F.when(F.col("item_id") % 2 == 0, sign).otherwise(summaries.signature(bio="older"))
    stored = i.select("item_id", F.when(F.col("item_id") % 10 == 4, " ").otherwise("done").alias("summary"), old.alias("summary_signature"))
    return summaries.batched(summaries.due(i, stored, sign), "lang").select("item_id", "signature", "batch")


@query(f"""WITH {X.ITEMS_SQL} SELECT item_id, CASE WHEN item_id % 3 <> 0 AND item_id % 5 <> 0 THEN 'api' ELSE 'extractive_fallback' END AS summary_backend, CASE WHEN item_id % 3 <> 0 AND item_id % 5 <> 0 THEN 'About ' || title END AS written FROM items""")
def summary_provenance(spark, d):
    i = X.items(spark, d)
    written = i.where("item_id % 3 <> 0").select("item_id", F.when(F.col("item_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("About "), "title")).alias("summary"))
    done = summaries.with_provenance(i, written, "api").withColumn("summary_signature", F.lit("s"))
    kept = summaries.store(i, done)
    return kept.select("item_id", "summary_backend", F.when(F.col("summary_backend") == "api", F.col("summary")).alias("written"))


@query(f"""WITH {X.ITEMS_SQL}, r AS (SELECT lang AS digest_id, trim(title) AS title, trim(source) AS source, row_number() OVER (PARTITION BY lang ORDER BY item_id) AS n FROM items)
SELECT digest_id, sha256(string_agg('- ' || title || ' (' || source || ')', chr(10) ORDER BY n)) AS listing FROM r WHERE n <= {summaries.BRIEFING_LINES} GROUP BY 1""")
def catch_up_briefing(spark, d):
    i = X.items(spark, d).withColumns({"digest_id": F.col("lang"), "position": F.col("item_id")})
    return summaries.briefing(i, 5).unionByName(summaries.briefing(i, 2)).select("digest_id", F.sha2("listing", 256).alias("listing"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 3 THEN TIMESTAMP '2024-01-31' WHEN o_orderstatus = 'F' THEN o_orderdate END AS sent_at FROM orders")
def sent_marks(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("digest_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("sent_at"))
    return summaries.mark_sent(o, "3", X.as_of()).select(F.col("digest_id").cast("long").alias("o_orderkey"), "sent_at")


# ---- stored tables

_BEFORE = "2004-01-01 00:00:00"


@query(f"""WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{_BEFORE}'),
kept AS (SELECT l_partkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM g) AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_linenumber = 7 UNION SELECT p_partkey FROM part WHERE p_size % 11 = 0),
old AS (SELECT p_partkey AS k FROM part WHERE p_size < 40 AND p_partkey NOT IN (SELECT k FROM kept))
SELECT 'digests' AS step, (SELECT count(*) FROM g) AS removed UNION ALL SELECT 'items', (SELECT count(*) FROM old) UNION ALL SELECT 'reasons', (SELECT count(*) FROM old WHERE k % 2 = 0)""")
def maintenance_counts(spark, d):
    part, before = X.table(spark, d, "part"), F.lit(_BEFORE).cast("timestamp")
    fetched = F.when(F.col("p_size") < 40, before - F.expr("INTERVAL 1 DAY")).otherwise(before)
    tables = {
        "digests": X.table(spark, d, "orders").select(F.col("o_orderkey").alias("digest_id"), F.col("o_orderdate").alias("created_at")),
        "digest_items": X.table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("digest_id"), F.col("l_partkey").alias("item_id")),
        "items": part.select(_k().alias("item_id"), fetched.alias("fetched_at")),
        "votes": part.where("p_size % 11 = 0").select(_k().alias("item_id")),
        "reasons": part.where(_k() % 2 == 0).select(_k().alias("item_id")),
    }
    return upkeep.maintain(tables, before)[1]


@query("SELECT doc_id, 'a' AS signature, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN -1.0::DOUBLE ELSE length(text)::DOUBLE END AS size FROM documents")
def embed_missing(spark, d):
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    hashed = F.when(F.col("item_id") % 4 == 0, F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise("stale")
    cache = docs.where("item_id % 2 = 0").select("item_id", F.when(F.col("item_id") % 8 == 0, "b").otherwise("a").alias("signature"), hashed.alias("text_hash"), F.array(F.lit(-1.0)).alias("vec"))
    return sinks.embed_missing(docs, cache, "a", F.array(F.length("text").cast("double"))).select(F.col("item_id").alias("doc_id"), "signature", F.col("vec")[0].alias("size"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) = 1)
SELECT l_orderkey, l_partkey FROM a QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey) = 1""")
def slate_labels(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("digest_id"), F.col("l_partkey").alias("item_id"), F.concat(F.lit("R"), (F.col("l_linenumber") % 3).cast("string")).alias("label"), order.alias("ord"))
    return sinks.label_slate(rows).select(F.col("digest_id").alias("l_orderkey"), F.col("item_id").alias("l_partkey"))


@query("SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AND c_custkey % 10 <> 0")
def bookmark_toggle(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    added = sinks.toggle(c.where("item_id % 3 = 0"), c.where("item_id % 5 = 0"), True)
    return sinks.toggle(added, c.where("item_id % 10 = 0"), False).select(F.col("item_id").alias("c_custkey"))


@query(f"""WITH {X.VOTES_SQL}, o AS (SELECT item_id FROM votes WHERE value = -1)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id IN (SELECT item_id FROM o) THEN 'promotional,off_topic' WHEN doc_id % 2 = 0 THEN 'promotional' ELSE 'off_topic' END AS reasons
FROM documents WHERE doc_id NOT IN (SELECT item_id FROM votes WHERE value = 1) AND (doc_id % 2 = 0 OR (doc_id % 3 = 0 AND doc_id IN (SELECT item_id FROM o)))""")
def reason_chips(spark, d):
    docs, voted = X.table(spark, d, "documents").select(F.col("doc_id").alias("item_id")), X.votes(spark, d)
    chips = docs.where("item_id % 2 = 0").select("item_id", F.array(F.lit("promotional")).alias("reasons"))
    new = docs.where("item_id % 3 = 0").select("item_id", F.lit("off_topic").alias("reason")).unionByName(docs.where("item_id % 3 = 0").select("item_id", F.lit("no such reason").alias("reason")))
    return feedback.clear_approved(feedback.add_reasons(chips, new, voted), voted).select(F.col("item_id").alias("doc_id"), F.array_join("reasons", ",").alias("reasons"))


# ---- gates and replies

_STOPS = lambda lang: "[" + ", ".join(f"'{w}'" for w in candidates._STOP[lang]) + "]"
_COUNT = lambda lang: f"len(list_filter(w, lambda x: list_contains({_STOPS(lang)}, x)))"


@query(rf"WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents) SELECT doc_id, length(text) < 20 OR {_COUNT('en')} >= greatest({_COUNT('de')}, {_COUNT('fr')}, {_COUNT('es')}) AS english FROM w")
def english_gate(spark, d):
    return X.table(spark, d, "documents").select("doc_id", candidates.looks_english(F.col("text")).alias("english"))


@query("""WITH p AS (SELECT *, (p_partkey * 7919 % 1009) / 1009.0::DOUBLE AS t, p_partkey % 4 AS s FROM part)
SELECT p_partkey FROM p WHERE p_partkey % 9 = 0 OR (s = 0 AND t - 0.05::DOUBLE >= 0.65) OR (s = 1 AND t >= 0.45 AND FALSE) OR (s = 2 AND t - 0.05::DOUBLE >= 0.58) OR (s = 3 AND t - 0.05::DOUBLE >= 0.58)""")
def topic_floor(spark, d):
    topic = F.when(_k() % 9 != 0, (_k() * 7919 % 1009) / F.lit(1009.0))
    section = F.when(_k() % 4 == 0, "research").when(_k() % 4 == 1, "off").when(_k() % 4 == 2, "opportunities").otherwise("events")
    rows = X.table(spark, d, "part").select("p_partkey", section.alias("section"), F.lit("Journal of Odd Results").alias("source"), topic.alias("topic_score"), F.lit(0.05).alias("negative"), F.lit(0.0).alias("confidence"))
    return candidates.off_topic(rows).select("p_partkey")


@query(r"""WITH t AS (SELECT conv_id, turn, string_split_regex(text || chr(10) || '> quoted' || chr(10) || ' +R1' || chr(10) || CASE turn % 3 WHEN 0 THEN '-- ' WHEN 1 THEN 'On Monday, A. wrote:' ELSE 'x' END || chr(10) || 'after', '\r?\n') AS l FROM conversations),
s AS (SELECT *, list_position(list_transform(l, lambda x: x = '-- ' OR regexp_matches(trim(x), '^On .*wrote:$') OR starts_with(trim(x), 'From:')), TRUE) AS stop FROM t)
SELECT conv_id, turn, sha256(array_to_string(list_filter(CASE WHEN stop > 0 THEN l[1:stop - 1] ELSE l END, lambda x: NOT starts_with(ltrim(x), '>')), chr(10))) AS said FROM s""")
def reply_unquoted(spark, d):
    turn = F.col("turn") % 3
    tail = F.concat(F.lit("\n> quoted\n +R1\n"), F.when(turn == 0, "-- ").when(turn == 1, "On Monday, A. wrote:").otherwise("x"), F.lit("\nafter"))
    said = text.unquoted_lines(F.concat("text", tail))
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.array_join(said, "\n"), 256).alias("said"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS summary, p_type AS why FROM part")
def summary_parts(spark, d):
    free = F.concat(F.when(_k() % 3 == 0, F.lit("no object")).otherwise(F.concat(F.lit("Sure: "), F.to_json(F.create_map(_str(_k()), F.col("p_name"))), F.lit(" done"))))
    said = F.concat(F.lit("What: x\nwhy read:  "), "p_type", F.lit("\nMore: y"))
    return X.table(spark, d, "part").select("p_partkey", F.try_element_at(text.first_json_object(free), _str(_k())).alias("summary"), text.summary_field(said, "Why read").alias("why"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 12 THEN 'title_day:t12h:' || (epoch(TIMESTAMP '2024-01-01' + p_size * INTERVAL 5 HOUR)::BIGINT // 43200 - 1) || ':' || p_name END AS key FROM part")
def title_day_keys(spark, d):
    at = (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("p_size") * 5).cast("int"))).cast("timestamp")
    return X.table(spark, d, "part").select("p_partkey", urls.title_day_key(F.upper(F.replace("p_name", F.lit(" "), F.lit(" - "))), at, 1).alias("key"))


@query("""WITH t AS (SELECT ts, event_id, 'd' || (user_id % 5) AS d, unnest([0, 1]) AS pos FROM events), v AS (SELECT ts, d, pos, 'R' || ((event_id + pos) % 4) AS label, CASE pos WHEN 0 THEN 1 ELSE -1 END AS value FROM t),
n AS (SELECT v.*, n_nationkey % 7 AS item_id FROM v JOIN nation ON d = 'd' || (n_nationkey % 5) AND label = 'R' || (n_nationkey // 5))
SELECT item_id, value, ts AS created_at FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, pos DESC) = 1""")
def reply_votes(spark, d):
    e, n = F.col("event_id"), F.col("n_nationkey")
    line = F.concat(F.lit("r"), _str(e % 4), F.lit(", -R"), _str((e + 1) % 4))
    lines = X.table(spark, d, "events").select(F.concat(F.lit("d"), _str(F.col("user_id") % 5)).alias("digest_id"), line.alias("line"), F.col("ts").alias("created_at"))
    slate = X.table(spark, d, "nation").select(F.concat(F.lit("d"), _str(n % 5)).alias("digest_id"), F.concat(F.lit("R"), _str(F.floor(n / 5))).alias("label"), (n % 7).alias("item_id"))
    return feedback.resolve_votes(lines, slate)


@query("SELECT count(*) AS items, count(*) FILTER (p_size % 2 = 0) AS research, count(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand END) AS families, count(*) > 0 AND count(*) FILTER (p_size % 2 = 0) >= 12 AND count(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand END) >= 2 AS ok FROM part")
def supply_check(spark, d):
    section = F.when(F.col("p_size") % 2 == 0, "Research").otherwise("world")
    return candidates.supply(X.table(spark, d, "part").select(section.alias("section"), F.col("p_brand").alias("family")), 12)


@query(f"""WITH {X.VOTES_SQL}, s AS (SELECT user_id AS item_id, arg_max(value, (ts, event_id)) AS score FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT round(score, 6) AS score, (value > 0)::INT AS label FROM votes JOIN s USING (item_id)""")
def calibration_rows(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("impression_id"), F.col("value").alias("score"), F.col("event_type").alias("ranker_version"))
    return learning.calibration_rows(e, X.votes(spark, d), "view").select(R6("score").alias("score"), "label")


@query("SELECT p_partkey, p_name FROM part WHERE p_size < 20 OR (p_partkey % 3 = 0 AND p_partkey % 2 = 1)")
def carryover_pool(spark, d):
    items = X.table(spark, d, "part").select(_k().alias("item_id"), "p_name", "p_size")
    pins = items.where("item_id % 3 = 0").select("item_id", F.when(F.col("item_id") % 2 == 0, "today").otherwise("before").alias("pinned_digest_id"))
    return candidates.add_carryover(items.where("p_size < 20"), items, pins, "today").select(F.col("item_id").alias("p_partkey"), "p_name")


@query(f"WITH {X.ITEMS_SQL} SELECT item_id FROM items WHERE section IN ('research', 'world')")
def section_gate(spark, d):
    return candidates.enabled_sections(X.items(spark, d), {"research": 0, "world": 3, "industry": 0}).select("item_id")


@query(f"""WITH {X.VECTORS_SQL}, {X.VOTES_SQL}, g AS (SELECT item_id, value, CASE WHEN item_id % 3 = 0 THEN CASE WHEN value > 0 THEN 100 ELSE 10 END ELSE grade END AS grade FROM votes)
SELECT item_id AS vec_id, value, round(greatest(0.05::DOUBLE, abs(grade - 50) / 50.0::DOUBLE), 6) AS weight, round(value * greatest(0.05::DOUBLE, abs(grade - 50) / 50.0::DOUBLE), 6) AS grade FROM g JOIN v USING (item_id)""")
def signed_exemplars(spark, d):
    votes = X.votes(spark, d).withColumn("grade", F.when(F.col("item_id") % 3 != 0, F.col("grade")))
    return feedback.exemplars(votes, X.vectors(spark, d)).select(F.col("item_id").alias("vec_id"), "value", R6("weight").alias("weight"), R6("grade").alias("grade"))


@query("SELECT event_id AS vote_id, user_id AS item_id, (event_id % 3)::INT AS value, NULL::INT AS grade, ts AS created_at FROM events")
def schema_migration(spark, d):
    old = X.table(spark, d, "events").select(F.col("event_id").alias("vote_id"), F.col("user_id").alias("item_id"), _str(F.col("event_id") % 3).alias("value"), F.col("ts").alias("created_at"), F.lit("old").alias("unknown"))
    return schemas.migrate(old, "votes")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey <> 3 UNION ALL SELECT 3, n_nationkey, 0.5 FROM nation")
def digest_replace(spark, d):
    rows = X.table(spark, d, "lineitem").select(_str(F.col("l_orderkey")).alias("digest_id"), "l_linenumber", "l_quantity")
    new = X.table(spark, d, "nation").select(F.lit("3").alias("digest_id"), F.col("n_nationkey").alias("l_linenumber"), F.lit(0.5).alias("l_quantity"))
    return sinks.replace_digest(rows, new, "3").select(F.col("digest_id").cast("long").alias("l_orderkey"), "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, 'slate' AS kind FROM lineitem WHERE l_orderkey <> 3 UNION ALL SELECT 3, n_nationkey, 0.5, 'slate' FROM nation
UNION ALL SELECT o_orderkey, 1, o_totalprice, 'impression' FROM orders UNION ALL SELECT o_orderkey, 2, o_totalprice, 'impression' FROM orders""")
def publish_commits(spark, d):
    """Digests published by commits of several tables, one of them replaced, folders merged on the way, read back as one version."""
    at = commits.Tables(spark, f"{shared_folder(spark)}/commits-{uuid.uuid4().hex}", fan=2)
    rows = X.table(spark, d, "lineitem").select(_str(F.col("l_orderkey")).alias("digest_id"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("l_quantity"))
    new = X.table(spark, d, "nation").select(F.lit("3").alias("digest_id"), F.col("n_nationkey").cast("long").alias("l_linenumber"), F.lit(0.5).alias("l_quantity"))
    seen = lambda n: X.table(spark, d, "orders").select(_str(F.col("o_orderkey")).alias("digest_id"), F.lit(n).cast("long").alias("l_linenumber"), F.col("o_totalprice").cast("double").alias("l_quantity"))
    at.commit([commits.Change("slate", rows), commits.Change("impression", seen(1))])
    at.commit([commits.Change("slate", new, [{"digest_id": "3"}]), commits.Change("impression", seen(2))])
    now = at.state()
    both = [at.read(t, now).withColumn("kind", F.lit(t)) for t in ("slate", "impression")]
    return both[0].unionByName(both[1]).select(F.col("digest_id").cast("long").alias("l_orderkey"), "l_linenumber", "l_quantity", "kind")


_GRAMS = f"""t AS (SELECT doc_id, lang, doc_id % 3 = 1 AS held_out, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS gram FROM t WHERE x IS NOT NULL),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
top AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {language.SIZE}),
z AS (SELECT lang, sum(n) + (SELECT count(*) FROM top) AS z FROM c JOIN top USING (gram) GROUP BY lang),
m AS (SELECT z.lang, top.gram, ln((coalesce(n, 0) + 1) / z) AS p FROM z CROSS JOIN top LEFT JOIN c ON c.lang = z.lang AND c.gram = top.gram),
s AS (SELECT doc_id, m.lang, sum(k * p) AS score FROM (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY ALL) JOIN m USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, lang AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"""


def _identified(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 3 == 1).alias("held_out"))
    return docs, language.fit(docs.where("not held_out"))


@query(f"WITH {_GRAMS} SELECT doc_id, held_out, predicted, length(trim(coalesce(text, ''))) < 20 OR coalesce(predicted = 'en', true) AS english FROM t LEFT JOIN b USING (doc_id)")
def language_identified(spark, d):
    docs, model = _identified(spark, d)
    return docs.select("doc_id", "held_out", model.language("text").alias("predicted"), model.passes("text").alias("english"))


@query(f"WITH {_GRAMS} SELECT lang, count(*) AS texts, count(*) FILTER (WHERE predicted = lang) AS correct FROM t LEFT JOIN b USING (doc_id) WHERE held_out GROUP BY lang")
def language_accuracy(spark, d):
    """Right answers of the identifier on texts that it has not seen."""
    docs, model = _identified(spark, d)
    held = docs.where("held_out").select("lang", model.language("text").alias("predicted"))
    return held.groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(F.col("predicted") == F.col("lang")).alias("correct"))


@query("""WITH t AS (SELECT date_trunc('second', ts) AS ts, event_id, '2024-01-0' || (user_id % 5 + 1) AS d, unnest([0, 1]) AS pos FROM events), v AS (SELECT ts, d, pos, 'R' || ((event_id + pos) % 4) AS label, CASE pos WHEN 0 THEN 1 ELSE -1 END AS value FROM t),
n AS (SELECT v.*, n_nationkey % 7 AS item_id FROM v JOIN nation ON d = '2024-01-0' || (n_nationkey % 5 + 1) AND label = 'R' || (n_nationkey // 5))
SELECT item_id, value, ts AS created_at FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, pos DESC) = 1""")
def mail_votes(spark, d):
    """Replies as raw mails, one an event and each there twice, parsed and resolved against slates."""
    e, n = F.col("event_id"), F.col("n_nationkey")
    head = F.concat(F.lit("From: a@example.org\r\nSubject: =?utf-8?q?Re=3A_Digest?= 2024-01-0"), _str(F.col("user_id") % 5 + 1), F.lit("\r\nMessage-ID: <"), _str(e), F.lit("@example.org>\r\nDate: "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n"))
    raw = X.table(spark, d, "events").select(F.concat(head, F.lit("Thank you!\r\nr"), _str(e % 4), F.lit(", =2DR"), _str((e + 1) % 4), F.lit("\r\n> +R0 +R1\r\n")).cast("binary").alias("content"))
    slate = X.table(spark, d, "nation").select(F.concat(F.lit("2024-01-0"), _str(n % 5 + 1)).alias("digest_id"), F.concat(F.lit("R"), _str(F.floor(n / 5))).alias("label"), (n % 7).alias("item_id"))
    return mail.votes(mail.fresh(mail.messages(raw.unionByName(raw)), None), slate)
