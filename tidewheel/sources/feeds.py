"""Parsing of raw feed payloads into items: one row per payload in, one row per entry out.

Every parser takes a DataFrame of raw payloads and gives the columns of
``ITEM_COLUMNS``. Fetching is left to a data source (:mod:`tidewheel.sources.live`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import quality, text, urls

ITEM_COLUMNS = ["source", "section", "external_id", "url", "title", "abstract", "authors", "published_at"]
ABSTRACT_CHARS, RSS_ENTRIES = 4000, 200

_RSS = "channel struct<item:array<struct<title:string,link:string,guid:string,description:string,`content:encoded`:string,pubDate:string,`dc:creator`:string>>>"
_ATOM = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"


def _item(source: Column, section: Column, external: Column, url: Column, title: Column, abstract: Column, authors: Column, published: Column) -> list[Column]:
    cut = F.substring(F.coalesce(abstract, F.lit("")), 1, ABSTRACT_CHARS)
    return [c.alias(n) for c, n in zip((source, section, external, url, title, cut, authors, published), ITEM_COLUMNS, strict=True)]


def _time(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")], F.try_to_timestamp(c))


def date_of(c: Column) -> Column:
    """Tolerant date: day, month or year, ISO or US style; else null."""
    tries = [F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy-MM", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy")]
    return F.coalesce(F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))), *tries)


def rss(payloads: DataFrame) -> DataFrame:
    """RSS payloads (source, section, xml): up to 200 entries each, clean text, hashed ids."""
    rows = payloads.select("source", "section", F.from_xml("xml", _RSS, {"rowTag": "rss"}).alias("x")).select("source", "section", F.explode(F.slice("x.channel.item", 1, RSS_ENTRIES)).alias("e"))
    url = urls.canonical_url(F.trim(F.col("e.link")))
    body = text.strip_html(F.coalesce(F.nullif(F.col("e.`content:encoded`"), F.lit("")), F.col("e.description")))
    return rows.select(*_item(F.col("source"), F.col("section"), urls.external_id(F.coalesce("e.guid", "e.link")), url, text.strip_html(F.col("e.title")), body, F.col("e.`dc:creator`"), _time(F.col("e.pubDate"))))


def arxiv(payloads: DataFrame) -> DataFrame:
    """arXiv Atom payloads (source, section, xml); ids without path and version."""
    rows = payloads.select("source", "section", F.explode(F.from_xml("xml", _ATOM, {"rowTag": "feed"})["entry"]).alias("e"))
    bare = F.regexp_replace(F.regexp_replace(F.col("e.id"), r"^.*/abs/", ""), r"v\d+$", "")
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(*_item(F.col("source"), F.col("section"), bare, F.col("e.id"), squeeze(F.col("e.title")), squeeze(F.col("e.summary")), F.array_join("e.author.name", ", "), F.try_to_timestamp(F.col("e.published"))))


def preprints(payloads: DataFrame) -> DataFrame:
    """Preprint-server pages (source, section, json): withdrawn ones out, noon dates, DOIs as ids, newest version."""
    kind = "collection array<struct<doi:string,title:string,abstract:string,authors:string,date:string,version:string>>"
    rows = payloads.select("source", "section", F.explode(F.from_json("json", kind)["collection"]).alias("e"))
    rows = rows.where(~F.lower(F.coalesce("e.title", F.lit(""))).contains("withdrawn"))
    doi = urls.canonical_doi(F.col("e.doi"))
    noon = F.try_to_timestamp(F.concat("e.date", F.lit(" 12:00:00")))
    return rows.select(*_item(F.col("source"), F.col("section"), doi, F.concat(F.lit("https://doi.org/"), doi), F.trim("e.title"), F.trim("e.abstract"), F.col("e.authors"), noon))


def openalex(payloads: DataFrame, upgrade: bool = True) -> DataFrame:
    """OpenAlex pages (source, section, json): abstracts from inverted indexes; known venues replace the aggregator's name."""
    kind = "results array<struct<id:string,doi:string,display_name:string,publication_date:string,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>>>"
    rows = payloads.select("source", "section", F.explode(F.from_json("json", kind)["results"]).alias("e"))
    venue = quality.recognized_venue(F.col("e.primary_location.source.display_name")) if upgrade else F.lit(None).cast("string")
    external = F.coalesce(F.nullif(urls.canonical_doi(F.col("e.doi")), F.lit("")), F.regexp_extract("e.id", r"([^/]+)$", 1))
    return rows.select(*_item(F.coalesce(venue, F.col("source")), F.col("section"), external, F.coalesce("e.doi", "e.primary_location.landing_page_url", "e.id"), F.trim("e.display_name"), F.coalesce(text.inverted_index_text(F.col("e.abstract_inverted_index")), F.lit("")), F.array_join("e.authorships.author.display_name", ", "), F.try_to_timestamp(F.col("e.publication_date"))))


def of_venues(items: DataFrame, venues: list[str]) -> DataFrame:
    """Items of listed venues, 120 at most."""
    return items.where(F.lower("source").isin([v.lower() for v in venues[:120]]))


def of_authors(items: DataFrame, names: list[str]) -> DataFrame:
    """Items by watched authors, 25 at most."""
    return items.where(text.author_match(F.col("authors"), names[:25]) > 0)


def repair_titles(items: DataFrame, crossref: DataFrame, prefix: str = "10.1021/") -> DataFrame:
    """Titles of a DOI prefix from a (doi, title) table, where it has them."""
    fixed = crossref.select(urls.canonical_doi(F.col("doi")).alias("external_id"), text.strip_html(F.col("title")).alias("_t")).where(F.col("external_id").startswith(prefix)).dropDuplicates(["external_id"])
    return items.join(fixed, "external_id", "left").withColumn("title", F.coalesce(F.nullif("_t", F.lit("")), "title")).select(items.columns)


def pubmed(payloads: DataFrame) -> DataFrame:
    """PubMed article sets (source, section, xml): labelled abstract parts joined, month names, year fallback."""
    kind = "PubmedArticle array<struct<MedlineCitation:struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,AuthorList:struct<Author:array<struct<LastName:string,Initials:string>>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>>>>>"
    rows = payloads.select("source", "section", F.explode(F.from_xml("xml", kind, {"rowTag": "PubmedArticleSet"})["PubmedArticle"]["MedlineCitation"]).alias("e"))
    part = lambda p: F.concat(F.when(F.coalesce(p["_Label"], F.lit("")) != "", F.concat(p["_Label"], F.lit(": "))).otherwise(""), F.coalesce(p["_VALUE"], F.lit("")))
    body = F.array_join(F.transform("e.Article.Abstract.AbstractText", part), " ")
    names = F.array_join(F.transform("e.Article.AuthorList.Author", lambda a: F.concat_ws(" ", a["LastName"], a["Initials"])), ", ")
    d = F.col("e.Article.Journal.JournalIssue.PubDate")
    year = F.coalesce(d["Year"], F.nullif(F.regexp_extract(d["MedlineDate"], r"(\d{4})", 1), F.lit("")))
    when = F.coalesce(F.try_to_timestamp(F.concat_ws(" ", year, d["Month"], d["Day"]), F.lit("yyyy MMM d")), F.try_to_timestamp(F.concat_ws("-", year, d["Month"], d["Day"]), F.lit("yyyy-M-d")), F.try_to_timestamp(F.concat_ws(" ", year, d["Month"]), F.lit("yyyy MMM")), F.try_to_timestamp(year, F.lit("yyyy")))
    pmid = F.col("e.PMID")
    return rows.select(*_item(F.col("source"), F.col("section"), pmid, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")), F.trim("e.Article.ArticleTitle"), body, names, when))


def fda(payloads: DataFrame) -> DataFrame:
    """Drug approvals (source, section, json): title of sponsor, product and number; the latest submission dates it."""
    kind = "results array<struct<application_number:string,sponsor_name:string,products:array<struct<brand_name:string>>,openfda:struct<generic_name:array<string>>,submissions:array<struct<submission_status:string,submission_status_date:string,submission_type:string>>>>"
    rows = payloads.select("source", "section", F.explode(F.from_json("json", kind)["results"]).alias("e"))
    latest = F.array_max(F.transform("e.submissions", lambda s: F.struct(s["submission_status_date"].alias("d"), s["submission_type"].alias("t"), s["submission_status"].alias("s"))))
    name = F.concat_ws("/", F.col("e.products")[0]["brand_name"], F.get("e.openfda.generic_name", F.lit(0)))
    title = F.concat_ws(" - ", F.nullif("e.sponsor_name", F.lit("")), F.nullif(name, F.lit("")), "e.application_number")
    return rows.select(*_item(F.col("source"), F.col("section"), F.col("e.application_number"), F.concat(F.lit("https://www.accessdata.fda.gov/scripts/cder/daf/?applno="), F.regexp_replace("e.application_number", r"\D", "")), title, F.concat_ws(" ", latest["t"], latest["s"]), F.col("e.sponsor_name"), date_of(latest["d"]).cast("timestamp")))


def trials(payloads: DataFrame, most: int = 100) -> DataFrame:
    """Clinical-trial pages (source, section, json); a page gives 100 studies at most."""
    kind = "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string,organization:struct<fullName:string>>,descriptionModule:struct<briefSummary:string>,statusModule:struct<overallStatus:string,lastUpdatePostDateStruct:struct<date:string>>>>>"
    rows = payloads.select("source", "section", F.explode(F.slice(F.from_json("json", kind)["studies"], 1, most)["protocolSection"]).alias("e"))
    nct = F.col("e.identificationModule.nctId")
    return rows.select(*_item(F.col("source"), F.col("section"), nct, F.concat(F.lit("https://clinicaltrials.gov/study/"), nct), F.trim("e.identificationModule.briefTitle"), F.col("e.descriptionModule.briefSummary"), F.col("e.identificationModule.organization.fullName"), date_of(F.col("e.statusModule.lastUpdatePostDateStruct.date")).cast("timestamp")))


def amount(c: Column) -> Column:
    """A number out of money text; null if there is none."""
    return F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")


def slug(c: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def truth(c: Column) -> Column:
    """A yes or no out of text; null if neither."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def grants(payloads: DataFrame, today: Column, horizon: int = 180, most: int = 60) -> DataFrame:
    """Grant details (source, section, json): open calls with a deadline inside the horizon, applicant types sorted."""
    kind = "id string, title string, description string, agency string, closeDate string, awardFloor string, awardCeiling string, costSharing string, applicantTypes array<struct<description:string>>"
    rows = payloads.select("source", "section", F.from_json("json", kind).alias("e"))
    due = date_of(F.col("e.closeDate"))
    rows = rows.withColumn("deadline", due).where(F.col("deadline").between(today, F.date_add(today, horizon))).orderBy("deadline", "e.id").limit(most)
    types = F.array_sort(F.array_distinct("e.applicantTypes.description"))
    details = F.struct(F.col("deadline"), amount(F.col("e.awardFloor")).alias("amount_min"), amount(F.col("e.awardCeiling")).alias("amount_max"), truth(F.col("e.costSharing")).alias("cost_sharing"), types.alias("eligibility_tags"))
    made = _item(F.col("source"), F.col("section"), F.col("e.id"), F.concat(F.lit("https://www.grants.gov/search-results-detail/"), F.col("e.id")), text.strip_html(F.col("e.title")), text.strip_html(F.col("e.description")), F.col("e.agency"), F.lit(None).cast("timestamp"))
    return rows.select(*made, details.alias("details"))


#: The kinds of an event, by the first word found; the labels of an event page; how a place tells the format.
EVENT_KINDS = ["conference", "workshop", "course", "symposium", "webinar", "lecture", "seminar"]
EVENT_LABELS = ["date", "location", "deadline(s)", "deadline", "organisers"]
EVENT_FORMATS = ["online", "hybrid"]

_DAY = r"(?i)\b(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\s+[a-z]{3,9}\s+\d{4}|[a-z]{3,9}\s+\d{1,2},?\s+\d{4})\b"


def labelled_parts(body: Column, *labels: str) -> Column:
    """What follows each ``label:`` up to the next label of an event page, in the page's order."""
    one_of = "|".join(label.replace("(", r"\(").replace(")", r"\)") for label in EVENT_LABELS)
    parts = F.split(body, rf"(?i)(?<!\w)(?=(?:{one_of})\s*:)")
    name = lambda part: F.trim(F.lower(F.substring_index(part, ":", 1)))
    rest = lambda part: F.regexp_replace(F.regexp_replace(part, r"^[^:]*:", ""), r"^[\s.;|]+|[\s.;|]+$", "")
    return F.transform(F.filter(parts, lambda part: F.contains(part, F.lit(":")) & name(part).isin(list(labels))), rest)


def days_in(value: Column) -> Column:
    """All dates that a text spells out, in its order."""
    return F.array_compact(F.transform(F.regexp_extract_all(value, F.lit(_DAY), F.lit(1)), lambda d: date_of(F.regexp_replace(d, r"\s+", " "))))


def date_range(value: Column) -> Column:
    """struct(start, end) of a text such as ``17 - 25 Aug 2026``: the end is the last whole date.

    The start is the first whole date, or a day (and month) in front of the only
    one, which takes the end's month and year; a single date is both.
    """
    days = days_in(value)
    end = F.try_element_at(days, F.lit(-1))
    lead = F.regexp_extract(value, rf"(?i)^(.*?)\s*(?:-|–|\bto\b|\buntil\b)\s*{_DAY[4:]}", 1)
    day, month = F.regexp_extract(lead, r"(\d{1,2})", 1), F.regexp_extract(lead, r"(?i)([a-z]{3,9})", 1)
    first = date_of(F.concat_ws(" ", day, F.coalesce(F.nullif(month, F.lit("")), F.date_format(end, "MMM")), F.year(end).cast("string")))
    start = F.when(F.size(days) > 1, F.try_element_at(days, F.lit(1))).when(day != "", F.coalesce(first, end)).otherwise(end)
    return F.struct(start.alias("start"), end.alias("end"))


def event_details(body: Column) -> Column:
    """struct(start, end, deadline, status, event_type, format, location) of an event page's text.

    The latest date under a deadline label counts, as it is the last chance to take
    part; an event is closed only where such a label tells so and no date is there.
    A kind that no word tells is empty; a format without a place is null.
    """
    when = F.try_element_at(labelled_parts(body, "date"), F.lit(1))
    place = F.nullif(F.try_element_at(labelled_parts(body, "location"), F.lit(1)), F.lit(""))
    chances = F.array_join(labelled_parts(body, "deadline", "deadline(s)"), " ")
    due = F.array_max(days_in(chances))
    status = F.when(due.isNotNull(), "open").when(chances.rlike(r"(?i)\bclosed\b"), "closed").otherwise("unknown")
    kind, form = F.lit(""), F.when(place.isNotNull(), "in_person")
    for word in reversed(EVENT_KINDS):
        kind = F.when(F.contains(F.lower(body), F.lit(word)), word).otherwise(kind)
    for word in reversed(EVENT_FORMATS):
        form = F.when(F.contains(F.lower(place), F.lit(word)), word).otherwise(form)
    held = date_range(when)
    return F.struct(held["start"].alias("start"), held["end"].alias("end"), due.alias("deadline"), status.alias("status"), kind.alias("event_type"), form.alias("format"), place.alias("location"))


def events(payloads: DataFrame) -> DataFrame:
    """Event feeds (source, section, xml): RSS items with their details."""
    return rss(payloads).withColumn("details", event_details(F.concat_ws("\n", "title", "abstract")))


def upcoming(items: DataFrame, today: Column, horizon: int = 365) -> DataFrame:
    """Events with ``details`` that can still be joined: dated, not closed, not past, within the horizon, deadline not over."""
    e = F.col("details")
    return items.where((e["status"] != "closed") & e["start"].between(today, F.date_add(today, horizon)) & (e["deadline"].isNull() | (e["deadline"] >= today)))


PARSERS = {"rss": rss, "arxiv": arxiv, "biorxiv": preprints, "openalex": openalex, "openalex_venues": openalex, "openalex_authors": openalex, "pubmed": pubmed, "fda": fda, "clinicaltrials": trials, "grants_gov": grants, "events_rss": events}


def parser(kind: str):
    """The parser of a kind of source; unknown kinds raise."""
    if kind not in PARSERS:
        raise ValueError(f"unknown source kind {kind!r}")
    return PARSERS[kind]


def search_terms(core: list[str], context: list[str], most: int) -> list[str]:
    """All core terms, then context terms up to a number; the first spelling of each counts."""
    out = {t.strip().lower(): t.strip() for t in reversed(core) if t.strip()}
    out = {k: out[k] for k in dict.fromkeys(t.strip().lower() for t in core if t.strip())}
    for t in context:
        if len(out) < most and t.strip():
            out.setdefault(t.strip().lower(), t.strip())
    return list(out.values())
