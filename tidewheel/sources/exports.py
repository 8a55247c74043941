"""Rows that leave the engine: calendar entries and feed outlines, each a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel.functions import text, urls

NOTE_CHARS = 1000
#: The frame of a calendar file.
CALENDAR_OPEN = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//tidewheel//calendar//EN", "CALSCALE:GREGORIAN", "BEGIN:VEVENT"]
CALENDAR_CLOSE = ["END:VEVENT", "END:VCALENDAR", ""]


def calendar(items: DataFrame) -> DataFrame:
    """(item_id, first_day, last_day, ics) of calls and events that have a day: an event's days, else its deadline.

    ``items`` has item_id, section, title, url, abstract, event_start, event_end and
    deadline. The file's end day is the day behind the last, as the format counts it;
    an end before the start counts as the start.
    """
    first = F.coalesce("event_start", "deadline")
    dated = items.where(F.lower("section").isin(L.DEADLINE_SECTIONS)).withColumn("first_day", first).where("first_day is not null")
    dated = dated.withColumn("last_day", F.greatest("first_day", F.coalesce("event_end", "first_day")))
    note = F.substring(F.coalesce("abstract", F.lit("")), 1, NOTE_CHARS)
    told = {
        "UID": F.concat(F.lit("tidewheel-"), F.col("item_id").cast("string"), F.lit("@localhost")),
        "DTSTART;VALUE=DATE": F.date_format("first_day", "yyyyMMdd"),
        "DTEND;VALUE=DATE": F.date_format(F.date_add("last_day", 1), "yyyyMMdd"),
        "SUMMARY": text.calendar_escape(F.coalesce("title", F.lit(""))),
        "DESCRIPTION": text.calendar_escape(note),
        "URL": text.calendar_escape(urls.safe_url(F.coalesce("url", F.lit("")))),
    }
    lines = [F.lit(x) for x in CALENDAR_OPEN] + [F.concat(F.lit(f"{k}:"), v) for k, v in told.items()] + [F.lit(x) for x in CALENDAR_CLOSE]
    return dated.select("item_id", "first_day", "last_day", F.concat_ws("\r\n", *lines).alias("ics"))


def _attribute(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def outlines(sources: DataFrame) -> DataFrame:
    """(section, feeds, skipped, outline): an outline element per section with its feeds by name; other kinds of sources are only counted.

    ``sources`` has name, kind, section and url; no section is research.
    """
    feed = F.when((F.col("kind") == "rss") & (F.coalesce("url", F.lit("")) != ""), F.struct("name", "url"))
    rows = sources.withColumns({"section": F.coalesce("section", F.lit("research")), "feed": feed})
    by = rows.groupBy("section").agg(F.array_sort(F.collect_list("feed")).alias("f"), F.count_if(F.col("kind") != "rss").alias("skipped"))
    one = lambda x: F.concat(F.lit('<outline type="rss" text="'), _attribute(x["name"]), F.lit('" title="'), _attribute(x["name"]), F.lit('" xmlUrl="'), _attribute(x["url"]), F.lit('"/>'))
    head = _attribute(F.initcap("section"))
    whole = F.concat(F.lit('<outline text="'), head, F.lit('" title="'), head, F.lit('">'), F.array_join(F.transform("f", one), ""), F.lit("</outline>"))
    return by.select("section", F.size("f").alias("feeds"), "skipped", whole.alias("outline"))
