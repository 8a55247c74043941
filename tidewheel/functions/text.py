"""Text expressions: clean-up, lexical scores, parsing of replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel.functions.terms import term_counts


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Keep a number within bounds."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def item_text(title: Column, abstract: Column, joint: str = " ") -> Column:
    """Title and abstract as one text; the title alone where there is no abstract."""
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    return F.when(abstract == "", title).otherwise(F.concat(title, F.lit(joint), abstract))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _terms(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms a lower-case text contains as substrings."""
    return F.size(F.filter(_terms(terms), lambda t: F.contains(text, t)))


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether a lower-case text contains one of the terms."""
    return F.exists(_terms(terms), lambda t: F.contains(text, t))


def strip_html(html: Column) -> Column:
    """Text of HTML: no scripts, styles and tags, common entities resolved, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def novelty(text: Column, source: Column, title: Column) -> Column:
    """Novelty from high and moderate terms; hype without substance counts half; reviews lose a little."""
    n = term_counts(text)
    substance = (n["method"] > 0) | text.rlike("[0-9]")
    strong = F.least(F.lit(0.75), n["high"] * F.lit(0.24)) * F.when((n["high"] > 0) & ~substance, 0.5).otherwise(1.0)
    review = (F.contains(F.lower(source), F.lit("review")) | F.lower(title).rlike(r"\breview\b")) & (n["high"] == 0)
    total = strong + F.least(F.lit(0.35), n["moderate"] * F.lit(0.08)) - F.when(review, 0.12).otherwise(0.0)
    return F.when(text == "", F.lit(0.0)).otherwise(clip(total))


def promotional(text: Column, promo_risk: Column) -> Column:
    """Promotion from sales and access terms on top of the source's own risk."""
    n = term_counts(text)
    return clip(F.least(F.lit(0.75), n["promo"] * F.lit(0.22)) + F.least(F.lit(0.35), n["access"] * F.lit(0.14)) + promo_risk)


def access_friction(text: Column) -> Column:
    """Friction from access terms."""
    return clip(F.least(F.lit(0.35), term_counts(text)["access"] * F.lit(0.14)))


def content_type(text: Column, section: Column) -> Column:
    """The first content type with a term in the text, else by section."""
    n = term_counts(text)
    out = F.when(F.lower(section) == "research", "research").otherwise("article")
    for label in reversed(L.CONTENT_TYPES):
        out = F.when(n[f"type_{label}"] > 0, label).otherwise(out)
    return out


def downweight(text: Column, terms: list[str], penalty: float = L.DOWNWEIGHT) -> Column:
    """Penalty if any of the reader's terms occurs."""
    return let(F.lower(text), lambda low: F.when(has_any(low, [t.lower() for t in terms]), penalty).otherwise(0.0))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def author_match(authors: Column, watched: list[str]) -> Column:
    """1.0 if all name parts of a watched author (two at least) are in the byline, else 0.0."""
    have = tokens(authors)
    found = F.lit(False)
    for name in watched:
        parts = sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split()))
        if len(parts) >= 2:
            found = found | (F.size(F.array_except(F.array(*[F.lit(p) for p in parts]), have)) == 0)
    return F.when(found, 1.0).otherwise(0.0)


def unusable_authors(watched: list[str]) -> list[str]:
    """Watch entries of fewer than two name parts."""
    return [n for n in watched if len(set("".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()).split())) < 2]


def sentences(text: Column) -> Column:
    """Sentences, cut behind ``.``, ``!`` or ``?`` and white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def title_like(sentence: Column, title: Column, share: float = 0.72) -> Column:
    """Whether a sentence repeats the title: its words cover most of the title's."""
    a, b = F.array_distinct(tokens(sentence)), F.array_distinct(tokens(title))
    return (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1)) >= share)


def extractive_summary(title: Column, abstract: Column, keep: int = 2) -> Column:
    """The best sentences of an abstract in their own order.

    A sentence scores its result terms plus up to three digits, then its length; title-like ones are left out.
    """
    scored = F.transform(sentences(abstract), lambda s, i: F.struct((hits(F.lower(s), L.METHOD_OR_RESULT) + F.least(F.regexp_count(s, F.lit("[0-9]")), F.lit(3))).alias("score"), F.length(s).alias("size"), (-i).alias("place"), s.alias("s")))
    fresh = F.filter(scored, lambda x: ~title_like(x["s"], title))
    best = F.slice(F.sort_array(fresh, asc=False), 1, keep)
    ordered = F.array_sort(F.transform(best, lambda x: F.struct((-x["place"]).alias("at"), x["s"].alias("s"))))
    return F.array_join(F.transform(ordered, lambda x: x["s"]), " ")


def unquoted_lines(body: Column) -> Column:
    """Lines of a reply above its signature or quotation, without quoted ones."""
    lines = F.split(body, r"\r?\n")
    stop = lambda x: (x == "-- ") | F.trim(x).rlike(r"^On .*wrote:$") | F.trim(x).startswith("From:")
    ends = F.filter(F.transform(lines, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
    cut = F.when(F.size(ends) > 0, F.slice(lines, F.lit(1), F.array_min(ends))).otherwise(lines)
    return F.filter(cut, lambda x: ~F.ltrim(x).startswith(">"))


def vote_tokens(line: Column) -> Column:
    """Vote tokens of a line as (label, value): a bare sign holds for what follows, an unsigned label is a plus."""
    words = F.filter(F.split(F.regexp_replace(line, ",", " "), r"\s+"), lambda w: w != "")
    empty = F.struct(F.lit(1).alias("sign"), F.array().cast("array<struct<label:string,value:int>>").alias("out"))
    label = lambda w: F.upper(F.regexp_extract(w, r"^[+\-]?([A-Za-z][0-9]+)$", 1))
    value = lambda acc, w: F.when(w.startswith("-"), -1).when(w.startswith("+"), 1).otherwise(acc["sign"])
    step = lambda acc, w: F.struct(F.when(w == "+", 1).when(w == "-", -1).otherwise(acc["sign"]).alias("sign"), F.when(label(w) != "", F.concat(acc["out"], F.array(F.struct(label(w).alias("label"), value(acc, w).alias("value"))))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(words, empty, step, lambda acc: acc["out"])


def inverted_index_text(index: Column) -> Column:
    """Text of a map from word to positions, by position, then word."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def summary_field(text: Column, label: str) -> Column:
    """What follows a label line in a structured summary."""
    return F.trim(F.regexp_extract(text, rf"(?im)^{label}:\s*(.*)$", 1))


def calendar_escape(text: Column) -> Column:
    """Text for a calendar file."""
    out = text
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def first_json_object(text: Column) -> Column:
    """Id-to-text map of the JSON object in free text; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), "map<string,string>")
