"""Divergence of the sources of each language, by an inverted index with baseline correction.

With p(g, t) = 1 + floor(S * (count + 1) / (N + V)) for group g and term t, over the V
terms that a language keeps and the N occurrences of them in the group, two groups
differ in a term by f(p, q) = floor((p - q)**2 / q). Every pair of groups begins at
V times the f of two zero counts. A posting (term, group, count) then adds what
differs from that: its count against the other group's zero, summed once per
distinct count of a group; and, where both groups have the term, the rest of it,
from the term's posting list. Terms that neither group has cost nothing.

All numbers are integers of 64 bits: f summed over a pair stays below 2e18, as the p
of a group add up to S + V at most, and the products are divided in three steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import buffers
from tidewheel.scratch import cut

MIN_DOCS = 3
#: S: the smoothed share of a term is a whole number of billionths.
SCALE_STEPS, STEP = 3, 1000
TOP_TERMS = 200
#: Distinct (group, term) counts that a task holds before it passes them on.
HELD = 300_000

#: A-Z to a-z; what is neither an ASCII letter nor beyond ASCII to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of one text that are split into terms at a time.
STEP_BYTES = 8_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold the term), summed per task; a row with an empty term for each group met."""
    kind = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in groups.items():
                size = len(n) + 1
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array([b"", *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(rows.__getitem__, n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for (a, b), key in zip(zip(offsets[:-1], offsets[1:], strict=True), keys, strict=True):
                n, rows = groups.setdefault(key, (Counter(), Counter()))
                text, lo, own = data[a:b].tobytes().translate(_FOLD), 0, set()
                while lo < len(text):
                    hi = text.find(b" ", lo + STEP_BYTES)
                    hi = len(text) if hi < 0 else hi
                    terms = text[lo:hi].split()
                    n.update(terms)
                    own.update(terms)
                    lo = hi
                rows.update(own)
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from out()
        yield from out()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(*[text(c).alias(c) for c in ("lang", "source", "text")]).mapInArrow(count, kind)


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative longs."""
    return F.call_function("div", a, b)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(S * (count + 1) / (n + v)), by long division so that no product leaves 64 bits."""
    whole, rest, of = F.lit(0).cast("long"), count + 1, F.greatest(n + v, F.lit(1))
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        whole, rest = whole * STEP + _div(rest, of), rest % of
    return whole + 1


def distance(p: Column, q: Column) -> Column:
    """f(p, q)."""
    return _div((p - q) * (p - q), q)


def index(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The postings and the groups, as tables in the shared folder.

    Postings: lang, term, source, n, of_lang (the term's occurrences in its
    language), for terms in at least ``min_docs`` rows of the language. Groups:
    lang, source, total (N), terms (V), lang_total and zero, the p of a zero count.
    """
    term = Window.partitionBy("lang", "term")
    rows = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.withColumn("of_lang", F.sum("n").over(term)).withColumn("held_by", F.sum("docs").over(term)).withColumn("leads", F.col("source") == F.min("source").over(term))
    rows = cut(rows.where((F.col("term") == "") | (F.col("held_by") >= min_docs)).drop("docs", "held_by"), "postings")
    lang = Window.partitionBy("lang")
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("leads") & (F.col("term") != "")).alias("led"))
    groups = groups.withColumn("terms", F.sum("led").over(lang)).withColumn("lang_total", F.sum("total").over(lang)).drop("led")
    groups = cut(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    return rows.where("term <> ''").drop("leads"), groups


def divergences(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: f summed over all kept terms, for every two sources of a language in either order."""
    own = postings.join(groups.select("lang", "source", "total", "terms", "zero"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("terms").alias("v"))
    ahead, back = (F.col("source"), F.col("item")), (F.col("item"), F.col("source"))
    both = lambda df, to, fro: df.select("lang", F.explode(F.array(F.struct(*_pair(*ahead), to.alias("value")), F.struct(*_pair(*back), fro.alias("value")))).alias("e")).select("lang", "e.*")
    z, iz, p, ip = F.col("zero"), F.col("item_zero"), F.col("p"), F.col("item_p")
    flat, flat_back = distance(z, iz), distance(iz, z)
    # every pair as if no source had any term
    begin = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * flat).alias("value"))
    # postings against a source without the term: once per distinct count
    alike = own.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times")).join(other, "lang").where("source <> item")
    alone = alike.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (distance(p, iz) - flat)).alias("to"), F.sum(F.col("times") * (distance(iz, p) - flat_back)).alias("fro"))
    # what is left where both have it: from the term's posting list
    mate = own.select("lang", "term", F.col("source").alias("item"), p.alias("item_p"), F.col("zero").alias("item_zero"))
    met = own.select("lang", "term", "source", "p", "zero").join(mate, ["lang", "term"]).where("source < item")
    shared = met.groupBy("lang", "source", "item").agg(
        F.sum(distance(p, ip) - distance(p, iz) - distance(z, ip) + flat).alias("to"),
        F.sum(distance(ip, p) - distance(ip, z) - distance(iz, p) + flat_back).alias("fro"),
    )
    parts = begin.unionByName(both(alone, F.col("to"), F.col("fro"))).unionByName(both(shared, F.col("to"), F.col("fro")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _pair(source: Column, item: Column) -> tuple[Column, Column]:
    return source.alias("source"), item.alias("item")


def telling_terms(postings: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source uses more than its language does, the most telling ``top`` of each source.

    The rank's bound reaches below the shuffle, so a source with most of the
    postings sends ``top`` of each task.
    """
    rows = postings.join(groups.drop("zero"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(_best())).where(F.col("rank") <= top)


def _best() -> Window:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others (``pair``), and by which terms from its language (``term``).

    Null text, lang and source count as empty; rows that repeat count each; texts
    without terms give their group all the same, at p of zero counts. Ties of one
    rank go by item, in UTF-8 order. A language that keeps no term has pairs of
    value 0. An empty table gives no row. Columns other than text, lang and source
    are not read. ``pair`` has a row for every ordered pair of a language's
    sources, which is what is asked for.
    """
    postings, groups = index(docs, min_docs)
    pairs = divergences(postings, groups).withColumn("rank", F.row_number().over(_best())).withColumn("part", F.lit("pair"))
    terms = telling_terms(postings, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term, count(*) AS of_lang FROM o GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(total)::HUGEINT AS total FROM t GROUP BY lang),
m AS (SELECT t.lang, t.source, v.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (t.total + s.v) AS p,
             1 + (1000000000::HUGEINT * (of_lang + 1)) // (l.total + s.v) AS q
      FROM t JOIN s USING (lang) JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (t.lang, t.source, v.term)),
a AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
      FROM m x JOIN m y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON (a.lang, a.source, a.item) = (x.lang, x.source, y.source)
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM m WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
