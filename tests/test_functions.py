import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import quality, scores, text, urls, vectors


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in zip(cols, ["string"] * len(cols), strict=True))) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/Path/?utm_source=a&b=2&utm_medium=c#frag", "https://example.com/Path/?b=2"),
        ("https://example.com/a/", "https://example.com/a"),
        ("https://www.example.com/?utm_source=x", "https://www.example.com"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.com/a%7Eb/?b=2&a=1&utm_id=9&fbclid=z", "https://example.com/a~b?a=1&b=2"),
        ("https://example.com/a b/", "https://example.com/a%20b"),
        ("https://example.com", "https://example.com"),
    ],
)
def test_normalized_url(spark, url, want):
    assert one(spark, urls.normalized_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("https://doi.org/10.1038/ABC.1", "10.1038/abc.1"),
        ("doi: 10.1000/xyz).", "10.1000/xyz"),
        ("https://www.nature.com/articles/s41586-026-01234-5", "10.1038/s41586-026-01234-5"),
        ("https://www.science.org/doi/10.1126/sciadv.abc", "10.1126/sciadv.abc"),
        ("nothing", None),
    ],
)
def test_extract_doi(spark, value, want):
    assert one(spark, urls.extract_doi(F.col("v")), v=value) == want


def test_arxiv_keys_are_anchored(spark):
    pub = "https://pubmed.ncbi.nlm.nih.gov/39876543/"
    assert one(spark, urls.extract_arxiv(F.col("u"), F.lit(""), F.lit("pubmed")), u=pub) is None
    assert one(spark, urls.extract_arxiv(F.col("u"), F.lit(""), F.lit("x"), legacy=True), u=pub) == "gov/3987654"
    assert one(spark, urls.extract_arxiv(F.col("u"), F.lit(""), F.lit("x")), u="https://arxiv.org/abs/2401.12345v3") == "2401.12345"


def test_title_keys(spark):
    assert one(spark, urls.title_key(F.col("t")), t="Self-Assembly: a  Study (Small 12/2024)") == "self assembly a study"
    day = one(spark, urls.title_day_key(F.col("t"), F.lit(dt.datetime(1970, 1, 2))), t="A long enough title")
    assert day == "title_day:t12h:2:a long enough title"
    assert one(spark, urls.title_day_key(F.col("t"), F.lit(dt.datetime(1970, 1, 2))), t="short") is None


def test_strip_html(spark):
    html = "<p>A &amp; B</p><script type='x'>bad()</script><STYLE>.a{}</STYLE> <b>c</b>"
    assert one(spark, text.strip_html(F.col("h")), h=html) == "A & B c"


def test_novelty_needs_substance(spark):
    hype = one(spark, text.novelty(F.col("t"), F.lit("x"), F.lit("y")), t="a landmark breakthrough")
    real = one(spark, text.novelty(F.col("t"), F.lit("x"), F.lit("y")), t="a landmark breakthrough in 9 mice")
    assert hype == pytest.approx(0.24) and real == pytest.approx(0.48)


def test_vote_tokens(spark):
    got = one(spark, text.vote_tokens(F.col("t")), t="+R3 R7, -I5 - g2 W1 x9y")
    assert [(r.label, r.value) for r in got] == [("R3", 1), ("R7", 1), ("I5", -1), ("G2", -1), ("W1", -1)]


def test_unquoted_lines(spark):
    got = one(spark, text.unquoted_lines(F.col("t")), t="+R1\n> old\nfine\nOn Monday, X wrote:\n-R2")
    assert got == ["+R1", "fine"]


def test_author_match(spark):
    assert one(spark, text.author_match(F.col("a"), ["Doe, Jane"]), a="J. Roe, Jane M. Doe") == 1.0
    assert one(spark, text.author_match(F.col("a"), ["Doe"]), a="Jane Doe") == 0.0
    assert text.unusable_authors(["Doe", "Jane Doe"]) == ["Doe"]


def test_extractive_summary(spark):
    body = "The title words here. We present an assay with 12 results. Filler text follows. A new method wins!"
    got = one(spark, text.extractive_summary(F.lit("The title words here"), F.col("b")), b=body)
    assert got == "We present an assay with 12 results. A new method wins!"


def test_calendar_and_json(spark):
    assert one(spark, text.calendar_escape(F.col("t")), t="a;b,c\nd") == "a\\;b\\,c\\nd"
    assert one(spark, text.first_json_object(F.col("t")), t='note {"1": "a"} end') == {"1": "a"}


def test_buckets(spark):
    for source, want in [("bioRxiv", "bio_med_preprint"), ("arXiv cs.LG", "arxiv_cs"), ("OpenAlex", "aggregator"), ("Nature", "published_journal"), ("J. Unknown", "low_impact_journal"), ("ChemRxiv", "preprint_other")]:
        assert one(spark, quality.source_bucket(F.col("s"), F.lit("research")), s=source) == want
    assert one(spark, quality.source_bucket(F.col("s"), F.lit("world")), s="BBC") == "world"


def test_freshness(spark):
    now = F.lit(dt.datetime(2024, 1, 31))
    at = lambda days, sec: one(spark, scores.freshness_penalty(F.lit(dt.datetime(2024, 1, 31) - dt.timedelta(days=days)), F.lit(sec), now))
    assert at(1, "research") == pytest.approx(-0.05)
    assert at(16, "research") == pytest.approx(0.04)
    assert at(3, "industry") == pytest.approx(0.2)
    assert at(46, "regulatory") == pytest.approx(0.05)


def test_catch_up_and_floor():
    assert scores.catch_up_window(0, 12) == (2, 12)
    assert scores.catch_up_window(30, 12) == (21, 40)
    assert scores.adaptive_floor(0.5, None, 1.0) == 0.5
    assert scores.adaptive_floor(0.5, 10.0, -5.5) == pytest.approx(0.55)
    assert scores.adaptive_floor(0.5, 10.0, -50.0) == pytest.approx(0.7)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 8), st.integers(1, 20), st.integers(0, 2**31))
def test_knn_matches_a_loop(k, n, seed):
    rng = np.random.default_rng(seed)
    x, e = rng.normal(size=(6, 4)), rng.normal(size=(n, 4))
    g, ids = rng.uniform(-1, 1, n), np.arange(n)
    got = vectors.knn_scores(x, np.arange(6), ids, e, g, k)
    for i in range(6):
        s = [(-1.0 if j == i else float(np.dot(x[i], e[j]) / np.linalg.norm(x[i]) / np.linalg.norm(e[j])), j) for j in range(n)]
        best = sorted(s)[::-1][:k]
        w = [max(v, 0) ** 2 for v, _ in best]
        want = sum(a * g[j] for a, (_, j) in zip(w, best, strict=True)) / sum(w) if sum(w) else 0.0
        assert got[i] == pytest.approx(want)
