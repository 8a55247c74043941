"""The language identifier, the embedding and the trigram index."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import vectors
from tidewheel.functions.grams import trigrams
from tidewheel.operators import candidates, embedding, language, search
from tidewheel.plans import fixtures
from tidewheel.sources.commits import Tables

TEXTS = [("the thing there", "en"), ("THE other then", "en"), ("der die das und", "de"), ("undön der ß", "de"), (None, "en"), ("nowhere", None), ("ab", "fr"), ("", "de")]


def test_trigram_numbers_sort_as_texts():
    some = ["abc", "ab\U0001f600", "zzz", "éàü", "aBC", "   "]
    assert sorted(some, key=lambda t: t.lower()) == sorted(some, key=lambda t: int(trigrams(t)[0]))
    assert len(trigrams(None)) == len(trigrams("ab")) == 0 and trigrams("aBCd").tolist() == trigrams("AbcD").tolist()


@pytest.mark.parametrize("size", [5, 1000])
def test_identifier_agrees_with_plain_counts(spark, size):
    model = language.fit(spark.createDataFrame(TEXTS, "text string, lang string").repartition(3), size=size)
    grams = lambda t: [t.lower()[i : i + 3] for i in range(len(t) - 2)]
    counts = {x: collections.Counter(g for t, y in TEXTS if t and y == x for g in grams(t)) for x in ("en", "de")}
    total = counts["en"] + counts["de"]
    kept = sorted(total, key=lambda g: (-total[g], g))[:size]

    def slow(text):
        known = [g for g in grams(text or "") if g in kept]
        sums = {x: sum(math.log((counts[x][g] + 1) / (sum(counts[x][k] for k in kept) + len(kept))) for g in known) for x in counts}
        return min(sums, key=lambda x: (-round(sums[x], 9), x)) if known else None

    for text in [*[t for t, _ in TEXTS], "und there", "the und", "xyz", "DER"]:
        assert model.likeliest(text) == slow(text)


def test_gate_lets_short_and_unknown_texts_pass(spark):
    model = language.fit(spark.createDataFrame(TEXTS, "text string, lang string"))
    rows = [(1, "der die das und der die"), (2, "the other thing there then"), (3, "und"), (4, None), (5, "1234567890 1234567890 1"), (6, " " * 30 + "der")]
    got = spark.createDataFrame(rows, "id int, t string").where(model.passes("t")).collect()
    assert sorted(r.id for r in got) == [2, 3, 4, 5, 6]
    empty = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert empty.likeliest("anything at all") is None


def test_small_holds_change_no_count(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS * 3, "text string, lang string").coalesce(1)
    want = sorted(map(tuple, language.gram_counts(df).collect()))
    monkeypatch.setattr(language, "GATHERED", 4)
    monkeypatch.setattr(language, "HELD", 3)
    assert sorted(map(tuple, language.gram_counts(df).collect())) == want


def test_held_out_accuracy(spark, sf):
    from tidewheel.plans import payloads

    rows = payloads.language_accuracy(spark, sf).collect()
    assert sum(r.correct for r in rows) >= 0.95 * sum(r.texts for r in rows) > 0


@pytest.fixture(scope="module")
def model(spark, sf):
    return embedding.fit(fixtures.items(spark, sf), "text", terms=3000)


def test_factors_are_the_dominant_ones(spark, sf, model):
    """Against numpy's SVD of the whole matrix: what they capture of its weight."""
    texts = [r.text for r in fixtures.items(spark, sf).select("text").collect()]
    a = np.zeros((len(texts), len(model.terms)))
    for k, t in enumerate(texts):
        at, w = model.weights(t)
        a[k, at] = w
    best = (np.linalg.svd(a, compute_uv=False)[: embedding.DIM] ** 2).sum()
    assert np.allclose(model.factors.T @ model.factors, np.eye(embedding.DIM), atol=1e-8)
    assert np.linalg.norm(a @ model.factors) ** 2 >= 0.97 * best


def test_near_copies_are_neighbours(spark, sf, model):
    """Of each text with every tenth word changed, the original is among the ten nearest texts, 95 times in 100."""
    texts = [r.text for r in fixtures.items(spark, sf).select("text").collect() if len((r.text or "").split()) >= 20]
    rng = np.random.default_rng(0)
    copies = [" ".join("changed" if rng.random() < 0.1 else w for w in t.split()) for t in texts]
    df = spark.createDataFrame(list(zip(texts, copies, strict=True)), "t string, c string").select(model.vectors("t").alias("a"), model.vectors("c").alias("b")).collect()
    a, b = (np.array([getattr(r, x) for r in df]) for x in "ab")
    near = np.argsort(-(b @ a.T), axis=1)[:, :10]
    same = np.array([[texts[j] == texts[i] for j in row] for i, row in enumerate(near)]).any(1)
    assert same.mean() >= 0.95
    assert np.allclose(vectors.unit(a), a)


def test_stamped_model_table(spark, model, tmp_path):
    table = model.table(spark)
    table.write.parquet(f"file://{tmp_path}/model")
    back = embedding.Factors.load(spark.read.parquet(f"file://{tmp_path}/model"), model.stamp)
    assert back.stamp == model.stamp and np.allclose(back.vector("the trial of a gene"), model.vector("the trial of a gene"))
    with pytest.raises(ValueError):
        embedding.Factors.load(table.withColumn("idf", F.col("idf") + 1))
    with pytest.raises(ValueError):
        embedding.Factors.load(table, "none")


def test_awkward_texts_have_vectors(spark, model):
    rows = spark.createDataFrame([(None,), ("",), ("\U0001f600 !!",), ("unseenword",), ("the " * 50_000,)], "t string").select(model.vectors("t").alias("v")).collect()
    assert [round(float(np.linalg.norm(r.v)), 6) in (0, 1) for r in rows] == [True] * 5 and all(len(r.v) == embedding.DIM for r in rows)
    few = embedding.fit(spark.createDataFrame([("a b",), ("a b c",), (None,)], "t string"), "t")
    assert len(few.terms) == 2 and len(few.vector("a")) == embedding.DIM
    none = embedding.fit(spark.createDataFrame([], "t string"), "t")
    assert not none.vector("a").any()


def test_search_through_postings(spark, tmp_path):
    words = ["alpha", "Phase", "PHASEOUT", "phas e", "über", "x", None, "Überphase", "a.b%c"]
    rows = [(i, words[i % len(words)], words[(i * 7 + 3) % len(words)], i % 10) for i in range(90)]
    items = spark.createDataFrame(rows, "item_id long, title string, body string, at int").withColumn("created_at", F.timestamp_seconds("at"))
    index = search.TrigramIndex(Tables(spark, f"file://{tmp_path}/s"), ["title", "body"])
    assert index.candidates("phase") is None
    index.add(items.where("item_id < 50"))
    index.add(items.where("item_id >= 50"))
    for query in ("phase", "PHASE", "s e", "Über", "b%c", "nothing", "x", "", "alphas"):
        want = [r.item_id for r in candidates.keyword_search(items, query, ["title", "body"]).collect()]
        assert [r.item_id for r in index.search(items, query).collect()] == want
    # an item whose text changed is found by the new text and no longer by the old
    items = items.withColumn("title", F.when(F.col("item_id") == 4, "gamma").otherwise(F.col("title"))).withColumn("body", F.when(F.col("item_id") == 4, "delta").otherwise(F.col("body")))
    index.add(items.where("item_id = 4"))
    for query in ("gamma", "phase", "über"):
        want = [r.item_id for r in candidates.keyword_search(items, query, ["title", "body"]).collect()]
        assert [r.item_id for r in index.search(items, query).collect()] == want


def test_search_reads_posting_lists_first(spark, tmp_path):
    items = spark.createDataFrame([(i, f"text {i}", i) for i in range(50)], "item_id long, title string, at int").withColumn("created_at", F.timestamp_seconds("at"))
    items.write.parquet(f"file://{tmp_path}/items")
    index = search.TrigramIndex(Tables(spark, f"file://{tmp_path}/s"), ["title"])
    index.add(items)
    found = index.search(spark.read.parquet(f"file://{tmp_path}/items"), "t 17")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "In(gram" in plan and [r.item_id for r in found.collect()] == [17]
    assert index.candidates("t 17").count() == 1
