import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel import schemas
from tidewheel.operators import digest, learning, profile, ranking
from tidewheel.plans import fixtures


def test_pairs_are_drawn_without_forming_others(spark):
    rows = [(i, 1 if i < 30 else -1, float(i)) for i in range(60)]
    votes = spark.createDataFrame(rows, "item_id long, value int, f double")
    few = learning.pairwise_training(votes.where("item_id in (0, 1, 40)"), ["f"])
    assert sorted((r.label, r.f) for r in few.collect()) == [(0.0, 39.0), (0.0, 40.0), (1.0, -40.0), (1.0, -39.0)]
    many = learning.pairwise_training(votes, ["f"], pairs=100, seed=1).collect()
    assert len(many) == 200
    again = learning.pairwise_training(votes.repartition(3), ["f"], pairs=100, seed=1).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, again))


def test_margin_ranks_by_the_informative_feature(spark):
    rng = np.random.default_rng(0)
    rows = [(float(k % 2), float(k % 2) + float(rng.normal() / 4), float(rng.normal()), 1.0) for k in range(80)]
    df = spark.createDataFrame(rows, "label double, good double, noise double, flat double")
    model = learning.MarginRanker(["good", "noise", "flat"]).fit(df)
    got = {r.label: r.m for r in model.margin(df).groupBy("label").agg(F.avg("margin").alias("m")).collect()}
    assert got[1.0] > 0 > got[0.0]
    with pytest.raises(ValueError, match="both"):
        learning.MarginRanker(["good"]).fit(df.where("label = 1"))


def test_calibrator(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "score double, label int")
    a, b = learning.fit_calibrator(df)
    grad = lambda a, b: (np.sum((1 / (1 + np.exp(-(a * x + b))) - y) * x) + a, np.sum(1 / (1 + np.exp(-(a * x + b))) - y))
    assert grad(a, b) == pytest.approx((0, 0), abs=1e-6)
    assert a == pytest.approx(2, abs=0.6)
    assert learning.fit_calibrator(df.limit(5)) is None
    assert learning.fit_calibrator(df.where("label = 1")) is None
    assert learning.fit_calibrator(df.withColumn("label", 1 - F.col("label"))) is None


def test_calibration_rows_use_one_version(spark):
    seen = spark.createDataFrame([(1, 1, 0.2, "v1", dt.datetime(2024, 1, 1)), (2, 1, 0.4, "v1", dt.datetime(2024, 1, 2)), (3, 1, 0.9, "v2", dt.datetime(2024, 1, 3))], "impression_id long, item_id long, score double, ranker_version string, created_at timestamp")
    votes = spark.createDataFrame([(1, 1), (2, 0)], "item_id long, value int")
    assert [tuple(r) for r in learning.calibration_rows(seen, votes, "v1").collect()] == [(0.4, 1)]


def test_deployment_gate():
    assert learning.deploys([0.9, 0.9], [0.8, 0.81])
    assert not learning.deploys([0.9, 0.88], [0.8, 0.81])
    assert not learning.deploys([], [])


def test_profile_facets(spark):
    p = profile.Profile("One. Two!", ["kw"], ["ctx"], {"KW": 9, "extra": 0.01}, ["Work"], {"kw": 0.7})
    assert profile.facet_rows(p) == [("One.", 1.5), ("Two!", 1.5), ("kw", 3.0), ("ctx", 0.45), ("extra", 0.05), ("Work", 2.0)]
    rows = profile.facets(spark, p, (np.ones(64), 0.2)).orderBy("facet_id").collect()
    assert len(rows) == 7 and rows[2].priority == 0.7 and rows[-1].label == "learnt"
    got = spark.createDataFrame([("a b",), (None,)], "t string").select(profile.hashed_embedding("t").alias("v")).collect()
    assert np.linalg.norm(got[0].v) == pytest.approx(1) and np.linalg.norm(got[1].v) == 0


def test_schemas_and_migration(spark):
    assert len(schemas.TABLES) == 15
    old = spark.createDataFrame([(1, 1, "x")], "item_id int, value long, junk string")
    new = schemas.migrate(old, "votes")
    assert new.schema == schemas.schema("votes") and new.first().grade is None


def test_brew(spark, sf):
    reader = profile.Profile(keywords=["crispr"])
    items = fixtures.items(spark, sf).withColumns({"external_id": F.lit(""), "url": F.lit(""), "fetched_at": F.col("published_at"), "vec": profile.hashed_embedding("text")})
    votes = fixtures.votes(spark, sf)
    run = digest.brew(items, votes, profile.facets(spark, reader), fixtures.as_of(), digest.Settings(days=20, mode="usual"))
    slate = run.slate.collect()
    assert 0 < len(slate) <= 15 and len({r.label for r in slate}) == len({r.item_id for r in slate}) == len(slate)
    assert run.slate.join(votes.where("value <> 1"), "item_id").count() == 0
    assert run.impressions.where("selected").count() == len(slate)
    assert run.dropped.join(run.slate, "item_id").count() == 0
    full = digest.brew(items, votes, profile.facets(spark, reader), fixtures.as_of(), digest.Settings(days=20, scoring="cosine"))
    assert full.slate.count() >= len(slate)


def test_brew_leaves_few_tables_and_moves_no_texts(spark, sf, monkeypatch):
    """Whole items are there twice at most, and what ranks read has no texts."""
    from tidewheel import scratch
    from tidewheel.operators import dedupe, embedding

    made, real = [], scratch.cut

    def cut(df, name="cut"):
        out = real(df, name)
        made.append((name, df.columns, out.cut_path))
        return out

    for module in (digest, dedupe, embedding, ranking):
        monkeypatch.setattr(module, "cut", cut)
    items = fixtures.items(spark, sf)
    model = embedding.fit(items, "text", terms=100, dim=8)
    items = items.withColumns({"external_id": F.lit(""), "url": F.concat(F.lit("https://x.org/"), F.col("item_id").cast("string")), "fetched_at": F.col("published_at"), "vec": model.vectors("text")}).drop("text")
    run = digest.brew(items, fixtures.votes(spark, sf), profile.facets(spark, profile.Profile(keywords=["crispr"]), embed=model.vector), fixtures.as_of(), digest.Settings(days=20))
    assert run.slate.count() and run.dropped.count() >= 0
    there = lambda path: spark.sparkContext._jvm.java.io.File(path.removeprefix("file:")).exists()
    assert {"weights", "pool", "keys", "single", "gated", "signal", "scored"} <= {name for name, _, _ in made}
    assert [name for name, columns, path in made if there(path) and ("abstract" in columns or name in ("weights", "keys"))] == ["gated"]


def test_config_files(spark, tmp_path):
    from tidewheel.sources import config

    (tmp_path / "s.yaml").write_text('{"sources": [{"name": "A", "section": "world", "kind": "rss", "prestige_score": 1}]}')
    body = config.read_text(spark, f"file://{tmp_path}/s.yaml")
    row = config.sources(spark, body).first()
    assert (row.name, row.prestige, row.paywalled) == ("A", 1.0, False)
    with pytest.raises(ValueError, match="section"):
        config.sources(spark, '{"sources": [{"name": "A", "section": "nowhere"}]}')
    with pytest.raises(ValueError, match="kind"):
        config.sources(spark, '{"sources": [{"name": "A", "section": "world", "kind": "ftp"}]}')
    assert config.reader_profile('{"keywords": ["a"], "weights": {"a": 2}}').weights == {"a": 2.0}
    assert config.constraints('{"event_regions": [" europe ", ""]}').event_regions == ["europe"]
    assert config.scoring_enabled({}, "research") and not config.scoring_enabled({"world": 0}, "world")


def test_decks_and_payloads(spark):
    from tidewheel.functions import explain
    from tidewheel.operators import decks

    deck = decks.compose(["j1", "j2", "j3", "j4"], ["f1", "f2"], dt.date(2024, 1, 1))
    start = deck.index("j1")
    assert deck[start:] + deck[:start] == ["j1", "j2", "f1", "j3", "j4", "f2"] and decks.compose([], [], dt.date(2024, 1, 1)) == []
    notes = spark.createDataFrame([(f"n{i}",) for i in range(10)], "note string")
    days = [{r.note for r in decks.daily_draw(notes, 3, dt.date(2024, 1, k), "x").collect()} for k in (1, 2)]
    assert all(len(d) == 3 for d in days) and not days[0] & days[1]
    got = spark.range(1).select(explain.payload(score=explain.rounded(F.lit(0.00005)), tags=explain.freshness_tags(F.lit(0.3)), more=explain.quality_tags(F.lit("top"), F.lit(0.5), F.lit(0.0), F.lit(False))).alias("p")).first().p
    assert got == '{"score":0.0,"tags":["fresh_signal"],"more":["high_quality_source","promo_risk"]}'


def test_item_features_against_plain_numpy(spark):
    rng = np.random.default_rng(2)
    x, f, e = rng.normal(size=(12, 4)), rng.normal(size=(3, 4)), rng.normal(size=(9, 4))
    when = dt.datetime(2024, 1, 20)
    items = spark.createDataFrame([(i, "Novel method", "first-in-class assay", "nature", "research", None if i == 3 else when + dt.timedelta(days=i), "Ann Lee; Bo", [float(v) for v in x[i]]) for i in range(12)], "item_id long, title string, abstract string, source string, section string, published_at timestamp, authors string, vec array<double>")
    facets = spark.createDataFrame([(k, [float(v) for v in f[k]], [0.5, 1.0, 2.5][k]) for k in range(3)], "facet_id long, vec array<double>, weight double")
    signs = [1, -1, 1, 1, -1, 1, 1, -1, 1]
    voted = spark.createDataFrame([(k, [float(v) for v in e[k]], signs[k], 0.1 * (k + 1)) for k in range(9)], "item_id long, vec array<double>, value int, weight double")
    rows = learning.item_features(items, facets, voted, F.lit("2024-01-31").cast("timestamp"), ["Ann Lee"]).orderBy("item_id").collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(x) @ unit(f).T * np.minimum([0.5, 1.0, 2.5], 1)
    for i, r in enumerate(rows):
        assert r.cosine == pytest.approx(0.7 * sims[i].max() + 0.3 * sims[i].mean())
        stale = 0.5 if i == 3 else min(1.0, max(0, 11 - i) / 14)
        assert r.fresh_cosine == pytest.approx(r.cosine * (1 - stale)) and r.author_match == 1.0
        for sign, name in ((1, "pos_affinity"), (-1, "neg_affinity")):
            near = sorted((float(unit(x)[i] @ unit(e)[k]) * 0.1 * (k + 1) for k in range(9) if signs[k] == sign and k != i), reverse=True)[:5]
            assert r[name] == pytest.approx(np.mean(near))
        assert r.novelty > 0 and r.promotional == 0 and r.access_friction == 0


def test_stored_rankers_and_calibrators(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 2), float(i % 2) + 0.1 * (i % 5), 1.0) for i in range(40)], "label double, good double, flat double")
    model = learning.MarginRanker(["good", "flat"]).fit(rows)
    path = f"file://{tmp_path}/ranker"
    assert learning.MarginRanker.load(spark, path, ["good", "flat"]) is None
    model.save(spark, path)
    again = learning.MarginRanker.load(spark, path, ["good", "flat"])
    assert [r.margin for r in again.margin(rows).collect()] == [r.margin for r in model.margin(rows).collect()]
    assert learning.MarginRanker.load(spark, path, ["flat", "good"]) is None and learning.MarginRanker.load(spark, path) is None
    path = f"file://{tmp_path}/calibrator"
    assert learning.load_calibrator(spark, path, "v1") is None
    learning.save_calibrator(spark, path, (2.0, -1.0), "v1")
    assert learning.load_calibrator(spark, path, "v1") == (2.0, -1.0) and learning.load_calibrator(spark, path, "v2") is None


def test_calibrator_against_plain_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(1.5 * x - 0.3)))).astype(int)
    got = learning.fit_calibrator(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "score double, label int"))
    w = np.zeros(2)
    m = np.stack([x, np.ones(200)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-m @ w))
        w -= np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag([1, 0]), m.T @ (p - y) + [w[0], 0])
    assert got == pytest.approx(tuple(w), abs=1e-6)


def test_learnt_facet(spark):
    facets = spark.createDataFrame([(4, "a", [1.0, 0.0], 1.0), (7, "b", [0.0, 1.0], 1.0)], "facet_id long, label string, vec array<double>, weight double")
    vote = lambda k, v, x: (k, v, 1.0, dt.datetime(2024, 1, 1, 0, k), k, x)
    kind = "item_id long, value int, weight double, created_at timestamp, vote_id long, vec array<double>"
    few = spark.createDataFrame([vote(0, 1, [1.0, 0.0])], kind)
    assert ranking.with_learnt_facet(facets, few).count() == 2
    many = spark.createDataFrame([vote(k, 1 if k % 2 else -1, [float(k % 2), 0.5]) for k in range(30)], kind)
    row = ranking.with_learnt_facet(facets, many).where("facet_id = 8").first()
    want = sum((0.08 if k % 2 else -0.04) * 0.995 ** (29 - k) * np.array([k % 2, 0.5]) for k in range(30))
    assert row.vec == pytest.approx(list(want / np.linalg.norm(want))) and row.weight == pytest.approx(2 * 0.25 / 0.75) and row.label is None


def test_brew_with_all_that_may_be_known(spark, sf):
    reader = profile.Profile(keywords=["crispr"])
    items = fixtures.items(spark, sf).withColumns({"external_id": F.lit(""), "url": F.lit(""), "fetched_at": F.col("published_at"), "vec": profile.hashed_embedding("text"), "authors": F.when(F.col("item_id") % 9 == 0, "Ann Lee")})
    votes, facets = fixtures.votes(spark, sf), profile.facets(spark, reader)
    as_of = fixtures.as_of()
    plain = digest.brew(items, votes, facets, as_of, digest.Settings(days=20, scoring="cosine"))
    voted = plain.impressions.orderBy("item_id").collect()
    chips = items.select("item_id", F.array(F.lit("promotional")).alias("reasons"))
    known = digest.Inputs(chips=chips, negatives=facets.limit(1), pins=items.limit(3).select("item_id", F.lit("d0").alias("pinned_digest_id")), deadlines=items.select("item_id", F.lit("2024-02-03").cast("date").alias("deadline")))
    late = digest.brew(items, votes, facets, as_of, digest.Settings(days=20, scoring="cosine", watched=["Ann Lee"], gap_days=10, digest_id="d1"), known)
    assert late.slate.count() > 0
    scored = {r.item_id: r.score for r in late.impressions.collect()}
    before = {r.item_id: r.score for r in voted}
    both = scored.keys() & before.keys()
    moved = {i for i in both if abs(scored[i] - before[i]) > 1e-6}
    assert moved & {i for i in both if i % 9 == 0 and i not in (0, 1, 2)}
    # venues of fresh lookups move scores by half the weight at most, and no other score; without calls and events the reader's fit moves none
    looked_up = items.where("item_id % 2 = 0").select("item_id", F.lit(0).alias("cited_by_count"), F.lit(99.0).alias("venue_impact"), as_of.alias("fetched_at"))
    near = digest.brew(items, votes, facets, as_of, digest.Settings(days=20, scoring="cosine"), digest.Inputs(enrichment=looked_up, reader=[1.0] * profile.DIM))
    after = {r.item_id: r.score for r in near.impressions.collect()}
    both = after.keys() & before.keys()
    assert {i % 2 for i in both} == {0, 1}
    assert {i: after[i] for i in both} == pytest.approx({i: before[i] + (0.09 if i % 2 == 0 else 0.0) for i in both})
    # a missing ranker falls back to the base score; a fitted one is fused with it
    alone = digest.brew(items, votes, facets, as_of, digest.Settings(days=20, scoring="hybrid_lr"))
    assert {r.item_id: r.score for r in alone.impressions.collect()} == pytest.approx(before)
    ranker = learning.MarginRanker(learning.FEATURES)
    ranker.weights, ranker.mean, ranker.scale = [1.0] * 8, [0.0] * 8, [1.0] * 8
    fused = digest.brew(items, votes, facets, as_of, digest.Settings(days=20, scoring="hybrid_lr"), digest.Inputs(ranker=ranker))
    assert {r.item_id: r.score for r in fused.impressions.collect()} != pytest.approx(before)


def test_appended_versions(spark, tmp_path):
    from tidewheel.sources import sinks

    table = sinks.VersionedTable(spark, f"file://{tmp_path}/log")
    for k in range(3):
        table.append(spark.createDataFrame([(k,)], "k int"))
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 2] and table.version()[0] == 3
    assert len(list((tmp_path / "log").glob("v-*"))) == 3
    table.write(spark.createDataFrame([(9,)], "k int"))
    assert [r.k for r in table.read().collect()] == [9]


def test_phrase_gates():
    import re

    from tidewheel.functions import phrases

    says = lambda patterns, t: any(re.search(p, t) for p in patterns)
    for t in ["Author Correction: a thing", "  Erratum", "News & Views on rice", "news&views", "Research highlights of May", "A round-up: News roundup", "How to write a killer CV", "Work–life in the lab", "Fraud charges dropped", "This week in physics", "How do I cite?"]:
        assert says(phrases.NOT_RESEARCH, t), t
    for t in ["Corrections of optics", "Editorially curated atlas of cells", "How to write a parser", "A podcasting study", "Retractions rise", "Networked life of work"]:
        assert not says(phrases.NOT_RESEARCH, t), t
    assert says([phrases.BLOCKED_TITLES], "Volume 3 of it") and says([phrases.BLOCKED_TITLES], "sponsored: x") and not says([phrases.BLOCKED_TITLES], "Volume control") and not says([phrases.BLOCKED_TITLES], "The editorial")
    assert says(phrases.FRONT_MATTER, "\nIssue  Editorial\n Masthead \n") and not says(phrases.FRONT_MATTER, "a\nIssue  Editorial Masthead \nb") and says(phrases.FRONT_MATTER, "see the front cover") and not says(phrases.FRONT_MATTER, "Issue editorial masthead of 1990")
