import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import vectors
from tidewheel.operators import learning, metric, replay

START = dt.datetime(2024, 1, 1)
TEXTS = ["A breakthrough first-in-class approval", "Novel CRISPR method and assay", "Sponsored webinar: register now", "Plain words", "Please subscribe or log in"]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def slow_fit(d, c=0.3):
    """Gradient descent on both directions of every pair."""
    x, y = np.vstack([d, -d]), np.r_[np.ones(len(d)), -np.ones(len(d))]
    scale = np.where(x.std(0) < 1e-6, 1, x.std(0))
    z, w = (x - x.mean(0)) / scale, np.zeros(x.shape[1])
    step = 1 / (1 + c / 4 * np.linalg.eigvalsh(z.T @ z).max())
    for _ in range(20000):
        w = w - step * (w - c * z.T @ (y / (1 + np.exp(y * (z @ w)))))
    return w / scale


def slow_metrics(ids, score, labels, must, k=10):
    order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))
    pairs = [(a, b) for a in range(len(ids)) for b in range(len(ids)) if labels[a] > 0 > labels[b]]
    acc = sum((score[a] > score[b]) + 0.5 * (score[a] == score[b]) for a, b in pairs) / len(pairs) if pairs else None
    ideal = sum(1 / math.log2(i + 2) for i in range(min(k, sum(v > 0 for v in labels))))
    ndcg = sum((labels[i] > 0) / math.log2(p + 2) for p, i in enumerate(order[:k])) / ideal if ideal else None
    recall = sum(must[i] for i in order[:k]) / sum(must) if any(must) else None
    return len(ids), len(pairs), sum(must), acc, ndcg, sum(labels[i] > 0 for i in order[:k]) / len(order[:k]), recall


def top(sims, k):
    return sorted(sims, reverse=True)[:k]


def slow_run(now, ids, labels, must, marks, vec, plain, facets, weights, age):
    """What every ranking is worth, with loops over votes and pairs. ``marks`` are in force, in order of time."""
    own = lambda i: unit(vec[i][None])[0]
    fs = unit(facets)

    def topic(i):
        s = sorted((fs @ own(i)) * np.minimum(weights, 1))[::-1]
        return 0.7 * s[0] + 0.3 * np.mean(s[:3])

    def memory(i):
        near = top([(own(i) @ own(m["item"]), m["item"], m["value"] * m["weight"]) for m in marks if m["item"] != i], 8)
        w = [max(s, 0) ** 2 for s, _, _ in near]
        return sum(a * g for a, (_, _, g) in zip(w, near, strict=True)) / sum(w) if sum(w) > 0 else 0.0

    def affinity(i, sign):
        best = top([own(i) @ own(m["item"]) * m["weight"] for m in marks if m["value"] == sign and m["item"] != i], 5)
        return sum(best) / max(1, len(best))

    def features(i):
        pair = [affinity(i, 1), affinity(i, -1)]
        fresh = topic(i) * (1 - min(1.0, max(0.0, age(now, i)) / 14))
        return {"lr_fused": [topic(i), *plain[i][:3], fresh, 0.0, *pair], "per_facet": [*(fs @ own(i)), *pair], "facets_only": list(fs @ own(i))}

    ups, downs = [m["item"] for m in marks if m["value"] > 0], [m["item"] for m in marks if m["value"] < 0]
    known = {i: features(i) for i in {*ids, *ups, *downs}}
    scores = {"topic": [topic(i) for i in ids]}
    place = lambda s: {i: p for p, (_, i) in enumerate(sorted((-round(v, 12), i) for v, i in zip(s, ids, strict=True)))}
    a = place(scores["topic"])

    def fuse(second):
        b = place(second)
        return [1 / (61 + a[i]) + 1 / (61 + b[i]) for i in ids]

    if marks:
        scores["fused"] = fuse([memory(i) for i in ids])
    if ups and downs:
        for r in replay.RANKERS:
            w = slow_fit(np.array([np.array(known[u][r]) - known[d][r] for u in ups for d in downs]))
            scores[r] = fuse([float(w @ known[i][r]) for i in ids])
    return {name: slow_metrics(ids, s, labels, must) for name, s in scores.items()}


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    n, tastes = 60, rng.normal(size=4)
    vec = {i: rng.normal(size=4) for i in range(n)}
    published = {i: START + dt.timedelta(days=int(rng.integers(-20, 3))) for i in range(n)}
    items = spark.createDataFrame([(i, TEXTS[i % 5], "Body " + TEXTS[i % 3], "nature", "research", published[i], [float(v) for v in vec[i]]) for i in range(n)], "item_id long, title string, abstract string, source string, section string, published_at timestamp, vec array<double>")
    facets = rng.normal(size=(3, 4))
    profile = spark.createDataFrame([(k, [float(v) for v in facets[k]], 0.6 + 0.3 * k) for k in range(3)], "facet_id long, vec array<double>, weight double")
    log = []  # (item, vote, value, grade, hour)
    for v in range(75):
        i = int(rng.integers(0, 50))
        value = int(np.sign(tastes @ vec[i] + rng.normal() / 2)) if v % 9 else 0
        log.append((i, v, value, {1: 100 if v % 4 == 0 else 70, -1: 20, 0: 50}[value], v // 2))
    votes = spark.createDataFrame([(i, v, s, g, START + dt.timedelta(hours=h)) for i, v, s, g, h in log], "item_id long, vote_id long, value int, grade int, created_at timestamp")
    none = spark.createDataFrame([], "item_id long, vec array<double>, value int, weight double")
    told = learning.item_features(items, profile, none, F.lit(START))
    plain = {r.item_id: (r.novelty, r.promotional, r.access_friction) for r in told.select("item_id", "novelty", "promotional", "access_friction").collect()}
    age = lambda now, i: (now - published[i]).total_seconds() / 86400
    return dict(items=items, profile=profile, votes=votes, log=log, vec=vec, plain=plain, facets=facets, weights=np.array([0.6, 0.9, 1.2]), age=age)


def close(got, want):
    assert got[:3] == want[:3]
    for a, b in zip(got[3:], want[3:], strict=True):
        assert a == b if b is None else a == pytest.approx(b, abs=1e-9)


COLUMNS = ["n_test", "n_pairs", "n_must_read", "accuracy", "ndcg", "precision", "recall"]


@pytest.mark.parametrize("limit", [None, 7])
def test_held_out_rankers_against_a_loop(spark, world, limit, monkeypatch):
    if limit:  # exemplars beyond the shared size go through the metric index
        own = replay.ranking._nearest
        monkeypatch.setattr(replay.ranking, "_nearest", lambda *a, **k: own(*[limit if isinstance(x, int) and x == vectors.MAX_ROWS else x for x in a], **k))
    fractions = (0.6, 0.85) if limit is None else (0.75,)
    got = {(r.fraction, r.ranking): r for r in replay.held_out(world["items"], world["votes"], world["profile"], F.lit(START), fractions).collect()}
    last = {i: (h, v, s, g) for i, v, s, g, h in sorted(world["log"], key=lambda r: (r[4], r[1]))}
    signed = [(i, s, g) for i, (h, v, s, g) in sorted(last.items(), key=lambda x: x[1][:2]) if s]
    seen = set()
    for f in fractions:
        cut = min(max(1, round(len(signed) * f)), len(signed) - 1)
        marks = [{"item": i, "value": s, "weight": max(0.05, abs(g - 50) / 50)} for i, s, g in signed[:cut]]
        test = sorted(signed[cut:])
        want = slow_run(START, [i for i, _, _ in test], [s for _, s, _ in test], [g >= 100 for _, _, g in test], marks, *[world[k] for k in ("vec", "plain", "facets", "weights", "age")])
        for name, values in want.items():
            row = got[f, name]
            assert row.n_train == cut
            close(tuple(row[c] for c in COLUMNS), values)
            seen.add((f, name))
    assert seen == set(got)


def slates_of(spark, hours):
    return spark.createDataFrame([(str(d), START + dt.timedelta(hours=h), i) for d, h in enumerate(hours) for i in range(d, 60, 2)], "digest_id string, at timestamp, item_id long")


def test_replay_against_a_loop(spark, world):
    hours = (0, 9, 20)
    got = {(int(r.digest_id), r.ranking): r for r in replay.replay(slates_of(spark, hours), world["votes"], world["items"], world["profile"], least=0).collect()}
    log = sorted(world["log"], key=lambda r: (r[4], r[1]))
    for d, h in enumerate(hours):
        before = {i: (t, v, s, g) for i, v, s, g, t in log if t < h}
        final = {i: (t, s, g) for i, v, s, g, t in log}
        marks = [{"item": i, "value": s, "weight": max(0.05, abs(g - 50) / 50)} for i, (t, v, s, g) in sorted(before.items(), key=lambda x: x[1][:2]) if s]
        ids = list(range(d, 60, 2))
        later = [final.get(i, (-1, 0, 0)) for i in ids]
        want = slow_run(START + dt.timedelta(hours=h), ids, [s if t >= h else 0 for t, s, g in later], [t >= h and g >= 100 for t, s, g in later], marks, *[world[k] for k in ("vec", "plain", "facets", "weights", "age")])
        for name in ("topic", "fused", *replay.RANKERS):
            row = got[d, name]
            assert (row.n_train, row.learnt) == (len(marks), name in want)
            close(tuple(row[c] for c in COLUMNS), want.get(name, want["topic"]))


def test_replay_over_many_votes(spark, world, monkeypatch):
    """Votes beyond the shared size give the same figures, and no table of the search has more rows than items that are asked for."""
    slates, rows = slates_of(spark, (0, 9, 20)), {}
    run = lambda: {(r.digest_id, r.ranking): tuple(r) for r in replay.replay(slates, world["votes"], world["items"], world["profile"], least=0).collect()}
    want, own, real = run(), replay.ranking._nearest, metric.cut

    def cut(df, name="cut"):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(metric, "cut", cut)
    monkeypatch.setattr(replay.ranking, "_nearest", lambda *a, **k: own(*[7 if isinstance(x, int) and x == vectors.MAX_ROWS else x for x in a], **k))
    got = run()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len(rows["queries"]) == 3 and max(n for found in rows.values() for n in found) <= max(rows["queries"]), rows


def test_held_out_searches_list_no_visits(spark, world, monkeypatch):
    """Over many votes the tables of the search have a row for each item asked for, at most, not one for each list it meets."""
    rows, own, real = {}, replay.ranking._nearest, metric.cut

    def cut(df, name="cut"):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(metric, "cut", cut)
    monkeypatch.setattr(replay.ranking, "_nearest", lambda *a, **k: own(*[7 if isinstance(x, int) and x == vectors.MAX_ROWS else x for x in a], **k))
    assert replay.held_out(world["items"], world["votes"], world["profile"], F.lit(START), (0.6, 0.75)).count() == 10
    assert max(n for found in rows.values() for n in found) <= max(rows["queries"]), rows


def test_a_future_vote_does_not_leak(spark, world):
    """Strong votes on items of no slate, cast between two digests, change the later one only."""
    slates = slates_of(spark, (8, 30)).where("item_id < 50")
    planted = spark.createDataFrame([(50 + k, 1000 + k, 1 if k % 2 else -1, 100 if k % 2 else 0, START + dt.timedelta(hours=8)) for k in range(10)], world["votes"].schema)
    rows = [{(r.digest_id, r.ranking): tuple(r) for r in replay.replay(slates, v, world["items"], world["profile"], least=0).collect()} for v in (world["votes"], world["votes"].unionByName(planted))]
    assert all(rows[0][k] == rows[1][k] for k in rows[0] if k[0] == "0")
    assert all(rows[0][k] != rows[1][k] for k in rows[0] if k[0] == "1" and k[1] != "topic")


def test_few_votes_leave_the_topic(spark, world):
    got = {r.ranking: r for r in replay.replay(slates_of(spark, (9,)), world["votes"], world["items"], world["profile"], least=1000).collect()}
    assert not any(got[r].learnt for r in got if r != "topic")
    assert len({tuple(got[r][c] for c in COLUMNS) for r in got}) == 1


def test_gate(spark):
    rows = [(f, r, v) for f in (0.6, 0.75) for r, v in (("per_facet", 0.9), ("lr_fused", 0.8))]
    ask = lambda rows: tuple(replay.gate(spark.createDataFrame(rows, "fraction double, ranking string, ndcg double")).first())
    assert ask(rows) == (2, 2, pytest.approx(0.1), True)
    assert ask([(0.6, "per_facet", 0.85), (0.6, "lr_fused", 0.8), *rows[2:]])[1::2] == (1, False)
    assert ask(rows[:2])[3] is False  # nothing at the mandated split
    assert ask([]) == (0, 0, None, False)


def test_spells_end_with_the_next_vote(spark):
    t = lambda h: None if h is None else START + dt.timedelta(hours=h)
    votes = spark.createDataFrame([(1, 1, 1, 70, t(1)), (1, 2, 0, None, t(3)), (1, 3, -1, None, t(3)), (2, 4, 1, None, t(None)), (3, 5, 1, 70, t(1))], "item_id long, vote_id long, value int, grade int, created_at timestamp")
    items = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "item_id long, vec array<double>")
    got = {r.vote_id: ((r.since, r.until) if r.since == replay.EVER else (r.until - r.since, r.until == replay.NEVER)) for r in replay.spells(votes, items).collect()}
    assert got[1] == (2 * 3600 * 10**6, False) and got[4] == (replay.EVER, replay.NEVER) and set(got) == {1, 3, 4}


def test_drawn_pairs_are_those_in_force(spark):
    marks = spark.createDataFrame([(i, i, 1 if i % 2 else -1, i, replay.NEVER if i != 3 else 10) for i in range(40)], "item_id long, vote_id long, value int, since long, until long")
    runs = spark.createDataFrame([("a", 0), ("b", 5), ("c", 12), ("d", 100)], "run string, at long")
    numbered, counted = replay.timeline(marks, runs)
    assert {r.run: (r.ups, r.downs, r.ended) for r in counted.collect()} == {"a": (0, 0, 0), "b": (2, 3, 0), "c": (6, 6, 1), "d": (20, 20, 1)}
    found = [tuple(r) for r in replay.drawn_pairs(numbered, counted, pairs=50).select("run", "up", "down").collect()]
    assert {p[1:] for p in found if p[0] == "b"} == {(u, d) for u in (1, 3) for d in (0, 2, 4)}
    assert {p[1:] for p in found if p[0] == "c"} == {(u, d) for u in (1, 5, 7, 9, 11) for d in range(0, 12, 2)}
    assert 40 <= len({p for p in found if p[0] == "d"}) <= 50 and all(p[1] != 3 for p in found if p[0] == "d")
