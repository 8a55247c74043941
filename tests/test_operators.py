import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import candidates, dedupe, evaluation, feedback, latest, opportunities, ranking, selection
from tidewheel.operators.components import connected_components
from tidewheel.sources import feeds, sinks
from tidewheel.streaming import views


def test_golden_metrics(spark):
    slate = spark.createDataFrame([("d", i, s, v) for i, (s, v) in enumerate([(0.9, 1), (0.8, -1), (0.7, 1), (0.6, -1)])], "digest_id string, item_id long, score double, label int")
    assert evaluation.ndcg(slate).first().ndcg == pytest.approx(0.9197, abs=1e-4)
    assert evaluation.precision_at(slate).first().precision == 0.5
    assert evaluation.average_precision(slate).first().ap == pytest.approx(0.8333, abs=1e-4)
    assert evaluation.pairwise_accuracy(slate).first().accuracy == 0.75
    assert evaluation.score_pairwise_accuracy(slate).first().accuracy == 0.75
    row = evaluation.macro(slate).first()
    assert (row.digests, row.accuracy) == (1, 0.75)


def test_orderings_use_features_and_skip_unvoted(spark):
    slate = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 3, 0.3)], "digest_id string, item_id long, score double")
    features = spark.createDataFrame([("a", 1, 0.9)], "digest_id string, item_id long, final_score double")
    votes = spark.createDataFrame([(1, 1)], "item_id long, value int")
    got = {(r.item_id, r.score, r.label) for r in evaluation.orderings(slate, features, votes).collect()}
    assert got == {(1, 0.9, 1), (2, 0.2, 0)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {n: find(n) for n in list(parent)}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.root for r in connected_components(df).collect()} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


def test_dedupe_candidates_is_transitive(spark):
    now = dt.datetime(2024, 1, 5)
    rows = [
        (1, "https://doi.org/10.1/abcd/x", "", "openalex", "A study of many things", now),
        (2, "https://example.org/p", "10.1000/zzz", "Nature", "A study of many things", now),
        (3, "https://doi.org/10.1000/zzz", "", "PubMed", "Another title altogether", now),
        (4, "https://example.org/q", "", "Nature", "Unrelated but long title", now),
    ]
    df = spark.createDataFrame([(i, u, e, s, "research", t, "", n, n) for i, u, e, s, t, n in rows], "item_id long, url string, external_id string, source string, section string, title string, abstract string, published_at timestamp, fetched_at timestamp")
    assert sorted(r.item_id for r in dedupe.dedupe_candidates(df).collect()) == [2, 4]


def test_greedy_leaders():
    x = np.array([[1, 0, 0], [0.99, 0.1, 0], [0, 1, 0], [0.7, 0.7, 0]])
    assert dedupe.greedy_leaders(x, 0.9).tolist() == [0, 2, 3]
    assert dedupe.greedy_leaders(x[:0], 0.9).tolist() == []


def test_max_similarity_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>")
    a, b = df.where("item_id < 20"), df.where("item_id >= 20")
    one = {r.item_id: r.max_sim for r in dedupe.max_similarity(a, b).collect()}
    many = {r.item_id: r.max_sim for r in dedupe.max_similarity(a, b, limit=6).collect()}
    assert one == pytest.approx(many)
    assert all(r.max_sim == -1.0 for r in dedupe.max_similarity(a, b.limit(0)).collect())


def test_rank_desc_with_ties_and_nulls(spark):
    rows = [(i, float(v) if v is not None else None) for i, v in enumerate([5, 5, 5, 1, None, 9, 9, 2] * 5)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = [r.id for r in ranking.rank_desc(df, "v", "id", "rank", buckets=4).orderBy("rank").collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_value_ranges_are_ordered_and_keep_ties_together(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 3, 3, 3, 4, 8, 9, 9, 9, 10] * 5], "v double")
    got = {(r.v, r.k) for r in df.withColumn("k", ranking.value_range(df, "v", 16, rows=8)).collect()}
    assert len(got) == 7 and len({k for _, k in got}) > 3
    assert [k for _, k in sorted(got)] == sorted(k for _, k in got)


def test_rrf_is_monotone(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)], "id long, a double, b double")
    got = [r.id for r in ranking.rrf(df, "a", "b", "id").orderBy(F.desc("fused")).collect()]
    assert got == list(range(9, -1, -1))
    flat = spark.createDataFrame([(1, 1.0, 1.0)], "id long, a double, b double")
    assert ranking.rrf(flat, "a", "b", "id").first().fused == 0.5


def _pool(rows):
    return pd.DataFrame(rows, columns=["item_id", "score", "source", "bucket", "tier"])


def test_research_quotas():
    pool = _pool([(i, 1 - i / 100, f"s{i % 3}", "bio_med_preprint", "repository") for i in range(10)] + [(10 + i, 0.5 - i / 100, f"j{i}", "published_journal", "high") for i in range(6)])
    got = selection.pick_research(pool, 10)
    buckets = [pool["bucket"][i] for i in got]
    assert len(got) == len(set(got)) == 10
    assert buckets.count("bio_med_preprint") <= 6 and buckets.count("published_journal") >= 3


def test_low_impact_stays_rare():
    pool = _pool([(i, 0.9 - i / 100, f"s{i}", "low_impact_journal", "unknown") for i in range(10)])
    assert len(selection.pick_research(pool, 12)) == 3
    assert selection.pick_research(pool, 0) == []


def test_news_balance_matches_the_two_passes(spark):
    rng = random.Random(5)
    rows = [(i, "world", f"s{rng.randrange(3)}", rng.random()) for i in range(40)]
    want, per = [], {}
    cap, most = 6, 2
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    for r in order:
        if len(want) < cap and per.get(r[2], 0) < most:
            want.append(r)
            per[r[2]] = per.get(r[2], 0) + 1
    want += [r for r in order if r not in want][: cap - len(want)]
    df = spark.createDataFrame(rows, "item_id long, section string, source string, score double")
    got = selection.source_balanced(df, {"world": cap})
    assert {r.item_id for r in got.collect()} == {r[0] for r in want}


def test_penalty_closed_form_equals_the_steps():
    rng = random.Random(1)
    for _ in range(2000):
        plus, minus, cap = [rng.random() / 5 for _ in range(rng.randrange(6))], [rng.random() / 5 for _ in range(rng.randrange(6))], 0.12
        v = 0.0
        for p in plus:
            v = min(cap, v + p)
        for m in minus:
            v = max(0.0, v - m)
        assert v == pytest.approx(max(0.0, min(cap, sum(plus)) - sum(minus)))


def test_reason_chips(spark):
    votes = spark.createDataFrame([(1, 1, -1, dt.datetime(2024, 1, 1)), (2, 2, 1, dt.datetime(2024, 1, 1))], "item_id long, vote_id long, value int, created_at timestamp")
    chips = spark.createDataFrame([(2, ["duplicate"])], "item_id long, reasons array<string>")
    new = spark.createDataFrame([(1, "off_topic"), (1, "nonsense"), (2, "low_impact")], "item_id long, reason string")
    got = {r.item_id: r.reasons for r in feedback.add_reasons(chips, new, votes).collect()}
    assert got == {1: ["off_topic"], 2: ["duplicate"]}
    assert [r.item_id for r in feedback.clear_approved(feedback.add_reasons(chips, new, votes), votes).collect()] == [1]
    assert feedback.remove_reason(chips, 2, "duplicate").count() == 0


def test_votes_by_label(spark):
    slate = spark.createDataFrame([("d", "R1", 7), ("d", "R2", 8)], "digest_id string, label string, item_id long")
    lines = spark.createDataFrame([("d", "+R1 -R2 R9", dt.datetime(2024, 1, 1)), ("d", "-R1", dt.datetime(2024, 1, 2))], "digest_id string, line string, created_at timestamp")
    assert {(r.item_id, r.value) for r in feedback.resolve_votes(lines, slate).collect()} == {(7, -1), (8, -1)}


def test_opportunities(spark):
    who = opportunities.ReaderConstraints(event_regions=["online"], event_formats=["in_person"], country="Germany", institution_type="University hospital")
    df = spark.createDataFrame([("open", "event", "in_person", "Berlin", None), ("open", "opportunity", None, None, ["Public university"])], "s string, k string, f string, l string, t array<string>")
    none = F.lit(None).cast("string")
    got = df.select(opportunities.assess(who, F.lit(dt.date(2024, 1, 1)), F.col("s"), F.lit(None).cast("date"), F.col("k"), none, none, F.col("f"), F.col("l"), F.col("t"), none).alias("a")).collect()
    assert got[0].a.reason == "location is outside preferences"  # online is no region
    assert got[1].a.reason == "country eligibility needs review"


def test_gate_skips_small_pools(spark):
    df = spark.createDataFrame([(1, "Hi", "", "research", "x")], "item_id long, title string, abstract string, section string, source string")
    assert candidates.quality_gate(df).first().drop_reason is None
    assert candidates.quality_gate(df, least_rows=1).first().drop_reason == "short_title"


def test_split_leaves_a_test_row(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3)) for i in range(4)], "event_id long, ts timestamp")
    got = latest.chronological_split(df, "ts", "event_id", 1.0).collect()
    assert sum(r.is_train for r in got) == 3


def test_upsert_is_idempotent_and_conservative(spark):
    kind = "source string, external_id string, section string, title string, abstract string, authors string, url string, published_at timestamp, summary string, ord int"
    old = spark.createDataFrame([("a", "1", "research", "A title", "x" * 10, "", "", None, "sum", 0)], kind)
    new = spark.createDataFrame([("a", "1", "research", "A titl", "x" * 95, "me", "u", None, None, 0), ("a", "2", "research", "New", "", "", "", None, None, 1), ("a", "2", "research", "Second", "", "", "", None, None, 2)], kind)
    out = sinks.upsert_items(old, new)
    got = {r.external_id: r for r in out.collect()}
    assert (got["1"].title, len(got["1"].abstract), got["1"].summary, got["1"].changed) == ("A title", 95, None, True)
    assert (got["2"].title, got["2"].inserted) == ("New", True)
    again = sinks.upsert_items(out.drop("inserted", "changed").withColumn("ord", F.lit(0)), new)
    assert not any(r.inserted or r.changed for r in again.collect())


def test_snapshots_ignore_verification_time(spark):
    rows = [(1, {"a": "x", "verified_at": "1"}, dt.datetime(2024, 1, 1)), (1, {"verified_at": "2", "a": "x"}, dt.datetime(2024, 1, 2)), (1, {"a": "y"}, dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "item_id long, details map<string,string>, observed_at timestamp")
    none = spark.createDataFrame([], "item_id long, details_hash string")
    first = sinks.new_snapshots(none, df)
    assert first.count() == 2
    assert sinks.new_snapshots(first, df).count() == 0


def test_feed_parsers(spark):
    rss = "<rss><channel><item><title>Big &amp; new</title><link>https://x.org/a/?utm_source=r</link><guid>g1</guid><description>&lt;p&gt;Text&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>"
    row = feeds.rss(spark.createDataFrame([("s", "world", rss)], "source string, section string, xml string")).first()
    assert (row.title, row.url, row.abstract, row.published_at) == ("Big & new", "https://x.org/a", "Text", dt.datetime(2024, 1, 1, 10))
    page = '{"collection": [{"doi": "10.1101/ABC", "title": "T", "abstract": "A", "authors": "X", "date": "2024-01-02"}, {"doi": "1", "title": "WITHDRAWN: x", "date": "2024-01-02"}]}'
    got = feeds.preprints(spark.createDataFrame([("bioRxiv", "research", page)], "source string, section string, json string")).collect()
    assert [(r.external_id, r.published_at.hour) for r in got] == [("10.1101/abc", 12)]
    works = '{"results": [{"id": "https://openalex.org/W1", "display_name": "T", "publication_date": "2024-01-02", "abstract_inverted_index": {"world": [1], "hello": [0, 2]}, "primary_location": {"source": {"display_name": "ACS Nano"}}}]}'
    row = feeds.openalex(spark.createDataFrame([("OpenAlex", "research", works)], "source string, section string, json string")).first()
    assert (row.source, row.abstract, row.external_id) == ("ACS Nano", "hello world hello", "W1")
    with pytest.raises(ValueError, match="unknown source kind"):
        feeds.parser("nope")
    assert feeds.search_terms(["A", "a", "b"], ["c", "B", "d"], 3) == ["A", "b", "c"]


def test_event_details(spark):
    body = "Workshop on things\nLocation: Online\nDeadline: 3 March 2024\nFinal deadline: 2024-04-01 (closed soon)"
    got = spark.range(1).select(feeds.event_details(F.lit(body)).alias("e")).first().e
    assert (got.deadline, got.status, got.event_type, got.format) == (dt.date(2024, 4, 1), "open", "workshop", "online")


def test_live_source(spark):
    from tidewheel.sources.live import read_payloads

    got = read_payloads(spark, [("a", "https://x/1"), ("b", "https://y/2"), ("c", "https://x/3")], "urllib.parse:quote").orderBy("ord").collect()
    assert [(r.source, r.ok) for r in got] == [("a", True), ("b", True), ("c", True)]


def test_streaming_latest_votes(spark, tmp_path):
    rows = [(1, 1, dt.datetime(2024, 1, 1)), (1, -1, dt.datetime(2024, 1, 2)), (2, 1, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "item_id long, value int, created_at timestamp").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("item_id long, value int, created_at timestamp").parquet(f"file://{tmp_path}/in")
    q = views.latest_votes(stream).writeStream.outputMode("update").format("memory").queryName("lv").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.item_id, r.value) for r in spark.table("lv").collect()} == {(1, -1), (2, 1)}


def test_streaming_windows(spark, tmp_path):
    rows = [("view", 1.0, dt.datetime(2024, 1, 1, h)) for h in (1, 2, 13, 23)] + [("view", 0.0, dt.datetime(2024, 1, 5))]
    spark.createDataFrame(rows, "event_type string, value double, ts timestamp").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("event_type string, value double, ts timestamp").parquet(f"file://{tmp_path}/in")
    q = views.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("wc").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("wc").collect()) == [2, 2]


@pytest.mark.parametrize(("rows", "limits"), [(20_050, {}), (60, {"limit": 7}), (3, {}), (0, {})])
def test_preference_over_exemplars_in_blocks(spark, rows, limits):
    from tidewheel.functions import vectors

    vec = F.array(*[F.sin(F.col("id") * (1.7 + j) + j) for j in range(3)])
    e = spark.range(rows).select(F.col("id").alias("item_id"), vec.alias("vec"), ((F.col("id") % 7 - 3) / F.lit(3.0)).alias("grade"), (F.col("id") % 5 / F.lit(4.0)).alias("weight"))
    items = spark.range(25).select(F.col("id").alias("item_id"), vec.alias("vec"))
    x = np.array([r.vec for r in items.orderBy("item_id").collect()])
    all_ = e.orderBy("item_id").collect()
    ids, y = np.array([r.item_id for r in all_], np.int64), np.array([r.vec for r in all_]).reshape(rows, 3)
    want = vectors.knn_scores(x, np.arange(25), ids, y, np.array([r.grade for r in all_]))
    got = ranking.preference_scores(items, e, **limits).orderBy("item_id").collect()
    assert [r.preference for r in got] == pytest.approx(want.tolist())
    want = vectors.affinity(x, np.arange(25), ids, y, np.array([r.weight for r in all_]))
    got = ranking.affinities(items, e, "near", **limits).orderBy("item_id").collect()
    assert [r.near for r in got] == pytest.approx(want.tolist())


def test_event_pages(spark):
    rows = [
        ("Talk Date: 17 - 25 Aug 2026 Location: Hybrid, Rome Deadline(s): Abstract: Closed Registration: 25 Jul 2026.",),
        ("Course Date: 30 Aug to 2 September 2026 Location: online Deadline: closed",),
        ("Date: Aug 3 2026",),
        ("Nothing is dated here",),
        (None,),
    ]
    got = [r.e for r in spark.createDataFrame(rows, "t string").select(feeds.event_details(F.col("t")).alias("e")).collect()]
    day = dt.date
    assert [(e.start, e.end, e.deadline, e.status, e.format) for e in got] == [
        (day(2026, 8, 17), day(2026, 8, 25), day(2026, 7, 25), "open", "hybrid"),
        (day(2026, 8, 30), day(2026, 9, 2), None, "closed", "online"),
        (day(2026, 8, 3), day(2026, 8, 3), None, "unknown", None),
        (None, None, None, "unknown", None),
        (None, None, None, "unknown", None),
    ]


def test_upkeep_frees_items_of_old_digests(spark):
    from tidewheel.operators import upkeep

    old, new = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    tables = {
        "digests": spark.createDataFrame([("a", old), ("b", new), ("c", None)], "digest_id string, created_at timestamp"),
        "digest_items": spark.createDataFrame([("a", 1), ("b", 2)], "digest_id string, item_id long"),
        "items": spark.createDataFrame([(1, old), (2, old), (3, old), (4, new), (5, None)], "item_id long, fetched_at timestamp"),
        "votes": spark.createDataFrame([(3,), (None,)], "item_id long"),
        "reasons": spark.createDataFrame([(1,), (3,)], "item_id long"),
    }
    kept, counts = upkeep.maintain(tables, F.lit("2022-01-01").cast("timestamp"))
    assert {r.step: r.removed for r in counts.collect()} == {"digests": 1, "items": 1, "reasons": 1}
    assert sorted(r.item_id for r in kept["items"].collect()) == [2, 3, 4, 5]
    assert [r.digest_id for r in kept["digest_items"].collect()] == ["b"]


def test_enrichment_ages_and_flags(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    items = spark.createDataFrame([(1, 0.5, None), (2, 0.5, None), (3, 0.5, None)], "item_id long, score double, published_at timestamp")
    known = spark.createDataFrame([(1, 0, 0.5, dt.datetime(2024, 1, 30)), (1, 9, 9.0, dt.datetime(2024, 1, 20)), (2, 99, 9.0, dt.datetime(2024, 1, 1))], "item_id long, cited_by_count int, venue_impact double, fetched_at timestamp")
    got = {r.item_id: r for r in ranking.enrich(items, known, now).collect()}
    assert got[1].score < 0.5 and got[1].venue_low_impact
    assert (got[2].score, got[2].venue_low_impact, got[3].score) == (0.5, False, 0.5)


def test_nothing_was_missed_in_a_short_gap(spark):
    from tidewheel.operators import summaries

    slate = spark.createDataFrame([("d", 1, 1, "T", None)], "digest_id string, item_id long, position int, title string, source string")
    assert summaries.briefing(slate, 2).count() == 0
    assert summaries.briefing(slate, 3).first().listing == "- T ()"
    digests = spark.createDataFrame([("d", None), ("e", None)], "digest_id string, sent_at timestamp")
    sent = summaries.mark_sent(digests, "d", F.lit("2024-01-31").cast("timestamp"))
    assert summaries.was_sent(sent, "d") and not summaries.was_sent(sent, "e") and not summaries.was_sent(sent, "f")
