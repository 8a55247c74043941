import re

from pyspark.sql import functions as F

from tests.llm import cases
from tidewheel.llm import divergence


def slow(rows, min_docs=3, top=200):
    """Every pair and term by the definition, term by term."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, held, groups = {}, {}, set()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in terms:
            count[lang, source, t] = count.get((lang, source, t), 0) + 1
        for t in set(terms):
            held[lang, t] = held.get((lang, t), 0) + 1
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in held.items() if k == lang and n >= min_docs]
        own = {s: {t: count.get((lang, s, t), 0) for t in kept} for k, s in groups if k == lang}
        all_of = {t: sum(o[t] for o in own.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (o[t] + 1) // (sum(o.values()) + len(kept)) for t in kept} for s, o in own.items()}
        q = {t: 1 + 10**9 * (all_of[t] + 1) // (sum(all_of.values()) + len(kept)) for t in kept}
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def same(docs, **how):
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    got = divergence.audit(docs, **how).collect()
    assert {tuple(r) for r in got} == slow(rows, **how) and len(got) == len(set(got))
    return got


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    assert same(docs.unionByName(docs))
    same(docs)  # languages that keep no term
    assert divergence.audit(cases.none(spark)).count() == 0


def test_random_texts_against_the_definition(spark):
    word = lambda k: F.concat(F.lit("Wäé"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9) + F.col("id") % 40).cast("string").substr(1, 1), F.char(97 + F.pmod(F.xxhash64("id", F.lit(k + 50)), F.lit(20) % 26)))
    text = F.concat_ws(" ", *[word(k) for k in range(12)])
    docs = spark.range(300).select("id", F.when(F.col("id") % 11 > 0, text).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("en")).alias("lang"), F.concat(F.lit("s"), F.least(F.col("id") % 13, F.lit(5))).alias("source"), F.lit("x").alias("term"), F.lit(1).alias("n"))
    got = same(docs.repartition(5), top=4)
    assert any(r["rank"] == 4 and r.part == "term" for r in got)


def test_small_holds_and_steps_change_nothing(spark, monkeypatch):
    docs = cases.docs(spark).unionByName(cases.docs(spark)).coalesce(1)
    want = divergence.term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()
    monkeypatch.setattr(divergence, "HELD", 1)
    monkeypatch.setattr(divergence, "STEP_BYTES", 5)
    got = divergence.term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_shares_of_large_counts(spark):
    n = 3 * 10**15
    row = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(n + 7).cast("long"), F.lit(10**6).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (n + 7 + 10**6)


def test_top_terms_are_cut_below_the_shuffle(spark, sf):
    postings, groups = divergence.index(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = divergence.telling_terms(postings, groups)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
