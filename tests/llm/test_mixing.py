import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidewheel.llm import mixing
from tidewheel.llm.common import ranked


def spread(spark, sizes, weights):
    df = spark.createDataFrame([(i, int(s), float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "i long, words long, weight double")
    return [r.target for r in sorted(mixing.targets(df, sum(sizes)).collect())]


def test_targets_fill_up_and_reshare(spark):
    sizes = [100, 300, 50, 0, 400]
    got = spread(spark, sizes, [5, 2, 1, 5, 2])
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    assert got[0] == 200 and got[3] == 0
    free = [(t / w) for t, s, w in zip(got, sizes, [5, 2, 1, 5, 2], strict=True) if t < 2 * s]
    assert max(free) == pytest.approx(min(free))
    assert spread(spark, [0, 0], [5, 2]) == [0.0, 0.0]


def test_many_sources_in_groups(spark, monkeypatch):
    """More sources than groups: totals of shards and of sources stay exact, and every source meets its target."""
    monkeypatch.setattr(mixing, "GROUPS", 7)
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('site ', id % 500) AS source", "repeat('word ', 1 + cast(id % 23 as int)) AS text")
    got = mixing.allot(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert all(0 <= s < mixing.SHARDS for s in r.mix.shards)
    assert len(by) == 500
    for rows in by.values():
        assert abs(sum(len(r.mix.shards) * r.size for r in rows) - rows[0].mix.target) <= max(r.size for r in rows) / 2 + 1
    rng = np.random.default_rng(1)
    quotas, totals = np.array([5, 0, 9, 30]), np.array([10, 4, 14, 16])
    split = mixing.split_group(quotas, totals, rng)
    assert (split.sum(0) == quotas).all() and (split.sum(1) == totals).all() and (split >= 0).all()


def test_sources_are_ranked_by_code_point(spark):
    names = [f"s{i}" for i in range(300)] + ["", "Z", "ä", "\U0001f600", "\uffee", None]
    df = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    got = [r.source for r in sorted(ranked(df, "source").collect(), key=lambda r: r["rank"])]
    assert got == sorted([n for n in names if n is not None], key=lambda n: n.encode()) + [None]


def test_rows_of_one_id_are_decided_each(spark):
    """A source whose rows share a doc_id, or have none, still meets its target."""
    df = spark.range(600).selectExpr("cast(if(id % 2 = 0, 7, null) as long) AS doc_id", "'s' AS source", "concat('a b ', id) AS text")
    got = mixing.allot(df).collect()
    assert abs(sum(len(r.mix.shards) * r.size for r in got) - got[0].mix.target) <= 2


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_splitting_tree_is_exact(shards):
    quotas = np.array([1000, 17, 0, 400, 1])
    got = mixing.split_quotas(quotas, shards, np.random.default_rng(3))
    assert got.shape == (shards, 5) and (got >= 0).all()
    assert (got.sum(0) == quotas).all()
    assert got.sum(1).max() - got.sum(1).min() <= shards


def test_splitting_tree_is_hypergeometric_on_average():
    quotas = np.array([300, 100])
    got = np.mean([mixing.split_quotas(quotas, 4, np.random.default_rng(s)) for s in range(200)], axis=0)
    assert got == pytest.approx(np.tile([75.0, 25.0], (4, 1)), rel=0.08)


def test_mix_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r for r in mixing.allot(docs).collect()}
    by = {}
    for r in a.values():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs_text(docs)[r.doc_id]))
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        taken = sum(len(r.mix.shards) * r.size for r in rows)
        assert abs(taken - rows[0].mix.target) <= max(r.size for r in rows) / 2 + 1
        assert all(len(r.mix.shards) <= 2 for r in rows)
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.mix_copy, r.mix_shard, r.mix_order)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len(rows) == sum(len(r.mix.shards) for r in a.values())


_TEXTS = {}


def docs_text(docs):
    if not _TEXTS:
        _TEXTS.update({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    return _TEXTS


def test_awkward_documents(spark):
    df = cases.docs(spark)
    got = mixing.allot(df).collect()
    assert len(got) == df.count()
    assert {r.source for r in got} == {"a", "b", "c", "ü", "", None}
    assert all(r.size == 0 for r in got if r.doc_id in (3, 4, 7))
    pair = [r.mix.shards for r in got if r.doc_id == 5]
    assert pair[0] == pair[1]
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_copy", "mix_shard", "mix_order"]
    assert {r.mix for r in out.select("mix").distinct().collect()} <= {"m"}
    assert mixing.allot(cases.none(spark)).count() == 0
    assert mixing.mix(cases.none(spark)).agg(F.count("*")).first()[0] == 0


def test_one_source_holds_all(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    got = mixing.allot(df).collect()
    assert got[0].mix.target == pytest.approx(2250.0)
    assert abs(sum(3 * len(r.mix.shards) for r in got) - 2250) <= 2


def test_clashing_and_dotted_columns(spark):
    df = spark.range(20).selectExpr("id AS doc_id", "'s' AS source", "'x y' AS text", "1 AS `a.b`", "2 AS plan_row", "3 AS mix_shard", "4 AS MIX")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "source", "text", "a.b", "plan_row", "MIX", "mix_copy", "mix_shard", "mix_order"]
    assert {(r["a.b"], r.plan_row, r.MIX) for r in out.collect()} == {(1, 2, 4)}
