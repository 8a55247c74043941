import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import exact_groups
from tidewheel.llm import mixing, toxicity


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_each_stage_against_its_own_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard"])
    raw, clean, single, plain, mixed = inputs
    last = docs.collect()
    ids = lambda rows: {r.doc_id for r in rows}
    # toxicity: the rows that score under the bar, and no others
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    from tests.llm.test_models import pack

    score = dict(zip([r.doc_id for r in raw], toxicity.score_texts(*pack([r.text for r in raw]), *model), strict=True))
    assert ids(clean) == {i for i, s in score.items() if s < toxicity.REJECT}
    # near duplicates: the smallest id of each group of texts that overlap
    first = set(exact_groups({r.doc_id: r.text for r in clean}).values())
    assert ids(single) == first and len(single) == len(first)
    # decontamination: no window of an item, and nothing else dropped
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    hit = lambda w: any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))
    assert ids(plain) == {r.doc_id for r in single if not hit(words(r.text))}
    # mixing: whole rows, twice at most; sharding: every row
    for rows in (mixed, last):
        times = {}
        for r in rows:
            times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert set(times) <= ids(plain) and max(times.values()) <= 2
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in mixed)
    assert {r["shard"] for r in last} <= set(range(40))


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_and_empty_tables(spark, tmp_path, empty):
    """Every stage takes nulls, empties, long texts, ties, repeats, clashing and dotted columns, and no rows at all."""
    docs = (cases.none(spark) if empty else cases.docs(spark)).withColumn("odd.name", F.lit(1)).withColumn("found", F.lit("f")).drop("shard")
    cases.labels(spark, [] if empty else [(1, 1, 0), (5, 0, 1), (6, 1, 0)]).write.parquet(f"file://{tmp_path}/labels.parquet")
    bench = [] if empty else [(1, "completely different words"), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == [*docs.columns, "shard"]
    rows = out.collect()
    assert all(0 <= r["shard"] < 40 for r in rows) and {r["odd.name"] for r in rows} <= {1}
    if empty:
        assert not rows


def test_the_mix_is_laid_out_by_shard_and_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    place = {(r.doc_id, r.mix_copy): (r.mix_shard, r.mix_order) for r in mixing.mix(docs).collect()}
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, sf).collect()]
    assert got == [i for (i, _), _ in sorted(place.items(), key=lambda kv: kv[1])]
