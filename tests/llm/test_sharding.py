import zlib

from pyspark.sql import functions as F

from tests.llm import cases
from tidewheel.llm import sharding


def test_shards_of_the_table(spark, sf):
    from tidewheel.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_shard"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    total, slots = {}, {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        total[r.shard] = total.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(total) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rows = sharding.shard_documents(df).groupBy("shard").agg(F.sum(sharding.byte_size("text")).alias("b")).collect()
    sizes = [r.b for r in rows]
    assert sorted(r["shard"] for r in rows) == list(range(40))
    assert max(sizes) - min(sizes) <= 4 * 113 + 0.01 * sum(sizes) / 40
    again = sharding.shard_documents(df.repartition(7)).select("doc_id", "shard")
    assert again.exceptAll(sharding.shard_documents(df).select("doc_id", "shard")).count() == 0


def test_tree_against_a_plain_one(spark):
    """Every split's left side weighs its share of the node, to one row; leaves are in order."""
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab"), (F.col("id") % 31 + 1).cast("int")), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("https://example.org/"), (F.col("id") % 5).cast("string")).alias("source"))
    tree, mixed = sharding.grow(df, 5)
    assert mixed.count() == 0
    rows = df.select(sharding.byte_size("text").alias("b"), *[c.alias(n) for n, c in sharding.metadata().items()]).collect()
    at = {d: {v: k for k, v in enumerate(sorted({r[d] for r in rows}))} if d != "bin" else {r.bin: int(r.bin) for r in rows} for d in sharding.DIMS}
    span = {d: max(max(v.values()) - min(v.values()), 1) for d, v in at.items()}

    def walk(node, own, shards):
        if shards == 1:
            assert tree.leaves[node] == walk.next
            walk.next += 1
            return
        split = tree.splits[node]
        spread = [(max(at[d][r[d]] for r in own) - min(at[d][r[d]] for r in own)) / span[d] for d in sharding.DIMS]
        assert spread[split.dim] == max(spread)
        key = lambda r: (r[sharding.DIMS[split.dim]], r.cell, r.text_hash, r.id_hash)
        cut = (split.value, split.cell, split.text_hash, split.id_hash)
        left, right = [r for r in own if key(r) < cut], [r for r in own if key(r) >= cut]
        assert abs(sum(r.b for r in left) - sum(r.b for r in own) * (shards // 2) / shards) <= max(r.b for r in own)
        walk(2 * node, left, shards // 2)
        walk(2 * node + 1, right, shards - shards // 2)

    walk.next = 0
    walk(1, rows, 5)


def test_equal_texts_stay_together_as_far_as_they_fit(spark):
    """Copies under other languages and sources share a shard; a text of half of all bytes is split; sizes stay near equal."""
    body = F.concat(F.lit("text "), F.when(F.col("id") < 2000, F.lit("hot")).when(F.col("id") < 2600, (F.col("id") % 150).cast("string")).otherwise(F.col("id").cast("string")))
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.rpad(body, 200, ".").alias("text"), F.concat(F.lit("l"), (F.col("id") % 3).cast("string")).alias("lang"), F.concat(F.lit("https://a.com/very/long/"), (F.col("id") % 11).cast("string")).alias("source"))
    rows = sharding.shard_documents(df, 8).select("text", "shard", "doc_id").collect()
    by, size = {}, {}
    for r in rows:
        by.setdefault(r.text, set()).add(r["shard"])
        size[r["shard"]] = size.get(r["shard"], 0) + 216
    split = [t for t, s in by.items() if len(s) > 1]
    assert [t.startswith("text hot") for t in split] == [True]
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 0.12 * 4000 * 216 / 8


def test_long_source_names_are_told_apart(spark):
    df = spark.range(800).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), 100, "x").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("https://site-"), (F.col("id") % 8 + 1).cast("string")).alias("source"))
    got = sharding.shard_documents(df, 8).groupBy("source").agg(F.count_distinct("shard").alias("n")).collect()
    assert [r.n for r in got] == [1] * 8


def test_slots_of_repeated_ids(spark):
    df = spark.range(3000).selectExpr("cast(1 as long) AS doc_id", "id AS size", "0 AS shard", "'x' AS bucket", "1 AS n")
    a = {r["size"]: r.slot for r in sharding.with_slots(df).collect()}
    b = sharding.with_slots(df.repartition(3))
    assert sorted(a.values()) == list(range(3000)) and b.columns == [*df.columns, "slot"]
    assert a == {r["size"]: r.slot for r in b.collect()}


def test_awkward_documents(spark):
    df = cases.docs(spark)
    out = sharding.shard_documents(df, 4)
    assert out.columns == df.columns and dict(out.dtypes)["shard"] == "int"
    rows = out.collect()
    assert len(rows) == df.count() and all(0 <= r["shard"] < 4 for r in rows)
    assert len({r["shard"] for r in rows if r.doc_id == 5}) == 1
    assert sharding.shard_documents(cases.none(spark)).count() == 0
    assert sharding.with_slots(out.select("doc_id", "shard")).count() == df.count()
    assert {r["shard"] for r in sharding.shard_documents(df, 1).collect()} == {0}
