"""Mixing sources to target weights by exact block quotas and a hypergeometric splitting tree.

Every source's documents fall into a power-of-two number of hashed blocks, which a
modular permutation puts in order. The words a source owes are met by whole passes
over its blocks, then by blocks in permuted order, then by documents of one last
block. The resulting numbers of block draws per source are exact quotas; a binary
tree over the output shards splits them, each node drawing its left half's quotas
from a multivariate hypergeometric law. A shard takes its quota as a run of the
permuted blocks, so shards are disjoint, and orders its rows by a hash.

The plan is a table of one row per source, however many there are. The driver sees
the quotas of ``GROUPS`` groups of sources; each group splits its own among its
sources. Deciding for a document takes its source's row only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import free_name, ranked
from tidewheel.scratch import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
SHARDS = 16
SEED = 20240131
#: Blocks of the whole mix, and documents a block has on average at least.
BLOCKS, BLOCK_DOCS = 32768, 64
#: Groups of sources between which the driver splits draws; up to so many sources each is one of its own.
GROUPS = 1024
KEY_BITS = 60


def word_count(text: str):
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_key(doc_id: str, text: str) -> Column:
    """The first 60 bits of an md5 over doc_id and text; null counts as empty."""
    as_text = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(as_text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, total: int, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Add ``target`` to (words, weight): ``share`` of all words by weight, none over ``ceiling`` times its words, the excess reshared.

    The level of the sources that aren't full rises until no more become full; each
    round is one sum over the sources.
    """
    full, weights, level = F.lit(False), None, 0.0
    limit = F.lit(float(ceiling)) * F.col("words")
    while True:
        r = sources.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights")).first()
        if not r.weights or r.weights == weights:
            break
        weights, level = r.weights, (share * total - r.full) / r.weights
        full = F.col("weight") * level > limit
    return sources.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal the draws of each source among shards: (shards, sources), rows and columns summing exactly."""
    if shards == 1:
        return quotas[None, :].copy()
    left = shards // 2
    half = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.concatenate([split_quotas(half, left, rng), split_quotas(quotas - half, shards - left, rng)])


def split_group(quotas: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As ``split_quotas``, with the shards' totals given: (shards, sources)."""
    if len(totals) == 1:
        return quotas[None, :].copy()
    left = len(totals) // 2
    half = rng.multivariate_hypergeometric(quotas, int(totals[:left].sum()), method="marginals")
    return np.concatenate([split_group(half, totals[:left], rng), split_group(quotas - half, totals[left:], rng)])


def _rank(key: str, a: Column, c: Column, bits: Column) -> Column:
    """The place of a key's block in the order of its source."""
    block = F.call_function("shiftright", F.col(key), F.lit(KEY_BITS) - bits)
    return (a * block + c).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def fit(slim: DataFrame, weights: Sequence[int], share: float, shards: int, seed: int) -> DataFrame:
    """The plan, one row per source: sizes, targets, block permutation, cut and shard runs.

    ``slim`` has source, size and key. Sources are ranked by code point, null last.
    """
    sources = slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked(sources, "source").withColumn("weight", weight), "sources")
    total, n = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    block_words = max(total // BLOCKS, BLOCK_DOCS * total // max(n, 1), 1)
    t, w = F.col("target"), F.col("words")
    digits = lambda a: F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), a, 8), 16, 10).cast("long")
    plan = targets(sources, total, share)
    plan = plan.withColumn("passes", F.when(w > 0, F.floor(t / w)).otherwise(0).cast("int"))
    plan = plan.select("source", "rank", w.alias("source_size"), "target", "passes", (t - F.col("passes") * w).alias("rest"), (F.length(F.bin(F.greatest(F.lit(1), F.floor(w / F.lit(block_words)).cast("long")))) - 1).alias("bits"), (2 * (digits(1) % 32768) + 1).alias("a"), (digits(9) % 65536).alias("c"))
    plan = cut(plan, "targets")
    # the block in which the remaining words end, then the last document of it that is taken
    side = plan.select(F.col("source").alias("s"), "rest", "bits", "a", "c")
    blocks = slim.join(side, F.col("source").eqNullSafe(F.col("s"))).select("source", "rest", "size", "key", _rank("key", F.col("a"), F.col("c"), F.col("bits")).alias("place"))
    run = Window.partitionBy("source").orderBy("place")
    edge = blocks.groupBy("source", "place", "rest").agg(F.sum("size").alias("words")).withColumn("after", F.sum("words").over(run)).withColumn("before", F.col("after") - F.col("words"))
    edge = cut(edge.where("before <= rest and rest < after").select(F.col("source").alias("e"), F.col("place").alias("edge"), "before"), "edges")
    last = blocks.join(edge, F.col("source").eqNullSafe(F.col("e")) & (F.col("place") == F.col("edge"))).groupBy("source", "key", "rest", "before").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("key")
    last = last.withColumn("middle", F.col("before") + F.sum("size").over(run) - F.col("size") / 2).where("middle <= rest")
    keys = last.groupBy(F.col("source").alias("k")).agg(F.max("key").alias("cut_key"))
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("e")), "left").join(keys, F.col("source").eqNullSafe(F.col("k")), "left")
    partial = F.when(F.col("edge").isNull(), 0).otherwise(F.col("edge") + F.col("cut_key").isNotNull().cast("long"))
    draws = F.col("passes") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) + partial
    plan = plan.select("source", "source_size", "target", "passes", "bits", "a", "c", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("cut_key", F.lit(-1)).alias("cut_key"), draws.cast("long").alias("draws"), "rank", (F.col("rank") % GROUPS).alias("group"))
    return _with_runs(cut(plan, "draws"), shards, seed)


def _with_runs(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """Add ``runs``, for each shard where its run of the source's draws ends, by the splitting tree."""
    spark = plan.sparkSession
    rows = sorted(plan.groupBy("group").agg(F.sum("draws").alias("draws")).collect())
    split = split_quotas(np.array([r.draws for r in rows], np.int64), shards, np.random.default_rng(seed)) if rows else np.zeros((shards, 0))
    totals = spark.createDataFrame([(r.group, [int(x) for x in split[:, k]]) for k, r in enumerate(rows)], "group long, totals array<long>")
    kind = "source string, source_size long, target double, passes int, bits int, a long, c long, edge long, cut_key long, runs array<long>"

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        rng = np.random.default_rng([seed, int(pdf["group"].iloc[0])])
        own = split_group(pdf["draws"].to_numpy(np.int64), np.asarray(pdf["totals"].iloc[0], np.int64), rng)
        return pdf.assign(runs=list(np.cumsum(own, axis=0).T))[["source", "source_size", "target", "passes", "bits", "a", "c", "edge", "cut_key", "runs"]]

    return cut(plan.join(F.broadcast(totals), "group").groupBy("group").applyInPandas(runs, kind), "plan")


def apply_plan(docs: DataFrame, plan: DataFrame, key: str, into: str = "mix", source: str = "source") -> DataFrame:
    """Add ``mix`` (or the column named by ``into``): struct(source_size, target, shards); shards names the output shard of each copy taken.

    ``key`` is the column with the documents' keys. The plan is a table of known
    size: Spark shares it while it is small, else documents move to their source's row.
    """
    name, own, rank, copies = (free_name(docs, c) for c in ("plan_source", "plan_row", "plan_rank", "plan_copies"))
    p = plan.select(F.col("source").alias(name), F.struct(*plan.columns[1:]).alias(own))
    of = lambda c: F.col(own)[c]
    out = docs.join(p, F.col(source).eqNullSafe(F.col(name)), "left").withColumn(rank, _rank(key, of("a"), of("c"), of("bits")))
    more = (F.col(rank) < of("edge")) | ((F.col(rank) == of("edge")) & (F.col(key) <= of("cut_key")))
    out = out.withColumn(copies, of("passes") + F.when(more, 1).otherwise(0))
    blocks = F.call_function("shiftleft", F.lit(1).cast("long"), of("bits"))
    shard = lambda i: F.size(F.filter(of("runs"), lambda end: end <= i * blocks + F.col(rank)))
    shards = F.when(F.col(copies) > 0, F.transform(F.sequence(F.lit(0), F.col(copies) - 1), shard)).otherwise(F.array().cast("array<int>"))
    mix = F.struct(of("source_size").alias("source_size"), of("target").alias("target"), shards.alias("shards"))
    return out.withColumn(into, mix).drop(name, own, rank, copies)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of every row, kept in the shared folder so that texts are read once."""
    return cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), doc_key("doc_id", "text").alias("key")), "sizes")


def allot(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, source, size and ``mix``; rows that are not taken have no shard.

    A null source is a source of its own, ranked last. Null and empty texts have
    size 0 and go with their block. Rows with equal doc_id are decided each by
    their own text; rows equal in both share one decision. An empty table gives an
    empty result. Columns other than doc_id, source and text are not read.
    """
    slim = measure(docs)
    return apply_plan(slim, fit(slim, weights, share, shards, seed), "key").drop("key")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` once per copy taken, with mix_shard, mix_copy and mix_order.

    Sorting a shard by mix_order is its local shuffle. Nulls, ties and repeated
    rows are treated as :func:`allot` says; all columns pass unchanged, but for
    those named like the three new ones, which are replaced.
    """
    docs = docs.drop("mix_shard", "mix_copy", "mix_order")
    plan = fit(measure(docs), weights, share, shards, seed)
    key, own = free_name(docs, "plan_key"), free_name(docs, "mix")
    taken = apply_plan(docs.withColumn(key, doc_key("doc_id", "text")), plan, key, into=own)
    out = taken.select(*[F.col(f"`{c}`") for c in docs.columns], key, F.posexplode(F.col(own)["shards"]).alias("mix_copy", "mix_shard"))
    return out.withColumn("mix_order", F.xxhash64("mix_shard", "mix_copy", key, F.lit(seed))).drop(key)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM s),
l AS (SELECT *, {CEILING} * words / weight AS ratio,
        ({SHARE}::DOUBLE * (SELECT sum(words) FROM s)::DOUBLE - coalesce(sum({CEILING}::DOUBLE * words) OVER (ORDER BY {CEILING} * words / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY {CEILING} * words / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, words, least({CEILING}::DOUBLE * words, (SELECT arg_min(level, (ratio, ord)) FROM l WHERE level <= ratio) * weight) AS target FROM l),
g AS (SELECT greatest(sum(words) // {BLOCKS}, {BLOCK_DOCS} * sum(words) // greatest(sum(n), 1), 1)::BIGINT AS block_words FROM s),
p AS (SELECT source, words, target, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS passes,
             1::BIGINT << (length(bin(greatest(1, words // block_words)::BIGINT)) - 1) AS blocks,
             2 * (('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % 32768) + 1 AS a,
             ('0x' || substr(md5(coalesce(source, '')), 9, 8))::BIGINT % 65536 AS c FROM t, g),
k AS (SELECT d.*, p.words, p.target, p.passes, p.target - p.passes * p.words AS rest,
             ((p.a * (d.key // ({1 << KEY_BITS} // p.blocks)) + p.c) & (p.blocks - 1)) AS rank
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
             sum(size) OVER (PARTITION BY source, key) AS own,
             sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_after FROM k)
SELECT doc_id, size, words AS source_size, target,
       (size * (passes + CASE WHEN block_after <= rest OR after - own / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
