"""Ranking: normalisation, fusion, preference memory, score adjustments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel.functions import scores, urls, vectors
from tidewheel.operators import metric
from tidewheel.scratch import cut


def min_max(df: DataFrame, column: str, into: str) -> DataFrame:
    """Scale a column to 0..1 over the run; 0.5 where it is constant. Two aggregates, no global window."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return df.join(F.broadcast(ends)).withColumn(into, scaled).drop("_lo", "_hi")


def value_range(df: DataFrame, column: str, most: int = 512, rows: int = 20_000) -> Column:
    """The number of a value's range: ranges of about ``rows`` rows, ``most`` at most, equal values in one; found by binary search."""
    got = df.agg(F.count(column).alias("n"), F.percentile_approx(column, [i / most for i in range(1, most)], 10000).alias("cuts")).first()
    ranges = min(most, max(1, got.n // rows))
    cuts = got.cuts or []
    edges = sorted({float(cuts[len(cuts) * k // ranges]) for k in range(1, ranges)}) if cuts else []
    bits = len(edges).bit_length()
    if not bits:
        return F.lit(0)
    table = F.array(*[F.lit(e) for e in edges], *[F.lit(None).cast("double")] * ((1 << bits) - 1 - len(edges)))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.element_at(table, at + s) <= F.col(column), F.lit(False)), at + s).otherwise(at))


def rank_desc(df: DataFrame, column: str, tie: str, into: str, buckets: int = 512) -> DataFrame:
    """0-based rank by a column, largest first, ties by ``tie``.

    Rows fall into ranges of the value; a rank is the rows of higher ranges plus the
    place in the own range, so no task sorts the whole run. Equal values stay in one
    range, so the rank is exact however they are spread.
    """
    place = value_range(df, column, buckets)
    tagged = df.withColumn("_range", F.when(F.col(column).isNull(), F.lit(-1)).otherwise(place))
    counts = tagged.groupBy("_range").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_range").orderBy(F.col(column).desc_nulls_last(), tie)
    return tagged.join(F.broadcast(counts), "_range").withColumn(into, F.col("_above") + F.row_number().over(inside) - 1).drop("_range", "_above")


def rrf(df: DataFrame, first: str, second: str, tie: str, into: str = "fused", k: int = L.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two scores over the pooled run, scaled to 0..1."""
    pool = cut(df, "pool")  # ranks read their column more than once; scores may be costly
    ranked = rank_desc(cut(rank_desc(pool, first, tie, "_a"), "ranked"), second, tie, "_b")
    raw = cut(ranked.withColumn("_raw", F.lit(1.0) / (k + F.col("_a") + 1) + F.lit(1.0) / (k + F.col("_b") + 1)), "fused")
    return min_max(raw, "_raw", into).drop("_a", "_b", "_raw")


#: Similarities that a task holds at once.
SIMS = 1 << 22


def _nearest(items: DataFrame, exemplars: DataFrame, k: int, near, columns: tuple[str, ...], vector: str, key: str, limit: int, own: str | Column | None = None, factor: str | None = None) -> DataFrame:
    """Add ``_near``: the k best (sim, id, number) of each item over all exemplars; larger sims, then larger ids, first.

    ``near`` takes vectors, the items' ids (column ``own``, by default ``key``) and a
    block of exemplars; ``factor`` names the column that it multiplies cosines by.
    Up to ``limit`` exemplars are shared with every task; more go into a metric index.
    """
    own = F.col(key) if own is None else F.col(own) if isinstance(own, str) else own
    if exemplars.count() > limit:
        ends = exemplars.agg(F.min(factor), F.max(factor)).first() if factor else (0.0, 1.0)
        return metric.nearest(items, exemplars, k, near, columns, vector, key, own, max(1.0, float(ends[1])) if ends[0] is not None and ends[0] >= 0 else None)
    block = next(vectors.blocks(exemplars, key, vector, *columns, limit=limit))

    @F.arrow_udf("array<struct<sim:double,id:long,number:double>>")
    def best(v: pa.Array, ids: pa.Array) -> pa.Array:
        step = max(1, SIMS // max(1, len(block[key])))  # rows whose similarities are held at once
        rows = [slice(lo, lo + step) for lo in range(0, max(1, len(v)), step)]
        x, mine = vectors.matrix(v), vectors.numbers(ids)
        return pa.concat_arrays([vectors.nearest(*near(x[r], mine[r], block), k) for r in rows])

    return items.withColumn("_near", best(vector, own))


def _facet_sims(weighted: bool, number: str | None = None):
    """Similarities to facets; of equal ones the smaller facet comes first."""

    def near(x: np.ndarray, ids: np.ndarray, f: dict[str, np.ndarray], key: str, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sims = vectors.unit(x) @ vectors.unit(f[vector]).T if len(x) and len(f[vector]) else np.zeros((len(x), len(f[key])))
        sims = sims * f["weight"] if weighted else sims
        return sims[:, ::-1], -np.asarray(f[key], np.int64)[::-1], (f[number] if number else np.zeros(len(f[key])))[::-1]

    return near


def topic_scores(items: DataFrame, facets: DataFrame, into: str = "topic_score", vector: str = "vec", key: str = "facet_id", limit: int = vectors.MAX_ROWS) -> DataFrame:
    """Add the multi-facet cosine to a profile of facets (facet_id, vec, weight): 0.7 of the best and 0.3 of the best three's mean; one facet counts alone."""
    near = _facet_sims(True)
    capped = facets.select(key, vector, F.least("weight", F.lit(1.0)).alias("weight"))
    out = _nearest(items, capped, 3, lambda x, ids, f: near(x, ids, f, key, vector), ("weight",), vector, key, limit, F.lit(0).cast("long"), "weight")
    mean = F.aggregate("_near", F.lit(0.0), lambda a, z: a + z["sim"]) / F.size("_near")
    best = F.col("_near")[0]["sim"]
    return out.withColumn(into, F.when(F.size("_near") == 1, best).otherwise(0.7 * best + 0.3 * mean)).drop("_near")


def query_aware_scores(items: DataFrame, facets: DataFrame, into: str = "score", vector: str = "vec", key: str = "facet_id", limit: int = vectors.MAX_ROWS) -> DataFrame:
    """Add the attention-weighted cosine to a profile of facets; sums over blocks of them."""
    out = items.withColumns({"_top": F.lit(0.0), "_all": F.lit(0.0)})
    many = facets.count() > limit
    for block in vectors.blocks(facets, key, vector, limit=limit):
        rows = vectors.unit(block[vector])
        weigh = lambda x, r: np.exp(3.0 * (vectors.unit(x) @ r.T))
        top = vectors.map_vectors(vector, lambda x, r=rows: (weigh(x, r) * (vectors.unit(x) @ r.T)).sum(1) if len(x) else np.zeros(0))
        every = vectors.map_vectors(vector, lambda x, r=rows: weigh(x, r).sum(1) if len(x) else np.zeros(0))
        out = out.withColumns({"_top": F.col("_top") + top, "_all": F.col("_all") + every})
        out = cut(out, "attended") if many else out
    return out.withColumn(into, F.col("_top") / F.col("_all")).drop("_top", "_all")


def facet_attribution(items: DataFrame, facets: DataFrame, vector: str = "vec", key: str = "facet_id", least: float = L.FACET_MIN, margin: float = L.FACET_MARGIN, second: float = L.FACET_SECOND, many: int = L.FACET_SECONDARIES, scale: float = 0.03, limit: int = vectors.MAX_ROWS) -> DataFrame:
    """Add primary_facet, primary_score, secondaries and priority_bonus.

    The best facet counts from ``least`` on; secondaries lie within ``margin`` of it
    and above ``second``, so the best ``many`` + 1 facets decide. ``facets`` may have
    a priority (0.5 where null).
    """
    near = _facet_sims(False, "priority")
    known = facets.select(key, vector, F.coalesce("priority", F.lit(0.5)).alias("priority"))
    out = _nearest(items, known, many + 1, lambda x, ids, f: near(x, ids, f, key, vector), ("priority",), vector, key, limit, F.lit(0).cast("long"))
    best = F.col("_near")[0]
    ok = best["sim"] >= least
    rest = F.slice(F.filter(F.slice("_near", 2, many), lambda z: (z["sim"] >= best["sim"] - margin) & (z["sim"] >= second)), 1, many)
    return out.withColumns({"primary_facet": F.when(ok, -best["id"]), "primary_score": best["sim"], "secondaries": F.when(ok, F.transform(rest, lambda z: -z["id"])).otherwise(F.array().cast("array<bigint>")), "priority_bonus": F.when(ok, scale * best["number"]).otherwise(0.0)}).drop("_near")


def negative_penalty(items: DataFrame, negatives: DataFrame, topic: str, weight: float = 1.0, margin: float = 0.0, vector: str = "vec", key: str = "facet_id", into: str = "penalty", limit: int = vectors.MAX_ROWS) -> DataFrame:
    """Add how much the best weighted match with an unwanted interest exceeds the topic score."""
    near = _facet_sims(True)
    out = _nearest(items, negatives, 1, lambda x, ids, f: near(x, ids, f, key, vector), ("weight",), vector, key, limit, F.lit(0).cast("long"), "weight")
    best = F.when(F.size("_near") > 0, F.col("_near")[0]["sim"])
    return out.withColumn(into, F.when(best.isNull(), 0.0).otherwise(weight * F.greatest(F.lit(0.0), best - F.col(topic) - margin))).drop("_near")


def _as_of(near, key: str, at: str | None) -> tuple:
    """(near, further columns, own) for exemplars of all times, or for those in force at the item's ``at``: since < at <= until."""
    if at is None:
        return near, (), None

    def then(x: np.ndarray, ids: np.ndarray, e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sims, names, values = near(x, ids[:, 0], e)
        when = ids[:, 1:]
        sims[(e["since"] >= when) | (when > e["until"])] = -np.inf
        return sims, names, values

    return then, ("since", "until"), F.struct(F.col(key).cast("long").alias("id"), F.col(at).cast("long").alias("at"))


def preference_scores(items: DataFrame, exemplars: DataFrame, k: int = L.KNN_K, vector: str = "vec", key: str = "item_id", into: str = "preference", limit: int = vectors.MAX_ROWS, at: str | None = None) -> DataFrame:
    """Add the graded k-nearest-neighbour preference; exemplars have (item_id, vec, grade in -1..1).

    With ``at``, a long column of the items, exemplars also have since and until and count where since < at <= until.
    """
    near, more, own = _as_of(lambda x, ids, e: vectors.graded_sims(x, ids, e[key], e[vector], e["grade"]), key, at)
    out = _nearest(items, exemplars, k, near, ("grade", *more), vector, key, limit, own)
    weight = lambda z: F.pow(F.greatest(z["sim"], F.lit(0.0)), 2)
    add = lambda f: F.aggregate("_near", F.lit(0.0), lambda a, z: a + f(z))
    total = add(weight)
    return out.withColumn(into, F.when(total > 0, add(lambda z: weight(z) * z["number"]) / total).otherwise(0.0)).drop("_near")


def affinities(items: DataFrame, exemplars: DataFrame, into: str, k: int = L.AFFINITY_K, vector: str = "vec", key: str = "item_id", limit: int = vectors.MAX_ROWS, at: str | None = None) -> DataFrame:
    """Add the mean of the k largest weighted similarities; exemplars have (item_id, vec, weight). ``at`` is as for ``preference_scores``."""
    near, more, own = _as_of(lambda x, ids, e: vectors.weighted_sims(x, ids, e[key], e[vector], e["weight"]), key, at)
    out = _nearest(items, exemplars, k, near, ("weight", *more), vector, key, limit, own, factor="weight")
    there = F.filter("_near", lambda z: z["sim"] > float("-inf"))
    return out.withColumn(into, F.aggregate(there, F.lit(0.0), lambda a, z: a + z["sim"]) / F.greatest(F.size(there), F.lit(1))).drop("_near")


def rocchio(votes: DataFrame, vector: str = "vec", up: float = L.ROCCHIO_UP, down: float = L.ROCCHIO_DOWN, decay: float = L.ROCCHIO_DECAY) -> DataFrame:
    """The learnt profile as (dim, value): signed, graded vectors that fade with the number of later votes.

    ``votes`` has (value, weight, recency, vec); recency 0 is the newest.
    """
    factor = F.when(F.col("value") > 0, up).when(F.col("value") < 0, -down).otherwise(0.0) * F.col("weight") * F.pow(F.lit(decay), F.col("recency"))
    return votes.select(factor.alias("f"), F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("f") * F.col("x")).alias("value"))


def rocchio_weight(votes: int, facets: int = 1) -> float:
    """Weight of the learnt facet beside so many static ones; 0 while votes are few."""
    share = min(0.25, votes / 60)
    return 0.0 if share < 0.02 else facets * share / (1 - share)


def with_learnt_facet(facets: DataFrame, voted: DataFrame, key: str = "facet_id", vector: str = "vec") -> DataFrame:
    """The profile (facet_id, vec, weight) and behind it the direction that votes point in, of unit length.

    ``voted`` has (value, weight, created_at, vote_id, vec). Without enough votes, or
    where they cancel out, the profile stays as it is.
    """
    n, many = voted.count(), facets.count()
    weight = rocchio_weight(n, many)
    if not weight:
        return facets
    aged = rank_desc(voted.withColumn("_at", F.unix_micros("created_at").cast("double")), "_at", "vote_id", "recency")
    found = {r["dim"]: r["value"] for r in rocchio(aged, vector).collect()}  # a row per dimension
    x = np.array([found[d] for d in sorted(found)])
    length = float(np.linalg.norm(x))
    if length < 1e-6:
        return facets
    top = facets.agg(F.max(key)).first()[0]
    row = facets.sparkSession.createDataFrame([(int(top) + 1, [float(v) for v in x / length], weight)], f"{key} long, {vector} array<double>, weight double")
    return facets.unionByName(row, allowMissingColumns=True)


def scoring_mode(mode: str, signed_votes: int) -> str:
    """The mode that really runs: cosine until enough signed votes are there."""
    return "cosine" if mode == "cosine" or signed_votes < L.SIGNED_VOTES else mode


def cut_scores(score: Column, *penalties: Column) -> Column:
    """A score less its penalties."""
    for p in penalties:
        score = score - F.coalesce(p, F.lit(0.0))
    return score


def enriched_score(score: Column, velocity: Column, venue: Column, weight: float = 0.10) -> Column:
    """A score with citation velocity and venue quality, where known."""
    return score + 0.12 * F.coalesce(velocity, F.lit(0.0)) + weight * (F.coalesce(venue, F.lit(0.5)) - 0.5)


def to_enrich(items: DataFrame, known: DataFrame, as_of: Column) -> DataFrame:
    """DOIs (doi) of items (item_id, url, external_id) without a fresh row of ``known``: what is still to be looked up."""
    named = items.withColumn("doi", urls.derive_doi(F.col("url"), F.col("external_id"))).where("doi is not null")
    return named.join(fresh_enrichment(known, as_of).select("item_id"), "item_id", "left_anti").select("doi").distinct()


def fresh_enrichment(known: DataFrame, as_of: Column, days: int = L.ENRICHMENT_DAYS) -> DataFrame:
    """Rows of ``known`` (item_id, cited_by_count, venue_impact, fetched_at) that are not over-aged; an unknown age counts as fresh."""
    return known.where(F.col("fetched_at").isNull() | (F.col("fetched_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")))


def enrich(items: DataFrame, known: DataFrame, as_of: Column, score: str = "score", weight: float = L.VENUE_WEIGHT) -> DataFrame:
    """Adjust a score by citation velocity and venue quality, and add ``venue_low_impact``; items without a fresh row stay as they are."""
    fresh = fresh_enrichment(known, as_of).groupBy("item_id").agg(F.max_by(F.struct("cited_by_count", "venue_impact"), F.struct("fetched_at")).alias("_facts"))
    out = items.join(fresh, "item_id", "left")
    age = F.when(F.col("published_at").isNotNull(), scores.age_days(F.col("published_at"), as_of))
    velocity = F.when(F.col("_facts").isNotNull(), scores.citation_velocity(F.col("_facts.cited_by_count"), age))
    venue = scores.venue_quality(F.col("_facts.venue_impact"))
    return out.withColumns({score: enriched_score(F.col(score), velocity, venue, weight), "venue_low_impact": F.coalesce(venue < L.LOW_VENUE, F.lit(False))}).drop("_facts")
