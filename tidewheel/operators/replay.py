"""Rankers held against votes that they could not have known.

A run is one evaluation at a time ``at`` of a clock that orders votes: a digest and
its hour, or a split of all votes and the number of its first later vote. What a run
learns from is in force then: a vote counts from after its own time until the next
vote on its item. All runs go through the same joins together, keyed by run; only
the fit of a ranker, on a bounded draw of pairs, is one task per run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel import lexicons as L
from tidewheel.functions import scores, vectors
from tidewheel.operators import feedback, learning, ranking
from tidewheel.operators.latest import latest
from tidewheel.scratch import cut

#: The splits that a new ranker has to win, and the one that counts most.
FRACTIONS, MANDATED = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85), 0.75
#: The learnt rankings, by the features of their ranker; ``fused`` is that of the vote memory.
RANKERS = ("lr_fused", "per_facet", "facets_only")
#: Facets that a ranker may have a weight for: its fit solves a system of that size.
MAX_FACETS = 512
#: Inverse strength of the ranker's penalty, and the grade of an item that must be read.
C, MUST_READ = 0.3, 100
#: Decimals that scores are ranked by: a mean of equal grades is the same grade, however it was rounded.
DIGITS = 12
EVER, NEVER = -(1 << 62), (1 << 62)
_MODEL = "run string, ranker string, coefficients array<double>"


def spells(votes: DataFrame, items: DataFrame) -> DataFrame:
    """Signed votes as exemplars with the time they are in force: item_id, vec, value, weight, grade, vote_id, since, until.

    ``votes`` is a log (item_id, vote_id, value, grade, created_at), in which a later
    vote, a neutral one too, ends an earlier one. A vote without a time is in force from
    the first on.
    """
    t = F.coalesce(F.unix_micros("created_at"), F.lit(EVER))
    own = Window.partitionBy("item_id").orderBy(t, "vote_id")
    timed = votes.withColumns({"since": t, "until": F.coalesce(F.lead(t).over(own), F.lit(NEVER))}).where("value <> 0 and since < until")
    weight = scores.grade_weight(F.coalesce("grade", scores.value_to_grade(F.col("value"))), L.MIN_EXEMPLAR_WEIGHT)
    return timed.join(items.select("item_id", "vec"), "item_id").select("item_id", "vec", "value", weight.alias("weight"), (F.col("value") * weight).alias("grade"), "vote_id", "since", "until")


def timeline(marks: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Up and down votes numbered in order of time from 0 (``_u``, ``_d``), and how many there are before each run.

    The second table is ``runs`` (run, at) with ``ups`` and ``downs`` begun before
    ``at`` and ``ended``, those no longer in force. One sort into ranges; running
    counts start from the sums of the ranges before.
    """
    none = F.lit(None)
    begun = marks.select(F.col("since").alias("_t"), F.lit(1).alias("_kind"), "vote_id", "item_id", "until", "value", none.cast("string").alias("run"))
    over = marks.where(F.col("until") < NEVER).select(F.col("until").alias("_t"), F.lit(2).alias("_kind"), "vote_id", "item_id", "until", "value", none.cast("string").alias("run"))
    asked = runs.select(F.col("at").alias("_t"), F.lit(0).alias("_kind"), none.cast("long").alias("vote_id"), none.cast("long").alias("item_id"), none.cast("long").alias("until"), F.lit(0).alias("value"), "run")
    rows = begun.unionByName(over).unionByName(asked).orderBy("_t", "_kind", "vote_id", "item_id", "run").withColumn("_place", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_part", F.shiftright("_place", 33)), "timeline")
    tests = {"ups": (F.col("_kind") == 1) & (F.col("value") > 0), "downs": (F.col("_kind") == 1) & (F.col("value") < 0), "ended": F.col("_kind") == 2}
    sums = rows.groupBy("_part").agg(*[F.count_if(test).alias(f"_{name}") for name, test in tests.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.select("_part", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in tests])
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.join(F.broadcast(sums), "_part")
    counted = cut(counted.select("*", *[(F.col(f"_{name}") + F.sum(test.cast("long")).over(inside)).alias(name) for name, test in tests.items()]), "counted")
    numbered = counted.where("_kind = 1").select("item_id", "until", F.when(F.col("value") > 0, F.col("ups") - 1).alias("_u"), F.when(F.col("value") < 0, F.col("downs") - 1).alias("_d"))
    return numbered, counted.where("_kind = 0").select("run", F.col("_t").alias("at"), "ups", "downs", "ended")


def drawn_pairs(numbered: DataFrame, counted: DataFrame, pairs: int = learning.PAIRS, seed: int = 0) -> DataFrame:
    """(run, at, up, down): pairs of an item voted up and one voted down before a run, all up to ``pairs``, else a seeded draw of so many.

    Numbers are drawn from all votes begun before the run; pairs with a vote that is no longer in force are left out.
    """

    @F.arrow_udf("array<struct<u:long,d:long>>")
    def draw(n: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(n.to_pylist(), m.to_pylist(), strict=True):
            flat = np.arange(a * b) if a * b <= pairs else np.random.default_rng(seed).choice(a * b, pairs, replace=False)
            out.append([{"u": int(p) // b, "d": int(p) % b} for p in flat])
        return pa.array(out, pa.list_(pa.struct([("u", pa.int64()), ("d", pa.int64())])))

    chosen = counted.select("run", "at", F.explode(draw("ups", "downs")).alias("p")).select("run", "at", F.col("p.u").alias("_u"), F.col("p.d").alias("_d"))
    side = lambda at, name: numbered.where(F.col(at).isNotNull()).select(at, F.col("item_id").alias(name), F.col("until").alias(f"_{name}"))
    both = chosen.join(side("_u", "up"), "_u").join(side("_d", "down"), "_d")
    return both.where((F.col("at") <= F.col("_up")) & (F.col("at") <= F.col("_down"))).select("run", "at", "up", "down")


def fit_pairs(d: np.ndarray, c: float = C, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic ranker on feature differences, each taken once in either direction.

    Differences are scaled to unit deviation; their mean and the intercept are 0, as
    every row has its negation. Newton steps on the penalised loss.
    """
    scale = np.sqrt((d * d).mean(0))
    scale = np.where(scale < 1e-6, 1.0, scale)
    x, w = d / scale, np.zeros(d.shape[1])
    loss = lambda w: w @ w / 2 + 2 * c * np.logaddexp(0, -(x @ w)).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))  # the weight of a pair in the wrong order
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * (x * (p * (1 - p))[:, None]).T @ x, w - 2 * c * x.T @ p)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-10:
            break
    return w / scale


def fit_all(differences: DataFrame, c: float = C) -> DataFrame:
    """A ranker for every (run, ranker) of ``differences`` (run, ranker, x): (run, ranker, coefficients). A group has as many rows as pairs are drawn."""

    def fit(rows: pa.Table) -> pa.Table:
        x = vectors.matrix(rows["x"].combine_chunks())
        order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))
        found = fit_pairs(x[order], c) if x.shape[1] else np.zeros(0)  # one order of rows, so that reruns agree
        return pa.table({"run": rows["run"][:1], "ranker": rows["ranker"][:1], "coefficients": pa.array([found], pa.list_(pa.float64()))})

    return differences.groupBy("run", "ranker").applyInArrow(fit, _MODEL)


def grouped_ranks(df: DataFrame, groups: list[str], score: str, tie: str, into: str) -> DataFrame:
    """0-based rank by score, largest first, in each group, and ``_range``. Ranges of the score are sorted apart, so no task has to sort a whole group."""
    tagged = df.withColumn("_range", ranking.value_range(df, score))
    sizes = tagged.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*groups).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*groups, "_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*groups, "_range").orderBy(F.desc(score), tie)
    return tagged.join(sizes, [*groups, "_range"]).withColumn(into, F.col("_above") + F.row_number().over(inside) - 1).drop("_above")


def metrics(scored: DataFrame, k: int = 10, head: int = 10) -> DataFrame:
    """(run, ranking, n_test, n_pairs, n_must_read, accuracy, ndcg, precision, recall) of lists (run, ranking, item_id, score, label, must).

    Accuracy is over pairs of labels of either sign, ties half right; the others look
    at the first ``k`` or ``head`` rows. What is undefined is null.
    """
    at = cut(grouped_ranks(scored, ["run", "ranking"], "score", "item_id", "rank"), "ranks")
    keys, up = ["run", "ranking"], F.col("label") > 0
    sums = at.groupBy(*keys).agg(
        F.count("*").alias("n_test"), F.count_if(up).alias("_up"), F.count_if(F.col("label") < 0).alias("_down"), F.count_if("must").alias("n_must_read"),
        F.sum(F.when(up & (F.col("rank") < k), 1.0 / F.log2(F.col("rank") + 2.0)).otherwise(0.0)).alias("_dcg"), F.avg(F.when(F.col("rank") < head, up.cast("double"))).alias("precision"), F.count_if(F.col("must") & (F.col("rank") < head)).alias("_must"),
    )
    levels = at.groupBy(*keys, "_range", "score").agg(F.count_if(up).alias("_u"), F.count_if(F.col("label") < 0).alias("_d"))
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = levels.groupBy(*keys, "_range").agg(F.sum("_d").alias("_s")).select(*keys, "_range", F.coalesce(F.sum("_s").over(lower), F.lit(0)).alias("_below"))
    inside = Window.partitionBy(*keys, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    right = levels.join(below, [*keys, "_range"]).withColumn("_under", F.col("_below") + F.coalesce(F.sum("_d").over(inside), F.lit(0))).groupBy(*keys).agg(F.sum(F.col("_u") * (F.col("_under") + F.col("_d") / 2)).alias("_right"))
    n = F.col("_up") * F.col("_down")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("_up"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return sums.join(right, keys).select(
        *keys, "n_test", n.alias("n_pairs"), "n_must_read", F.when(n > 0, F.col("_right") / n).alias("accuracy"), F.when(F.col("_up") > 0, F.col("_dcg") / ideal).alias("ndcg"), "precision", F.when(F.col("n_must_read") > 0, F.col("_must") / F.col("n_must_read")).alias("recall"),
    )


def _facet_sims(facets: DataFrame) -> tuple[Column, int]:
    """The cosines to all facets, in order of facet_id, as one column, and their number."""
    many = facets.count()
    if many > MAX_FACETS:
        raise ValueError(f"a ranker has weights for {MAX_FACETS} facets at most, not {many}")
    rows = vectors.unit(vectors.matrix(facets.select("facet_id", "vec").toArrow().sort_by("facet_id")["vec"].combine_chunks())) if many else None

    @F.arrow_udf("array<double>")
    def sims(v: pa.Array) -> pa.Array:
        found = vectors.unit(vectors.matrix(v)) @ rows.T if rows is not None and len(v) else np.zeros((len(v), 0))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    return sims("vec"), many


def evaluate(asked: DataFrame, runs: DataFrame, marks: DataFrame, items: DataFrame, facets: DataFrame, now: Column, least: int = 0, pairs: int = learning.PAIRS, seed: int = 0, k: int = 10, head: int = 10, watched: list[str] | None = None) -> DataFrame:
    """What every ranking is worth in every run: run, ranking, learnt, n_train and ``metrics``.

    ``asked`` (run, at, item_id, label, must) are the lists to rank, ``runs`` (run, at)
    their times, ``marks`` the votes as of ``spells``; ``items`` has what
    ``learning.item_features`` reads, ``now`` is the time of a row (which may use
    ``at``) from which ages count. Rankings are topic alone; fused with the vote
    memory; and fused with each of ``RANKERS``, fitted to pairs of votes in force at
    the run on the engine's features, on facet cosines with affinities, or on facet
    cosines alone. ``learnt`` is false where fewer than ``least`` votes are in force,
    or none of one sign: the ranking is then that of the topic.
    """
    numbered, counted = timeline(marks, runs)
    counted = counted.withColumn("n_train", F.col("ups") + F.col("downs") - F.col("ended"))
    chosen = cut(drawn_pairs(numbered, counted, pairs, seed), "pairs")
    sides = chosen.select("run", "at", F.explode(F.array("up", "down")).alias("item_id")).unionByName(asked.select("run", "at", "item_id")).distinct()
    used = items.join(asked.select("item_id").unionByName(marks.select("item_id")).distinct(), "item_id", "left_semi")
    plain = learning.plain_features(ranking.topic_scores(used, facets, "cosine"), F.lit(None).cast("timestamp"), watched).select("item_id", "vec", "published_at", *[f for f in learning.FEATURES if f not in ("fresh_cosine", "pos_affinity", "neg_affinity")])
    met = ranking.preference_scores(cut(sides.join(cut(plain, "plain"), "item_id"), "sides"), marks, at="at")
    met = learning.with_affinities(met, marks, at="at").withColumn("fresh_cosine", learning.fresh_cosine(now))
    sims, _ = _facet_sims(facets)
    met = met.withColumn("_sims", sims)
    kinds = {"lr_fused": F.array(*[F.col(f).cast("double") for f in learning.FEATURES]), "per_facet": F.concat("_sims", F.array("pos_affinity", "neg_affinity")), "facets_only": F.col("_sims")}
    met = cut(met.select("run", "item_id", F.col("cosine").alias("topic"), "preference", *[kinds[r].alias(r) for r in RANKERS]), "met")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ranker"), F.zip_with(F.col(f"u.{r}"), F.col(f"d.{r}"), lambda a, b: a - b).alias("x")) for r in RANKERS]))
    named = lambda item, name: met.select("run", F.col("item_id").alias(item), F.struct(*RANKERS).alias(name))
    both = chosen.join(named("up", "u"), ["run", "up"]).join(named("down", "d"), ["run", "down"])
    models = fit_all(both.select("run", each.alias("p")).select("run", "p.*"))
    models = cut(models.groupBy("run").agg(*[F.max_by("coefficients", F.col("ranker") == r).alias(f"_{r}") for r in RANKERS]), "models")
    dot = lambda x, w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    rows = asked.join(met, ["run", "item_id"]).join(counted.select("run", "n_train"), "run").join(models, "run", "left")
    enough = F.col("n_train") >= least
    signals = {"topic": (F.lit(True), F.col("topic")), "fused": (enough & (F.col("n_train") > 0), F.col("preference"))} | {r: (enough & F.col(f"_{r}").isNotNull(), dot(F.col(r), F.col(f"_{r}"))) for r in RANKERS}
    table = F.array(*[F.struct(F.lit(name).alias("ranking"), ok.alias("learnt"), F.round(F.when(ok, score).otherwise(F.col("topic")), DIGITS).alias("score")) for name, (ok, score) in signals.items()])
    long = cut(rows.select("run", "item_id", "label", "must", "n_train", F.explode(table).alias("s")).select("run", "item_id", "label", "must", "n_train", "s.*"), "signals")
    placed = cut(grouped_ranks(long, ["run", "ranking"], "score", "item_id", "_b").drop("_range"), "placed")
    topic = placed.where("ranking = 'topic'").select("run", "item_id", F.col("_b").alias("_a"))
    fused = F.lit(1.0) / (L.RRF_K + F.col("_a") + 1) + F.lit(1.0) / (L.RRF_K + F.col("_b") + 1)
    lists = placed.join(topic, ["run", "item_id"]).withColumn("score", F.when((F.col("ranking") == "topic") | ~F.col("learnt"), F.col("score")).otherwise(fused))
    lists = cut(lists.drop("_a", "_b"), "lists")
    known = lists.groupBy("run", "ranking").agg(F.first("learnt").alias("learnt"), F.first("n_train").alias("n_train"))
    return known.join(metrics(lists, k, head), ["run", "ranking"])


def held_out(items: DataFrame, votes: DataFrame, facets: DataFrame, as_of: Column, fractions: tuple[float, ...] = FRACTIONS, **more) -> DataFrame:
    """``evaluate`` on later votes, for several splits in time at once; ``fraction`` in place of run.

    Of the latest signed votes the earlier share teaches, the later ones are ranked.
    A ranking that had nothing to learn from is left out.
    """
    now = latest(votes, ["item_id"], ["created_at", "vote_id"]).where("value <> 0").withColumn("must", F.coalesce(F.col("grade") >= MUST_READ, F.lit(False)))
    known = feedback.exemplars(votes, items).join(now.select("item_id", "must"), "item_id")
    marks = cut(learning.numbered(known, ["created_at", "vote_id"], "_at").select("item_id", "vec", "value", "weight", "grade", "vote_id", "must", (F.col("_at") + 1).alias("since"), F.lit(NEVER).alias("until")), "marks")
    n = marks.count()
    ends = {f: min(max(1, round(n * f)), n - 1) if n > 1 else n for f in fractions}
    runs = items.sparkSession.createDataFrame([(f"{f:.2f}", end + 1) for f, end in ends.items()], "run string, at long")
    splits = F.explode(F.array(*[F.struct(F.lit(f"{f:.2f}").alias("run"), F.lit(end + 1).cast("long").alias("at")) for f, end in ends.items()]))
    asked = marks.select("item_id", F.col("value").alias("label"), "must", "since", splits.alias("s")).select("s.*", "item_id", "label", "must", "since").where("since >= at").drop("since")
    found = evaluate(asked, runs, marks.drop("must"), items, facets, as_of, **more)
    return found.where("learnt").select(F.col("run").cast("double").alias("fraction"), *[c for c in found.columns if c not in ("run", "learnt")])


def gate(found: DataFrame, new: str = "per_facet", old: str = "lr_fused", least: float = 0.08, mandated: float = MANDATED) -> DataFrame:
    """One row (considered, passes, gain, adopt): whether a new ranking gains ``least`` ndcg at the mandated split and at all others."""
    each = found.groupBy("fraction").agg((F.max(F.when(F.col("ranking") == new, F.col("ndcg"))) - F.max(F.when(F.col("ranking") == old, F.col("ndcg")))).alias("gain")).where("gain is not null")
    sums = each.agg(F.count("*").alias("considered"), F.count_if(F.col("gain") >= least).alias("passes"), F.max(F.when(F.abs(F.col("fraction") - mandated) < 1e-9, F.col("gain"))).alias("gain"))
    return sums.withColumn("adopt", F.coalesce((F.col("gain") >= least) & (F.col("passes") == F.col("considered")), F.lit(False)))


def replay(slates: DataFrame, votes: DataFrame, items: DataFrame, facets: DataFrame, least: int = L.SIGNED_VOTES, **more) -> DataFrame:
    """``evaluate`` for digests (digest_id, at timestamp, item_id), each of which sees only the votes before it; ``digest_id`` in place of run.

    An item's label is the latest vote on it if that came at or after the digest;
    without one it is ranked but neither liked nor disliked. Digests without a signed
    label are left out.
    """
    last = latest(votes, ["item_id"], ["created_at", "vote_id"]).select("item_id", "value", "grade", "created_at")
    rows = slates.select(F.col("digest_id").cast("string").alias("run"), F.unix_micros("at").alias("at"), "item_id").distinct().join(items.select("item_id"), "item_id", "left_semi").join(last, "item_id", "left")
    later = F.col("created_at").isNotNull() & (F.unix_micros("created_at") >= F.col("at"))
    rows = rows.select("run", "at", "item_id", F.when(later, F.col("value")).otherwise(0).alias("label"), F.coalesce(later & (F.col("grade") >= MUST_READ), F.lit(False)).alias("must"))
    rows = cut(rows, "asked")
    runs = cut(rows.groupBy("run", "at").agg(F.max(F.abs("label")).alias("_any")).where("_any > 0").drop("_any"), "runs")
    found = evaluate(rows.join(runs, ["run", "at"], "left_semi"), runs, cut(spells(votes, items), "spells"), items, facets, F.timestamp_micros("at"), least, **more)
    return found.withColumnRenamed("run", "digest_id")
