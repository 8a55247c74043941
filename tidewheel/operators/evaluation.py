"""Offline evaluation of slates against votes. Slates have (digest_id, item_id, score, label); a label above 0 is relevant, below 0 is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators import feedback, ranking
from tidewheel.operators.latest import chronological_split
from tidewheel.operators.ranking import value_range
from tidewheel.scratch import cut


def ranked(slates: DataFrame) -> DataFrame:
    """Add rank (from 1) by score within each digest."""
    return slates.withColumn("rank", F.row_number().over(Window.partitionBy("digest_id").orderBy(F.desc("score"), "item_id")))


def ndcg(slates: DataFrame, k: int = 10) -> DataFrame:
    """(digest_id, ndcg) with binary gains; the ideal order is that of all labels; null without relevant ones."""
    rel = (F.col("label") > 0).cast("double")
    discount = F.log2(F.col("rank") + 1.0)
    sums = ranked(slates).groupBy("digest_id").agg(F.sum(F.when(F.col("rank") <= k, rel / discount).otherwise(0.0)).alias("dcg"), F.count_if(F.col("label") > 0).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return sums.select("digest_id", F.when(F.col("n") > 0, F.col("dcg") / ideal).alias("ndcg"))


def precision_at(slates: DataFrame, k: int = 10) -> DataFrame:
    """(digest_id, precision): relevant share of the first k, or of all if fewer."""
    return ranked(slates).where(F.col("rank") <= k).groupBy("digest_id").agg(F.avg((F.col("label") > 0).cast("double")).alias("precision"))


def average_precision(slates: DataFrame) -> DataFrame:
    """(digest_id, ap): mean over relevant items of the precision at their rank; null without any."""
    w = Window.partitionBy("digest_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = ranked(slates).withColumn("hits", F.sum((F.col("label") > 0).cast("long")).over(w))
    return at.groupBy("digest_id").agg(F.avg(F.when(F.col("label") > 0, F.col("hits") / F.col("rank"))).alias("ap"))


def pairwise_accuracy(slates: DataFrame) -> DataFrame:
    """(digest_id, accuracy): share of (relevant, not relevant) pairs in the right order; one running count, no pairs are made."""
    w = Window.partitionBy("digest_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = ranked(slates).withColumn("ups", F.sum((F.col("label") > 0).cast("long")).over(w))
    sums = at.groupBy("digest_id").agg(F.sum(F.when(F.col("label") < 0, F.col("ups")).otherwise(0)).alias("right"), F.count_if(F.col("label") > 0).alias("up"), F.count_if(F.col("label") < 0).alias("down"))
    return sums.select("digest_id", F.when(F.col("up") * F.col("down") > 0, F.col("right") / (F.col("up") * F.col("down"))).alias("accuracy"))


def score_pairwise_accuracy(scored: DataFrame, ranges: int = 512) -> DataFrame:
    """One row, ``accuracy``, over all items by score, ties half right.

    Distinct scores fall into ranges; what lies below a score is the sum of the
    lower ranges and of the lower scores in its own, so no task sorts them all.
    """
    place = value_range(scored, "score", ranges)
    levels = scored.groupBy("score").agg(F.count_if(F.col("label") > 0).alias("up"), F.count_if(F.col("label") < 0).alias("down"))
    levels = levels.withColumn("_range", place)
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = levels.groupBy("_range").agg(F.sum("down").alias("_down")).select("_range", F.coalesce(F.sum("_down").over(lower), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    at = levels.join(F.broadcast(sums), "_range").withColumn("below", F.col("_below") + F.coalesce(F.sum("down").over(inside), F.lit(0)))
    total = at.agg(F.sum(F.col("up") * (F.col("below") + F.col("down") / 2)).alias("right"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    return total.select(F.when(F.col("up") * F.col("down") > 0, F.col("right") / (F.col("up") * F.col("down"))).alias("accuracy"))


def recall_at(slates: DataFrame, must: str, k: int = 10) -> DataFrame:
    """(digest_id, recall): share of must-read items (a boolean column) in the first k; null without any."""
    return ranked(slates).groupBy("digest_id").agg(F.count_if(F.col(must)).alias("n"), F.count_if(F.col(must) & (F.col("rank") <= k)).alias("hit")).select("digest_id", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).alias("recall"))


def orderings(slate: DataFrame, features: DataFrame, votes: DataFrame) -> DataFrame:
    """Slates to evaluate: the logged feature score where there is one, latest votes as labels, digests without a vote left out."""
    rows = slate.join(features.select("digest_id", "item_id", F.col("final_score").alias("_f")), ["digest_id", "item_id"], "left").join(votes.select("item_id", "value"), "item_id", "left")
    rows = rows.select("digest_id", "item_id", F.coalesce("_f", "score", F.lit(0.0)).alias("score"), F.coalesce("value", F.lit(0)).alias("label"), F.col("value").isNotNull().alias("voted"))
    seen = rows.groupBy("digest_id").agg(F.max("voted").alias("any")).where("any").select("digest_id")
    return rows.join(seen, "digest_id", "left_semi").drop("voted")


def macro(slates: DataFrame, ks: tuple[int, ...] = (10,)) -> DataFrame:
    """One row per k: digests, and means over digests of ndcg, precision, ap and accuracy where they exist.

    Ranks and running hits come from one window, and all metrics of all k from one
    sum per digest.
    """
    w = Window.partitionBy("digest_id").orderBy(F.desc("score"), "item_id").rowsBetween(Window.unboundedPreceding, 0)
    up, down, rank = F.col("label") > 0, F.col("label") < 0, F.col("rank")
    at = slates.select("digest_id", "label", F.row_number().over(w).alias("rank"), F.sum((F.col("label") > 0).cast("long")).over(w).alias("ups"))
    gain = lambda k: F.sum(F.when(up & (rank <= k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0)).alias(f"dcg_{k}")
    share = lambda k: F.avg(F.when(rank <= k, up.cast("double"))).alias(f"precision_{k}")
    each = at.groupBy("digest_id").agg(F.count_if(up).alias("n"), F.count_if(down).alias("m"), F.avg(F.when(up, F.col("ups") / rank)).alias("ap"), F.sum(F.when(down, F.col("ups")).otherwise(0)).alias("right"), *[f(k) for k in ks for f in (gain, share)])
    accuracy = F.when(F.col("n") * F.col("m") > 0, F.col("right") / (F.col("n") * F.col("m")))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    ndcgs = [F.avg(F.when(F.col("n") > 0, F.col(f"dcg_{k}") / ideal(k))).alias(f"ndcg_{k}") for k in ks]
    means = each.agg(F.count("*").alias("digests"), F.avg("ap").alias("ap"), F.avg(accuracy).alias("accuracy"), *ndcgs, *[F.avg(f"precision_{k}").alias(f"precision_{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), "digests", F.col(f"ndcg_{k}").alias("ndcg"), F.col(f"precision_{k}").alias("precision"), "ap", "accuracy") for k in ks])
    return means.select(F.inline(rows))


def head(scored: DataFrame, k: int = 10) -> DataFrame:
    """One row (ndcg, precision) for the first k of one list by score; the ideal order is that of all labels."""
    first = scored.orderBy(F.desc("score"), "item_id").limit(k).select((F.col("label") > 0).cast("double").alias("rel"), "score", "item_id")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "item_id"))  # k rows
    sums = first.withColumn("at", place).agg(F.sum(F.col("rel") / F.log2(F.col("at") + 1.0)).alias("dcg"), F.avg("rel").alias("precision"))
    n = scored.agg(F.count_if(F.col("label") > 0).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return sums.join(n).select(F.when(F.col("n") > 0, F.col("dcg") / ideal).alias("ndcg"), "precision")


def held_out(items: DataFrame, votes: DataFrame, facets: DataFrame, fraction: float = 0.75, k: int = 10) -> DataFrame:
    """What ranking by topic alone and fused with preference is worth on later votes: ranking, n_train, n_test, accuracy, ndcg, precision.

    Latest signed votes are split by time; preference comes from the earlier ones
    only, and only items voted on later are ranked, so nothing leaks. ``items`` has
    (item_id, vec); items without a signed vote take no part.
    """
    voted = feedback.exemplars(votes, items)
    parts = cut(chronological_split(voted, "created_at", "vote_id", fraction), "split")
    train = parts.where("is_train").select("item_id", "vec", "grade")
    test = parts.where("not is_train").select("item_id", "vec", F.col("value").alias("label"))
    scored = ranking.preference_scores(ranking.topic_scores(test, facets), train)
    scored = cut(ranking.rrf(cut(scored.drop("vec"), "signals"), "topic_score", "preference", "item_id"), "fused")
    sizes = parts.agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"))
    out = None
    for name, column in (("topic", "topic_score"), ("fused", "fused")):
        one = scored.select("item_id", "label", F.col(column).alias("score"))
        row = sizes.join(score_pairwise_accuracy(one)).join(head(one, k)).select(F.lit(name).alias("ranking"), "n_train", "n_test", "accuracy", "ndcg", "precision")
        out = row if out is None else out.unionByName(row)
    return out
