"""Connected components of an edge table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.scratch import cut, discard


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """Return ``(node, root)``: for every node of ``edges`` the smallest node it reaches.

    Alternating large-star / small-star rounds (Kiveris et al. 2014). Every round
    keeps at most as many rows as there are edges, aggregates minima map-side
    before each shuffle and ends in a table in the shared folder. Edges with a
    null end are ignored; self loops give a component of one node.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes_alone = pairs.where("u = v").select("u", "v")
    links = pairs.where("u > v")
    spark = edges.sparkSession
    state, last = None, None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is linked to the smallest node around u
        large = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every node keeps its smallest smaller neighbour, the others are linked to that one
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "star")
        if last:
            discard(spark, last)
        last = links.cut_path
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    rooted = links.groupBy("u").agg(F.min("v").alias("v"))
    roots = rooted.select(F.col("v").alias("u"), "v").unionByName(nodes_alone).distinct()
    lone = roots.join(rooted.select("u"), "u", "left_anti")
    return rooted.unionByName(lone).select(F.col("u").alias("node"), F.col("v").alias("root"))
