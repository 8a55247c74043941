"""Retention: what old state goes, in an order that keeps what is still referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.candidates import retained

#: Tables whose rows belong to a digest, and tables whose rows keep an item.
OF_DIGEST = ["digest_items", "digest_item_features", "digest_audits"]
KEEPERS = ["votes", "bookmarks", "known_items", "carryover_items", "digest_items"]


def maintain(tables: dict[str, DataFrame], before: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after upkeep, and (step, removed) per step.

    Digests made before ``before`` go first with all that belongs to them, so that
    their items are free; then items fetched before it that no vote, bookmark, known
    mark, pin or remaining digest keeps; then reasons and previews without their item
    or digest. Missing tables are left out. Null times are never old.
    """
    out = dict(tables)
    counts = []

    def drop(step: str, table: str, rest: DataFrame, size: Column = F.count("*")) -> None:
        gone = out[table].agg(size.alias("n")).select(F.lit(step).alias("step"), "n").unionByName(rest.agg((-size).alias("n")).select(F.lit(step).alias("step"), "n"))
        counts.append(gone.groupBy("step").agg(F.sum("n").alias("removed")))
        out[table] = rest

    if "digests" in out:
        drop("digests", "digests", out["digests"].where(F.coalesce(F.col("created_at") >= before, F.lit(True))))
        left = out["digests"].select("digest_id")
        for name in OF_DIGEST:
            if name in out:
                out[name] = out[name].join(left, "digest_id", "left_semi")
    if "items" in out:
        old = retained(out["items"], before, [out[k] for k in KEEPERS if k in out], "fetched_at", "item_id")
        drop("items", "items", out["items"].join(old.select("item_id"), "item_id", "left_anti"))
        if "reasons" in out:
            drop("reasons", "reasons", out["reasons"].join(out["items"].select("item_id"), "item_id", "left_semi"))
    if "previews" in out:
        drop("previews", "previews", out["previews"].where(F.coalesce(F.col("created_at") >= before, F.lit(True))))
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return out, total
