"""Streaming counterparts of batch operators. An extension: the batch forms define the results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.candidates import add_carryover
from tidewheel.sources.commits import Change, State, Tables
from tidewheel.sources.sinks import label_slate


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "12 hours", slide: str | None = None) -> DataFrame:
    """Events and their sum per window and type; later events than the watermark are dropped by design."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per user session."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def first_seen(items: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each (source, external_id) within the watermark."""
    return items.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["source", "external_id"])


def latest_votes(votes: DataFrame) -> DataFrame:
    """The running latest vote per item (item_id, value, created_at), state kept per item."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for pdf in batches:
            for value, at in zip(pdf["value"], pdf["created_at"], strict=True):
                stamp = int(pd.Timestamp(at).value // 1000)
                if best is None or stamp >= best[1]:
                    best = (int(value), stamp)
        state.update(best)
        yield pd.DataFrame({"item_id": [key[0]], "value": [best[0]], "created_at": [pd.Timestamp(best[1] * 1000)]})

    return votes.groupBy("item_id").applyInPandasWithState(step, "item_id long, value int, created_at timestamp", "value int, stamp long", "update", "NoTimeout")


def slate_publisher(tables: Tables, stream: str, digest_id: Callable[[int], str], brew: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, int], State]:
    """A function for ``foreachBatch`` that brews a digest from each batch of items and the pinned ones, each pin used once.

    ``brew`` takes the pool and the digest's id and returns its slate (digest_id,
    item_id, label, ord). The slate, the pins that are left and the batch's number
    go into one commit: a batch that is replayed after a crash finds its number and
    changes nothing, and one that crashed earlier finds its pins still there. Tables
    are ``items`` and ``pins`` (item_id, pinned_digest_id), both may be missing.
    """

    def publish(batch: DataFrame, number: int) -> State:
        base = tables.state()
        if base.batches.get(stream, -1) >= number:
            return base
        digest, items, pins = digest_id(number), tables.read("items", base), tables.read("pins", base)
        pool = batch if items is None or pins is None else add_carryover(batch, items, pins, digest)
        slate = label_slate(brew(pool, digest))
        changes = [Change("slate", slate, [{"digest_id": digest}])]
        if pins is not None:
            changes.append(Change("pins", pins.where(F.col("pinned_digest_id") == digest), overwrite=True))
        return tables.commit(changes, base, (stream, number))

    return publish
