"""Daily decks of short notes: deterministic draws and their order."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def note_key(note, kind: str):
    """Hash that orders the notes of a kind."""
    return F.sha2(F.concat(F.lit(f"{kind}|v1|"), note), 256)


def daily_draw(notes: DataFrame, count: int, day: dt.date, kind: str, note: str = "note") -> DataFrame:
    """The notes of a day: the hashed order, advanced by a whole draw each day. Adds ``at``.

    A bank of notes is a list that people write, so its order is one small sort.
    """
    from pyspark.sql import Window

    ranked = notes.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(note_key(F.col(note), kind))) - 1)
    total = notes.count()
    start = (day.toordinal() * count) % total if total else 0
    at = F.pmod(F.col("_n") - start, F.lit(max(total, 1)))
    return ranked.withColumn("at", at).where(F.col("at") < count).drop("_n")


def compose(jokes: list[str], facts: list[str], day: dt.date) -> list[str]:
    """Two jokes, then a fact, rotated by a hash of the day."""
    deck = [n for k, fact in enumerate(facts) for n in (*jokes[2 * k : 2 * k + 2], fact)]
    turn = hashlib.sha256(f"order|{day.isoformat()}".encode()).digest()[0] % len(deck) if deck else 0
    return deck[turn:] + deck[:turn]
