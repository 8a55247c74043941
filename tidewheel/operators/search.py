"""Substring search through posting lists of trigrams.

A posting is (gram, item): the item has the trigram in one of the searched columns.
Postings are added a batch at a time, each a folder of a common commit sorted by
gram, so that a scan for a few grams reads the row groups that hold them. A search
takes the items that have every trigram of the query, reads those and looks. A new
version of an item adds postings; older ones cost a look and never a miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.grams import trigrams
from tidewheel.sources.commits import Change, State, Tables

MOST = 500


def postings(items: DataFrame, columns: list[str], key: str = "item_id") -> DataFrame:
    """(gram, key) of every trigram that a row has in one of the columns, once a row; letter case is folded."""
    kind = items.schema[key].dataType

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(c).to_pylist() for c in range(1, batch.num_columns)]
            for lo in range(0, batch.num_rows, 64):
                own = [np.unique(np.concatenate([trigrams(t[r]) for t in texts])) for r in range(lo, min(lo + 64, batch.num_rows))]
                rows = np.repeat(np.arange(lo, lo + len(own)), [len(g) for g in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), batch.column(0).take(pa.array(rows))], names=["gram", key])

    folded = items.select(key, *[F.lower(F.col(c)).alias(f"_{k}") for k, c in enumerate(columns)])
    return folded.mapInArrow(explode, f"gram long, {key} {kind.simpleString()}")


class TrigramIndex:
    """Posting lists of some columns of a table of items, kept as ``table`` of common commits."""

    def __init__(self, tables: Tables, columns: list[str], key: str = "item_id", table: str = "postings"):
        self.tables, self.columns, self.key, self.table = tables, columns, key, table

    def add(self, batch: DataFrame, *more: Change, stream: tuple[str, int] | None = None) -> State:
        """Add the postings of new or changed items, with other changes in the same commit."""
        rows = postings(batch, self.columns, self.key).repartitionByRange("gram").sortWithinPartitions("gram")
        return self.tables.commit([Change(self.table, rows), *more], batch=stream)

    def candidates(self, query: str) -> DataFrame | None:
        """Keys of items that have every trigram of the query; None where it has none, or nothing is indexed."""
        grams = [int(g) for g in np.unique(trigrams(query.lower()))]
        held = self.tables.read(self.table)
        if not grams or held is None:
            return None
        hits = held.where(F.col("gram").isin(grams)).distinct().groupBy(self.key).agg(F.count("*").alias("n"))
        return hits.where(F.col("n") == len(grams)).select(self.key)

    def search(self, items: DataFrame, query: str, limit: int = MOST) -> DataFrame:
        """Rows with the query as a case-insensitive substring of a column, newest first; queries under three characters read all items."""
        found = self.candidates(query)
        near = items if found is None else items.join(found, self.key, "left_semi")
        holds = F.lit(False)
        for c in self.columns:
            holds = holds | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
        return near.where(holds).orderBy(F.col("created_at").desc(), self.key).limit(min(limit, MOST))
