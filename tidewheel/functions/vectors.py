"""Similarity to bounded sets of vectors, as array arithmetic over Arrow batches.

The small side (facets, exemplars, shown items) is counted first. Up to
``MAX_ROWS`` rows are shared with the executors; a larger side is taken in hashed
blocks of that size, one after another, with a table in the shared folder between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 20_000


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as float64."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of numbers, or one of structs of numbers as a row each."""
    if not pa.types.is_struct(column.type):
        return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    whole = column if isinstance(column, pa.Array) else column.combine_chunks()
    return np.stack([f.to_numpy(zero_copy_only=False) for f in whole.flatten()], axis=1) if len(whole) else np.zeros((0, whole.type.num_fields), np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def blocks(small: DataFrame, key: str, *columns: str, limit: int = MAX_ROWS) -> Iterator[dict[str, np.ndarray]]:
    """The small side as numpy columns, in blocks of about ``limit`` rows, each in key order."""
    n = small.count()
    parts = max(1, -(-n // limit))
    for k in range(parts):
        part = small if parts == 1 else small.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        table = part.select(key, *columns).toArrow().sort_by(key)
        yield {c: (matrix(table[c].combine_chunks()) if pa.types.is_list(table[c].type) else table[c].to_numpy()) for c in (key, *columns)}


def map_vectors(vec: str | Column, f, *others: str) -> Column:
    """A double per row from its vector (and other columns), computed a batch at a time."""

    @F.arrow_udf(T.DoubleType())
    def run(v: pa.Array, *rest: pa.Array) -> pa.Array:
        return pa.array(np.asarray(f(matrix(v), *[r.to_numpy(zero_copy_only=False) for r in rest]), np.float64))

    return run(vec, *others)


def multi_cosine(x: np.ndarray, facets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """0.7 of the best facet's similarity and 0.3 of the best three's mean; one facet counts alone.

    Similarities are scaled by the facet weight, 1 at most.
    """
    sims = unit(x) @ unit(facets).T * np.minimum(weights, 1.0)
    if sims.shape[1] == 1:
        return sims[:, 0]
    top = np.sort(sims, axis=1)[:, ::-1]
    return 0.7 * top[:, 0] + 0.3 * top[:, :3].mean(1)


def query_aware(x: np.ndarray, facets: np.ndarray, sharpness: float = 3.0) -> np.ndarray:
    """Similarity averaged over facets with softmax attention."""
    sims = unit(x) @ unit(facets).T
    w = np.exp(sharpness * (sims - sims.max(1, keepdims=True)))
    return (sims * w).sum(1) / w.sum(1)


def knn_scores(x: np.ndarray, ids: np.ndarray, exemplar_ids: np.ndarray, exemplars: np.ndarray, grades: np.ndarray, k: int = 8) -> np.ndarray:
    """Mean signed grade of the k nearest exemplars, weighted by squared similarity; an item never meets itself."""
    if not len(exemplars) or not len(x):
        return np.zeros(len(x))
    sims = unit(x) @ unit(exemplars).T
    sims[np.asarray(ids)[:, None] == exemplar_ids[None, :]] = -1.0
    near = np.argsort(sims, axis=1, kind="stable")[:, ::-1][:, :k]
    w = np.maximum(np.take_along_axis(sims, near, 1), 0) ** 2
    total = w.sum(1)
    return np.where(total > 0, (w * grades[near]).sum(1) / np.where(total > 0, total, 1), 0.0)


def affinity(x: np.ndarray, ids: np.ndarray, exemplar_ids: np.ndarray, exemplars: np.ndarray, weights: np.ndarray, k: int = 5) -> np.ndarray:
    """Mean of the k largest weighted similarities; an item never meets itself."""
    if not len(exemplars) or not len(x):
        return np.zeros(len(x))
    sims = unit(x) @ unit(exemplars).T * weights
    own = np.asarray(ids)[:, None] == exemplar_ids[None, :]
    sims[own] = -np.inf
    top = np.sort(sims, axis=1)[:, ::-1][:, :k]
    there = np.isfinite(top)
    return np.where(there, top, 0).sum(1) / np.maximum(there.sum(1), 1)


def graded_sims(x: np.ndarray, ids: np.ndarray, exemplar_ids: np.ndarray, exemplars: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarities as ``knn_scores`` sees them, with the exemplars' ids and grades."""
    sims = unit(x) @ unit(exemplars).T if len(x) and len(exemplars) else np.zeros((len(x), len(exemplar_ids)))
    sims[np.asarray(ids)[:, None] == exemplar_ids[None, :]] = -1.0
    return sims, exemplar_ids, grades


def weighted_sims(x: np.ndarray, ids: np.ndarray, exemplar_ids: np.ndarray, exemplars: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarities as ``affinity`` sees them, with the exemplars' ids and weights; -inf where an item meets itself."""
    sims = unit(x) @ unit(exemplars).T * weights if len(x) and len(exemplars) else np.zeros((len(x), len(exemplar_ids)))
    sims[np.asarray(ids)[:, None] == exemplar_ids[None, :]] = -np.inf
    return sims, exemplar_ids, weights


def floors(sims: np.ndarray, k: int) -> np.ndarray:
    """A value that k of each row reach: the k-th largest of the maxima of its parts; -inf for short rows, of which all may be looked at."""
    parts = 16 * k
    width = sims.shape[1] // parts
    if width < 2:
        return np.full(len(sims), -np.inf)
    tops = sims[:, : width * parts].reshape(len(sims), parts, width).max(2)
    return np.partition(tops, parts - k, axis=1)[:, parts - k]


class Top:
    """The k largest (sim, id, number) of each of some rows, over all that they have seen; of equal sims larger ids come first, -inf is never held."""

    def __init__(self, rows: int, k: int, least: np.ndarray | float = -np.inf):
        self.k, self.sim, self.least = k, np.full((rows, k), -np.inf), np.broadcast_to(least, rows)
        self.id, self.number = np.zeros((rows, k), np.int64), np.zeros((rows, k))

    def worst(self) -> np.ndarray:
        """What a sim must reach to be held: the k-th best, ``least`` at least."""
        return np.maximum(self.sim[:, -1], self.least)

    def see(self, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        """``sims`` has a row for each of ``rows`` and a column for each id and number. Only what reaches the k-th best is sorted."""
        if not sims.size:
            return
        floor = np.maximum(self.worst()[rows], floors(sims, self.k))
        r, c = np.nonzero((sims >= floor[:, None]) & (sims > -np.inf))
        if not len(r):
            return
        changed, at = np.unique(r, return_inverse=True)
        own = rows[changed]
        row = np.concatenate((np.repeat(np.arange(len(own)), self.k), at))
        sim = np.concatenate((self.sim[own].ravel(), sims[r, c]))
        id_ = np.concatenate((self.id[own].ravel(), np.asarray(ids, np.int64)[c]))
        number = np.concatenate((self.number[own].ravel(), np.asarray(numbers, np.float64)[c]))
        order = np.lexsort((-id_, -sim, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], np.arange(len(own)))[row[order]]
        best = order[place < self.k].reshape(len(own), self.k)
        self.sim[own], self.id[own], self.number[own] = sim[best], id_[best], number[best]

    def lists(self) -> pa.ListArray:
        """A list of (sim, id, number) for each row."""
        held = self.sim > -np.inf
        flat = pa.StructArray.from_arrays([pa.array(self.sim[held]), pa.array(self.id[held]), pa.array(self.number[held])], ["sim", "id", "number"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held.sum(1)))).astype(np.int32)), flat)


def nearest(sims: np.ndarray, exemplar_ids: np.ndarray, numbers: np.ndarray, k: int) -> pa.Array:
    """The k largest of each row as a list of (sim, id, number); of equal sims larger ids come first, -inf is left out."""
    top = Top(len(sims), k)
    top.see(np.arange(len(sims)), sims, exemplar_ids, numbers)
    return top.lists()
