"""Toxicity by subword bags: averaged character n-gram vectors and a linear softmax, trained jointly in numpy.

Words are runs of letters and digits in lower case. Every word gives the n-grams
of its characters between boundary marks, hashed to a table of vectors; a text is
the mean of the vectors of all its n-grams and a fixed number of blank ones, so a
word never seen shares vectors with its known relatives and a few words prove
little. All of it is array arithmetic over the characters of
many texts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import buffers, steps
from tidewheel.llm.labelled import training_rows

GRAMS = (5, 6)
TABLE_BITS = 18
DIM = 6
EPOCHS = 10
#: n-grams without meaning that every text is taken to have besides its own, so that a few words prove little.
BLANKS = 100
#: Multiples of the weights' root mean square under which a weight may be set to 0; held-aside rows choose.
FLOORS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)
#: Steps at least, for small samples; texts that an n-gram is in, at least, to be learnt.
MIN_STEPS, MIN_TEXTS = 400, 3
BATCH = 64
RATE, VECTOR_RATE = 0.02, 10.0
#: Weight of the pull of the vectors towards 0.
SHRINK = 3e-3
REJECT = 0.7
CALIBRATE = 5
SCALE = 50.0
SEED = 11

_MARK = np.uint32(1)
_LOWER: np.ndarray | None = None


def _lower() -> np.ndarray:
    """Character classes of the first 65,536 code points: the lower-case letter or digit, or the mark."""
    global _LOWER
    if _LOWER is None:
        table = np.full(1 << 16, _MARK, np.uint32)
        for c in range(1 << 16):
            x = chr(c)
            if x.isalnum():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LOWER = table
    return _LOWER


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of UTF-8 texts, and the text that each belongs to."""
    raw = data[offsets[0] : offsets[-1]]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    ends = lead[offsets - offsets[0]]
    # every text is padded with a mark at both ends
    n = len(ends) - 1
    chars = np.full(len(points) + 2 * n, _MARK, np.uint32)
    own = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    low = _lower()
    folded = np.where(points < len(low), low[np.minimum(points, len(low) - 1)], points)
    chars[np.arange(len(points)) + 2 * own + 1] = folded
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends) + 2)
    gap = chars == _MARK
    gaps = np.concatenate(([0], np.cumsum(gap, dtype=np.int64)))
    hashes, owners = [], []
    rolling = chars * np.uint32(0x9E3779B1)
    for k in range(2, max(GRAMS) + 1):
        rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + chars[k - 1 :] * np.uint32(0xC2B2AE35)
        if k not in GRAMS:
            continue
        m = len(rolling)
        if m <= 0:
            break
        whole = gaps[k - 1 : m + k - 1] == gaps[1 : m + 1]  # no mark inside; marks may stand at either end
        at = np.flatnonzero(whole)
        h = rolling[at]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        hashes.append(h >> np.uint32(32 - TABLE_BITS))
        owners.append(owner[at])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint32), np.concatenate(owners) if owners else np.zeros(0, np.int32)


def bag(text: str, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (those marked in ``known``) and their share of all its n-grams."""
    raw = np.frombuffer(text.encode(), np.uint8)
    grams, counts = np.unique(subwords(raw, np.array([0, len(raw)]))[0], return_counts=True)
    share = (counts / (counts.sum() + BLANKS)).astype(np.float32)
    return (grams, share) if known is None else (grams[known[grams]], share[known[grams]])


def train(rows: list[tuple[str, int]], prior: float | None = None, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Fit vectors and softmax; returns what scoring needs: one number per n-gram, and the bias.

    Every ``CALIBRATE``-th row is kept from the fit. These rows choose which small
    weights are noise and become 0, and set scale and bias of the log-odds, weighted
    so that label 1 has the share ``prior``. With rows
    of one class only, or none, every number is 0 and the bias says the class seen.
    """
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << TABLE_BITS, np.float32), (4.0 if len(labels) and labels[0] else -4.0)
    kept = [r for k, r in enumerate(rows) if k % CALIBRATE]
    weights, bias = _fit_vectors(kept if len({y for _, y in kept}) > 1 else rows, epochs, seed)
    aside = rows[::CALIBRATE]
    y = np.array([b for _, b in aside], np.float64)
    if len(set(y.tolist())) < 2:
        return weights, bias
    raw = [t.encode() for t, _ in aside]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    share = y.mean() if prior is None else prior
    spread = np.sqrt(np.mean(weights[weights != 0].astype(np.float64) ** 2)) if weights.any() else 0.0
    best = None
    for floor in FLOORS:
        kept_weights = np.where(np.abs(weights) >= floor * spread, weights, 0).astype(np.float32)
        p = np.clip(score_texts(data, offsets, kept_weights, bias), 1e-9, 1 - 1e-9)
        x = np.log(p / (1 - p))
        scale, shift = _platt(x, y, share)
        q = np.clip(1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y == 1, share / y.mean() * np.log(q), (1 - share) / (1 - y.mean()) * np.log(1 - q)))
        if best is None or loss < best[0]:
            best = loss, kept_weights * np.float32(scale), float(bias * scale + shift)
    return best[1], best[2]


def _platt(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale (kept positive) and shift of log-odds ``x`` by weighted logistic regression, Newton's method."""
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (share * (p - goal)) + 1e-3 * (w - [1, 0])
        hess = (a * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w = w - move / max(1.0, np.abs(move).max())
    return max(float(w[0]), 0.1), float(w[1])


def _fit_vectors(rows: list[tuple[str, int]], epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Vectors and softmax by Adagrad over shuffled batches."""
    labels = np.array([y for _, y in rows], np.int64)
    rng = np.random.default_rng(seed)
    spread = np.zeros(1 << TABLE_BITS, np.int32)
    for text, _ in rows:
        spread[bag(text)[0]] += 1
    known = spread >= MIN_TEXTS  # n-grams of fewer texts would learn these texts by heart
    own = [bag(t, known) for t, _ in rows]
    vectors = rng.normal(0, 1e-4, (1 << TABLE_BITS, DIM)).astype(np.float32)  # near 0: an n-gram that training never moved says nothing
    head = np.zeros((DIM, 2), np.float32)
    head[:, 1] = rng.uniform(0.5, 1.5, DIM) * np.where(np.arange(DIM) % 2, 1, -1)
    head[:, 0] = -head[:, 1]
    bias = np.zeros(2, np.float32)
    seen_v = np.full(1 << TABLE_BITS, 1e-8, np.float32)
    seen_h, seen_b = np.full_like(head, 1e-8), np.full_like(bias, 1e-8)
    steps_ = max(MIN_STEPS, epochs * len(rows) // BATCH)
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps_ * BATCH // len(rows)))])
    scale = np.float32(SCALE)  # means of many n-grams are small; the scale brings them to the size of a word's share
    for s in range(steps_):
        batch = order[s * BATCH : (s + 1) * BATCH]
        grams = np.concatenate([own[i][0] for i in batch])
        share = np.concatenate([own[i][1] for i in batch]) * scale
        sizes = np.array([len(own[i][0]) for i in batch])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        totals = np.concatenate((np.zeros((1, DIM), np.float64), np.cumsum(vectors[grams] * share[:, None], axis=0, dtype=np.float64)))
        mean = (totals[starts[1:]] - totals[starts[:-1]]).astype(np.float32)
        logit = mean @ head + bias
        logit -= logit.max(axis=1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(batch)), labels[batch]] -= 1
        p /= len(batch)
        gh, gb, gm = mean.T @ p, p.sum(axis=0), p @ head.T
        uniq, where = np.unique(grams, return_inverse=True)
        weighted = gm[np.repeat(np.arange(len(batch)), sizes)] * share[:, None]
        gv = SHRINK * vectors[uniq] + np.stack([np.bincount(where, weighted[:, d], len(uniq)) for d in range(DIM)], axis=1).astype(np.float32)
        seen_v[uniq] += (gv**2).mean(axis=1)
        rate = RATE * (1 - 0.9 * s / steps_)
        vectors[uniq] -= VECTOR_RATE * rate * gv / np.sqrt(seen_v[uniq])[:, None]
        seen_h += gh**2
        head -= rate * gh / np.sqrt(seen_h)
        seen_b += gb**2
        bias -= rate * gb / np.sqrt(seen_b)
    return (vectors @ (head[:, 1] - head[:, 0])) * scale, float(bias[1] - bias[0])


def score_texts(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of the toxic class for each UTF-8 text; a text without n-grams has the bias only."""
    out = np.empty(len(offsets) - 1)
    for lo, hi in steps(offsets):
        grams, owner = subwords(data, offsets[lo : hi + 1])
        total = np.bincount(owner, weights[grams], hi - lo)
        count = np.bincount(owner, minlength=hi - lo)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(total / (count + BLANKS) + bias, -30, 30)))
    return out


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """A column function that scores a text column; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def toxic(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(*buffers(texts), *shared.value))

    return toxic


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled rows outside the held-out third (see :mod:`labelled`)."""
    rows, prior = training_rows(docs, labels, "toxic", **bounds)
    return train(rows, prior)


def with_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``toxicity``, a double from 0 to 1, for every row's whole text.

    The score sees the text only. Null and empty texts get the score of no
    evidence; equal texts get equal scores; repeated rows are scored each;
    without labels of both classes all rows get the same score. Other columns
    pass; one named ``toxicity`` is replaced.
    """
    score: Column = scorer(docs, fit(docs, labels))("text")
    return docs.withColumn("toxicity", score)
