"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its two
neighbours, with weights between the labels of successive lines. Training takes
all lines of a labelled document to bear its label. The quality of a document is
the mean of its lines' marginal probabilities of good, by forward-backward,
weighted by line length. Chains of many documents advance together in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import buffers, free_name, powers, steps
from tidewheel.llm.labelled import training_rows

ACCEPT = 0.5
ROUNDS = 120
RATE = 0.1
SHRINK = 1e-4
#: Shares of a line above which a feature counts as present.
LEVELS = (0.02, 0.15, 0.5)
#: Multiplier of the hash by which words are compared.
WORD_BASE = 0x9E3779B97F4A7C15
#: Lines from which a chain is cut into blocks that advance together.
LONG_CHAIN = 4096

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "bar": b"|", "bang": b"!", "symbol": b"#$%&*@^~=<>{}[]\\_+/", "point": b".,;:?-'\"()", "wide": bytes(range(128, 256))}
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length plus 1, and the number of lines of each text (1 at least)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    raw = np.full(int(sizes.sum()) + n, 10, np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    raw[np.arange(len(owner)) + owner] = data[offsets[0] : offsets[-1]]
    text_ends = np.cumsum(sizes + 1) - 1
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lines = np.diff(np.concatenate(([0], np.searchsorted(ends, text_ends, "right"))))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[ends] - total[starts]).astype(np.float32)

    got = {k: count(t[raw]) for k, t in _TABLES.items()}
    space = _SPACE[raw]
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stop = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    length = stop - begin
    up, down = powers(WORD_BASE, len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)])))
    code = (sums[stop] - sums[begin]) * down[begin]  # of all bytes of a word
    again = np.zeros(len(raw), bool)
    if len(code) > 1:
        again[begin[1:]] = (code[1:] == code[:-1]) & (length[1:] == length[:-1])
    first = np.zeros(len(raw), bool)
    first[begin] = True
    words = count(first)
    size = (ends - starts).astype(np.float32)
    each = np.maximum(words, 1)
    shares = [got["upper"] / np.maximum(got["upper"] + got["lower"], 1), got["bar"] / each, got["bang"] / each, got["symbol"] / each, got["digit"] / np.maximum(size, 1), count(again) / each]
    shares = [np.minimum(s, 1) for s in shares]
    tail = raw[np.maximum(ends - 1, 0)]
    plain = [np.log1p(size) / 10, np.minimum(size / each / 10, 2), got["wide"] / np.maximum(size, 1), got["point"] / each, ((tail == 46) & (size > 0)).astype(np.float32), (size == 0).astype(np.float32)]
    own = np.stack([np.ones_like(size), *plain, *shares, *[s > v for s in shares for v in LEVELS]], 1).astype(np.float32)
    # neighbours: zero beyond the ends of a text
    cuts = np.concatenate(([0], np.cumsum(lines)))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[cuts[:-1]] = 0
    after[cuts[1:] - 1] = 0
    return np.concatenate([own, before[:, 1:], after[:, 1:]], 1), size + 1, lines


def _short_chains(local: np.ndarray, at: np.ndarray, lines: np.ndarray, link: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> None:
    """Fill in forward and backward messages of chains that start at ``at``, all of them a line at a step."""
    order = np.argsort(-lines, kind="stable")
    at, lines = at[order], lines[order]
    active = np.searchsorted(-lines, -np.arange(1, (lines[0] if len(lines) else 0) + 1), "right")
    for t, k in enumerate(active):
        rows = at[:k] + t
        a = local[rows] if t == 0 else (alpha[rows - 1] @ link) * local[rows]
        alpha[rows] = a / a.sum(1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        rows = at[: active[t]] + t
        b = (local[rows] * beta[rows]) @ link.T
        beta[rows - 1] = b / b.sum(1, keepdims=True)


def _long_chain(local: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of one chain in about 4 * sqrt(lines) steps.

    The chain is cut into blocks; products of the lines' 2 x 2 matrices are run up
    and down inside all blocks at once, then messages pass from block to block.
    """
    n = len(local)
    size = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // size)
    step = np.tile(np.eye(2), (blocks * size, 1, 1))  # the last block is filled up with steps that change nothing
    step[:n] = link[None] * local[:, None, :]
    step[0] = local[0][None, :]  # any message that enters the chain becomes that of its first line
    step = step.reshape(blocks, size, 2, 2)
    scaled = lambda m: m / m.sum((-2, -1), keepdims=True)
    ahead, behind = np.empty_like(step), np.empty_like(step)
    ahead[:, 0] = scaled(step[:, 0])
    behind[:, -1] = np.eye(2) / 2
    for t in range(1, size):
        ahead[:, t] = scaled(ahead[:, t - 1] @ step[:, t])
        behind[:, -1 - t] = scaled(step[:, -t] @ behind[:, -t])
    enter, leave = np.full((blocks, 2), 0.5), np.full((blocks, 2), 0.5)
    for k in range(1, blocks):
        a = enter[k - 1] @ ahead[k - 1, -1]
        enter[k] = a / a.sum()
        b = ahead[-k, -1] @ leave[-k]
        leave[-1 - k] = b / b.sum()
    alpha = np.einsum("bi,btij->btj", enter, ahead).reshape(-1, 2)[:n]
    beta = np.einsum("btij,bj->bti", behind, leave).reshape(-1, 2)[:n]
    return alpha / alpha.sum(1, keepdims=True), beta / beta.sum(1, keepdims=True)


def marginals(unary: np.ndarray, lines: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward of all chains at once; chains of many lines run in blocks.

    ``unary`` is the log-odds of good per line, ``links`` the 2 x 2 label weights.
    Returns the marginals of good per line and the expected label pairs in total.
    """
    at = np.cumsum(lines) - lines
    half = np.clip(unary, -40, 40) / 2
    local = np.exp(np.stack([-half, half], 1))
    link = np.exp(links)
    alpha, beta = np.empty_like(local), np.ones_like(local)
    short = lines < LONG_CHAIN
    _short_chains(local, at[short], lines[short], link, alpha, beta)
    for a, n in zip(at[~short], lines[~short], strict=True):
        alpha[a : a + n], beta[a : a + n] = _long_chain(local[a : a + n], link)
    later = np.ones(len(local), bool)
    later[at[lines > 0]] = False
    later = np.flatnonzero(later)
    joint = alpha[later - 1][:, :, None] * link[None] * (local[later] * beta[later])[:, None, :]
    pairs = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    post = alpha * beta
    return post[:, 1] / post.sum(1), pairs


def train(rows: list[tuple[str, int]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Fit feature and link weights by gradient ascent (Adam) on the conditional likelihood.

    With labels of one class only, or none, the weights are 0 but for a bias that says the class seen.
    """
    raw = [t.encode() for t, _ in rows] or [b""]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    made = [line_features(data, offsets[lo : hi + 1]) for lo, hi in steps(offsets)]
    x, lines = np.concatenate([m[0] for m in made]), np.concatenate([m[2] for m in made])
    weights, links = np.zeros(x.shape[1]), np.zeros((2, 2))
    label = np.array([y for _, y in rows], np.float64)
    if len(set(label.tolist())) < 2:
        weights[0] = 4.0 if len(label) and label[0] else -4.0
        return weights, links
    gold = np.repeat(label, lines)
    within = (lines - 1).astype(np.float64)
    gold_pairs = np.array([[within[label == 0].sum(), 0], [0, within[label == 1].sum()]])
    params = np.concatenate([weights, links.ravel()])
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    for r in range(1, rounds + 1):
        w, links = params[:-4], params[-4:].reshape(2, 2)
        good, pairs = marginals(x @ w.astype(np.float32), lines, links)
        grad = np.concatenate([x.T @ (gold - good).astype(np.float32), (gold_pairs - pairs).ravel()]) / len(gold) - SHRINK * params
        mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        params = params + RATE * (mean / (1 - 0.9**r)) / (np.sqrt(spread / (1 - 0.99**r)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def line_scores(data: np.ndarray, offsets: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good per line, line weights, and lines per text."""
    x, size, lines = line_features(data, offsets)
    good, _ = marginals(x @ model[0].astype(np.float32), lines, model[1])
    return good, size, lines


def score_texts(data: np.ndarray, offsets: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Length-weighted mean of the marginals of good for each UTF-8 text."""
    out = np.empty(len(offsets) - 1)
    for lo, hi in steps(offsets):
        good, size, lines = line_scores(data, offsets[lo : hi + 1], model)
        first = np.cumsum(lines) - lines
        out[lo:hi] = np.add.reduceat(good * size, first) / np.add.reduceat(size.astype(np.float64), first)
    return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Train on a bounded sample of labelled rows outside the held-out third (see :mod:`labelled`)."""
    return train(training_rows(docs, labels, "quality", **bounds)[0])


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``quality``, a double from 0 to 1, for every row's whole text, and ``line_quality``, one value per line.

    The scores see the text only. Null and empty texts are one empty line; equal
    texts get equal scores; repeated rows are scored each; without labels of both
    classes all texts get scores of that class. Other columns pass; columns named
    like the two results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf(T.StructType([T.StructField("quality", T.DoubleType()), T.StructField("lines", T.ArrayType(T.DoubleType()))]))
    def judge(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        score, marks, counts = np.zeros(len(texts)), [], []
        for lo, hi in steps(offsets):
            good, size, lines = line_scores(data, offsets[lo : hi + 1], shared.value)
            first = np.cumsum(lines) - lines
            score[lo:hi] = np.add.reduceat(good * size, first) / np.add.reduceat(size.astype(np.float64), first)
            marks.append(good)
            counts.append(lines)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1)
        per_line = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(marks).astype(np.float64) if marks else np.zeros(0)))
        return pa.StructArray.from_arrays([pa.array(np.clip(score, 0.0, 1.0)), per_line], ["quality", "lines"])

    both = free_name(docs, "judged")
    return docs.withColumn(both, judge("text")).withColumns({"quality": F.col(both)["quality"], "line_quality": F.col(both)["lines"]}).drop(both)
