"""Benchmark decontamination with an Aho-Corasick automaton over the words of the test items.

Normalisation lower-cases A-Z and takes as words the runs of ASCII letters and
digits and of non-ASCII characters. An item of at least ``WINDOW`` words is cut into
pieces of half a window, of which every window holds a whole one; an item of fewer
words is one piece. The pieces are the patterns, as sequences of word numbers, so a
text is scanned once, word by word, whatever the number of items, and the automaton
has about one node per item word. Around a piece that is met, the text's windows are
looked up among those of the items and compared word by word. Word positions map
back to character offsets of the text as it was.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import buffers, powers

WINDOW = 10
#: Item bytes in one automaton, of which a process holds one at a time; further items make further automata.
BLOCK_BYTES = 8_000_000
#: Bytes of texts that are scanned for one block before the next is built.
CHUNK_BYTES = 64_000_000

_FOLD = bytes(ord(" ") if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
_ARROW_HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
#: The automaton in use in this process, by the token of its items.
_BUILT: dict[str, Items] = {}


def words(text: bytes) -> list[bytes]:
    """The normalised words of UTF-8 text."""
    return text.translate(_FOLD).split()


@dataclass
class Items:
    """Test items ready for scanning."""

    window: int
    #: Word numbers from 1; 0 is any other word.
    numbers: dict[bytes, int]
    machine: ahocorasick.Automaton | None
    names: list[str]
    #: All items' word numbers, one item after another.
    words: np.ndarray
    #: Distinct windows by hash: hash, a place in ``words``, and the range of their items in ``owners``.
    hashes: np.ndarray
    places: np.ndarray
    ranges: np.ndarray
    owners: np.ndarray
    #: Multiplier of the hashes.
    base: int


def _window_hashes(numbers: np.ndarray, starts: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomial hashes of the windows that begin at ``starts``, from running sums."""
    up, down = powers(base, len(numbers) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers.astype(np.uint64) * up[: len(numbers)])))
    return (sums[starts + window] - sums[starts]) * down[starts]


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at ``at`` of ``a`` and at ``bt`` of ``b`` are equal word by word."""
    ok = np.ones(len(at), bool)
    for k in range(window):
        ok &= a[at + k] == b[bt + k]
    return ok


def build(items: list[tuple[str, str | None]], window: int) -> Items:
    """Number the words and set up patterns and windows; items of one name count as one."""
    numbers: dict[bytes, int] = {}
    names: dict[str, int] = {}
    piece = (window + 1) // 2
    patterns: dict[tuple[int, ...], set[int]] = {}
    every, starts, owners, at = [], [], [], 0
    for name, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words((text or "").encode())]
        if not ids:
            continue
        own = names.setdefault(name, len(names))
        if len(ids) < window:
            patterns.setdefault(tuple(ids), set()).add(own)
            continue
        for i in range(0, len(ids) - piece + 1, piece):
            patterns.setdefault(tuple(ids[i : i + piece]), set())
        every += ids
        starts.append(np.arange(at, at + len(ids) - window + 1))
        owners.append(np.full(len(starts[-1]), own))
        at += len(ids)
    machine = None
    if patterns:
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, short in patterns.items():
            machine.add_word(key, (len(key), sorted(short)))
        machine.make_automaton()
    flat = np.array(every, np.int64)
    if not len(flat):
        none = np.zeros(0, np.int64)
        return Items(window, numbers, machine, list(names), flat, none.astype(np.uint64), none, np.zeros(1, np.int64), none, 1)
    start, owner = np.concatenate(starts), np.concatenate(owners)
    base = 0x9E3779B97F4A7C15
    while True:
        h = _window_hashes(flat, start, window, base)
        order = np.lexsort((start, owner, h))
        h, start, owner = h[order], start[order], owner[order]
        again = np.flatnonzero(h[1:] == h[:-1])
        if _same(flat, start[again], flat, start[again + 1], window).all():
            break
        base += 2  # different windows share a hash: take another multiplier
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
    h, start, owner = h[fresh], start[fresh], owner[fresh]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return Items(window, numbers, machine, list(names), flat, h[first], start[first], np.append(first, len(h)), owner, base)


def hits(found: list[bytes], items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a text lie in an occurrence of a window, and the numbers of the items met."""
    n, window = len(found), items.window
    edge = np.zeros(n + 1, np.int64)
    if items.machine is None or not n:
        return edge[:-1] > 0, np.zeros(0, np.int64)
    get = items.numbers.get
    ids = tuple([get(w, 0) for w in found])
    piece = (window + 1) // 2
    near = np.zeros(n + 1, np.int64)
    met: list[np.ndarray] = []
    some = False
    for last, (length, short) in items.machine.iter(ids):
        if short:
            edge[last - length + 1] += 1
            edge[last + 1] -= 1
            met.append(np.array(short))
        if length == piece:
            near[max(0, last - window + 1)] += 1
            near[last - piece + 2] -= 1
            some = True
    if some and n >= window:
        start = np.flatnonzero(np.cumsum(near[: n - window + 1]) > 0)
        own = np.array(ids, np.int64)
        lo, hi = (start[0], start[-1] + window) if len(start) else (0, 0)
        own, start = own[lo:hi], start - lo
        h = _window_hashes(own, start, window, items.base)
        at = np.minimum(np.searchsorted(items.hashes, h), len(items.hashes) - 1) if len(items.hashes) else np.zeros(0, np.int64)
        like = np.flatnonzero(items.hashes[at] == h) if len(items.hashes) else at
        like = like[_same(own, start[like], items.words, items.places[at[like]], window)]
        np.add.at(edge, start[like] + lo, 1)
        np.add.at(edge, start[like] + lo + window, -1)
        met += [items.owners[items.ranges[k] : items.ranges[k + 1]] for k in np.unique(at[like])]
    return np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of hit words as character offsets (end exclusive)."""
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    places = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return list(zip(chars[places[turn[::2], 0]].tolist(), chars[places[turn[1::2] - 1, 1]].tolist(), strict=True))


def _chunks(batches: Iterator[pa.Array], most: int) -> Iterator[list[pa.Array]]:
    """Batches in runs of about ``most`` bytes, each of one batch at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanner(shared: list[tuple[str, Broadcast]], window: int, chunk_bytes: int, builds: Accumulator):
    """Arrow function over texts that scans a run of batches for one block of items after another, the one at hand first."""

    def block(token: str, items: Broadcast) -> Items:
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = build(pickle.loads(zlib.decompress(items.value)), window)
            builds.add(1)
        return _BUILT[token]

    def scan(batches: list[pa.Array], order: list[tuple[str, Broadcast]]) -> Iterator[pa.Array]:
        texts = []  # (text bytes, ranges of its rows) of each batch
        for batch in batches:
            data, offsets = buffers(batch)
            texts.append((memoryview(data), list(zip(offsets[:-1], offsets[1:], strict=True))))
        sizes = [[0] * len(ranges) for _, ranges in texts]
        marks: dict[tuple[int, int], np.ndarray] = {}
        names: dict[tuple[int, int], set[str]] = {}
        for token, items in order:
            own = block(token, items)
            for at, (raw, ranges) in enumerate(texts):
                for k, (a, b) in enumerate(ranges):
                    found = words(bytes(raw[a:b]))
                    sizes[at][k] = len(found)
                    hit, met = hits(found, own)
                    if len(met):
                        marks[at, k] = marks[at, k] | hit if (at, k) in marks else hit
                        names.setdefault((at, k), set()).update(own.names[i] for i in met)
        for at, (raw, ranges) in enumerate(texts):
            rows = [{"n_words": n, "n_hit": 0, "items": [], "spans": []} for n in sizes[at]]
            for k, (a, b) in enumerate(ranges):
                if (at, k) in marks:
                    hit = marks.pop((at, k))
                    rows[k].update(n_hit=int(hit.sum()), items=sorted(names[at, k]), spans=[{"start": x, "end": y} for x, y in spans(bytes(raw[a:b]), hit)])
            yield pa.array(rows, _ARROW_HIT)

    @F.arrow_udf(_HIT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in _chunks(batches, chunk_bytes):
            at_hand = [pair for pair in shared if pair[0] in _BUILT]
            yield from scan(held, at_hand + [pair for pair in shared if pair not in at_hand])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "hits", chunk_bytes: int = CHUNK_BYTES, builds: Accumulator | None = None) -> DataFrame:
    """Add ``hits`` (or the column named by ``into``) to ``docs``: struct(n_words, n_hit, items, spans) of every whole text.

    Items are shared with the executors in blocks of about ``block_bytes``. A task
    takes its texts in runs of about ``chunk_bytes`` and scans a run for one block
    after another; of b blocks it builds b - 1 automata for each run after the first,
    where b is 1 none. A worker holds one automaton, one run of texts and the items in
    compressed form; texts stay where they are. ``builds`` counts the automata. A null text has no words; a null item text
    has no window; a null item id is named ``null``; items with equal ids count
    once; repeated rows are answered one by one; an empty benchmark hits nothing.
    Columns other than ``text`` pass unchanged; a column of the result's name is
    replaced.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    shared, held, size = [], [], 0
    share = lambda rows: shared.append((uuid.uuid4().hex, spark.sparkContext.broadcast(zlib.compress(pickle.dumps(rows)))))
    for r in named.toLocalIterator():
        held.append((r.item, r.text))
        size += len((r.text or "").encode()) + 16
        if size >= block_bytes:
            share(held)
            held, size = [], 0
    if held or not shared:
        share(held)
    return docs.withColumn(into, _scanner(shared, window, chunk_bytes, spark.sparkContext.accumulator(0) if builds is None else builds)("text"))
