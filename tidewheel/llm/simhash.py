"""SimHash near-duplicates: fingerprints, and a binary-trie self-join within a Hamming budget.

A fingerprint is one or more words of 64 bits over the shingles of a text. Cut
into BUDGET + 2 blocks, two words that differ in at most ``BUDGET`` bits agree in
two blocks at least, so each distinct fingerprint goes once to each choice of two
blocks, with these blocks' bits in front: rows of one value of them are one subtrie
whose root the pair traversal starts from. The traversal walks pairs of trie nodes
downwards, adds up differing bits, and drops a pair once the sum is over the
budget. A subtrie of many rows is cut at deeper nodes and these are paired the same
way before rows are dealt. From every subtrie only a spanning forest of its links
leaves.

The corpus pipeline's stage follows an exact rule instead, five-word shingle sets that
overlap by ``SIMILAR`` or more: sets that do share a key, all that a set has in one
class of shingles, so the lists of the keys meet every such pair (``overlap_links``).
Links to the lists' first sets make most groups; then all pairs between groups are
compared, those of long lists inside tasks.

``wide_links`` is a net for such pairs that needs no sets: ten words of 64 bits a text,
each cut into four blocks, one of which must agree. A subtrie hands on two links of
each row, to the nearest text and to one within the estimate. It may miss pairs, so
the stage does not use it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import buffers, free_name, powers, steps
from tidewheel.operators.components import connected_components
from tidewheel.scratch import cut, discard, scope

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Rows of one subtrie that one task takes. A larger one is cut at deeper nodes, paired within the budget.
SUBTRIE_ROWS = 8192
#: Bits at most by which a large subtrie is cut; nodes that are still large are dealt by hash.
CUT_BITS = 12
#: Node pairs held at once while a subtrie is walked.
FRONTIER = 1 << 17
#: A fingerprint that this share of all rows has is hot: at most its inverse are, so they are shared.
HOT_SHARE = 1e-3
#: What five-word shingle sets of near-duplicates share, intersection over union.
SIMILAR, WIDE_SHINGLE = 0.8, 5
#: Bytes of a word from which on a set's shingles hold its hash in place of it.
LONG_WORD = 16
#: The wide net: words of a fingerprint, blocks of a word, bits of one word and of all that may differ. Texts at
#: ``SIMILAR`` differ in 97 of 640 bits, give or take 9; 122 lets 99.6 % of them through.
WIDE_WORDS, WIDE_BLOCKS, WIDE_REACH, WIDE_BITS = 10, 4, 14, 122
#: Bits up to which the estimate is 0.8 or more.
WIDE_LIKELY = 100
#: Shingles are counted in one of this many rows, to put common ones last in the sets' order, and from this count on
#: they are common; so many of the most common ones are told apart. Any order gives the same links.
COUNTED_ROWS, COMMON_COUNT, COMMON_SHINGLES = 16, 4, 500_000
#: Shingles of one class in the smallest sets of an octave, and classes at least: few classes are empty or hold one.
CLASS_SHINGLES, LEAST_CLASSES = 1.2, 16
#: Names of a list up to which its pairs become rows; those of a longer one are compared inside tasks, in parts of so
#: many names and shingles at most or so, by matrices of so many rows and columns.
PAIRED_ROWS, LIST_ROWS, LIST_SHINGLES, COUNT_ROWS, COUNT_COLUMNS = 32, 1024, 4_000_000, 512, 2048
#: The share of its front that a set has in lists of one first set, to be compared with that one before all other pairs.
STAR_SHARE = 0.25

_STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of UTF-8 text: a bit is 1 if set in over half of the shingles' H64; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - size + 1)
    stops = ends[size - 1 :].tolist() if len(words) >= size else [len(line)]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=False)], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


@F.arrow_udf(T.ArrayType(T.LongType()))
def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text, one signed long in a list; null counts as empty."""
    data, offsets = buffers(texts)
    raw = memoryview(data)
    found = np.array([fingerprint(bytes(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32)), pa.array(found))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[bytes], size: int = WIDE_SHINGLE, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of all texts, end to end, and how many each text has; no words: none.

    A shingle's hash is a polynomial of its bytes, read off running sums, so the
    shingles of many texts are hashed by a few array operations. A text of fewer
    words is one shingle. Words of over ``longest`` bytes are read as a hash of theirs.
    """
    parts = [t.lower().split() for t in texts]
    if longest is not None:
        name = lambda w: b"\n" + xxhash.xxh64_digest(w, SEED)  # noqa: E731  # no word has a line's end
        parts = [[w if len(w) <= longest else name(w) for w in p] if max(map(len, p), default=0) > longest else p for p in parts]
    counts = np.array([len(p) for p in parts], np.int64)
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    line = b" ".join(w for p in parts for w in p)
    if not line:
        return np.zeros(0, np.uint64), shingles
    lengths = np.fromiter((len(w) for p in parts for w in p), np.int64, int(counts.sum()))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    up, down = powers(int(_STEP), len(line) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(line, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(line)])))
    own = np.repeat(np.arange(len(texts)), shingles)
    lo = (np.cumsum(counts) - counts)[own] + np.arange(len(own)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    hi = np.minimum(lo + size, np.cumsum(counts)[own]) - 1
    return (sums[ends[hi]] - sums[starts[lo]]) * down[starts[lo]] ^ (ends[hi] - starts[lo]).astype(np.uint64) * _STEP, shingles


def set_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` for sets that stand for their texts: words of over ``LONG_WORD`` bytes go by their XXH64.

    Sums of multiples of bytes modulo 2**64 are equal for some unlike words of
    regular bytes, whatever the multiplier (2,048 letters of the Thue-Morse sequence
    and their exchange); they need more bytes than five short words have.
    """
    return shingle_hashes(texts, longest=LONG_WORD)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """A text's shingle hashes once each, ascending."""
    return np.unique(h)


def wide_fingerprints(texts: list[bytes], words: int = WIDE_WORDS, size: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of ``words`` x 64 bits over ``size``-word shingles, a row per text (no words: 0), and a hash of each text's shingle set."""
    h, shingles = shingle_hashes(texts, size)
    out, marks = np.zeros((len(texts), words), np.uint64), np.zeros(len(texts), np.uint64)
    ends = np.cumsum(shingles)
    for k in range(len(texts)):
        marks[k] = xxhash.xxh64_intdigest(shingle_set(h[ends[k] - shingles[k] : ends[k]]).tobytes())
    if not len(h):
        return out, marks
    some = np.flatnonzero(shingles)
    own = np.repeat(np.arange(len(some)), shingles[some])
    votes = np.zeros((len(some), words * 64), np.int64)
    salts = [np.uint64((k + 1) * int(_STEP) % (1 << 64)) for k in range(words)]
    place = np.arange(len(h)) - np.repeat(ends - shingles, shingles)
    for at in range(0, len(h), 1 << 16):
        part, who = h[at : at + (1 << 16)], own[at : at + (1 << 16)]
        mixed = np.stack([_mixed(part + s) for s in salts], 1).astype(">u8")
        bits = np.unpackbits(mixed.view(np.uint8), axis=1).view(np.uint64)
        # eight counts fit a 64-bit number while a run has at most 255 rows
        turn = place[at : at + (1 << 16)] % 255 == 0
        turn[0] = True
        begin = np.flatnonzero(turn)
        runs = np.add.reduceat(bits, begin, axis=0).view(np.uint8).astype(np.int64)
        np.add.at(votes, who[begin], runs)
    out[some] = np.packbits(votes * 2 > shingles[some][:, None], axis=1).view(">u8").reshape(len(some), words).astype(np.uint64)
    return out, marks


@F.arrow_udf(T.ArrayType(T.LongType()))
def wide_prints(texts: pa.Array) -> pa.Array:
    """The hash of each text's shingle set and its wide fingerprint, as signed longs; null counts as empty."""
    data, offsets = buffers(texts)
    raw = memoryview(data)
    rows = []
    for lo, hi in steps(offsets):
        found, marks = wide_fingerprints([bytes(raw[a:b]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)])
        rows.append(np.concatenate([marks[:, None], found], axis=1))
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (WIDE_WORDS + 1)), pa.array(flat.view(np.int64)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def set_names(texts: pa.Array) -> pa.Array:
    """The hash of each text's shingle set, one signed long in a list; null counts as empty."""
    names = np.array([xxhash.xxh64_intdigest(own.tobytes()) for own in _sets(texts)], np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32)), pa.array(names))


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: pa.Array) -> pa.Array:
    """Each text's shingle hashes once each; null counts as empty."""
    data, offsets = buffers(texts)
    raw = memoryview(data)
    rows = [shingle_set(set_hashes([bytes(raw[a:b])])[0]).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


Layouts = list[tuple[int, list[tuple[int, int, int]]]]


def layouts(blocks: int, front: int = 2) -> Layouts:
    """For each choice of ``front`` of a word's blocks: their bits, and (from, width, to) moves that bring them to the front."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    out = []
    for first in combinations(range(blocks), front):
        moves, at = [], 64
        for k in (*first, *[k for k in range(blocks) if k not in first]):
            width = edges[k + 1] - edges[k]
            at -= width
            moves.append((64 - edges[k + 1], width, at))
        out.append((sum(m[1] for m in moves[:front]), moves))
    return out


def arrange(word: np.ndarray, moves: list[tuple[int, int, int]]) -> np.ndarray:
    """64-bit words with their blocks in the order of ``moves``."""
    out = np.zeros_like(word)
    for a, width, b in moves:
        out |= ((word >> np.uint64(a)) & np.uint64((1 << width) - 1)) << np.uint64(b)
    return out


def _arranged(word: Column, choice: Column, forms: Layouts) -> Column:
    """``arrange`` for the choice of blocks in a column; shifts are looked up, so the expression stays small."""
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), choice + 1)
    out = None
    for moves in zip(*[m for _, m in forms], strict=True):
        away, width, to = (of(v) for v in zip(*moves, strict=True))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
        part = F.call_function("shiftleft", F.call_function("shiftrightunsigned", word, away).bitwiseAND(mask), to)
        out = part if out is None else out.bitwiseOR(part)
    return out


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def close_pairs(keys: np.ndarray, start: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of ``keys`` within ``budget`` bits, by the pairwise walk down from ``start``.

    A row of ``start`` is a node pair: two ranges of sorted keys (equal, or one
    behind the other), the bits that each range shares, and how many of these differ.
    The walk keeps arrays of such rows; small pairs are compared row by row, larger
    ones are split at their next bit.
    """
    stack = [start[k : k + FRONTIER // 8] for k in range(0, len(start), FRONTIER // 8)]
    while stack:
        f = stack.pop()
        a0, a1, b0, b1, d, e = f.T
        small = ((a1 - a0) * (b1 - b0) <= 64) | (d >= 64)
        if small.any():
            s = f[small]
            na, nb = s[:, 1] - s[:, 0], s[:, 3] - s[:, 2]
            cells = na * nb
            cuts = np.searchsorted(np.cumsum(cells), np.arange(FRONTIER * 8, cells.sum() + 1, FRONTIER * 8))
            for rows in np.split(np.arange(len(s)), np.unique(cuts)):
                if not len(rows):
                    continue
                c = cells[rows]
                own = np.repeat(np.arange(len(rows)), c)
                cell = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                i = s[rows, 0][own] + cell // nb[rows][own]
                j = s[rows, 2][own] + cell % nb[rows][own]
                ok = (i < j) & (_ones(keys[i] ^ keys[j]) <= budget)
                if ok.any():
                    yield i[ok], j[ok]
        f = f[~small]
        if not len(f):
            continue
        a0, a1, b0, b1, d, e = f.T
        bit = (63 - d).astype(np.uint64)
        am, bm = _split(keys, a0, a1, bit), _split(keys, b0, b1, bit)
        same = a0 == b0
        kids = [np.stack([a0, am, b0, bm, d + 1, e], 1), np.stack([am, a1, bm, b1, d + 1, e], 1), np.stack([a0, am, bm, b1, d + 1, e + 1], 1), np.stack([am, a1, b0, bm, d + 1, e + 1], 1)[~same]]
        kids = np.concatenate(kids)
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 5] <= budget)]
        stack += [kids[k : k + FRONTIER] for k in range(0, len(kids), FRONTIER)]


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First row of each range whose next bit is 1: a binary search in all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        up = open_ & (((keys[np.minimum(mid, len(keys) - 1)] >> bit) & one) == 0)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` rows is linked to, over all pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


class _Best:
    """For each of some rows, the neighbour with the least value seen so far, and its bits."""

    def __init__(self, n: int):
        self.value, self.mate, self.bits = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n, np.int64)

    def see(self, row: np.ndarray, mate: np.ndarray, value: np.ndarray, tie: np.ndarray, bits: np.ndarray) -> None:
        if not len(row):
            return
        order = np.lexsort((tie, value, row))
        row, mate, value, bits = row[order], mate[order], value[order], bits[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        row, mate, value, bits = row[first], mate[first], value[first], bits[first]
        less = value < self.value[row]
        row, mate, value, bits = row[less], mate[less], value[less], bits[less]
        self.value[row], self.mate[row], self.bits[row] = value, mate, bits


def _link(forms: Layouts, reach: int, bits: int | None):
    """Arrow function over partitions sorted by (own, pair, side, key): the links of every subtrie or pair of nodes.

    Without ``bits`` the rows' words are their names, and a spanning forest of the
    pairs within ``reach`` leaves. With it, names come before the words, and of each
    row two links leave with their bits: to the row that differs least, by ``bits``
    in all words at most, and to the one of smallest name within ``WIDE_LIKELY``.
    """

    def links(names: np.ndarray, all_words: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        near, low = _Best(len(names)), _Best(len(names))
        for i, j in pairs:
            differ = sum(_ones(w[i] ^ w[j]) for w in all_words)
            ok = differ <= bits
            i, j, differ = i[ok], j[ok], differ[ok]
            row, mate, differ = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((differ, differ))
            near.see(row, mate, differ, names[mate], differ)
            likely = differ <= WIDE_LIKELY
            low.see(row[likely], mate[likely], names[mate[likely]], names[mate[likely]], differ[likely])
        found = [(np.flatnonzero(b.mate >= 0), b) for b in (near, low)]
        return [(rows, b.mate[rows], b.bits[rows]) for rows, b in found]

    def flush(own: np.ndarray, pair: np.ndarray, side: np.ndarray, *signed: np.ndarray) -> pa.RecordBatch:
        n = len(own)
        names, all_words = signed[0], [w.view(np.uint64) for w in (signed if bits is None else signed[1:])]
        edges = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (pair[1:] != pair[:-1]), [True])))
        lo, hi = edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1]
        # of a pair of nodes, the rows of side 1 lie behind those of side 0
        second = np.concatenate(([0], np.cumsum(side)))
        mid = hi - (second[hi] - second[lo])
        mid = np.where(mid == lo, hi, mid)
        label, found = np.arange(n), []
        choice = own[lo] >> 32
        for c in np.unique(choice):
            width, moves = forms[c % len(forms)]
            mine = choice == c
            a, m, b = lo[mine], mid[mine], hi[mine]
            first, last = a[0], b[-1]
            key = arrange(all_words[c // len(forms)][first:last], moves)
            a, m, b = a - first, m - first, b - first
            cross = m < b
            start = np.stack([a, m, np.where(cross, m, a), b, np.full(len(a), width), np.zeros(len(a), np.int64)], 1)
            pairs = close_pairs(key, start, reach)
            if bits is None:
                label[first:last] = _forest(last - first, pairs) + first
            else:
                found += [(i + first, j + first, d) for i, j, d in links(names[first:last], [w[first:last] for w in all_words], pairs)]
        if bits is None:
            moved = np.flatnonzero(label != np.arange(n))
            found = [(moved, label[moved], np.zeros(len(moved), np.int64))]
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), pa.array(d)], ["src", "dst", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 16 * SUBTRIE_ROWS:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            stop = int(other[-1]) + 1 if len(other) else 0
            if stop:
                yield flush(*[c[:stop] for c in cols])
            held = [[c[stop:] for c in cols]]
            rows -= stop
        if rows:
            yield flush(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def node_pairs(rows: DataFrame, budget: int, subtrie_rows: int = SUBTRIE_ROWS) -> DataFrame:
    """Deal rows (own, width, key, ...) of large subtries to pairs of deeper nodes: adds pair and side.

    A subtrie is cut by as many further bits as bring nodes to about half of
    ``subtrie_rows``, ``CUT_BITS`` at most; a node with more rows is dealt by hash.
    Only pairs of nodes whose cut bits differ in at most ``budget`` places can hold
    a link, so a row is copied once per such pair of its node. A node is paired
    with itself too; in other pairs only rows of different sides are compared.
    """
    half = subtrie_rows / 2
    large = rows.groupBy("own").agg(F.least(F.ceil(F.log2(F.count("*") / half)), F.lit(CUT_BITS)).cast("int").alias("cut_bits"))
    cut_key = F.expr("shiftrightunsigned(shiftleft(key, width), 64 - cut_bits)")
    rows = rows.join(large, "own").withColumn("node", cut_key)
    nodes = rows.groupBy("own", "node").agg(F.ceil(F.count("*") / F.lit(half)).cast("int").alias("deals"))
    parts = nodes.select("own", "node", "deals", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    parts = cut(parts.withColumn("part", F.row_number().over(Window.partitionBy("own").orderBy("node", "deal"))), "nodes")
    a, b = parts.select("own", F.col("node").alias("a_node"), F.col("part").alias("a")), parts.select("own", F.col("node").alias("b_node"), F.col("part").alias("b"))
    met = a.join(b, "own").where("a <= b").where(F.bit_count(F.col("a_node").bitwiseXOR(F.col("b_node"))) <= budget)
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair")
    sides = met.select("own", F.col("a").alias("part"), pair, F.lit(0).alias("side")).unionByName(met.where("a < b").select("own", F.col("b").alias("part"), pair, F.lit(1).alias("side")))
    mine = rows.join(nodes, ["own", "node"]).withColumn("deal", F.pmod(F.xxhash64("key"), F.col("deals")).cast("int"))
    return mine.join(parts.drop("deals"), ["own", "node", "deal"]).join(sides, ["own", "part"]).drop("node", "deal", "deals", "part", "cut_bits")


def similar_links(prints: DataFrame, budget: int = BUDGET, subtrie_rows: int = SUBTRIE_ROWS) -> DataFrame:
    """(src, dst) links that connect all distinct fingerprints (``fp``, lists of one long) as all their pairs within ``budget`` bits would."""
    return _walk(prints, 1, layouts(budget + 2), budget, None, subtrie_rows).select("src", "dst")


def wide_links(prints: DataFrame, subtrie_rows: int = SUBTRIE_ROWS) -> DataFrame:
    """(src, dst, bits), src < dst, of texts that may be similar; ``fp`` lists a text's name and ``WIDE_WORDS`` words.

    Met are pairs that agree in a block of a word and differ in at most
    ``WIDE_REACH`` bits of it and ``WIDE_BITS`` of all. See ``_link`` for which of
    them leave; the same link of several subtries leaves once.
    """
    links = _walk(prints, WIDE_WORDS, layouts(WIDE_BLOCKS, 1), WIDE_REACH, WIDE_BITS, subtrie_rows)
    return links.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("bits").alias("bits"))


def _walk(prints: DataFrame, words: int, forms: Layouts, reach: int, bits: int | None, subtrie_rows: int) -> DataFrame:
    skip = 0 if bits is None else 1
    longs = [f"w{k}" for k in range(words + skip)]
    choice = (F.col("x") % len(forms)).cast("int")
    rows = prints.select(F.explode(F.sequence(F.lit(0), F.lit(words * len(forms) - 1))).alias("x"), "fp")
    rows = rows.withColumn("key", _arranged(F.element_at("fp", F.floor(F.col("x") / len(forms)).cast("int") + 1 + skip), choice, forms))
    rows = rows.withColumn("width", F.element_at(F.array(*[F.lit(w) for w, _ in forms]), choice + 1))
    own = F.shiftleft(F.col("x").cast("long"), 32).bitwiseOR(F.expr("shiftrightunsigned(key, 64 - width)"))
    rows = rows.select(own.alias("own"), "key", "width", *[F.col("fp")[k].alias(w) for k, w in enumerate(longs)])
    large = cut(rows.groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") > subtrie_rows).select("own"), "large")
    dealt = rows
    if not large.isEmpty():
        dealt = rows.join(large, "own", "left_anti")
    dealt = dealt.withColumns({"pair": F.lit(-1).cast("long"), "side": F.lit(0)})
    if not large.isEmpty():
        dealt = dealt.unionByName(node_pairs(rows.join(large, "own", "left_semi"), reach, subtrie_rows))
    # flipping the sign bit sorts the keys as unsigned, which is the order of the trie's leaves
    dealt = dealt.repartition("own", "pair").sortWithinPartitions("own", "pair", "side", F.col("key").bitwiseXOR(F.lit(-(2**63))))
    return dealt.select("own", "pair", "side", *longs).mapInArrow(_link(forms, reach, bits), "src long, dst long, bits long")


def _kinds(slim: DataFrame, links, *facts: Column) -> DataFrame:
    """One row per name (the first long of ``prints``) of ``slim``: fp, n, the ``facts`` aggregated, and root, the group's name."""
    kinds = cut(slim.groupBy(F.col("prints")[0].alias("fp")).agg(F.min("prints").alias("prints"), F.count("*").alias("n"), *facts), "kinds")
    roots = cut(connected_components(links(kinds.select(F.col("prints").alias("fp")))), "roots").withColumnRenamed("node", "fp")
    return kinds.drop("prints").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _by_print(slim: DataFrame, facts: DataFrame) -> DataFrame:
    """Join facts per fingerprint (fp, n, ...) to the rows of ``slim``; hot fingerprints don't move rows together.

    Fingerprints of more than ``HOT_SHARE`` of all rows number at most its
    inverse; they are shared, and their rows go by doc_id instead.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > HOT_SHARE * total
    columns = [c for c in facts.columns if c not in ("fp", "n")]
    shared = facts.where(hot).select(F.col("fp").alias("hot_fp"), F.struct(*columns).alias("hot_facts"))
    rows = slim.withColumn("fp", F.col("prints")[0]).drop("prints").join(F.broadcast(shared), F.col("fp") == F.col("hot_fp"), "left")
    # a hot row's place is a random one; it needs no partner there
    place = F.when(F.col("hot_fp").isNull(), F.col("fp")).otherwise(F.xxhash64("doc_id", "tag"))
    rest = facts.where(~hot).select(F.col("fp").alias("cold_fp"), F.struct(*columns).alias("cold_facts"))
    joined = rows.withColumn("place", place).join(rest, (F.col("place") == F.col("cold_fp")), "left")
    own = F.when(F.col("hot_fp").isNull(), F.col("cold_facts")).otherwise(F.col("hot_facts"))
    return joined.select(*[c for c in slim.columns if c != "prints"], "fp", *[own[c].alias(c) for c in columns])


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id.

    component_id is the smallest doc_id that links of at most ``budget`` differing
    bits reach, the row's own included. Null and empty texts have fingerprint 0 and
    link like any other; rows with a null doc_id take part and name no component
    unless alone, when it is null; repeated rows are kept. Only doc_id and text
    are read, so other columns may have any name.
    """
    slim = cut(docs.select("doc_id", F.lit(0).alias("tag"), fingerprints("text").alias("prints")), "prints")
    kinds = cut(_kinds(slim, lambda p: similar_links(p, budget), F.min("doc_id").alias("first")), "groups")
    linked = kinds.groupBy("root").agg(F.min("first").alias("component_id"))
    return _by_print(slim, kinds.join(linked, "root").select("fp", "n", "component_id")).select("doc_id", "fp", "component_id")


def _tag(docs: DataFrame) -> Column:
    """A hash of a row over all its columns; a null counts as a value of its own, a map as its sorted entries."""
    parts = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [c.isNull(), F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c]
    return F.xxhash64(*parts)


def held_sets(names: DataFrame, docs: DataFrame, slim: DataFrame, tag: Column) -> DataFrame:
    """(name, held): the shingle sets of distinct ``names``; of the texts of a name one is read again."""
    # the row whose text stands for a name: its smallest tag, which tells rows apart but for twins
    rows = cut(slim.select(F.col("prints")[0].alias("name"), "tag").join(names, "name").groupBy("name").agg(F.min("tag").alias("tag")), "rows")
    text, mark = free_name(docs, "own_text"), free_name(docs, "own_tag")
    texts = docs.select(F.col("text").alias(text), tag.alias(mark)).join(rows, F.col(mark) == F.col("tag")).select("name", F.col(text).alias("text"))
    return cut(texts.withColumn("held", shingle_sets("text")).groupBy("name").agg(F.first("held").alias("held")), "sets")


def checked_links(met: DataFrame, docs: DataFrame, slim: DataFrame, tag: Column) -> DataFrame:
    """The pairs (src, dst) of names of ``met`` whose shingle sets overlap by ``SIMILAR`` or more, compared pair by pair."""
    met = cut(met.select("src", "dst"), "met")
    sets = held_sets(met.select(F.col("src").alias("name")).unionByName(met.select(F.col("dst").alias("name"))).distinct(), docs, slim, tag)
    of = lambda end: sets.select(F.col("name").alias(end), F.col("held").alias(f"{end}_held"))
    both = met.join(of("src"), "src").join(of("dst"), "dst")
    shared = F.size(F.array_intersect("src_held", "dst_held"))
    alike = shared >= SIMILAR * (F.size("src_held") + F.size("dst_held") - shared)
    return both.where(alike).select("src", "dst")


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text; null counts as empty."""
    data, offsets = buffers(texts)
    raw = memoryview(data)
    for lo, hi in steps(offsets):
        h, n = set_hashes([bytes(raw[a:b]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)])
        yield from (shingle_set(own) for own in np.split(h, np.cumsum(n)[:-1]))


def common_shingles(docs: DataFrame, tag: Column) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of ``docs``, ascending, and their counts among one of ``COUNTED_ROWS`` rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own.view(np.int64) for own in _sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["token"])

    some = docs.where(F.pmod(tag, F.lit(COUNTED_ROWS)) == 0).select(F.col("text").cast("string").alias("text"))
    counts = some.mapInArrow(each, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_COUNT)
    top = counts.orderBy(F.desc("n"), "token").limit(COMMON_SHINGLES).toArrow()
    tokens, n = (top.column(c).to_numpy() for c in ("token", "n"))
    tokens = tokens.view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def front_keys(tokens: np.ndarray, lengths: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets laid end to end, and the set of each: two sets that overlap by ``SIMILAR`` have a key in common.

    A hash deals shingles to classes; a key is all that a set has in one class. The
    classes of a pair are as many as the octave of its larger set asks for, so a set
    near the end of its octave has keys for the next one too. Two sets that differ in
    d shingles differ in d classes at most, so with all keys in one order (rare ones
    first, then those of more shingles) the first d + 1 of each hold a common one.
    """
    sizes = lengths.astype(np.int64)
    rarity = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rarity = np.where(common[at] == tokens, counts[at], 0)
    spread = _mixed(tokens + _STEP)
    octave = np.frexp(np.maximum(sizes, 1))[1].astype(np.int64) - 1
    most = np.floor(sizes / SIMILAR + 1e-6).astype(np.int64)
    out = []
    for step in (0, 1):
        least = np.int64(1) << (octave + step)
        takes = (sizes > 0) & (most >= least)
        differ = np.floor((sizes + np.minimum(most, 2 * least - 1)) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-6).astype(np.int64)
        classes = np.maximum(np.ceil(least / CLASS_SHINGLES).astype(np.int64), LEAST_CLASSES)
        mine = np.repeat(takes, sizes)
        if not mine.any():
            continue
        base = np.cumsum(classes) - classes
        own = np.repeat(np.arange(len(sizes)), sizes)[mine]
        cell = base[own] + (spread[mine] % classes[own].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, own = cell[order], own[order]
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        held = np.diff(np.append(begin, len(cell)))
        own = own[begin]
        key = _mixed(np.add.reduceat(_mixed(tokens[mine][order]), begin) + (octave[own] + step).astype(np.uint64) * _STEP)
        first = np.lexsort((key, -held, np.minimum.reduceat(rarity[mine][order], begin), own))
        own, key = own[first], key[first]
        n = np.bincount(own, minlength=len(sizes))
        taken = np.arange(len(own)) - (np.cumsum(n) - n)[own] <= differ[own]
        # shingles in so few classes that all of them may differ: such sets meet by a key of their own
        poor = np.flatnonzero(takes & (n <= differ))
        out += [(key[taken], own[taken]), (_mixed((octave[poor] + step).astype(np.uint64)), poor)]
    keys, own = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return keys, own


def front(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of one set, of which any set that overlaps it by ``SIMILAR`` has one."""
    return front_keys(own, np.array([len(own)]), common, counts)[0]


def fronts(docs: DataFrame, tag: Column) -> DataFrame:
    """(token, name, size, first): the keys that several names share, and the smallest of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, tag))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            raw = memoryview(data)
            for lo, hi in steps(offsets):
                h, n = set_hashes([bytes(raw[a:b]) for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)])
                sets = [shingle_set(own) for own in np.split(h, np.cumsum(n)[:-1])]
                names = np.array([xxhash.xxh64_intdigest(own.tobytes()) for own in sets], np.uint64).view(np.int64)
                # a set of fewer than four shingles overlaps no other one by so much
                sets = [own if np.floor(len(own) / SIMILAR + 1e-6) > len(own) else own[:0] for own in sets]
                sizes = np.array([len(own) for own in sets], np.int32)
                keys, at = front_keys(np.concatenate(sets), sizes, common, counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names[at]), pa.array(sizes[at])], ["token", "name", "size"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "token long, name long, size int")
    mine = Window.partitionBy("token")
    return rows.withColumns({"first": F.min("name").over(mine), "last": F.max("name").over(mine)}).where("first < last").drop("last").distinct()


def _near(a: str, b: str) -> Column:
    """Sizes that an overlap of ``SIMILAR`` allows."""
    return F.least(a, b) >= SIMILAR * F.greatest(a, b) - 1e-6


def mixed_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, name, size, root, n, total): the lists of ``fronts`` with names of several groups of ``roots`` (node, root).

    n and total are a list's names and the sum of their sizes. Texts of one group are
    never paired, so a large group costs what it shares with others. Of lists of the
    same names, told by two hashes, one is there.
    """
    rows = lists.drop("first").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    same = [F.bit_xor(F.xxhash64("name", F.lit(k))).alias(f"same{k}") for k in (0, 1)]
    facts = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("root").alias("lo"), F.max("root").alias("hi"), *same)
    once = facts.where("lo < hi").groupBy("n", "total", "same0", "same1").agg(F.min("token").alias("token"))
    return rows.join(once.drop("same0", "same1"), "token")


def pairs_between(rows: DataFrame) -> DataFrame:
    """All pairs (src, dst), src < dst, of names of different groups that share a list of ``mixed_lists`` and whose sizes allow the overlap."""
    of = lambda end: rows.select("token", *[F.col(c).alias(f"{end}_{c}") for c in ("name", "size", "root")])
    met = of("a").join(of("b"), "token").where("a_name < b_name and a_root != b_root").where(_near("a_size", "b_size"))
    return met.select(F.col("a_name").alias("src"), F.col("b_name").alias("dst")).distinct()


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    tokens, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    own = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    left, right = (np.bincount(x, minlength=len(tokens)) for x in (at[own < len(a)], at[own >= len(a)]))
    column = np.cumsum((left > 0) & (right > 0)) - 1
    kept = ((left > 0) & (right > 0))[at]
    own, at = own[kept], column[at[kept]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COUNT_COLUMNS):
        i, j = np.searchsorted(at, (lo, lo + COUNT_COLUMNS))
        held = np.zeros((len(a) + len(b), COUNT_COLUMNS), np.float32)
        held[own[i:j], at[i:j] - lo] = 1
        out += held[: len(a)] @ held[len(a) :].T
    return out


def _between(table: pa.Table) -> pa.Table:
    """Links that connect what the alike pairs of one list's names would, between two of its parts or within one."""
    names, roots, side = (table.column(c).to_numpy() for c in ("name", "root", "side"))
    held = table.column("held").combine_chunks()
    sets = np.split(held.flatten().to_numpy(), held.offsets.to_numpy()[1:-1] - held.offsets.to_numpy()[0])
    size = np.array([len(x) for x in sets])
    low = np.flatnonzero(side == 0)
    high = np.flatnonzero(side == 1) if side.any() else low
    found = []
    for rows in np.split(low, range(COUNT_ROWS, len(low), COUNT_ROWS)) if len(low) and len(high) else []:
        shared = shared_counts([sets[k] for k in rows], [sets[k] for k in high]).astype(np.float64)
        alike = shared >= SIMILAR * (size[rows][:, None] + size[high] - shared)
        i, j = np.nonzero(alike & (roots[rows][:, None] != roots[high]))
        found.append((rows[i], high[j]))
    label = _forest(len(names), iter(found))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return pa.table({"src": names[moved], "dst": names[label[moved]]})


def links_within(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect all names of ``rows`` (of ``mixed_lists``) as their alike pairs between groups would; no pair becomes a row.

    A list is dealt by name to parts of ``LIST_ROWS`` names and ``LIST_SHINGLES``
    shingles at most or so, and a task compares two parts, or one with itself.
    """
    deals = F.ceil(F.greatest(F.col("n") / LIST_ROWS, F.col("total") / LIST_SHINGLES)).cast("int")
    rows = rows.withColumn("deals", deals).withColumn("deal", F.pmod(F.xxhash64("name"), F.col("deals")).cast("int"))
    rows = rows.select("token", "name", "root", "deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("other"))
    rows = rows.select("token", "name", "root", F.least("deal", "other").alias("a"), F.greatest("deal", "other").alias("b"), (F.col("deal") > F.col("other")).cast("int").alias("side"))
    return rows.join(sets, "name").groupBy("token", "a", "b").applyInArrow(_between, "src long, dst long").distinct()


def overlap_links(docs: DataFrame, slim: DataFrame, tag: Column) -> DataFrame:
    """(src, dst) links that connect all names as all their pairs that overlap by ``SIMILAR`` or more would.

    A set is compared with the first of each list that it shares a good part of its
    front with, which makes most groups; then all pairs between groups that may
    overlap are compared.
    """
    spark = docs.sparkSession
    lists = cut(fronts(docs, tag), "fronts")
    with scope(spark) as made:
        stars = lists.where("name > first").groupBy("name", "first").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        stars = stars.where(F.col("n") >= STAR_SHARE * (1 - SIMILAR) * F.col("size")).select(F.col("first").alias("src"), F.col("name").alias("dst"))
        near = cut(checked_links(stars, docs, slim, tag), "near")
        made.remove(near.cut_path)
    with scope(spark) as made:
        roots = cut(connected_components(near), "near_roots")
        rows = cut(mixed_lists(lists, roots), "mixed")
        rest = cut(checked_links(pairs_between(rows.where(F.col("n") <= PAIRED_ROWS)), docs, slim, tag), "rest")
        long = rows.where(F.col("n") > PAIRED_ROWS)
        within = cut(links_within(long, held_sets(long.select("name").distinct(), docs, slim, tag)), "within")
        made.remove(rest.cut_path)
        made.remove(within.cut_path)
    discard(spark, lists.cut_path)
    return near.unionByName(rest).unionByName(within)


def drop_near_duplicates(docs: DataFrame, prints: Column | None = None, links=None) -> DataFrame:
    """Keep one row of each near-duplicate group: that of the smallest doc_id, null last.

    By default all rows are linked whose five-word shingle sets overlap by
    ``SIMILAR`` or more, and groups follow links transitively: a row goes only if some other row is that similar to it, which is
    the row kept or one that leads to it by such links. ``prints`` and ``links``
    (over ``fp``) give another rule. Every row is judged by its own text, so rows
    that share a doc_id may be of different groups. Of rows of one doc_id in a group
    that of the smallest hash over all columns stays, and of rows equal in all
    columns one. Null and empty texts are one group. The columns pass unchanged,
    whatever their names and types; an empty table stays empty.
    """
    tag = _tag(docs)
    slim = cut(docs.select(F.col("doc_id"), tag.alias("tag"), (set_names("text") if prints is None else prints).alias("prints")), "prints")
    links = links or (lambda p: overlap_links(docs, slim, tag))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    kinds = cut(_kinds(slim, links, F.min(key).alias("best")), "groups")
    best = kinds.groupBy("root").agg(F.min("best").alias("kept"))
    judged = _by_print(slim, kinds.join(best, "root").select("fp", "n", "kept"))
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("tag") == F.col("kept.tag"))
    judged = cut(judged.select("doc_id", "tag", stays.alias("stays")), "judged")
    id_, mark, keep = free_name(docs, "gone_id"), free_name(docs, "gone_tag"), docs.select("*")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == tag)
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("tag").alias(mark))
    # rows that repeat in all columns can't be told apart: they leave together, and one comes back
    twins = cut(judged.where("stays").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1"), "twins")
    gone = judged.where("not stays")
    if twins.isEmpty():
        return keep.join(named(gone).distinct(), same, "left_anti")
    kept = keep.join(named(gone).unionByName(named(twins)).distinct(), same, "left_anti")
    whole = free_name(docs, "whole")
    again = keep.join(named(twins), same, "left_semi").select(tag.alias(mark), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole))
    return kept.unionByName(again.groupBy(mark).agg(F.first(whole).alias(whole)).select(f"{whole}.*"))
