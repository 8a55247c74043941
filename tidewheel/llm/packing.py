"""Best-fit packing of token pieces into sequences, planned on a histogram of lengths.

Texts are encoded once and cut into pieces of at most ``capacity`` tokens. What the
plan needs of them is how many pieces have each length: ``capacity`` numbers at most,
whatever the corpus. Best fit runs over these counts, longest first: all sequences
with the same room left are one run of sequence numbers, and a run takes as many
pieces of a length as fit before the next is opened. Each such step is a planned row
(length, first rank, first sequence, pieces a sequence, offset), and a piece finds
its slot by its rank among the pieces of its length.

Ranks need no sort: a task numbers its own pieces by length, and the counts of
(task, length) are summed in front of them.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidewheel.llm.common import buffers
from tidewheel.scratch import cut

CAPACITY = 4096
#: The id that ends a document.
END_ID = 1
#: White-space-free runs kept with their ids in one process, and the longest of them in bytes.
KEPT_RUNS, KEPT_BYTES = 1_000_000, 64
#: Bytes of one text that are split into runs at a time.
STEP_BYTES = 4_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STOPS = (b".", b",")
_SPACE = re.compile(rb"[\t-\r ]")
#: One word to the splitting pattern, and unchanged by the normaliser: small letters of Latin-1. Behind it, one piece of
#: ASCII marks; an apostrophe among them might be joined to letters.
_WORD = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_CODERS: dict[str, Coder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


_LETTERS = _byte_letters()


def default_vocabulary() -> str:
    """Path of the installed vocabulary with word ends."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Coder:
    """Ids of whole texts, as bytes of little-endian 32-bit numbers.

    The vocabulary folds case, and its normaliser and splitting pattern never look
    across ASCII white space nor join a stop or comma to letters before it, so a
    text's ids are those of its runs of other bytes in order. A run is encoded where
    it is first met and kept; the store is emptied when full.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.kept: dict[bytes, bytes] = {}

    def _encode(self, runs: list[bytes]) -> None:
        others = []
        for r in runs:
            if (word := _WORD.fullmatch(r.decode())) and not word[2]:
                letters = word[1] if r.isascii() else r.decode("latin-1").translate(_LETTERS)
                ids = [t.id for t in self.merges.tokenize(letters)]
                self.kept[r] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(r)
        runs = others
        found = self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)
        self.kept.update(zip(runs, [np.array(e.ids, "<u4").tobytes() for e in found], strict=True))

    def _learn(self, runs: set[bytes]) -> None:
        ends = [(r, r[:-1], r[-1:]) for r in runs if r[-1:] in _STOPS and r[:-1].decode().isalpha()]
        parts = runs.difference(r for r, _, _ in ends)
        for r in list(parts):
            if (word := _WORD.fullmatch(r.decode())) and word[2]:
                ends.append((r, word[1].encode(), word[2].encode()))
                parts.remove(r)
        parts = parts.union(*((a, b) for _, a, b in ends))
        self._encode(list(parts.difference(self.kept)))
        self.kept.update((r, self.kept[a] + self.kept[b]) for r, a, b in ends)

    def ids(self, raw: bytes) -> bytes:
        """The ids of one UTF-8 text."""
        if b"<|" not in raw:  # the marks of special tokens are lower case only
            raw = raw.translate(_LOWER)
        out, lo = [], 0
        while lo < len(raw):
            hi = lo + STEP_BYTES
            if hi < len(raw):
                space = _SPACE.search(raw, hi)
                hi = space.start() if space else len(raw)
            runs = raw[lo:hi].split()
            lo = hi
            if new := set(runs).difference(self.kept):
                if len(self.kept) + len(new) > KEPT_RUNS:
                    self.kept.clear()
                    new = set(runs)
                self._learn(new)
            out.append(b"".join(map(self.kept.__getitem__, runs)))
            for r in new:
                if len(r) > KEPT_BYTES:
                    del self.kept[r]
                    self.kept.pop(r[:-1], None)
                    if word := _WORD.fullmatch(r.decode()):
                        for part in word.groups():
                            self.kept.pop(part.encode(), None)
        return b"".join(out)


def coder(path: str) -> Coder:
    """The coder of a vocabulary file, loaded once per process."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with ``task`` and ``task_rank``, its number in the task among its length.

    With ``ids``, the piece's ids follow as an array. Only documents of more than
    ``capacity`` ids are cut; the last piece holds the rest.
    """
    path = vocabulary or default_vocabulary()
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("task_rank", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    last = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, seen = coder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            row, number, length, crc, held = [], [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                found = code.ids(data[a:b].tobytes()) + last
                for n, lo in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[lo : lo + 4 * capacity]
                    row.append(k)
                    number.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        held.append(np.frombuffer(part, "<u4").astype(np.int32))
            size, ranks = np.array(length, np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(size, kind="stable")
            lengths, at, counts = np.unique(size[order], return_index=True, return_counts=True)
            ranks[order] = np.arange(len(size)) - np.repeat(at, counts) + np.repeat(seen[lengths], counts)
            seen[lengths] += counts
            made = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(np.array(number, np.int64) * capacity), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(ranks)]
            if ids:
                made.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, names=[f.name for f in fields])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encode, T.StructType(fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit over counts of lengths: rows (length, first rank, first sequence, pieces a sequence, offset), by length and rank.

    Longest first; pieces of one length fill the fullest sequences that have room,
    as many as fit each, then open new ones. Sequences with equal room are runs of
    numbers, so a step is one row however many sequences it fills. A length splits
    two runs at most, and a sequence holds 90 lengths at most at 4,096, so the plan
    has a bound that does not grow with the corpus; in practice it has some rows a length.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequence numbers (first, how many)
    rooms: list[int] = []  # the rooms that occur, ascending
    made = 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer than one sequence takes
                rows.append((length, rank, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                full, left = full + 1, 0
            keep(room, first + full, n - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_SLOT = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids, where asked for).

    Null and empty texts are the end id alone. Rows that repeat, in doc_id or in
    all, are packed each; ties of one length go by task and row. An empty table
    gives no row. Columns other than doc_id and text are not read. Pieces are
    written to the shared folder once, so that a lost executor does not number
    them anew. A text is held whole, in bytes and ids.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, capacity, vocabulary, end_id, ids), "pieces")
    counts = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task")
    counts = cut(counts.withColumn("before", F.sum("n").over(before) - F.col("n")), "lengths")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length, capacity at most
    slots = spark.sparkContext.broadcast(plan(total, capacity))

    @F.arrow_udf(_SLOT)
    def slot(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        rows = slots.value
        size, rank = lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        # one ascending key of (length, rank): ranks count from the length's first row in the plan
        span = int(max(rank.max(initial=0), rows[:, 1].max(initial=0))) + 1
        at = np.searchsorted(rows[:, 0] * span + rows[:, 1], size * span + rank, "right") - 1
        over = rank - rows[at, 1]
        return pa.StructArray.from_arrays([pa.array(rows[at, 2] + over // rows[at, 3]), pa.array(rows[at, 4] + over % rows[at, 3] * size)], names=["sequence_id", "offset"])

    out = made.join(counts.select("task", "length", "before"), ["task", "length"])
    out = out.withColumn("slot", slot("length", F.col("before") + F.col("task_rank")))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "slot.sequence_id", "slot.offset", *(["ids"] if ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from :func:`pack` with ``ids``: sequence_id, ids, doc_ids and starts of the pieces, in order.

    A group holds ``capacity`` ids at most.
    """
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("held"))
    return rows.select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.piece").alias("pieces"), F.col("held.offset").alias("starts"))
