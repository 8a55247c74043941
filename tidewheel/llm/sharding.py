"""Sharding by a k-d tree over document metadata, with distributed weighted medians.

Rows of equal text are one unit, which has the smallest language and source of its
rows. Units are summed once to atoms: cells of (language, source, log bytes), of
which those over a small share of a shard are divided by the text's hash, and texts
over it by the hash of doc_id. The tree is grown on the atoms: all nodes of one
level are split together, each across the dimension in which it is widest, where
the bytes to its left come to its share of the leaves. Rows of one value are in the
order of their cell's hash, then of the text's, then of doc_id's; a cut is found by
each of these in turn, so no window holds a node's atoms. The fitted tree is a few
values; a row finds its shard by walking it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import free_name, ranked
from tidewheel.scratch import cut

SHARDS = 40
DIMS = ("lang", "source", "bin")
#: What orders rows of one value.
ORDER = ("cell", "text_hash", "id_hash")
#: Steps of the size dimension per doubling.
BINS = 8
#: Bits of the hashes that order texts within a cell, and rows within a text.
HASH_BITS, DIGIT_BITS = 60, 12
#: Shares of a shard: atoms are divided down to ATOM where they can be; a cut may miss its goal by KEEP to leave equal texts together.
ATOM, KEEP = 1e-3, 2e-2
SLOT_BUCKETS = 256


def byte_size(text: str) -> Column:
    """UTF-8 bytes plus 16; null has none."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")


def text_crc32(text: str) -> Column:
    """Unsigned CRC-32 of the UTF-8 text; null counts as empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _hash(value: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - HASH_BITS)


def _cell(lang: Column, source: Column, bin_: Column) -> Column:
    return _hash(F.concat_ws("\x00", lang, source, bin_))


def metadata() -> dict[str, Column]:
    """What places a row: language and source, null as empty, bytes on a log scale, and hashes of these three, of the text and of doc_id."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bin_ = F.lpad(F.floor(F.log2(byte_size("text")) * BINS).cast("string"), 3, "0")
    return {"lang": name("lang"), "source": name("source"), "bin": bin_, "cell": _cell(name("lang"), name("source"), bin_), "text_hash": _hash(F.coalesce("text", F.lit(""))), "id_hash": _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))}


@dataclass
class Split:
    """A node's cut: its dimension and the first (value, cell, text hash, id hash) that goes right."""

    dim: int
    value: str
    cell: int
    text_hash: int
    id_hash: int


@dataclass
class Tree:
    """Splits and leaves by heap number (root 1); leaves name shards."""

    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, int] = field(default_factory=dict)

    def _step(self, place: Column, node: Column, size: int) -> Column:
        of = lambda f, none: F.element_at(F.array(*[F.lit(f(self.splits[n]) if n in self.splits else none) for n in range(1, size)]), node)
        dim, value = of(lambda s: s.dim, -1), of(lambda s: s.value, "")
        cut_at = [of(lambda s, c=c: getattr(s, c), 0).cast("long") for c in ORDER]
        own = F.when(dim == 0, place["lang"]).when(dim == 1, place["source"]).otherwise(place["bin"])
        tie = F.lit(True)
        for c, at in reversed(list(zip(ORDER, cut_at, strict=True))):
            tie = (place[c] > at) | ((place[c] == at) & tie)
        right = (own > value) | ((own == value) & tie)
        return F.when(dim < 0, node).otherwise(node * 2 + right.cast("int"))

    def node(self, place: Column) -> Column:
        """The node that a row with this struct of metadata reaches."""
        size = 1 << max([1, *(n.bit_length() + 1 for n in [*self.splits, *self.leaves])])
        depth = max([0, *(n.bit_length() for n in self.splits)])
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), lambda n, _: self._step(place, n, size)) if depth else F.lit(1)

    def shard(self, place: Column) -> Column:
        """The shard of a row."""
        return F.element_at(F.array(*[F.lit(self.leaves.get(n, -1)) for n in range(1, max(self.leaves) + 1)]), self.node(place))


@dataclass
class Met:
    """Where a node's running bytes reach the goal: a value, what is left of the goal inside it, its bytes, and the next value."""

    value: str | int
    goal: float
    bytes: int
    next: str | int | None


def _crossing(rows: DataFrame, order: str, goals: Column) -> dict[int, Met]:
    """For each node of (node, size, ...), the value of ``order`` in which its bytes reach its goal; the last one, if they don't."""
    own = Window.partitionBy("node")
    sums = rows.groupBy("node", order).agg(F.sum("size").alias("w"))
    sums = sums.withColumn("after", F.sum("w").over(own.orderBy(order))).withColumn("total", F.sum("w").over(own)).withColumn("next", F.lead(order).over(own.orderBy(order)))
    met = sums.withColumn("goal", goals).where(F.col("after") >= F.least("goal", "total")).groupBy("node").agg(F.min(F.struct("after", F.col(order).alias("value"), "w", "goal", "next")).alias("at"))
    return {r.node: Met(r["at"]["value"], r["at"].goal - r["at"].after + r["at"].w, r["at"].w, r["at"].next) for r in met.collect()}


def atoms(slim: DataFrame, units: DataFrame, leaf: float) -> DataFrame:
    """What the tree is grown on: (lang, source, bin, cell, text_hash, id_hash, size), hashes as the lower ends of their ranges."""
    finest = max(leaf * ATOM, 1.0)
    bits = lambda w: F.least(F.greatest(F.ceil(F.log2(w / F.lit(finest))), F.lit(0)), F.lit(HASH_BITS)).cast("int")
    low = lambda h, b: F.call_function("shiftleft", F.call_function("shiftright", h, F.lit(HASH_BITS) - b), F.lit(HASH_BITS) - b)
    big = (F.col("size") > KEEP * leaf) & (F.col("n") > 1)
    cells = cut(units.where(~big).groupBy(*DIMS).agg(F.sum("size").alias("w")).withColumn("bits", bits(F.col("w"))), "cells")
    fine = units.where(~big).join(cells.drop("w"), list(DIMS)).groupBy(*DIMS, low(F.col("text_hash"), F.col("bits")).alias("text_hash")).agg(F.sum("size").alias("size"))
    # texts that many rows share and that weigh much: no more of them than shards / KEEP
    hot = cut(units.where(big).select("text_hash", *DIMS, bits(F.col("size")).alias("bits")), "hot")
    rows = slim.select("text_hash", "id_hash", "size").join(hot, "text_hash").groupBy(*DIMS, "text_hash", low(F.col("id_hash"), F.col("bits")).alias("id_hash")).agg(F.sum("size").alias("size"))
    every = fine.withColumn("id_hash", F.lit(0).cast("long")).unionByName(rows)
    return cut(every.withColumn("cell", _cell(F.col("lang"), F.col("source"), F.col("bin"))), "atoms")


def fit(parts: DataFrame, shards: int, leaf: float) -> Tree:
    """Grow the tree level by level over atoms."""
    places = {}
    for d in ("lang", "source"):
        places[d] = ranked(parts.select(d).distinct(), d).withColumnRenamed("rank", f"{d}_at")
        parts = parts.join(places[d], d)
    parts = cut(parts.withColumn("bin_at", F.col("bin").cast("long")), "atoms")
    ends = parts.agg(*[f(f"{d}_at") for d in DIMS for f in (F.min, F.max)]).first()
    span = [max((ends[2 * k + 1] or 0) - (ends[2 * k] or 0), 1) for k in range(3)]
    tree = Tree()
    width = {1: shards}
    place = F.struct(*DIMS, *ORDER)
    by_node = lambda values, kind: F.element_at(F.array(*[F.lit(values.get(n)).cast(kind) for n in range(1, max(values) + 1)]), F.col("node"))
    while open_ := {n: k for n, k in width.items() if k > 1 and n not in tree.splits}:
        rows = parts.withColumn("node", tree.node(place)).where(F.col("node").isin(*open_))
        wide = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("total"), *[(F.max(f"{d}_at") - F.min(f"{d}_at")).alias(d) for d in DIMS]).collect()}
        dim = {n: max(range(3), key=lambda k: (wide[n][DIMS[k]] / span[k], -k)) if n in wide else 0 for n in open_}
        goal = {n: wide[n].total * (k // 2) / k if n in wide else 0.0 for n, k in open_.items()}
        which = by_node(dim, "int")
        value = F.when(which == 0, F.col("lang")).when(which == 1, F.col("source")).otherwise(F.col("bin"))
        digit = F.shiftright("cell", HASH_BITS - DIGIT_BITS)
        rows = cut(rows.select("node", value.alias("value"), digit.alias("digit"), *ORDER, "size"), "level")
        met: dict[str, dict[int, Met]] = {}
        for order, kind in (("value", "string"), ("digit", "long"), *[(c, "long") for c in ORDER]):
            if wide:
                met[order] = _crossing(rows, order, by_node(goal, "double"))
                rows = rows.where(F.col(order) == by_node({n: m.value for n, m in met[order].items()}, kind))
                goal = {n: m.goal for n, m in met[order].items()}
        behind = lambda m: 1 << HASH_BITS if m.next is None else m.next
        for n in wide:
            text, row = met["text_hash"][n], met["id_hash"][n]
            # the cut lies before this text, behind it, or, if both miss the goal by too much, inside it
            if min(text.goal, text.bytes - text.goal) <= KEEP * leaf or row.bytes == text.bytes:
                at = (text.value if text.goal <= text.bytes / 2 else behind(text), 0)
            else:
                at = (text.value, row.value if row.goal <= row.bytes / 2 else behind(row))
            tree.splits[n] = Split(dim[n], met["value"][n].value, met["cell"][n].value, *at)
        for n, k in open_.items():
            tree.splits.setdefault(n, Split(0, "", 0, 0, 0))  # a node without rows
            width[2 * n], width[2 * n + 1] = k // 2, k - k // 2
    for shard, n in enumerate(sorted((n for n, k in width.items() if k == 1), key=lambda n: format(n, "b"))):
        tree.leaves[n] = shard
    return tree


def grow(docs: DataFrame, shards: int = SHARDS) -> tuple[Tree, DataFrame]:
    """The tree fitted to all rows of ``docs`` (doc_id, text, lang, source), and the metadata of texts whose rows differ in it."""
    slim = cut(docs.select(byte_size("text").alias("size"), *[c.alias(n) for n, c in metadata().items()]), "metadata")
    name = F.struct("lang", "source")
    units = slim.groupBy("text_hash").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(name).alias("name"), F.max(name).alias("other"), F.min("bin").alias("bin"))
    units = cut(units.select("text_hash", "size", "n", "name.lang", "name.source", "bin", (F.col("name") != F.col("other")).alias("mixed")), "units")
    leaf = (units.agg(F.sum("size")).first()[0] or 0) / shards
    tree = fit(atoms(slim, units, leaf), shards, leaf)
    return tree, cut(units.where("mixed").select("text_hash", "lang", "source"), "mixed")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard``: every row goes to one of ``shards`` leaves of near-equal bytes.

    Sizes are UTF-8 bytes plus 16. Null lang, source and text sort as empty;
    null doc_id is a value like any other. Rows of equal text go to one shard,
    whatever their other columns, unless a cut falls into their text and both its
    ends would miss the cut's goal by over ``KEEP`` of a shard; then rows of one
    doc_id still stay together. An empty table gives an empty result. Other columns
    pass; one named ``shard`` is replaced.
    """
    tree, mixed = grow(docs, shards)
    own = metadata()
    at, th, unit = (free_name(docs, c) for c in ("place", "unit_hash", "unit"))
    if mixed.isEmpty():
        out = docs.withColumn(at, F.struct(*[c.alias(n) for n, c in own.items()]))
        return out.withColumn("shard", tree.shard(F.col(at))).drop(at)
    # texts whose copies bear several languages or sources take those of their unit: a table of known size
    side = mixed.select(F.col("text_hash").alias(th), F.struct("lang", "source").alias(unit))
    out = docs.join(side, own["text_hash"] == F.col(th), "left")
    lang, source = (F.coalesce(F.col(unit)[c], own[c]) for c in ("lang", "source"))
    place = F.struct(lang.alias("lang"), source.alias("source"), _cell(lang, source, own["bin"]).alias("cell"), *[own[c].alias(c) for c in ("bin", "text_hash", "id_hash")])
    return out.withColumn(at, place).withColumn("shard", tree.shard(F.col(at))).drop(at, th, unit)


def with_slots(rows: DataFrame, doc_id: str = "doc_id", shard: str = "shard") -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, by numbering hashed buckets of a shard and adding offsets.

    Buckets and order follow all columns, doc_id first, so only rows that are equal
    in all of them are numbered in no stated order. Columns must be sortable.
    """
    bucket, before, n = (free_name(rows, c) for c in ("bucket", "before", "n"))
    every = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(*every), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = rows.groupBy(shard, bucket).agg(F.count("*").alias(n))
    counts = counts.withColumn(before, F.sum(n).over(Window.partitionBy(shard).orderBy(bucket)) - F.col(n)).drop(n)
    inside = Window.partitionBy(shard, bucket).orderBy(doc_id, *every)
    out = rows.join(counts, [shard, bucket]).withColumn("slot", F.col(before) + F.row_number().over(inside) - 1)
    return out.select(*every, "slot")
