"""The prefix trie of conversations, from the Cartesian tree over a sorted LCP array.

A conversation is the row of its turns' hashes. All conversations are sorted by it;
what two neighbours share, in turns, is the longest-common-prefix array. A trie node
at depth d is a run of conversations between two entries below d: nearest smaller
values on both sides. Inside a block of the sorted order a stack finds them, merges
nodes of equal entries and opens a node for every missing depth between a node and
its parent. Nodes that reach a block's edge, which are those of its first and last
conversation only, are finished between blocks: an edge entry looks for the nearest
earlier block whose minimum is smaller, and the pieces of one node are added up.

Every figure of a node is a sum or a minimum over its run, so pieces add up: members,
smallest member, leaves (conversations whose successor does not continue them), and
saved bytes, as the sum over the run, its first conversation left out, of the bytes
shared with the predecessor less those above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.scratch import cut

#: Bytes of a turn's hash.
KEY = 16
#: The contract's rebuilding: conversations share openings in families, of at most so many turns.
FAMILY, OPENINGS = 5, 9


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), key (the hash of role and text) and bytes (of the text) of every turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.withColumn("at", F.row_number().over(order)).select("conv_id", "at", key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))


def as_rows(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, seq (the hashes of its turns end to end) and sizes (bytes of their texts), for every id, without turns too."""
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "bytes"))).alias("held"))
    seq = F.unhex(F.array_join(F.transform("held.key", F.hex), ""))
    rows = held.select("conv_id", seq.alias("seq"), F.col("held.bytes").alias("sizes"))
    return ids.join(rows, "conv_id", "left").select("conv_id", F.coalesce("seq", F.lit(b"")).alias("seq"), F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes"))


def plain(conversations: DataFrame) -> DataFrame:
    """The conversations as they are, for :func:`trie`."""
    turns = cut(numbered(conversations), "turns")
    return as_rows(turns, turns.select("conv_id").distinct())


def rebuilt(conversations: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % family in place of its own, for :func:`trie`.

    h is the unsigned crc32 of c's decimal digits modulo ``openings``. Where that
    conversation has fewer turns, or none, the opening is shorter, or empty.
    """
    turns = cut(numbered(conversations), "turns")
    ids = cut(turns.select("conv_id").distinct().withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(openings))), "ids")
    lead = ids.withColumn("from", F.col("conv_id") - F.col("conv_id") % family)
    first = turns.where(F.col("at") < openings).withColumnRenamed("conv_id", "from")
    opening = lead.join(first, "from").where("at <= h").select("conv_id", F.struct(F.lit(0).alias("part"), "at").alias("at"), "key", "bytes")
    own = turns.join(ids, "conv_id").where("at > h").select("conv_id", F.struct(F.lit(1).alias("part"), "at").alias("at"), "key", "bytes")
    return as_rows(opening.unionByName(own), ids.select("conv_id"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two hash rows begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // KEY


def block_nodes(ids: np.ndarray, lens: np.ndarray, lcp: np.ndarray, sizes: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The nodes of one block of sorted conversations, by a stack over its LCP array.

    ``lcp[0]`` is 0 here and the first conversation opens all its depths from 0; the
    block's edges are mended later. A node is (first position, depth, last position,
    parent); ``ends`` counts the conversations that end in it, which come first.
    """
    n = len(ids)
    opened = lens - lcp
    opened[0] += 1
    base = np.concatenate(([0], np.cumsum(opened)))
    start, total = np.repeat(np.arange(n), opened), int(base[-1])
    depth = np.arange(total) - base[start] + np.where(start > 0, lcp[start] + 1, 0)
    end, parent, home = np.full(total, n - 1, np.int64), np.arange(total) - 1, np.zeros(n, np.int64)
    path, height = np.zeros(int(lens.max()) + 1, np.int64), 0  # the open node of each depth
    for i in range(n):
        keep = int(lcp[i]) + 1 if i else 0
        if keep < height:
            end[path[keep:height]] = i - 1
        height = int(lens[i]) + 1
        if keep < height:
            parent[base[i]] = path[keep - 1] if keep else -1
            path[keep:height] = np.arange(base[i], base[i + 1])
        home[i] = path[height - 1]
    above = [np.concatenate(([0, 0], np.cumsum(s))) for s in sizes]  # at d, the bytes above depth d
    common = np.array([a[k + 1] for a, k in zip(above, lcp, strict=True)], np.int64)
    over = np.concatenate([above[i][(lcp[i] + 1 if i else 0) : lens[i] + 1] for i in range(n)])
    shared, leaves = (np.concatenate(([0], np.cumsum(x))) for x in (common, np.append(lcp[1:] < lens[:-1], False)))
    least = np.full(total, np.iinfo(np.int64).max)
    np.minimum.at(least, home, ids)
    lower, up = least.tolist(), parent.tolist()
    for k in range(total - 1, 0, -1):  # a parent is opened before its children
        if lower[k] < lower[up[k]]:
            lower[up[k]] = lower[k]
    members = end - start + 1
    return {
        "start": start, "depth": depth, "end": end, "parent": parent, "n": members, "least": np.array(lower, np.int64), "above": over,
        "children": np.bincount(parent[1:], minlength=total), "leaves": leaves[end + 1] - leaves[start],
        "saved": shared[end + 1] - shared[start + 1] - (members - 1) * over, "ends": np.bincount(home, minlength=total),
    }


_NODE = "block int, start long, depth int, edge boolean, to_end boolean, n long, least long, children long, leaves long, saved long, above long, parent_start long, parent_conv long, ends string, ends_sha256 string"
_EDGE = "first binary, last binary, first_sizes array<long>, inner long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a sorted partition; its root carries what the edges need: first and last row, and the least entry inside."""
    ids, lens, lcp, sizes, first, last = [], [], [], [], None, None
    for batch in batches:
        ids += batch.column("conv_id").to_pylist()
        sizes += [np.array(s, np.int64) for s in batch.column("sizes").to_pylist()]
        for seq in batch.column("seq").to_pylist():
            lens.append(len(seq) // KEY)
            lcp.append(0 if last is None else shared_turns(last, seq))
            first, last = seq if first is None else first, seq
    if not ids:
        return
    got = block_nodes(np.array(ids, np.int64), np.array(lens, np.int64), np.array(lcp, np.int64), sizes)
    start, total = got["start"], len(got["start"])
    to_end = got["end"] == len(ids) - 1
    edge = (start == 0) | to_end
    rooted = got["parent"] >= 0
    open_above = edge[got["parent"]]
    texts, hashes = [None] * total, [None] * total
    for k in np.flatnonzero(got["ends"]):
        text = ",".join(map(str, ids[start[k] : start[k] + got["ends"][k]]))
        if edge[k]:
            texts[k] = text
        else:
            hashes[k] = hashlib.sha256(text.encode()).hexdigest()
    at_root = lambda v, kind: pa.array([v] + [None] * (total - 1), kind)
    columns = {
        "block": pa.array(np.full(total, TaskContext.get().partitionId(), np.int32)), "start": start, "depth": got["depth"].astype(np.int32), "edge": edge, "to_end": to_end,
        **{c: got[c] for c in ("n", "least", "children", "leaves", "saved", "above")},
        "parent_start": pa.array(start[got["parent"]], mask=~(rooted & open_above)), "parent_conv": pa.array(got["least"][got["parent"]], mask=~rooted | open_above),
        "ends": pa.array(texts, pa.string()), "ends_sha256": pa.array(hashes, pa.string()),
        "first": at_root(first, pa.binary()), "last": at_root(last, pa.binary()), "first_sizes": at_root(sizes[0].tolist(), pa.list_(pa.int64())), "inner": at_root(min(lcp[1:], default=None), pa.int64()),
    }
    yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def nearest_smaller(minima: np.ndarray, block: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each (block, depth), the nearest earlier block whose minimum is below depth, by doubling steps; -1 where none is."""
    table = [minima]
    while (1 << len(table)) <= len(minima):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    at = block - 1
    for k in reversed(range(len(table))):
        low = at - (1 << k) + 1
        ok = (low >= 0) & (table[k][np.maximum(low, 0)] >= depth)
        at = np.where(ok, low - 1, at)
    return at


def _hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's ids from its pieces in order; a piece at a time is held, whatever their number."""
    key, state = None, None
    for pdf in batches:
        out = []
        for *own, ends in pdf[["at_block", "at_start", "depth", "ends"]].itertuples(index=False):
            if own != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pd.DataFrame(out, columns=["at_block", "at_start", "depth", "ends_sha256"])
    if key:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["at_block", "at_start", "depth", "ends_sha256"])


def trie(rows: DataFrame, blocks: int | None = None) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``rows`` comes from :func:`plain` or :func:`rebuilt`: turns in order of (turn,
    role, text), null first; null role and text count as empty; rows without conv_id
    belong to no conversation; repeated rows are turns that repeat. An empty table
    gives no node. Conversations that are alike in all turns share a node, however
    many they are: they are sorted by conv_id too, so no block holds them all, and
    their ids are hashed from pieces in block order, one piece at a time. A
    conversation is one row, of 24 bytes a turn. ``blocks`` is the number of
    sorted ranges; Spark's own choice by default.
    """
    spark = rows.sparkSession
    rows = cut(rows, "rows")
    order = ["seq", "conv_id"]
    ranged = rows.repartitionByRange(blocks, *order) if blocks else rows.repartitionByRange(*order)
    made = cut(ranged.sortWithinPartitions(*order).mapInArrow(_blocks, f"{_NODE}, {_EDGE}"), "nodes")

    @F.arrow_udf("long")
    def entry(before: pa.Array, first: pa.Array) -> pa.Array:  # a row per block
        return pa.array([-1 if a is None else shared_turns(a, b) for a, b in zip(before.to_pylist(), first.to_pylist(), strict=True)], pa.int64())

    line = Window.orderBy("block")  # a row per sorted range
    edges = made.where("depth = 0 and start = 0").select("block", "first", "last", "first_sizes", "inner", F.lag("last").over(line).alias("before"))
    edges = edges.withColumn("entry", entry("before", "first"))
    common = F.aggregate(F.slice("first_sizes", F.lit(1), F.greatest(F.col("entry"), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda a, b: a + b)
    ends_here = F.coalesce(F.lead("entry").over(line) < F.octet_length("last") / KEY, F.lit(True)).cast("long")
    edges = edges.select("block", "entry", common.alias("common"), ends_here.alias("last_leaf"), F.least("entry", F.coalesce("inner", "entry")).alias("minimum"))
    edges = cut(edges, "edges")
    known = np.array(sorted((r.block, r.minimum) for r in edges.select("block", "minimum").collect()), np.int64).reshape(-1, 2)  # two numbers a sorted range

    @F.arrow_udf("int")
    def begins(block: pa.Array, depth: pa.Array) -> pa.Array:
        at = np.searchsorted(known[:, 0], block.to_numpy(zero_copy_only=False))
        return pa.array(known[nearest_smaller(known[:, 1], at, depth.to_numpy(zero_copy_only=False)), 0].astype(np.int32))

    left = (F.col("start") == 0) & (F.col("depth") <= F.col("entry"))
    rim = made.where("edge").drop("first", "last", "first_sizes", "inner").join(edges, "block").withColumn("left", left)
    rim = rim.withColumn("saved", F.col("saved") + F.when(F.col("left"), F.col("common") - F.col("above")).otherwise(0))
    rim = rim.withColumn("children", F.col("children") - (F.col("left") & (F.col("depth") < F.col("entry"))).cast("long"))
    rim = rim.withColumn("leaves", F.col("leaves") + F.when(F.col("to_end"), F.col("last_leaf")).otherwise(0))
    rim = cut(rim.withColumn("at_block", F.when(F.col("left"), begins("block", "depth")).otherwise(F.col("block"))), "rim")
    heads = rim.where("not left and to_end").select(F.col("block").alias("at_block"), "depth", F.col("start").alias("head"))
    rim = rim.join(heads, ["at_block", "depth"], "left").withColumn("at_start", F.when(F.col("left"), F.col("head")).otherwise(F.col("start")))
    node = ["at_block", "at_start", "depth"]
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    whole = rim.groupBy(*node).agg(F.min("least").alias("least"), *sums, F.max(F.when(~F.col("left"), F.col("parent_start"))).alias("parent_start"))
    pieces = rim.where("ends is not null").select(*node, "block", "ends").repartition(*node).sortWithinPartitions(*node, "block")
    hashes = pieces.drop("block").mapInPandas(_hash_ends, "at_block int, at_start long, depth int, ends_sha256 string")
    whole = cut(whole.join(hashes, node, "left"), "whole")
    parents = rim.select("block", "start", "depth", *node[:2]).join(whole.select(*node, "least"), node)
    parents = parents.select("block", F.col("start").alias("parent_start"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("found"))
    kept = ["depth", "least", "n", "children", "leaves", "saved", "ends_sha256"]
    inside = made.where("not edge")
    below = whole.withColumnRenamed("at_block", "block").select("block", "parent_start", *kept).unionByName(inside.where("parent_start is not null").select("block", "parent_start", *kept))
    below = below.join(parents, ["block", "parent_start", "depth"], "left").select(*kept, F.col("found").alias("parent_conv"))
    nodes = below.unionByName(inside.where("parent_start is null").select(*kept, "parent_conv"))
    return nodes.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % {OPENINGS} AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT h.conv_id, 0 AS part, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % {FAMILY} WHERE pos <= h
      UNION ALL SELECT h.conv_id, 1, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id WHERE pos > h),
n AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, count(*) OVER (PARTITION BY conv_id) AS len,
             sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w) AS id
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT conv_id, depth, bytes, len, id, coalesce(lag(id) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM n
      UNION ALL SELECT h.conv_id, 0, 0, coalesce(max(len), 0), '', NULL FROM h LEFT JOIN n USING (conv_id) GROUP BY 1),
g AS (SELECT id, up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, bool_and(len = depth) AS leaf,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
b AS (SELECT DISTINCT a.id, g.id AS below, g.leaf, (g.n_convs - 1) * g.bytes AS saved
      FROM m a JOIN m d ON a.conv_id = d.conv_id AND d.depth >= a.depth JOIN g ON g.id = d.id)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, (SELECT count(*) FROM g c WHERE c.up = g.id)::BIGINT AS n_children,
       s.n_leaves, s.saved_tokens, g.ends_sha256
FROM g LEFT JOIN g p ON p.id = g.up JOIN (SELECT id, count(*) FILTER (WHERE leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM b GROUP BY id) s ON s.id = g.id
"""
