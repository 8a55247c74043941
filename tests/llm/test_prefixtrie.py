import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewheel.llm import prefixtrie

KIND = "conv_id long, turn long, role string, text string, seq string, depth int"


def talks_of(rows):
    """conv_id -> ordered (role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in found.items()}


def slow_rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    return out


def slow_trie(talks):
    """Every node by its prefix, its subtree by looking at all nodes."""
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        saved[p] = sum(saved[b] for b in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(talks[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


AWKWARD = [
    (10, 0, "user", "a"), (10, 1, "assistant", "b"), (11, 0, "user", "a"), (11, 1, "assistant", "b"), (12, 0, "user", "a"), (12, 1, "assistant", "b"), (12, 2, "user", "c"),
    (13, None, None, None), (13, 0, "user", "a"), (14, 0, "user", ""), (14, 0, "user", ""), (14, 0, None, "z"), (7, 5, "as\nsist", "ü" * 50), (-3, 0, "user", "a"), (None, 0, "user", "nowhere"), (20, 0, "user" * 9, "x" * 100_000), (21, 3, "1:u", "ser"), (22, 3, "1", ":user"),
]


@pytest.mark.parametrize("blocks", [None, 1, 3, 9])
def test_awkward_rows(spark, blocks):
    df = spark.createDataFrame([(*r, "s", 1) for r in AWKWARD], KIND)
    talks = talks_of(AWKWARD)
    assert rows_of(prefixtrie.trie(prefixtrie.plain(df), blocks)) == slow_trie(talks)
    if blocks in (None, 3):
        positive = [r for r in AWKWARD if r[0] is None or r[0] >= 0]
        df = spark.createDataFrame([(*r, "s", 1) for r in positive], KIND)
        assert rows_of(prefixtrie.trie(prefixtrie.rebuilt(df), blocks)) == slow_trie(slow_rebuilt(talks_of(positive)))


def test_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    assert prefixtrie.trie(prefixtrie.rebuilt(none)).count() == 0 == prefixtrie.trie(prefixtrie.plain(none), 4).count()


@pytest.mark.parametrize(("seed", "blocks"), [(1, 2), (2, 5), (3, 16), (4, 40)])
def test_random_conversations_in_many_blocks(spark, seed, blocks):
    """Few different turns, so that runs of equal conversations and deep nodes reach over several blocks."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), 250):
        turns = ["x", "y"] if c % 3 == 0 else [rng.choice("ab" if seed % 2 else "aab") * (1 + d % 3) for d in range(rng.randint(1, 12))]
        rows += [(c, d, "user", t) for d, t in enumerate(turns)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], KIND)
    talks = talks_of(rows)
    assert rows_of(prefixtrie.trie(prefixtrie.plain(df), blocks)) == slow_trie(talks)
    assert rows_of(prefixtrie.trie(prefixtrie.rebuilt(df), blocks)) == slow_trie(slow_rebuilt(talks))


def test_conversations_without_turns(spark):
    """Conversations whose opening is missing and whose own turns are all replaced end in the root."""
    rows = [(c, 0, "user", "t") for c in range(101, 135) if c % 5]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], KIND)
    talks = slow_rebuilt(talks_of(rows))
    assert [] in talks.values()
    assert rows_of(prefixtrie.trie(prefixtrie.rebuilt(df), 5)) == slow_trie(talks)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_nearest_smaller_blocks(minima):
    m = np.array(minima)
    block, depth = (x.ravel() for x in np.meshgrid(np.arange(len(m)), np.arange(8)))
    want = [max((k for k in range(b) if m[k] < d), default=-1) for b, d in zip(block, depth, strict=True)]
    assert prefixtrie.nearest_smaller(m, block, depth).tolist() == want
