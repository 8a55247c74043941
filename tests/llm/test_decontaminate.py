import hashlib
import random
import re
import time

import numpy as np
import pytest

from tests.llm import cases
from tidewheel.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, window=10):
    own = words(text)
    hit, names = set(), set()
    for name, body in items:
        w = words(body)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    names.add(str(name))
    return len(own), len(hit), sorted(names)


def test_query_against_brute_force(spark, sf):
    from tidewheel.llm.queries import QUERIES

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(max(1, len(w) - 9))}
    firsts = {g[0] for g in grams}
    for d in docs:
        n, hits, names = slow(d.text, items) if firsts & set(words(d.text)) else (len(words(d.text)), 0, [])
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hits, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hits > 0)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Fox jumps, over"), (3, None), (4, ""), (5, "--- !"), (None, "näive ünïcode"), (2, "lazy dog"), (7, "Wörter und mehr Wörter und mehr Wörter und mehr Wörter")]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_awkward_documents(spark, block):
    df = cases.docs(spark)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.contamination(df, bench, block_bytes=block, into="found")
    assert out.columns == [*df.columns, "found"]
    items = [("null" if i is None else i, t) for i, t in ITEMS]
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        want = slow(r.text if len(r.text or "") < 1000 else r.text[:16] * 3, items)
        if len(r.text or "") < 1000:
            assert (r.found.n_words, r.found.n_hit, r.found.items) == want
            for a, b in r.found.spans:
                assert WORD.fullmatch(r.text[a]) and WORD.fullmatch(r.text[b - 1])
        else:
            assert (r.found.n_hit, r.found.items) == (11998, ["7"])  # windows start and end with the first word of a line
            assert [tuple(s) for s in r.found.spans] == [(0, len(r.text) - len(" und mehr\n"))]


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_automata_are_built_once_a_run(spark, chunk):
    """Six batches in one task, three blocks: all six in one run, or each a run, which finds one automaton at hand."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        names = ["alpha beta", "gamma delta", "epsilon zeta"]
        bench = spark.createDataFrame(list(enumerate(names)), "item_id long, text string").coalesce(1)
        df = spark.createDataFrame([(i, f"so {names[i % 3]} {i}") for i in range(60)], "doc_id long, text string").coalesce(1)
        builds = spark.sparkContext.accumulator(0)
        got = decontaminate.contamination(df, bench, block_bytes=1, chunk_bytes=chunk, builds=builds).collect()
        assert all((r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (4, 2, [str(r.doc_id % 3)]) for r in got) and len(got) == 60
        assert builds.value == (3 if chunk > 1 else 3 + 5 * 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_windows_do_not_start_inside_words(spark):
    bench = spark.createDataFrame([(1, "cat sat")], "item_id long, text string")
    df = spark.createDataFrame([(1, "the concat sat"), (2, "a CAT, sat."), (3, "cat saturn")], "doc_id long, text string")
    got = {r.doc_id: (r.hits.n_hit, [tuple(s) for s in r.hits.spans]) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {1: (0, []), 2: (2, [(2, 10)]), 3: (0, [])}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(r.hits.n_hit == 0 for r in decontaminate.contamination(cases.docs(spark), bench).collect())
    assert decontaminate.contamination(cases.none(spark), bench).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_scan_against_brute_force(window):
    """Few words, so that windows overlap, repeat and belong to several items."""
    rng = random.Random(window)
    draw = lambda n: " ".join(rng.choice("abc") + str(rng.randrange(2)) for _ in range(n))
    items = [(str(rng.randrange(12)), draw(rng.randrange(0, 3 * window))) for _ in range(15)]
    built = decontaminate.build(items, window)
    for _ in range(200):
        text = draw(rng.randrange(0, 40))
        if rng.random() < 0.6:
            text += ", " + rng.choice(items)[1].upper() + "! " + draw(rng.randrange(4))
        found = decontaminate.words(text.encode())
        hit, met = decontaminate.hits(found, built)
        assert (len(found), int(hit.sum()), sorted(built.names[i] for i in met)) == slow(text, items, window)


def test_spans_of_a_long_text_in_linear_time():
    text = ("Ünd x. " * 400_000).encode()
    hit = np.zeros(800_000, bool)
    hit[::2] = True
    began = time.perf_counter()
    got = decontaminate.spans(text, hit)
    assert time.perf_counter() - began < 10
    assert len(got) == 400_000 and got[0] == (0, 3) and got[-1] == (7 * 399_999, 7 * 399_999 + 3)
