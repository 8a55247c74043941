import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from tidewheel.llm import packing, queries


@pytest.fixture(scope="module")
def plainly():
    """The vocabulary's own ids of a whole text, in one call."""
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["a\x1cb\x85c d e　f", "<|endoftext|> x<|startoftext|>y.", "don't I'LL 's 'S.", "éá 가 ᄀ ᅡ", "ΟΔΟΣ. İstanbul,", "日本語." * 30, "foo. a.b, x². Ⅷ. ª. K̊. .,", "ABC <|END 12345 6.7\r\n8", " ́x á\n", "×. ÷, é. -. a-. €,"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_vocabularys(text, plainly):
    assert np.frombuffer(packing.coder(packing.default_vocabulary()).ids(text.encode()), "<u4").tolist() == plainly(text)[:-1]


@given(st.text(alphabet="aAé.,' \n\t́ <|1ß\U0001f600", max_size=40))
@settings(max_examples=200, deadline=None)
def test_ids_of_any_text(text):
    code = packing.coder(packing.default_vocabulary())
    assert np.frombuffer(code.ids(text.encode()), "<u4").tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids


def test_small_store_and_steps_change_nothing(monkeypatch, plainly):
    monkeypatch.setattr(packing, "KEPT_RUNS", 3)
    monkeypatch.setattr(packing, "STEP_BYTES", 7)
    code = packing.Coder(packing.default_vocabulary())
    text = "One two, three. Four fünf six seven eight nine, ten. " + "long" * 40 + ". " + "One two."
    assert np.frombuffer(code.ids(text.encode()), "<u4").tolist() == plainly(text)[:-1]


def slow_best_fit(lengths, capacity):
    """Best fit, longest first, a piece at a time: how many sequences."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


@given(st.lists(st.integers(1, 24), max_size=120))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit(lengths):
    plan = packing.plan(dict(Counter(lengths)), 24)
    taken = {}
    for length in set(lengths):
        mine = plan[plan[:, 0] == length]
        for rank in range(lengths.count(length)):
            _, first, sequence, each, offset = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            taken.setdefault(sequence + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
    for held in taken.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 24
    assert len(taken) == slow_best_fit(lengths, 24)


def whole(rows, docs, plainly, capacity):
    """Every document's ids, from its pieces; offsets without gaps; pieces cut only where they must be."""
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, []).append(r)
    texts = {}
    for d in docs:
        texts.setdefault(d.doc_id, []).append(plainly(d.text))
    assert set(ids) == set(texts)
    for doc, own in texts.items():
        want = sorted((n, len(t[lo : lo + capacity]), lo, zlib.crc32(np.array(t[lo : lo + capacity], "<u4").tobytes())) for t in own for n, lo in enumerate(range(0, len(t), capacity)))
        assert sorted((r.piece, r.length, r.start, r.ids_crc32) for r in ids[doc]) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_against_plain_best_fit(spark, sf, plainly):
    rows = queries.QUERIES["op11_pack"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert whole(rows, docs, plainly, packing.CAPACITY) == slow_best_fit([r.length for r in rows], packing.CAPACITY)


def test_awkward_rows(spark, plainly):
    docs = cases.docs(spark).repartition(3)
    packed = packing.pack(docs, capacity=100, ids=True)
    rows = packed.collect()
    n = whole(rows, docs.collect(), plainly, 100)
    assert n == slow_best_fit([r.length for r in rows], 100)
    made = packing.sequences(packed).collect()
    assert len(made) == n and all(len(s.ids) <= 100 and len(s.doc_ids) == len(s.starts) for s in made)
    assert sorted(i for s in made for i in s.ids) == sorted(i for r in rows for i in r.ids)
    assert packing.pack(cases.none(spark)).count() == 0


def test_many_equal_lengths_over_many_tasks(spark, plainly):
    docs = spark.range(3000).selectExpr("id % 7 as doc_id", "if(id % 3 = 0, null, 'one two') as text").repartition(9)
    rows = packing.pack(docs, capacity=8).collect()
    assert whole(rows, docs.collect(), plainly, 8) == slow_best_fit([r.length for r in rows], 8)


def test_plain_words_need_no_full_encoding(monkeypatch):
    """Small Latin-1 letters, and marks behind them, give the vocabulary's ids without its normaliser and splitting."""
    path = packing.default_vocabulary()
    text = "thhaedhe bebe. onntha.%%% esthat$$$ heitßch, ñezóas, èçque!? naïveÿ don't x'll, a'%s ÷ a÷b abc<|endoftext|> c<|x| é́a µm q_r_ [z] z[] z\\^`"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Coder(path).ids(text.encode()), "<u4").tolist() == want
    code, given = packing.Coder(path), []
    monkeypatch.setattr(code, "tokenizer", type("Seen", (), {"encode_batch_fast": lambda self, runs, **kw: given.extend(runs) or packing.coder(path).tokenizer.encode_batch_fast(runs, **kw)})())
    code.ids("thhaedhe onntha.%%% heitßch, èçque!? esthat$$$".encode())
    assert set(given) == {".%%%", ",", "!?", "$$$"}
