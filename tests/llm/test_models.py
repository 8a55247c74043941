"""Toxicity, quality and language-model scores: held-out accuracy, brute force, awkward input."""

import math
import time
import zlib

import numpy as np
import pytest

from tests.llm import cases
from tidewheel.llm import labelled, lmscore, quality, toxicity


def pack(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def slow_words(text):
    return "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalnum() else " " for c in text).split(" ")


def test_subwords_are_those_of_words():
    texts = ["Idiot, you", "", "ÉOI--x", "idiot", "ab"]
    grams, owner = toxicity.subwords(*pack(texts))
    for i, t in enumerate(texts):
        want = sum(max(0, len(f"<{w}>") - n + 1) for w in slow_words(t) if w for n in toxicity.GRAMS)
        assert (owner == i).sum() == want
    one = toxicity.subwords(*pack(["idiot"]))[0]
    assert set(one.tolist()) <= set(grams[owner == 0].tolist())


def _toxic_rows(n, seed):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("aeioulrnst"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for k in range(n):
        w = [plain[i] for i in rng.integers(0, 400, rng.integers(8, 120))]
        y = k % 3 == 0
        if y:
            for _ in range(1 + len(w) // 40):
                w[rng.integers(len(w))] = ["grumbolin", "fizzwacker"][rng.integers(2)] + ["", "ish", "er"][rng.integers(3)]
        rows.append((" ".join(w), int(y)))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings():
    model = toxicity.train(_toxic_rows(900, 1))
    test = _toxic_rows(300, 2)
    s = toxicity.score_texts(*pack([t for t, _ in test]), *model)
    y = np.array([b for _, b in test])
    assert (s[y == 1] >= 0.7).mean() > 0.9 and (s[y == 0] >= 0.7).mean() < 0.05
    odd = toxicity.score_texts(*pack(["you grumbolinn total grumboliny thing", "you simple total normal thing"]), *model)
    assert odd[0] > odd[1]


def test_equal_texts_score_equally_in_any_batch():
    model = toxicity.train(_toxic_rows(200, 3))
    texts = ["fizzwacker here", "", "quiet words", "fizzwacker here"]
    all_ = toxicity.score_texts(*pack(texts), *model)
    each = [toxicity.score_texts(*pack([t]), *model)[0] for t in texts]
    assert all_.tolist() == pytest.approx(each) and all_[0] == all_[3]


@pytest.mark.parametrize(("rows", "high"), [([], False), ([("a b", 0)], False), ([("a b", 1), ("c d", 1)], True)])
def test_one_class_or_none(rows, high):
    s = toxicity.score_texts(*pack(["x y z"]), *toxicity.train(rows))[0]
    assert (s > 0.9) == high
    assert (quality.score_texts(*pack(["x y z", ""]), quality.train(rows)) > 0.9).all() == high


def slow_marginals(unary, links):
    n = len(unary)
    weight = np.zeros(n)
    total = 0.0
    for code in range(1 << n):
        lab = [code >> i & 1 for i in range(n)]
        w = math.exp(sum((u / 2 if y else -u / 2) for u, y in zip(unary, lab, strict=True)) + sum(links[a][b] for a, b in zip(lab[:-1], lab[1:], strict=True)))
        total += w
        weight += w * np.array(lab)
    return weight / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    lines = np.array([1, 5, 3, 7])
    unary = rng.normal(size=lines.sum())
    links = rng.normal(size=(2, 2))
    got, pairs = quality.marginals(unary, lines, links)
    at = np.cumsum(lines) - lines
    for a, n in zip(at, lines, strict=True):
        assert got[a : a + n] == pytest.approx(slow_marginals(unary[a : a + n], links))
    assert pairs.sum() == pytest.approx((lines - 1).sum())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 997])
def test_blocks_of_a_long_chain_agree_with_single_steps(n, monkeypatch):
    rng = np.random.default_rng(n)
    unary, links, lines = rng.normal(size=n + 5) * 4, rng.normal(size=(2, 2)), np.array([3, n, 2])
    want = quality.marginals(unary, lines, links)
    monkeypatch.setattr(quality, "LONG_CHAIN", 1)
    got = quality.marginals(unary, lines, links)
    assert got[0] == pytest.approx(want[0], abs=1e-12) and got[1] == pytest.approx(want[1])


def test_a_text_of_very_many_lines_is_scored_in_blocks():
    model = quality.train(_quality_rows(100, 5))
    began = time.perf_counter()
    score = quality.score_texts(*pack(["a\n" * 400_000, "a\n" * 400_001]), model)
    assert time.perf_counter() - began < 15 and score[0] == pytest.approx(score[1], abs=1e-4)


def test_repeated_words_are_compared_whole():
    """Words of one length that share their first eight bytes aren't repeats."""
    x, _, _ = quality.line_features(*pack(["internationalA internationalB internationalC", "international international international"]))
    differ = np.flatnonzero(x[0] != x[1])
    assert len(differ) and not np.array_equal(x[0], x[1])
    share = 12  # the plain share of repeated words lies behind the bias, six plain features and five shares
    assert x[0][share] == 0 and x[1][share] == pytest.approx(2 / 3)


def slow_quality(text, model):
    """The length-weighted mean of enumerated marginals of a short text."""
    x, size, _ = quality.line_features(*pack([text]))
    good = slow_marginals((x @ model[0].astype(np.float32)).astype(float), model[1])
    return sum(g * s for g, s in zip(good, size, strict=True)) / size.sum()


def test_document_scores_against_enumeration():
    model = quality.train(_quality_rows(200, 8))
    texts = [t for t, _ in _quality_rows(30, 9)] + ["", "one line", "a\n\nb\n"]
    assert quality.score_texts(*pack(texts), model).tolist() == pytest.approx([slow_quality(t, model) for t in texts], abs=1e-5)


def slow_toxicity(text, weights, bias):
    """The softmax over the mean of n-gram weights, word by word."""
    total = count = 0
    for w in "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalnum() else " " for c in text).split(" "):
        whole = "\x01" + w + "\x01"
        for n in toxicity.GRAMS:
            for i in range(len(whole) - n + 1 if w else 0):
                h = 0
                for k, c in enumerate(whole[i : i + n]):
                    m = 0xFFFFFFFF
                    h = ord(c) * 0x9E3779B1 & m if k == 0 else ((h ^ h >> 15) * 0x85EBCA6B + ord(c) * 0xC2B2AE35) & m
                h = (h ^ h >> 13) * 0x27D4EB2F & 0xFFFFFFFF
                total += float(weights[h >> (32 - toxicity.TABLE_BITS)])
                count += 1
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total / (count + toxicity.BLANKS) + bias))))


def test_toxicity_scores_against_brute_force():
    model = toxicity.train(_toxic_rows(300, 4))
    texts = [t for t, _ in _toxic_rows(20, 5)] + ["", "?!", "Éa fizzWACKER\x01\u0130x 12", "a" * 50]
    assert toxicity.score_texts(*pack(texts), *model).tolist() == pytest.approx([slow_toxicity(t, *model) for t in texts], abs=1e-6)


@pytest.mark.parametrize("name", ["op5_toxicity", "op9_quality"])
def test_score_queries(name, spark, sf):
    """Whole table, held-out rows marked, equal to the model applied row by row, right on held-out labels."""
    from tidewheel.llm.queries import QUERIES

    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has too few labels to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    module, bar = (toxicity, 0.7) if name == "op5_toxicity" else (quality, 0.5)
    model = module.fit(docs, labels)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= bar)
    some = sorted(texts)
    want = toxicity.score_texts(*pack([texts[i] for i in some]), *model) if module is toxicity else quality.score_texts(*pack([texts[i] for i in some]), model)
    assert [rows[i].score for i in some] == pytest.approx(want.tolist(), abs=1e-5)
    told = [(r["toxic" if module is toxicity else "quality"], rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    ups, downs = [r.score for y, r in told if y], [r.score for y, r in told if not y]
    # 33 toxic labels to learn from put held-out rows in order, though few over the bar; the README has figures of large tables
    assert np.mean([u > d for u in ups for d in downs]) >= (0.8 if module is toxicity else 0.95)
    if module is quality:
        assert sum(y == r.predicted for y, r in told) >= 0.95 * len(told)


def test_sample_of_text_ids_and_clashing_columns(spark):
    docs = cases.docs(spark).selectExpr("concat('d', cast(doc_id as string)) as doc_id", "text", "lang as judged", "source as tokens", "n_chars as toxicity", "hits as quality", "shard as line_quality", "mix as key", "mix as at", "mix as y")
    labels = spark.createDataFrame([("d1", 1, 0), ("d2", 0, 1), ("d4", 1, 0), ("d5", 0, 0), ("d8", 1, 1)], "doc_id string, quality int, toxic int")
    tox, qual = toxicity.with_toxicity(docs, labels), quality.with_quality(docs, labels)
    assert set(tox.columns) == set(docs.columns) and set(qual.columns) == set(docs.columns)
    assert all(0 <= r.toxicity <= 1 for r in tox.collect()) and all(0 <= r.quality <= 1 for r in qual.collect())


def test_one_id_of_many_texts_gives_one_sample_row(spark):
    docs = spark.range(3000).selectExpr("cast(1 as long) AS doc_id", "concat('text number ', id) AS text").unionByName(spark.createDataFrame([(2, "other")], "doc_id long, text string"))
    rows, _ = labelled.training_rows(docs, cases.labels(spark, [(1, 1, 0), (2, 0, 0)]), "quality")
    assert len(rows) <= 2


def _quality_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        body = [" ".join("".join(rng.choice(list("aeiourst"), 5)) for _ in range(rng.integers(3, 12))) + "." for _ in range(rng.integers(1, 9))]
        if k % 2 == 0:
            body = [line.upper().replace(" ", "!! ") if k % 4 else line.replace(" ", " | ") for line in body]
        rows.append(("\n".join(body), k % 2))
    return rows


def test_quality_on_held_out_rows():
    model = quality.train(_quality_rows(300, 5))
    test = _quality_rows(200, 6)
    s = quality.score_texts(*pack([t for t, _ in test]), model)
    assert ((s >= 0.5) == np.array([y for _, y in test])).mean() > 0.97
    texts = [t for t, _ in test[:20]]
    assert s[:20].tolist() == pytest.approx([quality.score_texts(*pack([t]), model)[0] for t in texts], abs=1e-5)


def test_line_features_of_empty_texts():
    x, size, lines = quality.line_features(*pack(["", "a\n\nb", "", "\n"]))
    assert lines.tolist() == [1, 3, 1, 2] and len(x) == len(size) == 7


def test_training_never_sees_the_held_out_third(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "cast(id as string) AS text")
    labels = cases.labels(spark, [(i, i % 2, 0) for i in range(200)] + [(3, 0, 1), (None, 1, 1)])
    rows, prior = labelled.training_rows(docs, labels, "quality")
    seen = {int(t) for t, _ in rows}
    assert seen == {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1} - {3}
    assert 0.4 < prior < 0.6
    few, _ = labelled.training_rows(docs, labels, "quality", rows=40)
    assert len(few) < 80 and few == labelled.training_rows(docs.repartition(5), labels, "quality", rows=40)[0]
    small, _ = labelled.training_rows(docs, labels, "quality", size=60)
    assert 0 < len(small) < len(rows)


@pytest.mark.parametrize("rows", [(), [(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, 0, 0)]])
def test_awkward_documents(spark, rows):
    df, labels = cases.docs(spark), cases.labels(spark, rows)
    tox = toxicity.with_toxicity(df, labels).collect()
    qual = quality.with_quality(df, labels).collect()
    assert len(tox) == len(qual) == df.count()
    assert all(0 <= r.toxicity <= 1 for r in tox) and all(0 <= r.quality <= 1 for r in qual)
    assert len({r.toxicity for r in tox if r.doc_id in (3, 4)}) == 1
    assert [len(r.line_quality) for r in qual if r.doc_id in (3, 4)] == [1, 1]
    assert {r.hits for r in tox} == {"h"}
    assert toxicity.with_toxicity(cases.none(spark), labels).count() == 0
    assert quality.with_quality(cases.none(spark), labels).count() == 0


def slow_slot(data, i, k):
    gram = 0
    for j in range(k + 1):
        gram |= (data[i - j] if i - j >= 0 else 0) << (8 * j)
    return gram


def slow_losses(texts, marks):
    counts = [{}, {}]
    for t, m in zip(texts, marks, strict=True):
        for i in range(len(t)):
            for k in range(lmscore.ORDER):
                for model in (0, 1) if m else (0,):
                    key = (k, slow_slot(t, i, k))
                    counts[model][key] = counts[model].get(key, 0) + 1
    out = []
    for t in texts:
        row = []
        for c in counts:
            total = max(1, sum(v for (k, _), v in c.items() if k == 0))
            bits = 0.0
            for i in range(len(t)):
                p = lmscore.WEIGHTS[0] / 256 + lmscore.WEIGHTS[1] * c.get((0, t[i]), 0) / total
                for k in range(1, lmscore.ORDER) if i else ():
                    n = c.get((k, slow_slot(t, i, k)), 0)
                    before = c.get((k - 1, slow_slot(t, i - 1, k - 1)), 0)
                    p += lmscore.WEIGHTS[k + 1] * n / max(before, n, 1)
                if not i:
                    opening = slow_slot(t, 0, lmscore.ORDER - 1)
                    p += sum(lmscore.WEIGHTS[2:]) * c.get((lmscore.ORDER - 1, opening), 0) / max(1, sum(v for (k, g), v in c.items() if k == lmscore.ORDER - 1 and g < 256))
                bits -= math.log2(p)
            row.append(bits / max(1, len(t)))
        out.append(row)
    return out


def test_lm_scores_against_brute_force(spark):
    texts = ["the cat sat on the mat", "le chat était là", "", None, "the the the", "zzz"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lm string")
    targets = spark.createDataFrame([(0,), (4,), (4,), (None,), (99,)], "doc_id long")
    got = {r.doc_id: r.lm for r in lmscore.with_target_scores(df, targets).collect()}
    want = slow_losses([(t or "").encode() for t in texts], [i in (0, 4) for i in range(6)])
    for i, (b, t) in enumerate(want):
        assert got[i].n_tokens == len((texts[i] or "").encode())
        assert (got[i].background_loss, got[i].target_loss) == pytest.approx((b, t), rel=1e-4)
        assert got[i].score == pytest.approx(t - b, abs=1e-3)
    assert got[4].score < 0 < got[5].score


def test_lm_awkward(spark):
    df = cases.docs(spark)
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.with_target_scores(df, none).count() == df.count()
    assert lmscore.with_target_scores(cases.none(spark), df.select("doc_id")).count() == 0


def exact_losses(texts, marks):
    """As slow_losses, but n-grams are told apart by their own bytes."""
    pad = [bytes(lmscore.ORDER - 1) + t for t in texts]
    spot = lambda p, i, k: (k, p[i + lmscore.ORDER - 1 - k : i + lmscore.ORDER])
    counts = [{}, {}]
    for p, t, m in zip(pad, texts, marks, strict=True):
        for i in range(len(t)):
            for k in range(lmscore.ORDER):
                for model in (0, 1) if m else (0,):
                    counts[model][spot(p, i, k)] = counts[model].get(spot(p, i, k), 0) + 1
    for p, t in zip(pad, texts, strict=True):
        row = []
        for c in counts:
            total = max(1, sum(v for (k, _), v in c.items() if k == 0))
            bits = 0.0
            for i in range(len(t)):
                prob = lmscore.WEIGHTS[0] / 256 + lmscore.WEIGHTS[1] * c.get(spot(p, i, 0), 0) / total
                for k in range(1, lmscore.ORDER) if i else ():
                    n = c.get(spot(p, i, k), 0)
                    prob += lmscore.WEIGHTS[k + 1] * n / max(c.get(spot(p, i - 1, k - 1), 0), n, 1)
                if not i:
                    opened = sum(v for (k, g), v in c.items() if k == lmscore.ORDER - 1 and not any(g[:-1]))
                    prob += sum(lmscore.WEIGHTS[2:]) * c.get(spot(p, 0, lmscore.ORDER - 1), 0) / max(1, opened)
                bits -= math.log2(prob)
            row.append(bits / max(1, len(t)))
        yield row


def test_first_bytes_are_a_law(spark):
    """Over all first bytes the masses of either model add up to what orders above the first and the bytes that occur have."""
    texts = [bytes([65 + k % 16]).decode() + "x" * (k % 5) for k in range(48)] + ["\x00\x00\x00\x00q"]
    df = spark.createDataFrame([(t, k % 3 == 0) for k, t in enumerate(texts)], "text string, target boolean")
    rows = lmscore.loss_table(lmscore.count(df)).where("gram < 256").collect()
    for model, own in (("first_background", texts), ("first_target", texts[::3])):
        mass = sum(2 ** -r[model] for r in rows)
        seen = "".join(own).encode()
        there = {r.gram for r in rows}
        want = sum(lmscore.WEIGHTS[2:]) + lmscore.WEIGHTS[0] * len(there) / 256 + lmscore.WEIGHTS[1] * sum(b in there for b in seen) / len(seen)
        assert mass == pytest.approx(want, rel=1e-5) and mass <= 1


def test_lm_counts_every_ngram_by_itself(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(0, 0x3000, 9000))) for _ in range(8)] + ["\x00\x00\x00a", "a", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    targets = spark.createDataFrame([(0,), (1,), (9,)], "doc_id long")
    want = list(exact_losses([t.encode() for t in texts], [i in (0, 1, 9) for i in range(len(texts))]))
    for block in (lmscore.BLOCK_GRAMS, 50_000):  # one block, and several
        for r in lmscore.with_target_scores(df, targets, block).collect():
            assert (r.lm.background_loss, r.lm.target_loss) == pytest.approx(want[r.doc_id], rel=1e-6)


def test_lm_query(spark, sf):
    from tidewheel.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    want = dict(zip([r.doc_id for r in docs], exact_losses([(r.text or "").encode() for r in docs], [r.doc_id in good for r in docs]), strict=True))
    rows = QUERIES["op7_lm_score"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.background_loss, r.target_loss) == pytest.approx(want[r.doc_id], rel=1e-5)
        assert r.score == pytest.approx(r.target_loss - r.background_loss, abs=1e-9)
