import random

import numpy as np
import pytest
import xxhash

from tests.llm import cases
from tidewheel.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, budget=4):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", ["", " \n", "a", "A b C", "a b c d", "A b c d e f g a b c d", "ünï Çode x\x0by\x0cz w", "x " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize(("seed", "near"), [(1, 0), (2, 120), (3, 300)])
def test_trie_walk_finds_every_pair(seed, near):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    keys = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(near):
        x = centre
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        keys.add(x)
    keys = np.array(sorted(keys), np.uint64)
    got = {(int(i), int(j)) for a, b in simhash.close_pairs(keys, np.array([[0, len(keys), 0, len(keys), 0, 0]]), 4) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 4}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("rows", [8192, 16])
def test_links_connect_what_pairs_connect(spark, rows):
    rng = random.Random(7)
    prints = {0, 2**64 - 1, 15}
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([([signed(p)],) for p in prints], "fp array<long>")
    from tidewheel.operators.components import connected_components

    links = simhash.similar_links(df, subtrie_rows=rows)
    found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in connected_components(links).collect()}
    groups, want = {}, {}
    for p in prints:
        groups.setdefault(found.get(p, p), set()).add(p)
    for p, r in components(prints).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_awkward_documents(spark):
    df = cases.docs(spark)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == 1 and by[5] == by[6] == 5 and by[3] == by[4] == by[7] == 3
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 8, 9]
    assert simhash.near_duplicates(cases.none(spark)).count() == 0
    assert simhash.drop_near_duplicates(cases.none(spark)).count() == 0


def test_query_against_brute_force(spark, sf):
    from tidewheel.llm.queries import QUERIES

    texts = {r.doc_id: slow_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    root = components(set(texts.values()))
    first = {}
    for i, p in sorted(texts.items()):
        first.setdefault(root[p], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, sf).collect()}
    assert got == {i: (f"{p:016x}", first[root[p]]) for i, p in texts.items()}


def test_a_large_subtrie_is_copied_a_bounded_number_of_times(spark):
    """Nodes are paired only within the budget, all pairs within it meet, and once."""
    rng = random.Random(3)
    front = 0x2A5 << 43
    prints = sorted({front | rng.getrandbits(43) for _ in range(2000)})
    df = spark.createDataFrame([(1, signed(p), 21) for p in prints], "own long, key long, width int")
    dealt = simhash.node_pairs(df, 2, subtrie_rows=16).collect()
    copies, met = {}, {}
    for r in dealt:
        copies[r.key] = copies.get(r.key, 0) + 1
        met.setdefault(r.pair, ([], []))[r.side].append(r.key & (2**64 - 1))
    bits, deals = 8, 4  # 2,000 rows in nodes of 8
    assert set(copies) == {signed(p) for p in prints}
    assert max(copies.values()) <= (1 + bits + bits * (bits - 1) // 2) * deals < len(met)
    seen = set()
    for pair, (a, b) in met.items():
        own = pair >> 32 == pair & 0xFFFFFFFF
        assert bool(b) != own
        seen |= {(min(x, y), max(x, y)) for x in a for y in (a if own else b) if x != y}
    close = {(x, y) for i, x in enumerate(prints) for y in prints[i + 1 :] if (x ^ y).bit_count() <= 2}
    assert close <= seen


def grams(text, size=5):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def slow_wide(text, words=10):
    m, b = 1 << 64, 0x9E3779B97F4A7C15
    if not grams(text):
        return (0,) * words
    hashes = []
    for gram in grams(text):
        v = sum((c + 1) * pow(b, k, m) for k, c in enumerate(gram)) % m
        hashes.append(v ^ (len(gram) * b % m))
    out = []
    for k in range(words):
        mixed = []
        for h in hashes:
            z = (h + (k + 1) * b) % m
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % m
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % m
            mixed.append(z ^ (z >> 31))
        out.append(sum(1 << at for at in range(64) if 2 * sum(h >> at & 1 for h in mixed) > len(mixed)))
    return tuple(out)


def slow_wide_links(prints):
    """The links that leave the wide net, said plainly: {name: words} to {(name, name): bits}."""
    out = {}
    for k in range(10):
        for block in range(4):
            part = lambda n, k=k, block=block: prints[n][k] >> (48 - 16 * block) & 0xFFFF
            for a in prints:
                met = []
                for b in prints:
                    total = sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
                    if a != b and part(a) == part(b) and (prints[a][k] ^ prints[b][k]).bit_count() <= 14 and total <= 122:
                        met.append((total, b))
                likely = [(b, d) for d, b in met if d <= 100]
                for d, b in ([min(met)] if met else []) + ([min(likely)[::-1]] if likely else []):
                    out[min(a, b), max(a, b)] = d
    return out


def overlaps(texts, least):
    """Every pair of texts whose five-word shingle sets overlap by ``least`` or more: {(id, id): overlap}."""
    sets = {i: set(grams(t)) for i, t in texts.items()}
    where, out = {}, {}
    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in where.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            where[g].append(i)
        for j, n in shared.items():
            if n >= least * (len(s) + len(sets[j]) - n):
                out[j, i] = n / (len(s) + len(sets[j]) - n)
    empty = [i for i, s in sets.items() if not s]
    return out | {(a, b): 1.0 for a, b in zip(empty, empty[1:], strict=False)}


def exact_groups(texts):
    """{id: the smallest id that overlaps of 0.8 or more lead to}."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in overlaps(texts, 0.8):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_wide_fingerprints():
    texts = ["", " \n", "a", "A b C", "a b c d e", "A b c d e f g a b c d e", "ünï Çode x\x0by\x0cz w v", "x " * 3000, "x y " * 700]
    got, marks = simhash.wide_fingerprints([t.encode() for t in texts])
    assert [tuple(int(v) for v in r) for r in got] == [slow_wide(t) for t in texts]
    same = {}
    for t, m in zip(texts, marks.tolist(), strict=True):
        same.setdefault(m, set()).add(frozenset(grams(t)))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({frozenset(grams(t)) for t in texts})


@pytest.mark.parametrize("rows", [8192, 16])
def test_wide_links_against_the_plain_rule(spark, rows):
    rng = random.Random(11)
    prints = {}
    for centre in range(6):
        words = [rng.getrandbits(64) for _ in range(10)]
        for k in range(15):
            noise = [sum(1 << b for b in range(64) if rng.random() < rng.choice((0.01, 0.1, 0.16))) for _ in range(10)]
            prints[centre * 100 + k - 250] = tuple(w ^ x for w, x in zip(words, noise, strict=True))
    df = spark.createDataFrame([([n, *map(signed, w)],) for n, w in prints.items()], "fp array<long>")
    got = {(r.src, r.dst): r.bits for r in simhash.wide_links(df, subtrie_rows=rows).collect()}
    if rows == 8192:
        assert got == slow_wide_links(prints)
    else:  # a cut subtrie hands on the best of each of its pairs of nodes
        want = slow_wide_links(prints)
        assert want.items() <= got.items()
        assert all(d == sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= 122 for (a, b), d in got.items())


def test_every_pair_of_a_table_compared_exactly(spark):
    """No row goes without a partner at 0.8; of pairs at 0.85 none keeps both rows, and of those from 0.8 on at most 5 %."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    pairs = overlaps(texts, 0.8)
    partnered = {i for p in pairs for i in p}
    assert set(texts) - kept <= partnered
    root = exact_groups(texts)
    assert all(kept & {j for j in texts if root[j] == root[i]} for i in texts)  # a row of each group is there
    unequal = {p: o for p, o in pairs.items() if texts[p[0]] != texts[p[1]]}
    lost = {p: o for p, o in unequal.items() if p[0] in kept and p[1] in kept}
    assert len(unequal) >= 10 and not [p for p, o in lost.items() if o >= 0.85] and len(lost) <= 0.05 * len(unequal)


def test_near_copies_of_four_fifths_are_dropped(spark):
    """Of pairs that share 0.8 of their five-word shingles or more, 95 in 100 lose a row; of pairs under 0.8, none."""
    rng = random.Random(5)
    texts, overlap = {}, {}
    for k in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts[2 * k] = " ".join(w)
        for at in rng.sample(range(300), rng.randrange(1, 11)):
            w[at] = f"v{rng.randrange(10**6)}"
        texts[2 * k + 1] = " ".join(w)
        a, b = set(grams(texts[2 * k])), set(grams(texts[2 * k + 1]))
        overlap[k] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {2 * k for k in overlap} <= kept
    near, far = [k for k, o in overlap.items() if o >= 0.8], [k for k, o in overlap.items() if o < 0.8]
    assert len(near) >= 100 and len(far) >= 50
    assert sum(2 * k + 1 not in kept for k in near) >= 0.95 * len(near)
    assert all(2 * k + 1 in kept for k in far)


def test_nulls_of_different_columns_are_told_apart(spark):
    rows = [(1, "one text", None, "a", {"k": 1}), (1, "one text", "a", None, {"k": 1}), (1, "one text", "a", None, {"k": 1})]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, more map<string,int>")
    tags = [r.t for r in df.select(simhash._tag(df).alias("t")).collect()]
    assert tags[0] != tags[1] == tags[2]
    assert simhash.drop_near_duplicates(df).count() == 1
    twins = simhash.drop_near_duplicates(df.where("lang = 'a'")).collect()
    assert [(r.doc_id, r.lang, r.source, r.more) for r in twins] == [(1, "a", None, {"k": 1})]


def test_repeated_null_and_tied_rows(spark):
    """One row of each group stays: the smallest doc_id, null last; then one of the rows that share it."""
    copy, other = "a copied text of several words in a row for all", "something wholly different that stands alone over here"
    rows = [(None, copy, "x"), (None, copy, "y"), (None, other, "x"), (None, other, "x"), (7, copy, "a"), (7, copy, "b"), (7, copy, "b"), (8, copy, "a"), (9, None, "a"), (None, "", "a"), (10, other + " but not quite the same as that one", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.gone_id) for r in kept.collect()), key=str)
    assert [g[:2] for g in got if g[1] == copy] == [(7, copy)]
    assert [g for g in got if g[1] == other] == [(None, other, "x")]
    assert [g[:2] for g in got if not g[1]] == [(9, None)] and len(got) == 4
    # string ids, and the rows' order doesn't matter
    text_ids = df.selectExpr("cast(doc_id as string) as doc_id", "text", "gone_id").repartition(3)
    assert simhash.drop_near_duplicates(text_ids).count() == 4


def test_rows_of_one_id_are_dropped_by_their_own_text(spark):
    copy, other, third = "a copied text of several words in a row", "something wholly different that stands alone here", "zebras graze on yet another unrelated plain tonight"
    rows = [(1, copy), (2, copy), (2, other), (3, third), (3, other), (3, third), (4, None), (4, "one more text that nobody else has written down")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, copy), (2, other), (3, third), (4, ""), (4, rows[-1][1])])


def kept_ids(spark, texts, slices=4):
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), slices), "doc_id long, text string")
    return {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}


def test_no_link_at_four_fifths_is_lost(spark):
    """Groups that hang on single pairs just over 0.8, with nearer mates under it: the net meets or hands on too few of them."""
    rng = random.Random(6)
    texts = {}
    for k in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((64, 104, 204)))]
        texts[3 * k] = " ".join(w)
        n = len(w) - 4
        # a run of changed words costs its length plus four shingles: j = n - run - 4 shared of 2 n - j
        run = max(r for r in range(1, n) if (n - r - 4) >= 0.8 * (2 * n - (n - r - 4)))
        at = rng.randrange(4, len(w) - run - 4)
        texts[3 * k + 1] = " ".join(w[:at] + [f"v{rng.randrange(10**6)}" for _ in range(run)] + w[at + run :])
        texts[3 * k + 2] = " ".join(w[: at - 1] + [f"u{rng.randrange(10**6)}" for _ in range(run + 1)] + w[at + run :])
    root = exact_groups(texts)
    assert sum(i != r for i, r in root.items()) >= 400
    assert kept_ids(spark, texts) == set(root.values())


def test_texts_of_one_repeated_line_are_no_copies(spark):
    line = "one line that is there once more "
    texts = {k: line * 400 + " ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)}
    assert kept_ids(spark, texts) == set(texts)


def test_a_table_keeps_one_row_of_each_exact_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(exact_groups(texts).values())


@pytest.mark.parametrize("common", [0, 50, 400])
def test_fronts_of_similar_sets_meet(common):
    rng = np.random.default_rng(common)
    known = np.unique(rng.integers(0, 2**63, common).astype(np.uint64))
    counts = rng.integers(4, 20, len(known))
    for n in [*range(1, 30), 100, 399]:
        pool = np.concatenate((known, rng.integers(0, 2**63, 400).astype(np.uint64)))
        a = rng.choice(pool, n, replace=False)
        for m in range(int(np.ceil(0.8 * n)), n + 1):
            b = rng.choice(a, m, replace=False)
            assert len(np.intersect1d(simhash.front(np.sort(a), known, counts), simhash.front(np.sort(b), known, counts)))


@pytest.mark.parametrize("common", [0, 200])
def test_keys_of_sets_that_just_overlap_meet(common):
    """Sets at 0.8 or the least above it, of other sizes and octaves, each with shingles of its own."""
    rng = np.random.default_rng(common)
    known = np.unique(rng.integers(0, 2**63, common).astype(np.uint64))
    counts = rng.integers(4, 20, len(known))
    for n in [*range(4, 40), 63, 64, 65, 130, 300]:
        for _ in range(8):
            pool = rng.permutation(np.concatenate((known, rng.integers(0, 2**63, 3 * n).astype(np.uint64))))
            m = int(rng.integers(int(np.ceil(0.8 * n)), int(n / 0.8 + 1e-6) + 1))
            share = int(np.ceil((n + m) * 0.8 / 1.8 - 1e-6))
            if share <= min(n, m):
                a, b = np.sort(pool[:n]), np.sort(pool[n - share : n - share + m])
                assert len(np.intersect1d(simhash.front(a, known, counts), simhash.front(b, known, counts)))


def test_sets_in_too_few_classes_meet(monkeypatch):
    """Where all shingles share one class, no key is safe; such sets have one of their own."""
    monkeypatch.setattr(simhash, "LEAST_CLASSES", 1)
    monkeypatch.setattr(simhash, "CLASS_SHINGLES", 1000)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.arange(1, 6, dtype=np.uint64)
    assert len(np.intersect1d(simhash.front(a, *none), simhash.front(a[:4], *none)))


def cloud(rng, n):
    """Copies of one text with few words changed each, near 0.7 of each other; some pairs are at 0.8."""
    words = [f"w{k}" for k in range(150)]
    texts = {}
    for k in range(n):
        own = list(words)
        for at in rng.sample(range(150), rng.randrange(2, 6)):
            own[at] = f"v{rng.randrange(10**6)}"
        texts[k] = " ".join(own)
    return texts


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    """Of 400 near copies most pairs are under 0.8 and must be compared, yet no table grows with their 79,800 pairs."""
    texts, rows = cloud(random.Random(8), 400), {}
    real = simhash.cut

    def cut(df, name="cut"):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    root = exact_groups(texts)
    assert len(set(root.values())) > 40
    assert kept_ids(spark, texts) == set(root.values())
    assert max(rows.values()) < 25 * len(texts), rows


@pytest.mark.parametrize("paired", [1, 10**6])
def test_lists_compared_in_parts_and_as_rows(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_ROWS", paired)
    monkeypatch.setattr(simhash, "LIST_ROWS", 9)
    monkeypatch.setattr(simhash, "STAR_SHARE", 2.0)  # no first links: all is left to the lists
    texts = cloud(random.Random(9), 60) | {100 + k: t.replace("w", "x") for k, t in cloud(random.Random(10), 30).items()}
    assert kept_ids(spark, texts) == set(exact_groups(texts).values())


def test_shared_phrases_make_few_lists(spark):
    """Texts of phrases that others have too, but no more than a phrase: few keys are shared, though two thirds of the shingles are."""
    rng = random.Random(12)
    phrases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(1000)]
    texts = {k: " ".join(rng.sample(phrases, 15)) for k in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    listed = simhash.fronts(docs, simhash._tag(docs)).count()
    assert listed < 8 * len(texts), listed
    assert kept_ids(spark, texts) == set(exact_groups(texts).values())


def test_shared_counts():
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 5000, n).astype(np.int64)) for n in sizes] for sizes in ([3, 400, 2000, 1], [3000, 0, 50]))
    assert simhash.shared_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_unlike_texts_of_regular_words_stay(spark):
    """Words whose sums of multiples of bytes are equal modulo 2**64 for every odd multiplier: no shingle of theirs is the same."""
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(30))
    texts = {1: one, 2: two, 3: f"{one} {tail}", 4: f"{two} {tail}", 5: " ".join([one] * 6), 6: " ".join([two] * 6), 7: f"{one} {two}", 8: f"{two} {one}", 9: one, 10: ""}
    assert kept_ids(spark, texts) == set(exact_groups(texts).values()) == {1, 2, 3, 5, 6, 7, 8, 10}


def test_set_hashes_are_those_of_the_shingles():
    """Equal shingles have equal hashes wherever they are, others have others; as many as there are, of whole texts."""
    rng = random.Random(14)
    long = " ".join(rng.choice(("a", "B", "\u00fc", "x\x0by", "w" * 3000, "no\u00a0break")) for _ in range(5000))
    texts = ["", " \n", "a", "A b C", "a b c d", "a b c d e", "b c d e a", "A b c d e f g a b c d e", "ab c", "a bc", long, long[5:]]
    h, n = simhash.set_hashes([t.encode() for t in texts])
    seen = [g for t in texts for g in grams(t)]
    assert n.tolist() == [len(grams(t)) for t in texts] and len(h) == len(seen)
    assert len(set(zip(h.tolist(), seen, strict=True))) == len(set(seen)) == len(set(h.tolist()))
    empty, none = simhash.set_hashes([])
    assert not len(empty) and not len(none)
