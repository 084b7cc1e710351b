"""Near-duplicates against all pairs."""

import random
import re

import numpy as np

from chromaforge.llm import near_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= 80 * len(a | b):
                i, j = sorted((root(x), root(y)))
                comp[j] = i
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def fixture(seed, n_base=12, copies=14):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    rows, i = [], 0
    for _ in range(n_base):
        base = [r.choice(vocab) for _ in range(r.choice((3, 20, 60, 200)))]
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3, 6))):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = r.choice((" ", "\n", "  ")).join(w)
            rows.append((i, r.choice((text, text.upper())), "en", "s", len(text), "k", 1))
            i += 1
    rows += [(i + j, t, None, None, 0, None, None) for j, t in enumerate(["", None, "   ", "one", "ONE", "é É"])]
    r.shuffle(rows)
    return rows


def test_components_are_those_of_all_pairs(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        got = near_dup.components(spark.createDataFrame(rows, SCHEMA), size=4).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_chain_in_one_bucket_is_followed_to_its_end(spark):
    """Each text is near the next one only, so links beyond the first hub count."""
    vocab = ["v%d" % i for i in range(400)]
    rows = [(i, " ".join(vocab[3 * i : 3 * i + 40]), "en", "s", 1, "k", 1) for i in range(60)]
    random.Random(3).shuffle(rows)
    got = near_dup.components(spark.createDataFrame(rows, SCHEMA), size=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)
    assert {r.component_id for r in got} == {0}


def test_keep_leaves_one_row_a_group_and_all_columns(spark):
    rows = fixture(5)
    repeated = [*rows, rows[0], rows[0], (None, "no id", "en", "s", 5, "k", 1)]
    docs = spark.createDataFrame(repeated, SCHEMA)
    kept = near_dup.keep(docs, size=4)
    assert kept.columns == docs.columns
    expected = sorted(i for i, (_, _, k) in brute(rows).items() if k)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected
    assert kept.filter("doc_id is null").count() == 1


def test_rows_of_one_id_with_other_texts_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(2, a), (3, b), (5, a), (5, b), (5, "wholly other words of five"), (7, a), (7, a), (8, ""), (8, " "), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 99, x.component_id or 99) for x in near_dup.components(docs, size=4).collect())
    assert got == [(2, 2), (3, 3), (5, 2), (5, 3), (5, 5), (7, 2), (7, 2), (8, 8), (8, 8), (99, 99)]
    for few in (1_000_000, 0):  # by broadcast and by shuffle
        kept = sorted((x.doc_id or 99, x.text.strip()) for x in near_dup.keep(docs, size=4, few=few).collect())
        assert kept == [(2, a), (3, b), (5, "wholly other words of five"), (8, ""), (99, a)]


def test_very_long_texts(spark):
    words = ["w%d" % (i * 7919 % 200_003) for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words])), (3, " ".join(words[100_000:]))]
    got = near_dup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_dup.components(docs).count() == 0
    assert near_dup.keep(docs).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.3, 0.8, 0.95):
        a, b = pool[:1000], pool[int(1000 * (1 - share) / (1 + share)) :][:1000]
        sk = near_dup.sketches(np.concatenate([a, b]), np.array([1000, 1000]))
        union = near_dup.sketches(np.union1d(a, b), np.array([len(np.union1d(a, b))]))
        assert (near_dup.merge(sk[0], sk[1]) == union[0]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = near_dup.joint_estimate(sk[:1], sk[1:], np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(est - true) < 0.1


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Many copies that are near one another by chance only, with blocks and buckets of a few members."""
    from functools import partial

    monkeypatch.setattr(near_dup, "_links", partial(near_dup._links, small=2))
    monkeypatch.setattr(near_dup, "_families", partial(near_dup._families, block=6))
    r = random.Random(9)
    vocab = ["w%d" % i for i in range(3000)]
    base = [r.choice(vocab) for _ in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w), "en", "s", 1, "k", 1))
    got = near_dup.components(spark.createDataFrame(rows, SCHEMA), size=4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute(rows)


def test_overlaps_of_a_block():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, n)).astype(np.uint64) for n in (1, 5, 40, 60, 200)]
    got = near_dup.overlaps(sets, columns=16)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_connected_follows_paths_and_random_graphs(spark):
    r = random.Random(11)
    graphs = [[(i, i + 1) for i in range(50)], [(i, i + 7) for i in range(0, 60, 3)], [(r.randrange(200), r.randrange(200)) for _ in range(150)]]
    shuffled = list(range(60))
    r.shuffle(shuffled)
    graphs.append([(shuffled[i], shuffled[i + 1]) for i in range(59)])
    for edges in graphs:
        edges = [(a, b) for a, b in edges if a != b]
        comp = {v: v for e in edges for v in e}
        for _ in comp:
            for a, b in edges:
                comp[a] = comp[b] = min(comp[a], comp[b])
        got = near_dup.connected(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {x.v: x.comp for x in got} == comp and len(got) == len(comp)
