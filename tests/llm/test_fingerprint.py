"""Fingerprints: the order of ids, edited texts, and what likeness says."""

import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from chromaforge.llm import fingerprint

SCHEMA = "doc_id long, text string, fp string, block string"


def fixture():
    r = random.Random(3)
    vocab = ["w%d" % i for i in range(500)]
    ids = [-5, -4, 0, 1, 2, 1023, 1024, 1025, 5000, 10**12] + r.sample(range(6000, 10**9), 40)
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice((0, 1, 2, 3, 80, 400)))), "f", "b") for i in ids]
    rows[3] = (rows[3][0], None, "f", "b")
    rows[4] = (rows[4][0], "é😀 word " * 30, "f", "b")
    r.shuffle(rows)
    return rows


def test_edited_text_takes_from_the_next_document(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {x.doc_id: x for x in fingerprint.compare_with_next(docs).collect()}
    order = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(rows)
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t == nxt:
            assert got[i].near_next == 1.0 and got[i].fingerprint == got[j].fingerprint
        assert 0 <= got[i].near_edited <= 1
    long = [x for x in got.values() if x.n_chars > 300 and x.doc_id != 2]
    assert sum(x.near_edited > x.near_next for x in long) >= len(long) - 1


def sketched(df, **names):
    """df with the fingerprints of its text columns: new name = text column."""
    for name, column in names.items():
        df = df.withColumn("_k", fingerprint.kmers(F.col(column)))
        df = fingerprint.with_sketch(df, "_k", name).drop("_k")
    return df


def likeness(spark, a, b):
    df = sketched(spark.createDataFrame([(a, b)], "a string, b string"), x="a", y="b")
    return df.select(fingerprint.likeness(F.col("x"), F.col("y"))).first()[0]


def plain(text):
    """Order MinHash from its definition: for each draw the two first numbered k-mers, in text order."""
    k = fingerprint.K
    seen, numbered = {}, []
    for at in range(max(len(text) - k + 1, min(len(text), 1))):
        gram = text[at : at + k]
        seen[gram] = n = seen.get(gram, 0) + 1
        key = (xxhash.xxh64_intdigest(gram.encode(), seed=42) & (1 << 63) - 1) >> fingerprint.PLACE_BITS
        if n > 1:
            h = xxhash.xxh64_intdigest(struct.pack("<i", n), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
            key = (h & (1 << 63) - 1) >> fingerprint.PLACE_BITS
        numbered.append((key, at))

    def rank(x, draw):
        if x[0] % fingerprint.DRAWS == draw:
            return (0, x[0], x[1])
        h = xxhash.xxh64_intdigest(struct.pack("<q", draw), seed=xxhash.xxh64_intdigest(struct.pack("<q", x[0]), seed=42))
        return (1, (h & (1 << 63) - 1) >> fingerprint.PLACE_BITS, x[0])

    out = []
    for draw in range(fingerprint.DRAWS if numbered else 0):
        two = sorted(numbered, key=lambda x: rank(x, draw))[:2]
        out.append(tuple(key for key, _ in sorted(two, key=lambda x: x[1])))
    return out


def test_fingerprints_are_those_of_a_plain_order_minhash(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = ["", "a", "abcdefgh", "abcdefghi", "x" * 300, "日本語の文章は空白なしで続きます" * 9, "é😀ab" * 40]
    texts += [text(n) for n in (2, 5, 20, 40, 80, 300, 1500)] + [text(40) + " same same " * 30]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i, len(texts))]
    halves = [(t, t[len(t) // 2 :] + t[: len(t) // 2]) for t in texts] + [(t, t[:-3] + "zzz") for t in texts]
    rows = [(texts[i], texts[j]) for i, j in pairs] + halves
    df = sketched(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string"), x="a", y="b")
    for row in df.select("i", "a", "b", fingerprint.likeness(F.col("x"), F.col("y")).alias("like")).collect():
        a, b = plain(row.a), plain(row.b)
        want = sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)) if a or b else 1.0
        assert row.like == pytest.approx(want), (row.a[:30], row.b[:30])


def test_edited_fingerprints_are_those_of_the_edited_text(spark):
    """Shared k-mers of the first half are not computed anew; the result is the same."""
    rows = fixture() + [(20, "abcdefgh", "f", "b"), (21, "abcdefghi", "f", "b"), (22, "z", "f", "b"), (23, "q" * 40, "f", "b")]
    got = {x.doc_id: x.edited_fingerprint for x in fingerprint.compare_with_next(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted((i, t or "") for i, t, *_ in rows)
    edited = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        edited.append((i, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]))
    whole = sketched(spark.createDataFrame(edited, "doc_id long, t string"), fp="t")
    want = {x.doc_id: x.w for x in whole.select("doc_id", fingerprint.as_text(F.col("fp")).alias("w")).collect()}
    assert got == want


def test_likeness_follows_edits_and_order(spark):
    r = random.Random(4)
    words = ["v%d" % r.randrange(5000) for _ in range(400)]
    text = " ".join(words)
    few = " ".join("new" if i % 80 == 7 else w for i, w in enumerate(words))
    turned = " ".join(words[200:] + words[:200])
    assert likeness(spark, text, text) == 1.0
    assert likeness(spark, text, few) > 0.6
    # the same k-mers in another order: their set is alike, their order is not
    assert likeness(spark, text, turned) < likeness(spark, text, few)
    assert likeness(spark, text, "other words here that share nothing " * 20) < 0.1
    assert likeness(spark, "", "") == 1.0 and likeness(spark, "", "a") == 0.0


def test_occurrences_count(spark):
    once, often = " ".join("a b c d e f g h".split()), " ".join("a b c d e f g h".split() * 6)
    assert likeness(spark, once, often) < 0.6
    repeated = sketched(spark.createDataFrame([("x y " * 50,), ("x y " * 50,)], "t string"), fp="t")
    prints = repeated.select(fingerprint.as_text(F.col("fp"))).distinct().collect()
    assert len(prints) == 1 and len(prints[0][0]) == 8 * fingerprint.DRAWS


def test_following_solves_wide_tables_by_groups(spark):
    blocks = spark.createDataFrame([(i * 7 - 500,) for i in range(400)], "block long")
    got = {x.block: x.next_block for x in fingerprint._following(blocks, base=8, small=10).collect()}
    ids = [i * 7 - 500 for i in range(400)]
    assert got == dict(zip(ids, [*ids[1:], None], strict=True))


def test_single_row_repeated_rows_and_empty_table(spark):
    one = spark.createDataFrame([(7, "a b c d", "f", "b")], SCHEMA)
    assert fingerprint.compare_with_next(one).first().near_next == 1.0
    rows = [(7, "a b c d", "f", "b")] * 3 + [(9, "e f g h", "f", "b"), (None, "n", "f", "b")]
    assert fingerprint.compare_with_next(spark.createDataFrame(rows, SCHEMA)).count() == 5
    assert fingerprint.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_counts_in_short_texts(spark):
    """Halves swapped: the set of k-mers stays, so only their order tells the texts apart."""
    r = random.Random(6)
    rows = []
    for n in (20, 40, 80):
        for _ in range(40):
            w = ["v%d" % r.randrange(10**6) for _ in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    df = sketched(spark.createDataFrame(rows, "n int, a string, b string"), x="a", y="b")
    got = df.select("n", F.size("x").alias("filled"), fingerprint.likeness(F.col("x"), F.col("y")).alias("like")).collect()
    assert {x.filled for x in got} == {fingerprint.DRAWS}
    for n in (20, 40, 80):
        like = [x.like for x in got if x.n == n]
        assert 0.3 < sum(like) / len(like) < 0.55  # half of the pairs keep their order


def test_texts_without_spaces_have_many_k_mers(spark):
    r = random.Random(8)
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(400))
    assert likeness(spark, text, text[:380] + text[:20]) > 0.8
    assert likeness(spark, text, text[200:] + "。" * 200) < likeness(spark, text, text[50:])


def test_long_texts_and_wide_or_skewed_ids(spark):
    long = "lorem ipsum dolor sit amet " * 40_000
    rows = [(1, long, "f", "b"), (1 << 40, long + "x", "f", "b"), (-(1 << 40), None, "f", "b")]
    rows += [(None, "no id %d" % i, "f", "b") for i in range(20)] + [(5, "same id %d" % i, "f", "b") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, other = (
        {(x.doc_id, x.fingerprint): (x.edited_sha256, x.near_next) for x in fingerprint.compare_with_next(docs, **o).collect()}
        for o in ({}, {"broadcast_rows": 0})
    )
    assert one == other and len(one) == len(rows)
    with pytest.raises(ValueError):
        fingerprint.compare_with_next(docs.withColumn("doc_id", F.lit("a")))


def test_long_texts_sort_only_the_beginning_of_their_ranking(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = " ".join(r.choice(vocab) for _ in range(2000)) + "😀é " * 60
    texts = [prose + prose[:3000], prose[:500], "lorem ipsum dolor " * 700, "zy" * 3000, "ab" * 20, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string").withColumn("k", fingerprint.kmers(F.col("a")))
    df = fingerprint.with_ranking(df, "k", "x")
    got = {x.i: x for x in df.select("i", F.size("k").alias("n"), "_x_t", fingerprint._whole("_x_s", "_x_l", "_x_r").alias("all")).collect()}
    for i, text in enumerate(texts):
        assert got[i].n == len(got[i].all) == max(len(text) - fingerprint.K + 1, min(len(text), 1))
        assert got[i]._x_t == got[i].all[: len(got[i]._x_t)]
        assert len(got[i]._x_t) >= min(got[i].n, fingerprint._FIRST)
    assert len(got[0]._x_t) < got[0].n / 8
    edited = [t[: len(t) // 2] + t[: len(t) // 3] for t in texts]
    rows = sketched(spark.createDataFrame(list(zip(texts, edited)), "a string, b string"), x="a", y="b")
    for row in rows.select("a", "b", fingerprint.likeness(F.col("x"), F.col("y")).alias("like")).collect():
        a, b = plain(row.a), plain(row.b)
        assert row.like == pytest.approx(sum(x == y for x, y in zip(a, b, strict=True)) / len(a) if a else 1.0)
