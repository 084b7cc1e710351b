"""Spelling variants against a plain search over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from chromaforge.llm import spelling
from chromaforge.llm.queries import op11_spelling_variants

SCHEMA = "doc_id long, text string, word string, n long"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain_words(docs, length=7, least=2):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= length
    return {w: n for w, n in counts.items() if n >= least}


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, factor=10):
    near = {w: [v for v in words if distance_is_one(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v and words[v] >= factor * words[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(x) for x in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def typo(r, word):
    at, letter = r.randrange(len(word)), r.choice("abcxyé")
    return r.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def corpus():
    r = random.Random(3)
    stems = ["therefore", "thereafter", "ésprition", "aaaaaaa", "aaaaaaab", "mentioned", "mentions", "abcabcabc"]
    docs = [(None, "Nullified nullified"), (1, None), (2, ""), (3, " \n "), (4, "x" * 20_000 + " " + "x" * 20_000 + " " + "x" * 19_999 + " " + "x" * 19_999)]
    for i in range(300):
        words = [r.choice(stems) for _ in range(12)]
        words = [typo(r, w) if r.random() < 0.2 else w.upper() if r.random() < 0.1 else w for w in words]
        docs.append((10 + i, ", ".join(words)))
    docs += [docs[20]] * 3  # repeated rows
    return docs


@pytest.mark.parametrize("chars", [1_000_000, 2_000, 300])
def test_variants_are_those_of_all_pairs(spark, chars):
    words = plain_words(corpus())
    found = spelling.near(spark.createDataFrame(list(words.items()), "word string, n long"), chars=chars).collect()
    want = {x[0]: x[4] for x in plain_variants(words) if x[4]}
    assert len(want) > 100 and max(want.values()) > spelling.FEW
    assert {x.word: x.n_near for x in found} == want


def test_whole_query_and_edge_cases(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([(i, t, "x", 5) for i, t in docs], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(op11_spelling_variants(spark, str(tmp_path)))
    want = plain_variants(plain_words(docs))
    assert got == sorted(want, key=lambda x: x[0]) and any(x[1] and x[1] != x[2] or x[1] for x in got)


def test_crowds_are_looked_up_by_halves():
    r = random.Random(5)
    words = sorted({"abcd" + "".join(r.choice("ab") for _ in range(r.choice([4, 5, 6]))) for _ in range(400)} | {"abcd" + "ab" * 3})
    assert len(words) > 80
    for side in (0, 1):
        ends = words if side == 0 else [w[::-1] for w in words]
        halves = [spelling.Halves(s, ends, list(range(1, len(ends) + 1))) for s in (0, 1)]
        for w in ends:
            hits = [h.near(w) for h in halves]
            assert sum(x[0] for x in hits if x) == sum(distance_is_one(w, v) for v in ends)


def test_chains_of_forms_end_at_their_root(spark):
    links = [(f"w{i:02}", f"w{i + 1:02}") for i in range(18)]
    got = {x.word: x.root for x in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w18" for w, _ in links}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_empty_table_and_short_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.count(spelling.with_typos(spelling.runs(empty)))).count() == 0
    with pytest.raises(ValueError):
        spelling.count(spark.createDataFrame([("a",)], "word string"), length=5)


def test_one_edit():
    for a, b, yes in [("ab", "ab", 0), ("ab", "b", 1), ("ab", "abc", 1), ("ab", "ba", 0), ("", "a", 1), ("abc", "axc", 1), ("abcd", "ab", 0), ("aab", "ab", 1)]:
        assert spelling.one_edit(a, b) is spelling.one_edit(b, a) is bool(yes)
