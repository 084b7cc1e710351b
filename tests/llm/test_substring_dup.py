"""Repeated sentence spans against a plain search."""

import random
import re

import pytest

from chromaforge.llm import substring_dup
from chromaforge.llm.substring_dup import SPANS, sentences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string"


def brute(rows):
    seen, drop = {}, {}
    for doc_id, text in sorted((r[0], r[1]) for r in rows if r[1] is not None):
        cuts = sentences(text)
        parts = [text[a:b].lower().split() for a, b in zip(cuts, cuts[1:], strict=False)]
        for k, least in SPANS:
            for i in range(len(parts) - k + 1):
                words = [tuple(p) for p in parts[i : i + k]]
                if sum(map(len, words)) >= least:
                    name = (k, tuple(words))
                    if name in seen and seen[name] != (doc_id, i):
                        drop.setdefault(doc_id, set()).update(range(i, i + k))
                    seen.setdefault(name, (doc_id, i))
    out = {}
    for doc_id, text, *_ in rows:
        if text is None:
            out[doc_id] = None
        else:
            cuts = sentences(text)
            out[doc_id] = "".join(
                text[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i not in drop.get(doc_id, ())
            )
    return out


def fixture(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(200)]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + r.choice(".!?")
    passages = [" ".join(sentence(r.randint(6, 14)) for _ in range(6)) for _ in range(5)] + [sentence(60)]
    rows = []
    for i in range(60):
        body = [sentence(r.randint(1, 12)) for _ in range(r.randint(0, 9))]
        for _ in range(r.choice((0, 0, 1, 2))):
            body.insert(r.randint(0, len(body)), r.choice(passages))
        text = "".join(s + r.choice((" ", "\n", "  ")) for s in body)
        rows.append((i, text, "en", "s", len(text), "p"))
    rows += [(60, None, None, None, None, None), (61, "", "en", "s", 0, "p"), (62, "the. the. the. the. the.", "en", "s", 0, "p")]
    return rows


def test_removed_text_is_that_of_a_plain_search(spark):
    for seed in (1, 2):
        rows = fixture(seed)
        docs = spark.createDataFrame(rows, SCHEMA)
        out = substring_dup.remove(docs)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == brute(rows)
        assert any(got[r[0]] != r[1] for r in rows) and any(r[1] and got[r[0]] == r[1] for r in rows)


def test_report_null_ids_repeated_rows_and_empty_table(spark):
    p = "Some words that make a first sentence here. Then a second one of some length follows. And a third one ends it."
    rows = [(1, p, "en", "s", 1, "x"), (1, p, "en", "s", 1, "x"), (2, "Own start here. " + p, "en", "s", 1, "x"), (None, p, "en", "s", 1, "x")]
    out = substring_dup.remove(spark.createDataFrame(rows, SCHEMA), report=True).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 4 and by[1].text == p and by[None].text == p
    assert by[2].text == "Own start here. " and by[2].n_removed == 3 and by[2].words_removed == len(p.split())
    assert by[2].n_chars == len("Own start here. ")
    assert substring_dup.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sentences_cover_the_text():
    for t in ("", "a", "a. b", "a.\n\nb!  c", "x@y.z 3.5 a?\n"):
        cuts = sentences(t)
        assert "".join(t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)) == t
        assert not re.search("[.!?]\\s+\\S", "".join(t[a:b].strip() + "|" for a, b in zip(cuts, cuts[1:], strict=False)))


def plain(rows, words=15, alone=25):
    """What is left by the rule itself: all runs of 2 or more sentences with 15 words, and sentences of 25."""
    seen, drop = {}, {}
    parts = {i: re.findall(r"(?:[^.!?\n]|[.!?](?!\s))+(?:[.!?]\s*|\n\s*|$)", t) for i, t in rows}
    for i, ps in sorted(parts.items()):
        for a in range(len(ps)):
            for b in range(a + 1, len(ps) + 1):
                run = tuple(tuple(p.lower().split()) for p in ps[a:b])
                if sum(map(len, run)) >= (alone if b == a + 1 else words) and seen.setdefault(run, (i, a)) != (i, a):
                    drop.setdefault(i, set()).update(range(a, b))
    return {i: "".join(p for j, p in enumerate(ps) if j not in drop.get(i, ())) for i, ps in parts.items()}


def test_passages_of_short_lines_and_of_two_sentences(spark):
    r = random.Random(5)
    say = lambda n: " ".join("u%d" % r.randrange(10**6) for _ in range(n))
    lines = lambda n, k: "".join(say(k) + "\n" for _ in range(n))
    verse, words, two = lines(20, 4), lines(20, 1), f"{say(24)}. {say(15)}.\n"
    tail, less = f"{say(10)}. {say(10)}. {say(3)}.\n", lines(14, 1)
    passages = [verse, words, two, tail, less]
    rows = [(j, "".join(say(5) + "\n" + p for p in passages)) for j in range(2)]
    rows += [(2, lines(3, 2) + verse + two), (3, words * 2 + say(4) + "\n"), (4, "\n\n" + say(24) + ".")]
    rows.append((5, rows[-1][1]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "p") for i, t in rows], SCHEMA)
    got = {x.doc_id: x.text for x in substring_dup.remove(docs).collect()}
    assert verse not in got[1] and words not in got[1] and two not in got[1] and tail not in got[1] and less in got[1]
    assert got[4] == got[5] == rows[4][1]
    assert {i: t for i, t in got.items() if i < 4} == plain(rows[:4])


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    passage = "The quick brown fox jumps over the lazy dog today. It then rests beside the quiet river for hours. Nobody saw it there."
    other = "Wholly unique alpha words stand here alone now. Wholly unique beta words stand here too. Gamma ends it. Delta."
    rows = [(1, passage), (2, passage), (2, other), (None, passage), (None, other + " More."), (3, "Own words only.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id or 9, x.text) for x in substring_dup.remove(docs).collect()))
    assert got == sorted([(1, passage), (2, ""), (2, other), (9, passage), (9, other + " More."), (3, "Own words only.")])
    # two rows of the smallest id: one of them is first, whatever the order
    twice = [(1, passage + " End one."), (1, passage + " End two."), (2, passage)]
    for rows in (twice, twice[::-1]):
        out = [x.text for x in substring_dup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert sum(passage in t for t in out) == 1 and sorted(map(len, out))[0] == 0


def test_very_long_texts(spark):
    long = " ".join(f"Sentence number {i} has its own seven words." for i in range(30_000))
    rows = [(1, long), (2, "Before it all. " + long)]
    got = {x.doc_id: x.text for x in substring_dup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: long, 2: "Before it all. "}


@pytest.mark.parametrize(("words", "alone"), [(0, None), (6, None), (0, 5), (40, 25)])
def test_minima_are_parameters(spark, words, alone):
    rows = [(r[0], r[1]) for r in fixture(8) if r[1]] + [(90, "Yes. No. Yes. No. Yes."), (91, "No. Yes.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in substring_dup.remove(docs, words=words, alone=alone).collect()}
    want = plain(rows, words, 10**9 if alone is None else alone)
    assert {i: t.split() for i, t in got.items()} == {i: t.split() for i, t in want.items()}
    assert got != dict(rows)


def test_minima_out_of_range_and_taken_report_names(spark):
    docs = spark.createDataFrame([(1, "A b. " * 20, 7)], "doc_id long, text string, n_removed int")
    with pytest.raises(ValueError, match="words"):
        substring_dup.remove(docs, words=256)
    out = substring_dup.remove(docs, report=True)
    assert out.columns == ["doc_id", "text", "n_removed", "n_removed_", "words_removed"]
    assert [(x.n_removed, x.n_removed_ > 0) for x in out.collect()] == [(7, True)]
