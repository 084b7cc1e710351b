"""Language network: its gradients, what it learns, and rows it can't judge."""

import random
import zlib

import numpy as np

from chromaforge.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, held_out string"


def test_gradients_are_those_of_small_steps():
    m = language.ByteGRU(["a", "b", "c"], 5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, n = language._as_matrix([b"hello ", b"ab ", b"xyz"])
    y = np.array([0, 2, 1])
    _, g = m.gradients(x, n, y)
    for k, p in m.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, losses = p[at], []
        for step in (1e-3, -1e-3):
            p[at] = old + step
            losses.append(m.gradients(x, n, y)[0])
        p[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[k][at]) < 1e-4


def rows():
    r = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ße", "üt", "sch"], "cc": ["éa", "oux", "tre"]}
    out = []
    for i in range(300):
        lang = r.choice(list(syllables))
        words = ["".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 40))]
        out.append((i, " ".join(words), lang, "s", "h"))
    return out


def test_learns_from_the_rest_and_predicts_all(spark):
    data = rows() + [(1000, None, "aa", "s", "h"), (1001, "123 !!", "aa", "s", "h"), (1002, "KALOMI kalo", None, None, None), (None, "kami", "aa", "s", "h")]
    got = language.identify(spark.createDataFrame(data, SCHEMA), train_docs=150, train_segments=3000).collect()
    assert len(got) == len(data)
    by = {x.doc_id: x for x in got}
    for i, _, lang, *_ in data[:300]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    right = [by[i].lang_pred == lang for i, _, lang, *_ in data[:300] if by[i].held_out]
    assert len(right) > 60 and np.mean(right) > 0.97
    assert (by[1000].lang_pred, by[1000].score) == ("und", 0.0) and by[1001].lang_pred == "und"
    assert by[1002].lang_pred == "aa" and by[None].held_out and by[None].lang_pred == "aa"
    assert all(0 <= x.score <= 1 for x in got)


def test_held_out_labels_are_never_seen(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, h) for i, t, lang, s, h in data]
    options = {"train_docs": 100, "train_segments": 1000, "epochs": 1}
    a = language.identify(docs, **options).orderBy("doc_id").collect()
    b = language.identify(spark.createDataFrame(changed, SCHEMA), **options).orderBy("doc_id").collect()
    assert a == b


def test_nothing_to_learn_and_empty_table(spark):
    none = spark.createDataFrame([(1, "text", None, None, None), (2, "text", None, None, None)], SCHEMA)
    assert {x.lang_pred for x in language.identify(none).collect()} == {"und"}
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_label_of_the_training_rows_is_learned(spark):
    """A label with one row in a thousand, and fewer rows than the sample has by chance, is still predicted."""
    r = random.Random(9)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(12))
    data = [(i, make(["ka", "lo", "mi"]), "aa", "s", "h") for i in range(3000)]
    data += [(5000 + i, make(["ße", "üt", "sch"]), "bb", "s", "h") for i in range(12)]
    data += [(6000 + i, make(["qwx", "zzy", "vvu"]), "cc", "s", "h") for i in range(3)]
    docs = spark.createDataFrame(data, SCHEMA)
    model = language.train(docs.select("doc_id", "text", "lang"), train_docs=60, train_segments=1200)
    assert model.labels == ["aa", "bb", "cc"]
    got = {x.doc_id: x.lang_pred for x in language.predict(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i] == lang for i, _, lang, *_ in data if i >= 5000)
    assert np.mean([got[i] == "aa" for i in range(3000)]) > 0.97
