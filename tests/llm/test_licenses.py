"""License scan against plain Python, and notices with small edits."""

import random
import re

from chromaforge.llm import licenses

SCHEMA = "doc_id long, text string, labels string, copy string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def fixture():
    r = random.Random(2)
    vocab = ["mit", "License", "MIT", "apache", "LICENSE", "general", "Public", "license", "é", "x9", "Kit", "İa"]
    rows = [(0, None), (1, ""), (2, "!!!"), (3, "license"), (4, "MIT-License mit license"), (5, "mıt license MİT license")]
    for i in range(6, 80):
        rows.append((i, "".join(r.choice(vocab) + r.choice([" ", "-", "\n", "!! "]) for _ in range(r.randint(1, 60)))))
    return [(*x, "l", "c") for x in rows]


def test_phrases_are_those_of_plain_python(spark):
    rows = fixture()
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {r[0]: plain(r[1]) for r in rows}
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == want[x.doc_id]
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) | {""}
        assert 0 <= x.score <= 1


def test_notices_survive_edits_and_stay_out_of_other_text(spark):
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd").split()
    edited = bsd[:10] + ["really"] + bsd[10:20] + bsd[21:]
    filler = ["word%d" % i for i in range(40)]
    rows = [
        (1, " ".join(filler + edited + filler)),
        (2, "Licensed under CC BY-NC 4.0. " + " ".join(filler)),
        (3, " ".join(bsd[:12] + filler)),
        (4, " ".join(filler)),
        (5, "LICENSED!! UNDER!! CC!! BY-NC!! 4.0!!"),
        (2, "Licensed under CC BY-NC 4.0. " + " ".join(filler)),
    ]
    docs = spark.createDataFrame([(*r, "l", "c") for r in rows], SCHEMA)
    got = [(x.doc_id, x.labels, x.n_base) for x in licenses.scan(docs).collect()]
    assert sorted(got) == [(1, "bsd", 0), (2, "cc-by-nc", 0), (2, "cc-by-nc", 0), (3, "", 0), (4, "", 0), (5, "cc-by-nc", 0)]
    spans = {x.doc_id: x for x in licenses.notices(docs.select("doc_id", "text")).filter("label = 'bsd'").collect()}
    assert (spans[1]["first"], spans[1]["last"]) == (40, 40 + len(edited) - 1)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_versions_elements_whole_texts_and_long_insertions(spark):
    mit = max((t for label, t in licenses.TEMPLATES if label == "mit"), key=len).split()
    named = mit[:60] + ["the", "very", "long", "name", "of", "one", "holder"] + mit[60:]
    zlib = next(t for label, t in licenses.TEMPLATES if label == "zlib").split()
    lines = [w for i in range(0, len(zlib), 12) for w in [str(i // 12 + 1), *zlib[i : i + 12]]]
    short = [f"CC BY{e} {v}" for e in ("", "-NC", "-SA", "-ND", "-NC-SA", "-NC-ND") for v in ("4.0", "3.0", "2.5")]
    long = [
        ("cc-by", "a Creative Commons Attribution 3.0 Unported License"),
        ("cc-by-nc", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
        ("cc-by-nc-sa", "the Creative Commons Attribution-Non Commercial-Share Alike 3.0 License"),
        ("cc-by-nd", "a Creative Commons Attribution-NoDerivs 2.0 License"),
    ]
    want = [(" ".join(x.split()[:-1]).lower().replace(" ", "-"), f"Licensed under {x}.") for x in short]
    want += [(label, f"This work is licensed under {text}.") for label, text in long]
    want += [("mit", " ".join(named)), ("zlib", " ".join(lines)), ("cc0", "Dedicated under CC0 1.0 Universal")]
    want += [("", "We write cc by hand and by 4 0 others, under a creative commons of attribution.")]
    names = {"isc", "unlicense", "epl"}
    want += [(x, t.replace("{v}", "2 0")) for x, t in licenses.TEMPLATES if x in names and not t.startswith("spdx")]
    docs = spark.createDataFrame([(i, f"Some words. {t} Some more.", "l", "c") for i, (_, t) in enumerate(want)], SCHEMA)
    got = {x.doc_id: x.labels for x in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(want))] == [label for label, _ in want]


def test_siblings_names_lines_and_versions(spark):
    notice = next(t for label, t in licenses.TEMPLATES if label == "gpl" and "distributed in the hope" in t)
    lgpl = next(t for label, t in licenses.TEMPLATES if label == "lgpl" and "distributed in the hope" in t)
    want = [
        ("gpl", notice.replace("{v}", "2")),
        ("gpl,lgpl", lgpl.replace("{v}", "2 1")),
        ("gpl,lgpl", "under the GNU Lesser General Public License, Version 3"),
        ("agpl,gpl", "under the GNU Affero General Public License"),
        ("mit", "// SPDX-License-Identifier: MIT"),
        ("apache", "# SPDX-License-Identifier: Apache-2.0"),
        ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
        ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
        ("mpl", "Mozilla Public License Version 2.0"),
        ("mpl", "the Mozilla Public License, v. 1.1"),
        ("bsl", "Boost Software License - Version 1.0 - August 17th, 2003"),
        ("apache", "Grant of Copyright License. " + next(t for _, t in licenses.TEMPLATES if t.startswith("grant of"))),
        ("", "CC BY 7.9"),
        ("", "Creative Commons Attribution Non Commercial Share Alike 7.9"),
        ("", "Mozilla Public License Version 5.0"),
        ("", "SPDX-License-Identifier: LGPL-7.0"),
        ("", "SPDX-License-Identifier: Custom"),
    ]
    docs = spark.createDataFrame([(i, f"Some words. {t} and more.", "l", "c") for i, (_, t) in enumerate(want)], SCHEMA)
    got = {x.doc_id: x.labels for x in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(want))] == [label for label, _ in want]


def plain_notices(text, k=3, slack=3, coverage=0.7):
    """(label, first, last) of the spans, by a loop over all templates and places."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for label, template in licenses.TEMPLATES:
        for texts, marks in licenses._variants(label, template):
            size = len(texts[0])
            near = max(slack, size // 8)
            diagonals = {}
            for w in range(len(words) - k + 1):
                for t in range(size - k + 1):
                    if any(words[w : w + k] == x[t : t + k] for x in texts):
                        diagonals.setdefault(w - t, []).append((w, t))
            runs, before = [], None
            for d in sorted(diagonals):
                if before is None or d - before > near:
                    runs.append([])
                runs[-1] += diagonals[d]
                before = d
            need = {t for t in range(size - k + 1) if any(t <= m < t + k for m in marks)}
            for run in runs:
                votes = {t for _, t in run}
                first, last = min(w for w, _ in run), max(w for w, _ in run) + k - 1
                marked = len(votes) == size - k + 1 if size <= 9 else 2 * len(votes & need) >= len(need)
                enough = len(votes) >= coverage * (size - k + 1) and marked
                if enough and last - first + 1 <= size + 2 * near:
                    out.append((label, first, last))
    return sorted(out)


def test_notices_are_those_of_a_loop_over_templates(spark):
    r = random.Random(9)
    texts = [None, "", "one two"]
    for _ in range(45):
        parts = []
        for _ in range(r.randint(1, 2)):
            label, template = r.choice(licenses.TEMPLATES)
            ws = template.replace("{v}", r.choice(["1 0", "2 0", "3", "2 1", "9 9"])).split()[:60]
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(ws))
                ws[at : at + r.randint(0, 2)] = r.choices(["and", "x", "license", "the"], k=r.randint(0, 3))
                ws = ws or ["x"]
            parts += ws + r.choices(["alpha", "the", "of"], k=r.randint(0, 8))
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in licenses.notices(docs).collect():
        got.setdefault(x.doc_id, []).append((x.label, x["first"], x["last"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, t in enumerate(texts) if (v := plain_notices(t))}
    assert len(got) > 10
