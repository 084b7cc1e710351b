"""License scan by diagonal voting.

All rolling word k-gram hashes of every text are joined with the positions of the same k-grams in a fixed set of
license templates. A hit votes for a diagonal (its place in the text less its place in the template); votes are
summed by document, template and diagonal; neighbouring diagonals (a few words put in or left out) are merged;
and a merged span counts when it covers enough of the template, has half of the k-grams with the template's marked
words (those that tell it from a sibling) and is not much longer than it. A template stands for all versions that its
license has, and for no others: at the place of the version it has a k-gram for each. Templates of up to ``WHOLE``
words are names and must be there whole.

Templates are notices, names with a version, SPDX lines (the first identifier of an expression), whole short licenses,
and the openings and grants of long ones.

Beside it stands a plain phrase search, whose places are exact.

Defined cases: null and empty texts have no words, places or labels and score 0; texts shorter than k words have
no k-gram; repeated rows are judged alike, each on its own; an empty table gives an empty result; extra columns
of the input are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, lower_ascii

K = 3
#: Words of a template that has no room for edits.
WHOLE = 9
#: What stands between words: all ASCII but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases and the labels they stand for.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: The versions of each license, as words.
VERSIONS = {
    "apache": ("1 0", "1 1", "2 0"),
    "gpl": ("1", "2", "3", "1 0", "2 0", "3 0"),
    "lgpl": ("2", "3", "2 0", "2 1", "3 0"),
    "agpl": ("1", "3", "1 0", "3 0"),
    "mpl": ("1 0", "1 1", "2 0"),
    "epl": ("1 0", "2 0"),
    "bsl": ("1 0",),
    "cc0": ("1 0",),
    "cc": ("1 0", "2 0", "2 1", "2 5", "3 0", "4 0"),
}
#: Words of a template that a span must have, by label; a version always is one.
MARKS = {"lgpl": ("lesser", "library"), "agpl": ("affero",)}

#: Well-known notices, in lower case and without punctuation, with the label they stand for; {v} is a
#: version, and a template is meant for all that VERSIONS has of its label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("apache", "licensed under the apache license version {v}"),
    (
        "apache",
        "licensed under the apache license version {v} the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license {v}",
    ),
    ("gpl", "this work is licensed under the gnu general public license version {v}"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version {v} of the license or at your "
        "option any later version",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice this "
        "list of conditions and the following disclaimer",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v {v} if a copy of the mpl was "
        "not distributed with this file you can obtain one at http mozilla org mpl {v}",
    ),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "software the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
        "event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
        "an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
    ),
    (
        "apache",
        "licensed under the apache license version {v} the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at http www apache org licenses license {v} unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied see the license for "
        "the specific language governing permissions and limitations under the license",
    ),
    *(
        (
            label,
            f"this {work} is free software you can redistribute it and or modify it under the terms of the gnu {name} "
            "public license as published by the free software foundation either version {{v}} of the license or at your "
            f"option any later version this {work} is distributed in the hope that it will be useful but without any "
            "warranty without even the implied warranty of merchantability or fitness for a particular purpose see "
            f"the gnu {name} public license for more details you should have received a copy of the gnu {name} public "
            f"license along with this {work} if not see http www gnu org licenses",
        )
        for label, work, name in (
            ("gpl", "program", "general"),
            ("lgpl", "library", "lesser general"),
            ("agpl", "program", "affero general"),
        )
    ),
    *(
        (
            "bsd",
            "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met redistributions of source code must retain the above copyright "
            "notice this list of conditions and the following disclaimer redistributions in binary form must "
            "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            f"documentation and or other materials provided with the distribution {third}this software is provided by "
            "the copyright holders and contributors as is and any express or implied warranties including but not "
            "limited to the implied warranties of merchantability and fitness for a particular purpose are "
            "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
            "incidental special exemplary or consequential damages including but not limited to procurement of "
            "substitute goods or services loss of use data or profits or business interruption however caused and on "
            "any theory of liability whether in contract strict liability or tort including negligence or otherwise "
            "arising in any way out of the use of this software even if advised of the possibility of such damage",
        )
        for third in (
            "",
            "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission ",
        )
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the "
        "software is provided as is and the author disclaims all warranties with regard to this software including "
        "all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection "
        "with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions the origin of this software must not be misrepresented you must not "
        "claim that you wrote the original software if you use this software in a product an acknowledgment in the "
        "product documentation would be appreciated but is not required altered source versions must be plainly "
        "marked as such and must not be misrepresented as being the original software this notice may not be removed "
        "or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
    ),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license "
        "v {v} which accompanies this distribution and is available at",
    ),
    ("epl", "made available under the terms of the eclipse public license {v} which is available at"),
    ("cc0", "cc0 {v} universal"),
    ("cc0", "creative commons zero v {v} universal"),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
        "this work",
    ),
]

#: Openings and grants of long licenses, and the Boost license.
TEMPLATES += [
    (
        "apache",
        "apache license version {v} january 2004 http www apache org licenses terms and conditions for use reproduction "
        "and distribution 1 definitions license shall mean the terms and conditions for use reproduction and "
        "distribution as defined by sections 1 through 9 of this document",
    ),
    (
        "apache",
        "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants "
        "to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce "
        "prepare derivative works of publicly display publicly perform sublicense and distribute the work and such "
        "derivative works in source or object form",
    ),
    *(
        (
            label,
            f"gnu {name} public license version {{v}} {date} copyright c {year} free software foundation inc everyone is "
            "permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        )
        for label, name, date, year in (
            ("gpl", "general", "29 june 2007", "2007"),
            ("gpl", "general", "june 1991", "1989 1991"),
            ("lgpl", "lesser general", "29 june 2007", "2007"),
            ("lgpl", "lesser general", "february 1999", "1991 1999"),
            ("agpl", "affero general", "19 november 2007", "2007"),
        )
    ),
    (
        "mpl",
        "mozilla public license version {v} 1 definitions 1 1 contributor means each individual or legal entity that "
        "creates contributes to the creation of or owns covered software",
    ),
    (
        "bsl",
        "distributed under the boost software license version {v} see accompanying file license {v} txt or copy at "
        "http www boost org license {v} txt",
    ),
    (
        "bsl",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license the software to use reproduce display distribute execute "
        "and transmit the software and to prepare derivative works of the software and to permit third parties to whom "
        "the software is furnished to do so all subject to the following",
    ),
]

#: Names of licenses; with and without a version.
TEMPLATES += [
    (label, f"{name} public license {word}{{v}}")
    for label, name in (("mpl", "mozilla"), ("epl", "eclipse"))
    for word in ("", "v ", "version ")
]
TEMPLATES += [("bsl", f"boost software license {word}{{v}}") for word in ("", "v ", "version ")]
TEMPLATES += [
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("agpl", "gnu affero general public license"),
]

#: SPDX identifiers as words.
SPDX = {
    "mit": ("mit", "mit 0"),
    "bsd": ("bsd 2 clause", "bsd 3 clause", "0bsd"),
    "isc": ("isc",),
    "zlib": ("zlib",),
    "unlicense": ("unlicense",),
    **{label: (label + " {v}",) for label in ("apache", "gpl", "lgpl", "agpl", "mpl", "epl", "bsl", "cc0")},
}
TEMPLATES += [(label, f"spdx license identifier {name}") for label, names in SPDX.items() for name in names]

#: Elements of a Creative Commons license: short form, and how they are written out.
_CC = {"nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike")}
_CC["nd"] = ("noderivatives", "no derivatives", "noderivs", "no derivs")
for _parts in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
    _label = "-".join(("cc", "by", *_parts))
    TEMPLATES.append((_label, f"{_label.replace('-', ' ')} {{v}}"))
    TEMPLATES += [
        (_label, " ".join(("creative commons attribution", *names, "{v}")))
        for names in itertools.product(*(_CC[x] for x in _parts))
    ]


def word_list(text: Column) -> Column:
    """Words of text (letters A-Z in lower case), in order."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK)
    # only the first and the last part can be empty
    return let(
        parts,
        lambda p: let(
            F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0),
            lambda a: F.slice(
                p, a + 1, F.greatest(F.size(p) - a - F.when(F.element_at(p, -1) == "", 1).otherwise(0), F.lit(0))
            ),
        ),
    )


def _grams(ws: Column, k: int) -> Column:
    """Hash of the k words from each place on."""
    return F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(ws, i + j) for j in range(1, k))),
    )


def _variants(label: str, text: str) -> list[tuple[list[list[str]], list[int]]]:
    """(texts of one length, places of marked words) of a template: versions of equal length differ in words only."""
    versions = VERSIONS.get("cc" if label.startswith("cc-") else label, ()) if "{v}" in text else ("",)
    out = []
    for n in sorted({len(v.split()) for v in versions}):
        same = [text.replace("{v}", v).split() for v in versions if len(v.split()) == n]
        marked = text.replace("{v}", " ".join(["{v}"] * n)).split()
        marks = ("{v}", *MARKS.get(label, ()))
        out.append((same, [i for i, w in enumerate(marked) if w in marks]))
    return out


def template_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """(gram, template, label, size, must, tpos) of the fixed templates: a few thousand rows at most.

    must holds the places of k-grams with a marked word (all places of a short template) and how many of them a span
    has at least; a place has a row for each version.
    """
    forms = [(label, *form) for label, text in TEMPLATES for form in _variants(label, text)]
    rows = []
    for i, (label, texts, marks) in enumerate(forms):
        n = len(texts[0])
        whole = n <= WHOLE
        places = [t for t in range(n - k + 1) if whole or any(t <= m < t + k for m in marks)]
        must = (places, len(places) if whole else (len(places) + 1) // 2)
        rows += [(i, label, n, must, " ".join(ws)) for ws in texts]
    must_type = "struct<places: array<int>, least: int>"
    t = docs.sparkSession.createDataFrame(rows, f"template int, label string, size int, must {must_type}, text string")
    return t.select("template", "label", "size", "must", F.posexplode(_grams(F.split("text", " "), k)).alias("tpos", "gram")).distinct()


def notices(docs: DataFrame, k: int = K, slack: int = 3, coverage: float = 0.7) -> DataFrame:
    """Verified notices: one row per span with its template, label, first and last word and coverage.

    docs has doc_id and text. Only k-gram hits are shuffled, as one row a place and template. Diagonals up to slack
    words apart, or an eighth of the template's words if that is more, are neighbours.
    """
    grams = docs.select(
        "doc_id",
        F.inline(
            F.transform(
                F.array(word_list(F.col("text"))),
                lambda ws: F.struct(F.xxhash64(F.array_join(ws, " ")).alias("copy"), _grams(ws, k).alias("grams")),
            )
        ),
    ).select("doc_id", "copy", F.posexplode("grams").alias("wpos", "gram"))
    hits = grams.join(F.broadcast(template_grams(docs, k)), "gram")  # a fixed set
    key = ["doc_id", "copy", "template"]
    votes = (
        hits.withColumn("diag", F.col("wpos") - F.col("tpos"))
        .groupBy(*key, "label", "size", "must", "diag")
        .agg(
            F.collect_set("tpos").alias("votes"),
            F.min("wpos").alias("first"),
            F.max("wpos").alias("last"),
        )
    )
    by_place = Window.partitionBy(*key).orderBy("diag")
    near = F.greatest(F.lit(slack), F.floor(F.col("size") / 8))
    step = F.when(F.col("diag") - F.lag("diag").over(by_place) <= near, 0).otherwise(1)
    runs = votes.withColumn("step", step).withColumn("run", F.sum("step").over(by_place))
    spans = runs.groupBy(*key, "label", "size", "must", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"), F.min("first").alias("first"), (F.max("last") + (k - 1)).alias("last")
    )
    covered = F.least(F.lit(1.0), F.size("votes") / (F.col("size") - (k - 1)))
    return (
        spans.withColumn("coverage", covered)
        .filter(F.col("coverage") >= coverage)
        .filter(F.size(F.array_intersect("votes", "must.places")) >= F.col("must.least"))
        .filter(F.col("last") - F.col("first") + 1 <= F.col("size") + 2 * near)
        .select("doc_id", "copy", "template", "label", "first", "last", "coverage")
    )


def _places(ws: Column) -> Column:
    """(start, label) of every phrase place."""

    def starts(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def here(w: Column, i: Column) -> Column:
            same = w == parts[0]
            for j, part in enumerate(parts[1:], 1):
                same = same & F.coalesce(F.get(ws, i + j) == part, F.lit(False))
            return F.when(same, F.struct(i.alias("start"), F.lit(label).alias("label")))

        return F.filter(F.transform(ws, here), lambda x: x.isNotNull())

    return F.concat(*(starts(p, label) for p, label in PHRASES.items()))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For every row of docs its words, phrase places, labels (of phrases and of notices) and a score from 0 to 1."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<struct<start:int,label:string>>")
    counted = F.transform(
        F.array(word_list(F.col("text"))),
        lambda ws: F.struct(
            F.xxhash64(F.array_join(ws, " ")).alias("copy"),
            F.size(ws).cast("long").alias("n_words"),
            F.when(F.array_contains(ws, "license"), _places(ws)).otherwise(none).alias("places"),
        ),
    )
    base = d.select("doc_id", F.inline(counted))
    found = (
        notices(d, **options)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy"))
        .agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))  # at most one of each label
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy"))
    starts, own = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    return base.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ","
        ).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
