"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences. Every run of two or more consecutive sentences with ``WORDS`` words is a span, however
many sentences it takes; so is one sentence of ``ALONE`` words. Spans are hashed (128 bits, over lower-cased words),
joined over all rows, and each sentence that lies in a span which is not its first occurrence goes. First means the
smallest doc_id, then the smaller hash of the row, and in a row the first place. Only the shortest run that begins at
a sentence and the shortest that ends at one are hashed: inside any repeated run these cover each of its sentences. A
row names each span once; what recurs inside it is known without the join. Spans are computed once and written;
counts of a span are combined before they are dealt, and a span that very many rows hold meets its first row in a join
of two shuffles, which adaptive execution splits.

``WORDS`` keeps clean text: without it, two short sentences that recur by chance are a repeated span. Both minima are
parameters: with 0 words and no single sentences (None), every run of several sentences that recurs goes, and no other.

Defined cases: null stays null and blank texts stay as they are; a text without a repeated span is returned
unchanged, byte for byte; a row is known by its id and text, so rows of one id with other texts are rows like others,
and exact repeats of a row keep or lose spans alike; rows without an id are only compared with themselves; an empty
table gives an empty result; all columns of the input are kept, n_chars is brought up to date where it exists; a
report column whose name the input has takes underscores until it is new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import slices
from .common import discard, map_arrow, materialize

#: Words that a run of sentences, and a single sentence, has at least
WORDS, ALONE = 15, 25
#: (sentences of a span, words it has at least); a shortest run has no more sentences than words
SPANS = (*((k, WORDS) for k in range(2, WORDS + 1)), (1, ALONE))
_CUT = re.compile(r"[.!?]+[\"')\]]*\s+|\n\s*")
_LANES = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xD6E8FEB86659FD93, 0x94D049BB133111EB))


def sentences(text: str) -> list[int]:
    """Places where sentences begin, and the end of text; a sentence takes the white space that follows it."""
    cuts = [0, *(m.end() for m in _CUT.finditer(text))]
    if len(cuts) > 1 and text[: cuts[1]].isspace():  # blank lines before the first sentence are no sentence
        del cuts[1]
    return cuts if cuts[-1] == len(text) else [*cuts, len(text)]


def _mix(h: np.ndarray, a: int, b: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(a)
    return (h ^ (h >> np.uint64(29))) * np.uint64(b)


def _shortest(sizes: np.ndarray, owner: np.ndarray, words: int, single: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, end) of every sentence's shortest run from it and up to it, and of long single sentences."""
    n = len(sizes)
    before = np.concatenate(([0], np.cumsum(sizes)))
    each = np.arange(n)
    end = np.maximum(each + 2, np.searchsorted(before, before[:-1] + words, "left"))
    onward = end <= np.searchsorted(owner, owner, "right")
    start = np.minimum(each - 1, np.searchsorted(before, before[1:] - words, "right") - 1)
    back = start >= np.searchsorted(owner, owner, "left")
    alone = sizes >= (np.inf if single is None else single)
    starts = np.concatenate((each[onward], start[back], each[alone]))
    ends = np.concatenate((end[onward], each[back] + 1, each[alone] + 1))
    return np.divmod(np.unique(starts * (n + 1) + ends), n + 1)


def spans(texts: list[str], least: int = WORDS, alone: int | None = ALONE) -> tuple[np.ndarray, ...]:
    """(text number, first sentence, sentences, hash, second hash) of the spans of all texts."""
    hashes, sizes, owner = [], [], []
    for row, text in enumerate(texts):
        cuts = sentences(text)
        lowered = text.lower()
        if len(lowered) != len(text):  # a letter that lower-cases to two: fold sentence by sentence
            parts = [text[a:b].lower() for a, b in zip(cuts, cuts[1:], strict=False)]
        else:
            parts = [lowered[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for part in parts:
            words = part.split()
            sizes.append(len(words))
            hashes.append(xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass")))
        owner += [row] * len(parts)
    if not owner:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    owner_, sizes_ = np.array(owner, np.int64), np.array(sizes, np.int64)
    mask = (1 << 64) - 1
    lanes = [np.array([h >> s & mask for h in hashes], np.uint64) for s in (0, 64)]
    first_of = np.searchsorted(owner_, owner_)
    starts, ends = _shortest(sizes_, owner_, least, alone)
    lengths = ends - starts
    found = []
    for k in np.unique(lengths).tolist():
        at = starts[lengths == k]
        run = []
        for lane, (a, b) in zip(lanes, _LANES, strict=True):
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = _mix(h + lane[at + j], a, b)
            run.append(h.view(np.int64))
        found.append((owner_[at], at - first_of[at], np.full(len(at), k), *run))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _firsts(row: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which spans are the first of their hash in their text."""
    order = np.lexsort((at, h2, h1, row))
    same = np.zeros(len(order), bool)
    r, a, b = row[order], h1[order], h2[order]
    same[1:] = (r[1:] == r[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first = np.empty(len(order), bool)
    first[order] = ~same
    return first


def _span_rows(words: int, alone: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 2_000_000):
                row, at, k, h1, h2 = spans(batch.column(2).fill_null("").to_pylist(), words, alone)
                keep = _firsts(row, at, h1, h2)
                row, at, k, h1, h2 = row[keep], at[keep], k[keep], h1[keep], h2[keep]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(h1), pa.array(h2), pa.array(at << 8 | k)],
                    ["doc", "row", "h1", "h2", "place"],
                )

    return rows


def covered(docs: DataFrame, words: int = WORDS, alone: int | None = ALONE) -> DataFrame:
    """(doc, row, place) of spans of docs (doc_id, row, text) that an earlier row has.

    place is first sentence * 256 + sentences.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.filter("doc_id is not null").select("doc_id", "row", "text")
    rows = map_arrow(named, _span_rows(words, alone), f"doc {kind}, row long, h1 long, h2 long, place long")
    rows = materialize(rows, "spans")
    # the hash of a row takes in its id, so rows of several ids differ in it
    several = rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.min("row").alias("low"), F.max("row").alias("high"))
    several = materialize(several.filter("low != high").select("h1", "h2", "first"), "repeated-spans")
    held = materialize(rows.join(several, ["h1", "h2"]), "held-spans")
    # several rows of the smallest id may hold a span: the one with the smallest hash is first
    same = held.filter("doc = first")
    lowest = same.groupBy("h1", "h2").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low != high")
    later = same.join(lowest.select("h1", "h2", "low"), ["h1", "h2"]).filter("row != low")
    found = held.filter("doc != first").select("doc", "row", "place").unionByName(later.select("doc", "row", "place"))
    discard(rows, several)
    return found


def remove(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    report: bool = False,
    words: int = WORDS,
    alone: int | None = ALONE,
) -> DataFrame:
    """docs without repeated spans; with report, also how many sentences and words went (n_removed, words_removed).

    words is what a run of several sentences has at least (255 at most: a place has a byte for its sentences), alone
    what a single sentence has; None: single sentences are no spans.
    """
    if not 0 <= words < 256:
        raise ValueError(f"words is {words}, not from 0 to 255")
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    slim = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).alias("text"))
    name = "_places"
    while name in map(str.lower, docs.columns):
        name += "_"
    places = covered(slim, words, alone).groupBy("doc", "row").agg(F.collect_list("place").alias(name))  # bounded by the row's length
    fields = docs.schema.fields
    text_at = docs.columns.index(text_col)
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), row.alias("_hash"))
    same = (F.col("_hash") == F.col("row")) & (F.col("_id") == F.col("doc"))
    joined = packed.join(places, same, "left").select("_row.*", name)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at, 2_000_000):
                column = batch.column(text_at)
                texts = column.fill_null("").to_pylist()
                row, at, k, h1, h2 = spans(texts, words, alone)
                again = ~_firsts(row, at, h1, h2)
                local: dict[int, list[tuple[int, int]]] = {}
                for r, a, n in zip(row[again].tolist(), at[again].tolist(), k[again].tolist(), strict=True):
                    local.setdefault(r, []).append((a, n))
                out, gone, gone_words = [], [], []
                for r, (text, other) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                    runs = local.get(r, []) + [(p >> 8, p & 255) for p in other or ()]
                    n_gone = n_words = 0
                    if runs:
                        cuts = sentences(text)
                        drop = np.zeros(len(cuts) - 1, bool)
                        for a, n in runs:
                            drop[a : a + n] = True
                        n_gone = int(drop.sum())
                        n_words = sum(len(text[cuts[i] : cuts[i + 1]].split()) for i in np.flatnonzero(drop))
                        text = "".join(text[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(~drop))
                    out.append(text)
                    gone.append(n_gone)
                    gone_words.append(n_words)
                new = pa.array([None if x is None else t for x, t in zip(column.to_pylist(), out, strict=True)], pa.string())
                columns = list(batch.columns[:-1])
                columns[text_at] = new
                if report:
                    columns += [pa.array(gone, pa.int64()), pa.array(gone_words, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    taken, extra = {c.lower() for c in docs.columns}, []
    for column in ("n_removed", "words_removed") if report else ():
        while column in taken:
            column += "_"
        extra.append(T.StructField(column, T.LongType()))
    schema = T.StructType([*fields, *extra])
    names = schema.names
    done = map_arrow(joined, rewrite, schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return done
