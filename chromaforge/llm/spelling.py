"""Spelling variants: words one insertion, deletion or replacement apart, found by automata over halves of words.

One edit leaves one half of a word as it was: the first half still stands at the beginning of the other word, or the
second half at its end. So every word is held by two shards, one for each half. A shard builds an Aho-Corasick automaton
from its halves and scans its words with it; a hit counts where the half stands at the right offset in a word whose
length differs by at most one, and what is left beside the half is then compared.

Words are dealt to shards by the ``PIECE`` characters at the end in question, which both words of a pair share. An end
that more than ``CHARS`` characters of words share is cut into blocks of about that size; its words are scanned against
each block, so a task never holds more than a block, however many words begin alike. In a crowd of words with the same
half, what is left is looked up by its own halves, so a crowd is never compared pair by pair.

A word's form is its most frequent near word, if that is at least ``factor`` times as frequent; its root is the end of
the chain of forms. A chain has at most 18 forms for 64-bit counts, so five rounds of pointer doubling always end it.

Defined cases: a null or blank text has no words; a null id is the empty string; repeated rows count as often as they
occur; case is folded for A-Z only; a run may be of any length; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Characters at a word's end by which it is dealt: no longer than the shorter half of the shortest words.
PIECE = 3
#: Characters of words that a shard or a block holds, about.
CHARS = 1_000_000
#: Words with the same half up to which what is left is compared one by one.
FEW = 16


def fold(run: Column) -> Column:
    """run with A-Z in lower case; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.lower(run) == run, run).otherwise(F.translate(run, upper, upper.lower()))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(id, run): every maximal run of letters with at least ``least`` of them, folded, as often as it occurs."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    return rows.select("id", fold(F.col("run")).alias("run"))


def with_typos(rows: DataFrame, one_in: int = 31) -> DataFrame:
    """(word) of (id, run): a run loses one letter where the hash of its text and row says so."""
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select("run", h.alias("h")).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def count(rows: DataFrame, length: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of (word) for words of ``length`` code points that occur ``least`` times."""
    if length < 2 * PIECE:
        raise ValueError(f"words need {2 * PIECE} characters: each half must have {PIECE}")
    counts = rows.filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character makes a of b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return a[i + 1 :] == b[i + (len(a) == len(b)) :]
    return len(a) != len(b)


class _Crowd:
    """Words of one length with the same half: (rest, n, word)."""

    def __init__(self) -> None:
        self.all: list[tuple[str, int, str]] = []
        self.by_start: dict[str, list] | None = None

    def like(self, rest: str) -> list[tuple[str, int, str]]:
        """Those that may be one edit from rest: all of a few, else those that share a half of what is left."""
        if len(self.all) <= FEW:
            return self.all
        size = len(self.all[0][0])
        half = size // 2
        if self.by_start is None:
            self.by_start, self.by_end = defaultdict(list), defaultdict(list)
            for x in self.all:
                self.by_start[x[0][:half]].append(x)
                self.by_end[x[0][half:]].append(x)
        start = rest[:half]
        ends = self.by_end.get(rest[len(rest) - (size - half) :], ())
        return self.by_start.get(start, []) + [x for x in ends if x[0][:half] != start]


class Halves:
    """Automaton over the first (side 0) or second (side 1) halves of words."""

    def __init__(self, side: int, words: list[str], counts: list[int]) -> None:
        self.side = side
        held: dict[str, dict[int, _Crowd]] = {}
        for word, n in zip(words, counts, strict=True):
            half = len(word) // 2
            key, rest = (word[half:], word[:half]) if side else (word[:half], word[half:])
            held.setdefault(key, defaultdict(_Crowd))[len(word)].all.append((rest, n, word))
        self.automaton = ahocorasick.Automaton()
        for key, crowds in held.items():
            self.automaton.add_word(key, (len(key), crowds))
        if held:
            self.automaton.make_automaton()

    def near(self, word: str) -> tuple[int, int, str] | None:
        """(number of near words, count of the most frequent, that word); equal counts: the smallest word.

        A pair that keeps both halves (an insertion between them) is left to side 0.
        """
        size, found, best_n, best = len(word), 0, 0, ""
        reach = size // 2 + 1
        span = (size - reach, size) if self.side else (0, reach)
        for end, (length, crowds) in self.automaton.iter(word, *span):
            if end != (size if self.side else length) - 1:
                continue
            rest = word[: size - length] if self.side else word[length:]
            for other in (size - 1, size, size + 1):
                crowd = crowds.get(other)
                for there, n, name in crowd.like(rest) if crowd else ():
                    if one_edit(rest, there) and not (self.side and word.startswith(there)):
                        found += 1
                        if n > best_n or n == best_n and name < best:
                            best_n, best = n, name
        return (found, best_n, best) if found else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (side, shard, only_scan, word, n), sorted by the first three: a shard's own words come first, are held and scanned."""
    key, held, halves = None, ([], []), None

    def out(words: list[str]) -> Iterator[pa.RecordBatch]:
        found = [(w, *x) for w in words if (x := halves.near(w))]
        if found:
            columns = zip(*found, strict=True)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal halves
        if halves is None and held[0]:
            halves = Halves(key[0], *held)
            yield from out(held[0])

    for batch in batches:
        others: list[str] = []
        for side, shard, only_scan, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (side, shard) != key:
                if others:
                    yield from out(others)
                    others = []
                yield from close()
                key, held, halves = (side, shard), ([], []), None
            if only_scan:
                yield from close()
                if halves is not None:
                    others.append(word)
            else:
                held[0].append(word)
                held[1].append(n)
        if others:
            yield from out(others)
    yield from close()


def near(words: DataFrame, chars: int = CHARS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones."""
    spark = words.sparkSession
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", 1, PIECE).alias("piece")),
        F.struct(F.lit(1).alias("side"), F.substring("word", -PIECE, PIECE).alias("piece")),
    )
    rows = words.select("word", "n", F.explode(ends).alias("e")).select("e.*", "word", "n")
    sizes = materialize(rows.groupBy("side", "piece").agg(F.sum(F.length("word")).alias("size")), "ends")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(3 * tasks, -(-total // chars))
    crowded = sizes.filter(F.col("size") > chars).select("side", "piece", F.ceil(F.col("size") / chars).alias("blocks"))
    rows = rows.join(crowded, ["side", "piece"], "left")
    home = F.pmod(F.xxhash64("word"), F.col("blocks"))
    blocks = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.select("side", "piece", "word", "n", "blocks", home.alias("home"), F.explode(blocks).alias("block"))
    shard = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("side", "piece"), F.lit(shards))).otherwise(F.xxhash64("piece", "block"))
    dealt = rows.select("side", shard.alias("shard"), (F.coalesce("home", "block") != F.col("block")).alias("only_scan"), "word", "n")
    dealt = dealt.repartition(max(tasks, 1), "side", "shard").sortWithinPartitions("side", "shard", "only_scan")
    found = map_arrow(dealt, _scan, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))  # largest count, then smallest word
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form of each chain. Each round doubles the steps taken."""
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        moved = bool(step.filter("_moved").head(1))
        discard(at)
        if not moved:
            return step.drop("_moved")
        at = step.drop("_moved")
        at.table_path = step.table_path


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n)."""
    words = materialize(words, "words")
    all_words = words.join(near(words), "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    form, form_n = F.when(is_form, F.col("best")), F.when(is_form, F.col("best_n"))
    forms = materialize(all_words.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")), "forms")
    discard(words)
    found = roots(forms.filter("form is not null").select("word", "form"))
    return forms.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
