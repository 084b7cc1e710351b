"""Document fingerprints by order MinHash over character k-mers.

Each k-mer of ``K`` code points gets its occurrence number (first, second, ... time in the text), and the numbered
k-mer is hashed. Every one of ``DRAWS`` draws ranks all numbered k-mers of the text: first those whose hash bears the
draw's number, by the rest of their hash, then all others, by a hash of hash and draw. The two first ones are put back
in text order and hashed as a tuple: a reordered or edited text changes tuples even where its set of k-mers stays.
The second part of a ranking is computed only in draws whose number fewer than two hashes bear: none in long texts,
most in short ones. Likeness of two fingerprints is the share of equal draws among those that either text fills.

A k-mer is one long: its hash (rank, then draw) above, its place below. So numbering, ranking and drawing are sorts
and element-wise passes over arrays of longs, and a text may be as long as a string can be.

Defined cases: null is the empty text; an empty text has an empty fingerprint, which is like another empty one (1)
and unlike all else (0); any other text fills all draws; a text of at most K code points is one k-mer, and a single
k-mer is the tuple of every draw; equal texts have equal fingerprints; ids are numbers or null (else ValueError); null
ids come first, rows of one id follow each other by a hash of their text; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, materialize

K, DRAWS = 8, 64
#: Bits for a k-mer's place; above them lie the draw's number and the rank.
PLACE_BITS = 31
_PLACE = (1 << PLACE_BITS) - 1
_HASH = (1 << 63) - 1 - _PLACE
#: So many of a text's first k-mers by rank hold two of every draw nearly always; draws they don't fill see all.
_FIRST = 10 * DRAWS  # 4,096 at most: an index takes 12 bits
#: So many of a long text's first k-mers, each repeat still under its first rank, give the first ones by rank.
_SORTED = 11 * DRAWS
#: Consecutive ids in one block of ``with_next``.
BLOCK = 256


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(_HASH)).bitwiseOR(place)


def _key(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _draw(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS).bitwiseAND(F.lit(DRAWS - 1).cast("long"))


def _without(marked: Column) -> Column:
    """The elements of an array of longs that are not -1."""
    return F.array_remove(marked, F.lit(-1).cast("long"))


def _or_none(x: Column) -> Column:
    """x, or -1 for null: zip_with pads with nulls, and arrays that can't hold any are sorted and compared faster."""
    return F.coalesce(x, F.lit(-1).cast("long"))


def _next_of(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a))


def kmers(text: Column, k: int = K, first_place: Column | int = 0) -> Column:
    """Packed k-mers of text in text order; a text of at most k code points is one k-mer, the empty text has none."""
    start = (F.lit(first_place) if isinstance(first_place, int) else first_place).cast("long")
    place = lambda i: i.cast("long") if isinstance(first_place, int) and first_place == 0 else start + i
    none = F.slice(F.array(F.lit(0).cast("long")), 1, 0)  # of elements that can't be null, so that sorts are those of longs
    # an empty match at every place but the second half of a surrogate pair
    each = F.regexp_extract_all(text, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{k}}}))"), F.lit(1))
    return (
        F.when(F.length(text) == 0, none)
        .when(F.length(text) <= k, F.array(_packed(F.xxhash64(text), start)))
        .otherwise(F.transform(each, lambda x, i: _packed(F.xxhash64(x), place(i))))
    )


def _whole(s: str, l: str, r: str) -> Column:  # noqa: E741
    """All numbered k-mers by rank."""
    return F.sort_array(F.concat(F.array_except(F.col(s), F.col(l)), F.col(r)))


def with_ranking(df: DataFrame, packed: str, name: str) -> DataFrame:
    """df with the ranking's beginning (_<name>_t) of the k-mers in column packed, and what the whole is made of.

    These are the sorted k-mers (s), the later occurrences among them (l) and these with their numbers (r). The whole
    ranking is sorted only for texts with few k-mers or mostly repeats.
    """
    s, l, r, c, t = (f"_{name}_{x}" for x in ("s", "l", "r", "c", "t"))  # noqa: E741
    col = F.col
    one = F.lit(1 << PLACE_BITS)
    df = df.withColumn(s, F.sort_array(col(packed)))
    # equal k-mers lie side by side: all but the first of each are later occurrences
    later = F.zip_with(col(s), _next_of(col(s)), lambda x, y: _or_none(F.when(x.bitwiseXOR(y) < one, y)))
    df = df.withColumn(l, _without(later))
    last = F.transform(col(l), lambda x, i: F.when(x.bitwiseXOR(F.get(col(l), i + 1)) < one, -1).otherwise(i))
    counts = let(
        F.array_remove(last, F.lit(-1)),
        lambda ends: F.zip_with(
            ends, F.concat(F.array(F.lit(-1)), ends), lambda a, before: F.coalesce(a - before, F.lit(0))
        ),
    )
    numbers = F.flatten(F.transform(F.filter(counts, lambda n: n > 0), lambda n: F.sequence(F.lit(2), n + 1)))
    renamed = F.zip_with(
        col(l), numbers, lambda x, n: _or_none(_packed(F.xxhash64(_key(x), n), x.bitwiseAND(F.lit(_PLACE).cast("long"))))
    )
    df = df.withColumn(r, renamed)
    # all numbered k-mers up to the last one of the first originals: the ranking's beginning
    first = F.slice(col(s), 1, _SORTED)
    begins = let(F.get(col(s), F.lit(_SORTED - 1)), lambda bound: F.filter(col(r), lambda x: x <= bound))
    df = df.withColumn(
        c,
        F.when((F.size(s) <= _SORTED) | (F.size(l) == 0), first).otherwise(
            F.concat(F.array_except(first, F.slice(col(l), 1, _SORTED)), begins)
        ),
    )
    few = (F.size(s) <= _SORTED) | (F.size(c) < _FIRST)
    ranked = F.when(F.size(l) == 0, col(c)).when(few, _whole(s, l, r)).otherwise(F.sort_array(col(c)))
    return df.withColumn(t, ranked).drop(c)


def with_sketch(df: DataFrame, packed: str, name: str) -> DataFrame:
    """df with the fingerprint ``name`` (array<int>, a value for every draw, by draw) of the k-mers in column packed.

    Steps are projections of their own, one array each: so each is computed once, and sorts are those of longs.
    """
    s, l, r, t, b, two, rest = (f"_{name}_{x}" for x in ("s", "l", "r", "t", "b", "two", "rest"))  # noqa: E741
    col = F.col
    one = F.lit(1 << PLACE_BITS)
    none = F.lit(-1).cast("long")
    df = with_ranking(df, packed, name)
    # the first ones by rank, dealt to their draws: draw above, index below
    in_draw = F.lit((DRAWS - 1) << PLACE_BITS).cast("long")
    df = df.withColumn(
        b, F.sort_array(F.transform(F.slice(col(t), 1, _FIRST), lambda x, i: x.bitwiseAND(in_draw).bitwiseOR(i.cast("long"))))
    )

    # a draw's first one stands where the draw changes, its second one beside it: draw, index, index
    no_draw = F.lit(1 << 62)
    before = F.concat(F.array(no_draw), col(b))
    lead = F.zip_with(col(b), before, lambda x, y: F.when(x.bitwiseXOR(y) >= one, x).otherwise(no_draw))
    both = F.zip_with(
        lead,
        _next_of(col(b)),
        lambda x, y: F.when(
            x.bitwiseXOR(y) < one, F.shiftleft(x, 12).bitwiseOR(y.bitwiseAND(F.lit(4095).cast("long")))
        ).otherwise(none),
    )
    df = df.withColumn(two, _without(both))

    def value(draw: Column, x: Column, y: Column) -> Column:
        """Draw above; below it the hash of the two k-mers in text order."""
        at = lambda v: v.bitwiseAND(F.lit(_PLACE).cast("long"))
        h = F.when(at(x) < at(y), F.hash(_key(x), _key(y))).otherwise(F.hash(_key(y), _key(x)))
        return F.shiftleft(draw, 32).bitwiseOR(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

    def of_all(draw: Column) -> Column:
        """The draw's value from its ranking of all k-mers."""
        ranks = F.transform(
            col(rest),
            lambda x, i: F.when(_draw(x) == draw, i.cast("long")).otherwise(_packed(F.xxhash64(_key(x), draw), i.cast("long"))),
        )
        pick = lambda r: F.get(col(rest), r.bitwiseAND(F.lit(_PLACE).cast("long")).cast("int"))
        return let(
            ranks,
            lambda r: let(
                F.array_min(r),
                lambda a: let(
                    F.coalesce(F.array_min(F.array_remove(r, a)), a), lambda c: value(draw, pick(a), pick(c))
                ),
            ),
        )

    # what draws that the beginning leaves open choose from
    df = df.withColumn(
        rest,
        F.when(F.size(two) == DRAWS, F.slice(col(t), 1, 0)).when(F.size(t) == F.size(s), col(t)).otherwise(_whole(s, l, r)),
    )
    filled = f"_{name}_filled"
    df = df.withColumn(filled, F.transform(col(two), lambda x: F.shiftright(x, PLACE_BITS + 12)))
    here = lambda i: F.get(col(t), i.bitwiseAND(F.lit(4095).cast("long")).cast("int"))
    own = F.transform(col(two), lambda x: value(F.shiftright(x, PLACE_BITS + 12), here(F.shiftright(x, 12)), here(x)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long"))
    others = F.transform(F.array_except(every, col(filled)), of_all)
    values = f"_{name}_values"
    df = df.withColumn(values, F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(F.concat(own, others)))
    # a value of its own for each draw: the draw's number takes the lowest bits
    out = F.transform(
        F.sort_array(col(values)),
        lambda v: F.shiftright(F.shiftleft(v, 32), 32)
        .bitwiseAND(F.lit(-DRAWS).cast("long"))
        .bitwiseOR(F.shiftright(v, 32))
        .cast("int"),
    )
    return df.withColumn(name, out).drop(s, l, r, t, b, two, rest, filled, values)


def as_text(fp: Column) -> Column:
    """Fixed-width hexadecimal form."""
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal draws among the draws that a or b fills."""
    filled = F.greatest(F.size(a), F.size(b))  # a fingerprint fills all draws or none
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _following(blocks: DataFrame, base: int = BLOCK, small: int = 4096) -> DataFrame:
    """(block, next_block) in ascending order; the last has null. Wide tables are first solved by groups of base."""
    if blocks.limit(small + 1).count() <= small:
        return blocks.select("block", F.lead("block").over(Window.orderBy("block")).alias("next_block"))
    grouped = blocks.withColumn("upper", F.floor(F.col("block") / base))
    firsts = grouped.groupBy("upper").agg(F.min("block").alias("first"))
    upper = _following(firsts.select(F.col("upper").alias("block")), base, small)
    after = (
        upper.select(F.col("block").alias("upper"), F.col("next_block").alias("nu"))
        .join(firsts.select(F.col("upper").alias("nu"), F.col("first").alias("after")), "nu", "left")
        .select("upper", "after")
    )
    inside = F.lead("block").over(Window.partitionBy("upper").orderBy("block"))
    return (
        grouped.withColumn("in_group", inside)
        .join(after, "upper", "left")
        .select("block", F.coalesce("in_group", "after").alias("next_block"))
    )


def with_next(rows: DataFrame, columns: list[str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """rows (doc_id, text_hash and others) with next_<column>: that of the next row; the first follows the last.

    The order is by doc_id, then text_hash. Rows are dealt by blocks of consecutive ids (those without an id by blocks
    of hashes); the first row of each block also goes to the block before it. So rows are shuffled once, a window spans
    one block only, and a task's share does not grow with the table.
    """
    hashed = F.shiftright(F.col("text_hash"), 54) - F.lit(1 << 62)
    key = F.coalesce(F.floor(F.col("doc_id") / BLOCK).cast("long"), hashed)
    blocks = rows.select(F.struct("doc_id", "text_hash").alias("id"), key.alias("block"))
    blocks = materialize(blocks.groupBy("block").agg(F.min("id").alias("head")), "id-blocks")
    order = materialize(_following(blocks.select("block")), "block-order")
    first = order.agg(F.min("block").alias("first_block"))
    before = order.crossJoin(F.broadcast(first)).select(  # first is one row
        F.coalesce("next_block", "first_block").alias("block"), F.col("block").alias("previous")
    )
    heads = blocks.join(before, "block").select(
        F.col("head.doc_id").alias("head_id"), F.col("head.text_hash").alias("head_hash"), "previous"
    )
    heads = materialize(heads, "block-heads")
    few = heads.count() <= broadcast_rows  # three longs a row
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_hash") == F.col("head_hash"))
    sent = rows.join(F.broadcast(heads) if few else heads, same)
    sent = sent.select("doc_id", "text_hash", *columns, F.col("previous").alias("block"), F.lit(1).alias("is_head"))
    own = rows.select("*", key.alias("block"), F.lit(0).alias("is_head"))
    both = own.unionByName(sent, allowMissingColumns=True)
    w = Window.partitionBy("block").orderBy("is_head", F.col("doc_id").asc_nulls_first(), "text_hash")
    out = both.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return out.filter("is_head = 0").drop("is_head", "block")


def edit(text: Column, following: Column) -> Column:
    """text whose last half (in code points, rounded down) is replaced by the first as many of following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    if not isinstance(docs.schema[id_col].dataType, T.NumericType):
        raise ValueError(f"{id_col} is not a number: rows are dealt by blocks of consecutive ids")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    pairs = with_next(d, ["text"], **options)
    cut = F.length("text") - F.floor(F.length("text") / 2).cast("int")
    # k-mers before this place lie in the half that stays: they are the text's own
    kept = F.greatest(cut - (K - 1), F.lit(0)).alias("kept")
    pairs = pairs.select("*", kept, edit(F.col("text"), F.col("next_text")).alias("edited"), kmers(F.col("text")).alias("own"))
    tail = kmers(F.substr(F.col("edited"), F.col("kept") + 1), first_place=F.col("kept"))
    shared = F.length("edited") - F.col("kept") > K  # else the tail is no run of k-mers
    pairs = pairs.withColumn(
        "changed",
        F.when(shared, F.concat(F.slice(F.col("own"), F.lit(1), F.col("kept")), tail)).otherwise(kmers(F.col("edited"))),
    )
    pairs = pairs.select(
        "doc_id",
        "text_hash",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "own",
        "changed",
    )
    done = with_sketch(with_sketch(pairs, "own", "fp"), "changed", "edited_fp").drop("own", "changed")
    done = with_next(materialize(done, "fingerprints"), ["fp"], **options)
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
