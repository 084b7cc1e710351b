"""Near-duplicate detection with SetSketch registers.

Every text becomes its set of distinct word shingles. A SetSketch holds, for each of ``BANDS * ROWS`` registers, the
truncated logarithm (base ``BASE``) of the smallest exponential value any shingle draws there; sketches of two sets
merge by the larger register, and registers agree about as often as the sets overlap. Texts with equal sets form a
class first, and only classes go on. Bands of registers deal classes into buckets, candidate pairs are estimated
jointly by likelihood from their registers, and what is near the limit or over it is verified on the full sets.

Large buckets are never turned into rows of all their pairs. Every member is compared with its bucket's first one;
what is left counts only where it lies in several components. Small buckets are then compared pair by pair. Members of
large ones are compared with a second pivot of their bucket, and components drawn together: most groups of near copies
end there. What is open then is gathered into families, and blocks of bounded size of a family meet in tasks that
compare whole sets at once and return only links that join components. So every pair that shares a bucket and could
join two components is compared.

Buckets with more than a few thousandths of all rows are few, whatever the input; they are looked up by broadcast, so
that no task gets a whole one.

With 40 bands of 6 registers a pair at a similarity of 0.8 misses all buckets with a chance of 5 in a million.

Defined cases: null and blank texts have an empty set and are linked with nothing; texts shorter than a shingle are
one shingle; each row is judged by its own text, so rows of one id with differing texts are documents of their own,
whose components carry the smallest id of each; a null id is linked with nothing and kept; ``keep`` returns one row of
an id's rows with equal sets; an empty table gives an empty result; extra columns are ignored by ``components`` and
kept by ``keep``; texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import slices
from .common import discard, map_arrow, materialize

BANDS, ROWS = 40, 6
#: SetSketch parameters: base of the truncation, rate, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
_ODD = np.random.default_rng(20_240_229).integers(1 << 31, size=(2, BANDS * ROWS), dtype=np.uint32) * 2 + 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat sorted distinct shingle hashes, number of each text's)."""
    if len(_words) > 100_000:
        _words.clear()
    look = _words.__getitem__
    flat, counts = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # lower() and split() of bytes know ASCII only
        w = np.fromiter(map(look, words), np.uint64, len(words))
        n = max(len(w) - size + 1, min(len(w), 1))
        h = np.zeros(n, np.uint64)
        if n:
            for j in range(min(size, len(w))):
                h = (h ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h = np.unique(h * np.uint64(0xBF58476D1CE4E5B9))
        flat.append(h)
        counts.append(len(h))
    return np.concatenate(flat) if flat else np.empty(0, np.uint64), np.array(counts, np.int64)


def sketches(flat: np.ndarray, counts: np.ndarray, block: int = 32_768) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets that lie one after the other."""
    out = np.empty((len(counts), _ODD.shape[1]), np.uint32)
    ends = np.cumsum(counts)
    short = (flat >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(counts):
        start = int(ends[at] - counts[at])
        stop = max(int(np.searchsorted(ends, start + block)), at + 1)
        x, heads = short[start : int(ends[stop - 1])], (ends[at:stop] - counts[at:stop] - start)
        v = np.empty_like(x)
        for i in range(out.shape[1]):
            np.multiply(x, _ODD[0, i], out=v)
            np.add(v, _ODD[1, i], out=v)
            out[at:stop, i] = np.minimum.reduceat(v, heads)
        at = stop
    smallest = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 128) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sets of known sizes, from their registers (one pair a row)."""
    m = ka.shape[1]
    more, less = (ka > kb).sum(1), (ka < kb).sum(1)
    same = m - more - less
    u, v = na / (na + nb), nb / (na + nb)
    best = np.minimum(u / v, v / u)
    j = best[:, None] * np.linspace(0, 1, steps)[None, :]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    eps = 1e-12
    likelihood = (
        more[:, None] * np.log(up + eps)
        + less[:, None] * np.log(down + eps)
        + same[:, None] * np.log(np.maximum(1 - up - down, eps))
    )
    return j[np.arange(len(j)), likelihood.argmax(1)]


def _band_hashes(registers: np.ndarray) -> np.ndarray:
    """One 64-bit value for each row and band."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        h = (h ^ r[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _set_key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _rep(key: bytes) -> int:
    """Number of the class of equal sets with this key."""
    return int.from_bytes(key[:8], "little", signed=True)


def _sketch_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 2_000_000):
                flat, counts = shingle_sets(batch.column(2).fill_null("").to_pylist(), size)
                full = np.flatnonzero(counts)
                ends = np.cumsum(counts)
                keys = [_set_key(flat[e - n : e]) if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                registers: list[bytes | None] = [None] * len(counts)
                if len(full):
                    for i, row in zip(full.tolist(), sketches(flat, counts[full]), strict=True):
                        registers[i] = row.tobytes()
                reps = pa.array([None if k is None else _rep(k) for k in keys], pa.int64())
                columns = [pa.array(counts), pa.array(keys, pa.binary()), reps, pa.array(registers, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *columns],
                    ["doc_id", "text_hash", "n_shingles", "key", "rep", "registers"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 5000):
            batch = whole.slice(at, 5000)
            raw = b"".join(batch.column(1).to_pylist())
            h = _band_hashes(np.frombuffer(raw, np.uint16).reshape(batch.num_rows, -1))
            rows = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(h.reshape(-1))], ["rep", "bucket"]
            )


def _estimate_filter(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                ka, kb = (
                    np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (2, 3)
                )
                na, nb = (b.column(c).to_numpy().astype(np.float64) for c in (4, 5))
                keep = joint_estimate(ka, kb, na, nb) >= limit
                yield b.select([0, 1]).filter(pa.array(keep))

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2_000_000):
                flat, counts = shingle_sets(batch.column(1).fill_null("").to_pylist(), size)
                ends = np.cumsum(counts).tolist()
                reps = [_rep(_set_key(flat[e - n : e])) for e, n in zip(ends, counts.tolist(), strict=True)]
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                members = pa.ListArray.from_arrays(edges, pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), members], ["rep", "members"])

    return run


def _similar(percent: int):
    """Whether the sets ma and mb are similar enough; sets stay in the JVM, where they meet row by row."""
    common = F.size(F.array_intersect("ma", "mb"))
    return 100 * common >= percent * (F.size("ma") + F.size("mb") - common)


def connected(edges: DataFrame) -> DataFrame:
    """(v, comp): the smallest vertex reachable from v over edges (a, b), for every vertex of an edge.

    Every vertex takes the label of its smallest neighbour (or keeps its own), and the label of that one; then edges
    are drawn between labels, and those inside one label are gone. The rounds go on over what is left, which shrinks
    fast; labels of all rounds are chained.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    labels: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("near"))
        near = materialize(near, "nearest")
        far = near.select(F.col("v").alias("near"), F.col("near").alias("far"))
        step = materialize(near.join(far, "near").select("v", F.col("far").alias("comp")), "labels")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("v").alias("comp"), F.col("comp").alias("then"))
            chained = labels.join(after, "comp", "left").select("v", F.coalesce("then", "comp").alias("comp"))
            old, labels = labels, materialize(chained, "labels")
            discard(old)
        moved = edges.join(step.select(F.col("v").alias("a"), F.col("comp").alias("x")), "a")
        moved = moved.join(step.select(F.col("v").alias("b"), F.col("comp").alias("y")), "b").filter("x != y")
        drawn = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, edges = edges, materialize(drawn, "edges")
        discard(old, near)
        if not edges.limit(1).count():
            discard(edges)
            return labels


def _sets_of(reps: DataFrame, classes: DataFrame, docs: DataFrame, size: int, few: int) -> DataFrame:
    """(rep, members) of the classes in reps (rep), from the text of each one's first document."""
    ids = materialize(classes.select("rep", "doc_id").join(reps.distinct(), "rep"), "set-ids")
    is_few = ids.count() <= few and _narrow(docs)
    wanted = ids.select("doc_id").distinct()
    texts = docs.join(F.broadcast(wanted) if is_few else wanted, "doc_id", "left_semi")
    sets = map_arrow(texts.select("doc_id", "text"), _set_rows(size), "rep long, members array<bigint>")
    known = ids.select("rep")  # an id may have other texts, whose sets nobody asked for
    sets = sets.join(F.broadcast(known) if is_few else known, "rep", "left_semi")
    made = materialize(sets.dropDuplicates(["rep"]), "sets")
    discard(ids)
    return made


def _narrow(docs: DataFrame) -> bool:
    """Whether ids are numbers, so that a number of them bounds their size."""
    return isinstance(docs.schema["doc_id"].dataType, T.NumericType)


def _compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, few: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough; classes has rep, doc_id, n, registers."""
    side = lambda x: classes.select(
        F.col("rep").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}")
    )
    with_registers = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")
    # five standard deviations below the limit
    slack = 5 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5
    likely = map_arrow(with_registers, _estimate_filter(percent / 100 - slack), "a long, b long")
    likely = materialize(likely, "likely-pairs")
    sets = _sets_of(likely.select(F.explode(F.array("a", "b")).alias("rep")), classes, docs, size, few)
    full = (
        likely.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("ma")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("members").alias("mb")), "b")
        .select("a", "b", "ma", "mb")
    )
    links = materialize(full.filter(_similar(percent)).select("a", "b"), "links")
    discard(likely, sets)
    return links


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of a block of sets, as products of 0/1 matrices."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # what one set has alone is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(shared.sum()), columns):
        low, high = np.searchsorted(column, (at, at + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[row[low:high], column[low:high] - at] = 1
        total += m @ m.T
    return total


def _block_links(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links that join components among the rows of two blocks: never more than there are rows."""
        sets = [np.asarray(x, np.int64) for x in group["members"]]
        rep, comp = (group[c].tolist() for c in ("rep", "comp"))
        sizes = np.array([len(x) for x in sets], np.float64)
        common = overlaps(sets)
        near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
            x, y = find(comp[i]), find(comp[j])
            if x != y:
                root[x] = y
                links.append((rep[i], rep[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype({"a": group["rep"].dtype, "b": group["rep"].dtype})

    return run


def _families(crowded: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, few: int, block: int = 192) -> DataFrame:
    """Links between components among the members of crowded buckets (bucket, rep, comp).

    Members of buckets that share members form a family. A family is cut into blocks of bounded size: of one
    component where that is large, of several else. Every two blocks that can hold two components meet in one task,
    which compares all their sets and returns no more links than it has rows.
    """
    star = crowded.groupBy("bucket").agg(F.min("rep").alias("a"))
    family = connected(crowded.select("bucket", F.col("rep").alias("b")).join(star, "bucket").filter("a != b").select("a", "b"))
    members = crowded.select("rep", "comp").distinct().join(family.select(F.col("v").alias("rep"), F.col("comp").alias("family")), "rep")
    members = materialize(members, "families")
    per = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    large = F.col("n_comp") > block
    rest = per.groupBy("family").agg(F.sum(F.when(~large, F.col("n_comp"))).alias("n_rest"))
    sized = members.join(per, ["family", "comp"]).join(rest, "family")
    part = lambda key, n: F.pmod(F.xxhash64(key), F.ceil(n / (block // 2)))
    placed = sized.select(
        "family",
        "rep",
        "comp",
        F.when(large, F.struct(F.col("comp").alias("of"), part("rep", F.col("n_comp")).alias("part")))
        .otherwise(F.struct(F.lit(None).cast("long").alias("of"), part("comp", F.col("n_rest")).alias("part")))
        .alias("block"),
    )
    placed = materialize(placed, "blocks")
    blocks = placed.select("family", "block").distinct()
    x, y = blocks.withColumnRenamed("block", "bx"), blocks.withColumnRenamed("block", "by")
    meets = x.join(y, "family").filter("bx <= by and not (bx.of is not null and bx.of <=> by.of)")
    meets = materialize(meets.withColumn("meet", F.xxhash64("family", "bx", "by")), "block-pairs")
    sides = meets.select("meet", "family", F.col("bx").alias("block")).unionByName(
        meets.filter("not (bx <=> by)").select("meet", "family", F.col("by").alias("block"))
    )
    sets = _sets_of(placed.select("rep"), classes, docs, size, few)
    rows = placed.join(sets, "rep").join(sides, ["family", "block"]).select("meet", "rep", "comp", "members")
    links = materialize(rows.groupBy("meet").applyInPandas(_block_links(percent), "a long, b long"), "links")
    discard(members, placed, meets, sets)
    return links


def _by_bucket(rows: DataFrame, buckets: DataFrame, heavy: int) -> DataFrame:
    """rows joined with buckets (one row each, n the number of its rows).

    Buckets of more than heavy rows, at most the number of all rows by heavy, are broadcast.
    """
    large, small = F.broadcast(buckets.filter(F.col("n") > heavy)), buckets.filter(F.col("n") <= heavy)
    others = rows.join(large.select("bucket"), "bucket", "left_anti")
    return rows.join(large, "bucket").unionByName(others.join(small, "bucket"))


def _links(classes: DataFrame, docs: DataFrame, size: int, percent: int, few: int, small: int = 32) -> DataFrame | None:
    """(v, comp) of classes that are linked with another; None where none is.

    First every member of a bucket is compared with the bucket's first one. What is left of a bucket then matters
    only if it lies in several components: buckets of at most ``small`` members are compared pair by pair, larger
    ones with pivots and then in blocks.
    """
    heavy = max(256, classes.count() * BANDS // 4096)  # so at most 4,096 buckets are heavier
    bands = map_arrow(classes.select("rep", "registers"), _bands, "rep long, bucket long")
    firsts = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).filter("n > 1")
    firsts = materialize(firsts, "first-members")
    left = materialize(_by_bucket(bands, firsts, heavy).filter("rep > first").select("bucket", "rep", "first"), "buckets")
    discard(firsts)
    pairs = materialize(left.select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    if not pairs.limit(1).count():
        return None
    edges = _compare(pairs, classes, docs, size, percent, few)

    def still_open(members: DataFrame) -> DataFrame:
        """(bucket, rep, comp, n) of buckets whose members lie in several components as far as edges say."""
        if edges.limit(1).count():
            now = connected(edges).select(F.col("v").alias("rep"), "comp")
            members = members.select("bucket", "rep").join(now, "rep", "left")
            members = members.select("bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
        else:
            members = members.select("bucket", "rep", F.col("rep").alias("comp"))
        members = materialize(members, "members")
        several = members.groupBy("bucket").agg(
            F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")
        )
        several = materialize(several.filter("x != y").select("bucket", "n"), "several")
        found = materialize(_by_bucket(members, several, heavy), "open-buckets")
        discard(members, several)
        return found

    left = still_open(left)
    few_members = left.filter(F.col("n") <= small)
    other = few_members.select("bucket", F.col("rep").alias("a"), F.col("comp").alias("comp_a"))
    more = few_members.join(other, "bucket").filter("a < rep and comp != comp_a").select("a", F.col("rep").alias("b")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        edges = edges.unionByName(_compare(more, classes, docs, size, percent, few))
    crowded = still_open(left.filter(F.col("n") > small))
    if crowded.limit(1).count():
        # a member of each bucket by a hash of its own: it meets all members of other components
        order = F.xxhash64("rep", F.lit(1))
        pivots = crowded.groupBy("bucket", "n").agg(F.min(F.struct(order.alias("h"), "rep", "comp")).alias("p"))
        pivots = materialize(pivots.select("bucket", "n", F.col("p.rep").alias("a"), F.col("p.comp").alias("of")), "pivots")
        meet = _by_bucket(crowded.drop("n"), pivots, heavy).filter("comp != of")
        meet = meet.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        found = _compare(materialize(meet, "pairs"), classes, docs, size, percent, few)
        if found.limit(1).count():
            edges = edges.unionByName(found)
            crowded = still_open(crowded)
    if crowded.limit(1).count():
        edges = edges.unionByName(_families(crowded, classes, docs, size, percent, few))
    return connected(edges) if edges.limit(1).count() else None


def _judged(docs: DataFrame, size: int, percent: int, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, text_hash, n_shingles, component_id and kept of docs (doc_id, text), and the tables that this reads."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    made = f"doc_id {kind}, text_hash long, n_shingles long, key binary, rep long, registers binary"
    rows = materialize(map_arrow(hashed, _sketch_rows(size), made), "sketches")
    filled = rows.filter("key is not null and doc_id is not null")
    classes = filled.groupBy("key", "rep").agg(
        F.min(F.struct("doc_id", "n_shingles", "registers")).alias("c")  # equal sets have equal registers
    )
    classes = classes.select(
        "key",
        "rep",
        F.col("c.doc_id").alias("doc_id"),
        F.col("c.n_shingles").alias("n"),
        F.col("c.registers").alias("registers"),
    )
    classes = materialize(classes, "classes")
    labels = _links(classes.drop("key"), docs, size, percent, few)
    if labels is not None:
        linked = classes.select("rep", "doc_id").join(labels.withColumnRenamed("v", "rep"), "rep")
        smallest = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        placed = linked.join(smallest, "comp").select("rep", "component_id")
        placed = classes.select("key", "rep", "doc_id").join(placed, "rep", "left")
        placed = placed.select("key", F.coalesce("component_id", "doc_id").alias("component_id"))
    else:
        placed = classes.select("key", F.col("doc_id").alias("component_id"))
    slim = ["doc_id", "text_hash", "n_shingles"]
    alone = rows.filter("key is null or doc_id is null").select(*slim, F.col("doc_id").alias("component_id"))
    out = filled.select(*slim, "key").join(placed, "key").drop("key").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), [rows, classes]


def components(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    few: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Documents are linked when 100 * intersection >= percent * union of their sets of size-word shingles. few is the
    largest number of ids that is broadcast; more are joined by a shuffle.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _judged(d, size, percent, few)[0].drop("text_hash")


def keep(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    few: int = 1_000_000,
) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    judged, read = _judged(d, size, percent, few)
    judged = materialize(judged, "components").filter("doc_id is not null")
    discard(*read)
    name = ["doc_id", "text_hash"]
    # several rows of the smallest id may be in its component; those without a word are no part of it
    first = judged.filter("kept").groupBy("doc_id", (F.col("n_shingles") == 0).alias("blank")).agg(F.min("text_hash").alias("text_hash"))
    dropped = judged.select(*name).distinct().join(first.select(*name), name, "left_anti")
    dropped = materialize(dropped.select(F.col("doc_id").alias("_dropped"), F.col("text_hash").alias("_text")), "dropped")
    gone = F.broadcast(dropped) if dropped.count() <= few and _narrow(d) else dropped
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"))
    left = packed.join(gone, (F.col("_id") == F.col("_dropped")) & (F.col("_hash") == F.col("_text")), "left_anti")
    if judged.groupBy(*name).count().filter("count > 1").limit(1).count():
        best = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("row"))
        ranked = left.filter("_id is not null").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
        left = ranked.unionByName(left.filter("_id is null"))
    return left.select("row.*")
