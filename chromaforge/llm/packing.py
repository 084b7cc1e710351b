"""Best-fit packing of documents into token sequences.

Each document's ids, with an end id, form one piece, or pieces when there are more than a sequence holds (then
the first piece takes the rest, so all others fill a sequence). Pieces are dealt evenly to groups of a bounded
number of pieces; in each group best-fit decreasing puts every piece into the open sequence it fits most tightly,
found in a segment tree over remaining capacities. A group wastes at most about one sequence, whatever the input.

Defined cases: null is the empty text, whose only id is the end id; repeated rows are packed as often as they
occur; an empty table gives an empty result; ties in length are packed by the order of id and piece; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BYTE_LEVEL, shared_encoder, slices
from .common import map_arrow, materialize


class OpenBins:
    """Open bins by remaining capacity, and a segment tree that knows where any are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, number: int) -> None:
        if capacity > 0:
            self.bins[capacity].append(number)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the tightest open bin that holds need; it is open no more."""
        node, tree = self.size + need, self.tree
        while not tree[node]:
            while node & 1:  # a right child: go up until a right sibling is left to look at
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, given in descending order."""
    bins, offsets, opened, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), OpenBins(capacity), 0
    for i, need in enumerate(lengths.tolist()):
        found = opened.take(need)
        if found is None:
            found, n = (capacity, n), n + 1
        room, number = found
        bins[i], offsets[i] = number, capacity - room
        opened.put(room - need, number)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, BYTE_LEVEL)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, counts = encoder.ids(batch.column(1).fill_null("").to_pylist())
                at, rows, out = 0, [], ([], [], [], [])
                for row, n in enumerate(counts.tolist()):
                    own = np.append(ids[at : at + n], end_id).astype("<u4").tobytes()
                    at += n
                    n += 1
                    start, length = 0, n % capacity or capacity
                    piece = 0
                    while start < n:
                        rows.append(row)
                        for values, v in zip(
                            out, (piece, start, length, zlib.crc32(own[4 * start : 4 * (start + length)])), strict=True
                        ):
                            values.append(v)
                        start, length, piece = start + length, capacity, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32())]
                    + [pa.array(x, pa.int64()) for x in out[1:]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 1024,
    group_pieces: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece of docs with its sequence and its offset there."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = materialize(pieces(d, tokenizer, end_id, capacity), "pieces")
    n_groups = max(1, cut.count() // group_pieces)
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(g["length"].to_numpy(), capacity)
        return g.assign(sequence_id=g["group"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="group")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("group").applyInPandas(fit, f"{schema}, sequence_id long, offset long")
