"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

Words (runs that no vocabulary piece crosses) lie one after the other in flat numpy arrays. In each round every
word finds the smallest rank of its adjacent pairs by one segmented minimum and merges all pairs of that rank at once,
from the left where they overlap; the arrays are compacted, and words without a pair leave. The library merges one
pair after the other, which is the same as long as no merge of a rank makes a pair of that rank or a smaller one. For
four of five ranks the model itself tells so (``calm``); of the others a word merges up to the first merge that makes
such a pair with the symbols beside it, and leaves the rest to later rounds.

Rounds go over all symbols that are left, so a word of more than ``LONG`` symbols would take too many over itself: its
rounds take the same ranks in the same order, but touch only the pairs of their rank, by neighbour arrays instead of
compaction. Characters outside the vocabulary become bytes.

Defined cases: null is the empty text, which has no ids and decodes to the empty text; repeated rows are encoded
alike; an empty table gives an empty result; extra columns and null ids change nothing; words may have any length.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, ragged, shared_encoder, slices
from .common import map_arrow

MARK = "▁"
NONE = np.int64(1 << 40)
LONG = 512  # symbols of a word whose rounds still go over all that is left of it


def _apart(touches: np.ndarray) -> np.ndarray:
    """The first, third, ... of every row of pairs that overlap; touches tells whether the next pair overlaps."""
    each = np.arange(len(touches) + 1)
    start = np.maximum.accumulate(np.where(np.append(False, touches), 0, each))
    return (each - start) % 2 == 0


class PieceModel:
    """Vocabulary, pair ranks and bytes of a SentencePiece byte-pair model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        normal = [
            i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        if any(MARK in names[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece crosses words")
        self.newline_cuts = not any("\n" in names[i] for i in normal)
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        # symbols: pieces by id; characters that are no piece of their own come after them
        symbol = {names[i]: i for i in normal}
        self.extra: list[str] = []
        for c in sorted({c for i in normal for c in names[i]} - symbol.keys()):
            symbol[c] = self.size + len(self.extra)
            self.extra.append(c)
        self.char_symbol = {c: s for c, s in symbol.items() if len(c) == 1}
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        pairs = {}
        for i in normal:
            name = names[i]
            for cut in range(1, len(name)):
                a, b = symbol.get(name[:cut]), symbol.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = (order[sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        # ranks whose merges make no pair of that rank or a smaller one
        left, right = self.keys >> 21, self.keys & ((1 << 21) - 1)
        lowest = np.full(self.size + len(self.extra), NONE)
        np.minimum.at(lowest, left, self.ranks[:-1])
        np.minimum.at(lowest, right, self.ranks[:-1])
        self.calm = np.ones(len(order), bool)
        self.calm[self.ranks[:-1][lowest[self.merged[:-1]] <= self.ranks[:-1]]] = False
        text = [
            bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
            else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode()
            for i in range(self.size)
        ]
        self.is_byte = np.array([sp.is_byte(i) for i in range(self.size)])
        self.text_lengths = np.array([len(x) for x in text], np.int64)
        self.text_starts = np.cumsum(self.text_lengths) - self.text_lengths
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.decimal = [str(i) for i in range(self.size)]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of adjacent symbols; rank NONE where they don't merge."""
        none = (1 << 21) - 1  # what unknown characters count as
        key = np.minimum(left, none) << 21 | np.minimum(right, none)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == key, at, len(self.keys))
        return self.ranks[at], self.merged[at]

    def _in_order(self, rank, to, left, right, word) -> np.ndarray:
        """Which merges (in order, of one rank a word) come before any pair that an earlier one of the word makes.

        left and right are the symbols beside a merge when it is made, -1 at the ends of its word.
        """
        rude = np.zeros(len(to), bool)
        check = np.flatnonzero(~self.calm[rank])
        for a, b in ((left[check], to[check]), (to[check], right[check])):
            inner = (a >= 0) & (b >= 0)
            made = np.full(len(check), NONE)
            made[inner] = self._pairs(a[inner], b[inner])[0]
            rude[check] |= made <= rank[check]
        before = np.cumsum(rude) - rude
        head = np.append(True, word[1:] != word[:-1])
        return before == before[np.maximum.accumulate(np.where(head, np.arange(len(to)), 0))]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word)."""
        text = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        unique, where = np.unique(codes, return_inverse=True)
        # an unknown character is kept as a symbol past all others, and merges with none
        first = self.size + len(self.extra)
        sym = np.array([self.char_symbol.get(chr(c), first + c) for c in unique.tolist()], np.int64)
        sym = sym[where] if len(unique) else np.empty(0, np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        rank, to = self._pairs(sym, np.append(sym[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)[: len(rank)]] = NONE
        is_long = np.repeat(lengths > LONG, lengths)
        if is_long.any():
            ends = np.cumsum(lengths)
            for w in np.flatnonzero(lengths > LONG).tolist():
                at = slice(int(ends[w] - lengths[w]), int(ends[w]))
                merged = self._merge_long(sym[at], rank[at])
                done_sym.append(merged)
                done_word.append(np.full(len(merged), w))
            sym, word, rank, to = sym[~is_long], word[~is_long], rank[~is_long], to[~is_long]
        while len(sym):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(heads, len(sym)))
            best = np.minimum.reduceat(rank, heads)
            live = np.repeat(best < NONE, counts)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, to = sym[live], word[live], rank[live], to[live]
                if not len(sym):
                    break
                counts, best = counts[best < NONE], best[best < NONE]
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            p = hit[_apart(hit[1:] == hit[:-1] + 1)]  # pairs side by side are of one word
            if not self.calm[rank[p]].all():
                beside = np.where(np.append(False, p[1:] == p[:-1] + 2), to[np.append(0, p[:-1])], sym[p - 1])
                beside[(p == 0) | (word[p - 1] != word[p])] = -1
                right = np.minimum(p + 2, len(sym) - 1)
                right = np.where((p + 2 < len(sym)) & (word[right] == word[p]), sym[right], -1)
                p = p[self._in_order(rank[p], to[p], beside, right, word[p])]
            sym[p] = to[p]
            rank[p] = rank[p + 1]  # where the merged symbol ends its word, so it stays
            gone = np.ones(len(sym), bool)
            gone[p + 1] = False
            p = p - np.arange(len(p))  # every earlier merge has taken one symbol
            sym, word, rank, to = sym[gone], word[gone], rank[gone], to[gone]
            for at in (p[p > 0] - 1, p):
                at = at[at + 1 < len(sym)]
                at = at[word[at] == word[at + 1]]
                rank[at], to[at] = self._pairs(sym[at], sym[at + 1])
            last = p[(p + 1 == len(sym)) | (word[np.minimum(p + 1, len(sym) - 1)] != word[p])]
            rank[last] = NONE
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        return self._to_bytes(sym, word, len(words))

    def _merge_long(self, symbols: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Symbols of one long word after all merges, by rounds that touch the pairs of their rank only."""
        n = len(symbols)
        sym = symbols.copy()
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray, rank: np.ndarray) -> None:
            at, rank = at[rank < NONE], rank[rank < NONE]
            by_rank = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.diff(rank[by_rank])) + 1
            for part in np.split(by_rank, cuts) if len(by_rank) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(at[part])

        wait(np.arange(n), ranks)
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[(sym[at] >= 0) & (after[at] < n)]  # below 0: merged into its left neighbour
            rank, to = self._pairs(sym[at], sym[after[at]])
            at, to = at[rank == r], to[rank == r]  # else another pair stands here by now, which waits for itself
            if not len(at):
                continue
            hits, take = at, _apart(after[at[:-1]] == at[1:])
            at, to = at[take], to[take]
            gone = after[at]
            if not self.calm[r]:
                left = np.where(np.append(False, before[at[1:]] == gone[:-1]), np.append(0, to[:-1]), sym[before[at]])
                left[before[at] < 0] = -1
                right = np.where(after[gone] < n, sym[np.minimum(after[gone], n - 1)], -1)
                take = self._in_order(np.full(len(at), r), to, left, right, np.zeros(len(at)))
                at, to, gone = at[take], to[take], gone[take]
                rest = hits[hits > at[-1]]  # with those that overlap one that is left
                wait(rest, np.full(len(rest), r))
            sym[at], sym[gone] = to, -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            new = np.unique(np.concatenate((before[at], at)))
            new = new[new >= 0]
            new = new[after[new] < n]
            wait(new, self._pairs(sym[new], sym[after[new]])[0])
        return sym[sym >= 0]

    def _to_bytes(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace symbols that are no pieces by the ids of their bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            first = self.size + len(self.extra)
            unique, where = np.unique(sym[odd], return_inverse=True)
            chars = [self.extra[s - self.size] if s < first else chr(s - first) for s in unique.tolist()]
            raw = [c.encode("utf-8", "replace") for c in chars]
            sizes = np.array([len(x) for x in raw], np.int64)
            flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            counts = np.ones(len(sym), np.int64)
            counts[odd] = sizes[where]
            out = np.repeat(sym, counts)
            at = (np.cumsum(counts) - counts)[odd]
            out[ragged(at, sizes[where])] = flat[ragged((np.cumsum(sizes) - sizes)[where], sizes[where])]
            sym, word = out, np.repeat(word, counts)
        return sym, np.bincount(word, minlength=n_words).astype(np.int64)

    def encoder(self) -> ChunkEncoder:
        """Encoder of whole texts that start with one space of the model's own."""
        cut = "\n" if self.newline_cuts else ""
        pattern = rf"[ {MARK}]+[^ {MARK}{cut}]*|[^ {MARK}{cut}]+" + (r"|\n+" if cut else "")
        return ChunkEncoder(pattern, lambda words: self.encode_words([w.replace(" ", MARK) for w in words]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the first space is the model's own."""
        raw = self.text_bytes[ragged(self.text_starts[ids], self.text_lengths[ids])].tobytes()
        if len(ids) and raw[:1] == b" " and not self.is_byte[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _encoder(path: str, _: str) -> ChunkEncoder:
    model = PieceModel(path)
    encoder = model.encoder()
    encoder.model = model
    return encoder


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from them, for every row of docs."""
    return _run(docs, model, id_col, text_col, digest=False)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, but the number of ids and the SHA-256 of ids and decoded text."""
    return _run(docs, model, id_col, text_col, digest=True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, "pieces", _encoder)
        model = encoder.model
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).fill_null("").to_pylist()
                flat, counts = encoder.ids([" " + t if t else "" for t in texts])
                ends = np.cumsum(counts)
                spans = [flat[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                back = [model.decode(s) for s in spans]
                if digest:
                    name = model.decimal.__getitem__
                    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                    columns = [
                        pa.array(counts, pa.int64()),
                        pa.array([sha(",".join(map(name, s.tolist()))) for s in spans], pa.string()),
                        pa.array([sha(x) for x in back], pa.string()),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    offsets = pa.array(np.append(0, ends), pa.int32())
                    columns = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(back, pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return map_arrow(d, run, f"doc_id {kind}, {out}")
