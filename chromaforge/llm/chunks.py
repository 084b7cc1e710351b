"""Exact token ids of many texts, each distinct chunk encoded once.

A tokenizer whose merges never cross certain places gives the same ids for a text as for its chunks one after the
other. Natural text repeats its words, so a worker keeps the ids of chunks it has seen and only looks them up after
that. What it keeps is bounded in number and in bytes (before a batch of texts; the batch itself is bounded too).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow.compute as pc

#: White space as the tokenizers' patterns know it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Letters that need no care (the one whose lower case is two characters does), ASCII punctuation, and what may follow a run of each: places where both tokenizers cut
#: for certain. An apostrophe may begin a contraction, so it begins a run only before a digit, white space or the end.
_L, _P = "A-Za-zÀ-ÖØ-öø-įı-ɏ", r"!-/:-@\[-`{-~"
_AFTER_L, _AFTER_P = r"(?=[\x00-@\[-`{-\x7f]|\Z)", rf"(?=[{_L}0-9\t\n\r ]|\Z)"
_NO_QUOTE = r"!-&(-/:-@\[-`{-~"
#: Byte-level rule: one space may lead a word; other runs of white space leave their last one to what follows. What
#: is not certain stays together up to the next white space.
BYTE_LEVEL = (
    rf" ?[{_L}]++{_AFTER_L}|(?: [{_P}]|[{_NO_QUOTE}])[{_P}]*+{_AFTER_P}|'[{_P}]*+(?=[0-9\t\n\r ]|\Z)"
    rf"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: The same for tokenizers that drop white space.
ASCII_WORDS = (
    rf"[{_L}]++{_AFTER_L}|[{_NO_QUOTE}][{_P}]*+{_AFTER_P}|'[{_P}]*+(?=[0-9\t\n\r ]|\Z)|[^\t\n\x0b\x0c\r ]+"
)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of all runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class _Numbers(dict):
    """Gives every new key the next number and remembers it as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class ChunkEncoder:
    """ids(texts) by a pattern that cuts texts and a function that encodes a list of chunks."""

    def __init__(
        self,
        pattern: str,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        most: int = 600_000,
        most_bytes: int = 256 << 20,
        specials: Sequence[str] = (),
    ):
        self._find, self._encode, self._most, self._most_bytes = re.compile(pattern).findall, encode, most, most_bytes
        #: Strings that the tokenizer cuts out before its own pattern; what is left between them stands alone.
        self._specials = tuple(specials)
        self._special = re.compile("(" + "|".join(map(re.escape, self._specials)) + ")") if specials else None
        self.size = 0  # of the vocabulary, where it is known
        self._forget()

    def _forget(self) -> None:
        self._numbers = _Numbers()
        self._bytes = 0  # of what is kept, roughly
        self._flat = np.empty(0, np.int32)
        self._starts, self._lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        if len(self._numbers) > self._most or self._bytes > self._most_bytes:
            self._forget()
        look = self._numbers.__getitem__
        codes, n_chunks = [], []
        for text in texts:
            if any(x in text for x in self._specials):
                parts = self._special.split(text)  # every second one is a special string
                got = [look(c) for i, p in enumerate(parts) for c in ([p] if i % 2 else self._find(p))]
            else:
                got = list(map(look, self._find(text)))
            n_chunks.append(len(got))
            codes += got
        if self._numbers.new:
            flat, lengths = self._encode(self._numbers.new)
            self._bytes += 180 * len(lengths) + 2 * sum(map(len, self._numbers.new)) + 4 * len(flat)
            self._numbers.new = []
            self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(lengths) - lengths])
            self._lengths = np.concatenate([self._lengths, lengths])
            self._flat = np.concatenate([self._flat, flat.astype(np.int32)])
        codes = np.asarray(codes, np.int64)
        lengths = self._lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(n_chunks)]).astype(np.int64)
        return self._flat[ragged(self._starts[codes], lengths)], np.diff(ends[edges])


def library_encoder(path: str, pattern: str) -> ChunkEncoder:
    """Encoder over a file of the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, parts = [], []
        for at in range(0, len(chunks), 5000):
            for e in tokenizer.encode_batch_fast(chunks[at : at + 5000], add_special_tokens=False):
                ids = e.ids
                lengths.append(len(ids))
                parts += ids
        return np.asarray(parts, np.int32), np.asarray(lengths, np.int64)

    added = tokenizer.get_added_tokens_decoder()
    encoder = ChunkEncoder(pattern, encode, specials=[t.content for t in added.values()])
    encoder.size = max([tokenizer.get_vocab_size(with_added_tokens=True), *(i + 1 for i in added)])
    return encoder


_made: dict[tuple[str, str], ChunkEncoder] = {}


def shared_encoder(path: str, pattern: str, make: Callable[[str, str], ChunkEncoder] = library_encoder) -> ChunkEncoder:
    """This worker process's encoder for path; its chunks serve all later batches and tasks."""
    if (path, pattern) not in _made:
        _made[path, pattern] = make(path, pattern)
    return _made[path, pattern]


def slices(batch, text_at: int, most_chars: int = 4_000_000):
    """Parts of an Arrow batch of at most about most_chars characters (one longer text stands alone)."""
    sizes = pc.utf8_length(batch.column(text_at)).fill_null(0).to_pylist()
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most_chars:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)
