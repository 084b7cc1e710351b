"""Tokenising operators against their libraries; packing and token files against what they were given."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaforge.llm import chunks, packing, pieces, token_files

SCHEMA = "doc_id long, text string, ids string, piece string, start string"
BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts(n=1500):
    r = random.Random(5)
    parts = list(" \n\t ▁aabbtheing.,!?()'s-0129éßñÉİIK😀ﬁ‌\x85\x1c") + [
        "'s", "'t", "'re", "'LL", "<s>", "<|endoftext|>", "   ", "\r\n", " the", "ŉ", "²", "½", "́", "̸", "Ж", "日", "words", " Words", "...",
    ]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return made + ["", "a" * 1500, " " * 70, "x\n\n\ny", "word " * 900]


def test_chunks_give_the_library_ids():
    for path, pattern in ((BYTES, chunks.BYTE_LEVEL), (WORDS, chunks.ASCII_WORDS)):
        library = Tokenizer.from_file(path)
        encoder = chunks.library_encoder(path, pattern)
        encoder._most = 500  # forgets in between
        x = texts()
        for at in range(0, len(x), 300):
            part = x[at : at + 300]
            flat, counts = encoder.ids(part)
            ends = np.cumsum(counts)
            want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
            assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want


def test_pieces_are_those_of_the_library():
    model = pieces.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    x = texts()
    flat, counts = model.encoder().ids([" " + t if t else "" for t in x])
    want = library.encode(x)
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want
    assert [model.decode(np.array(w, np.int64)) for w in want] == [library.decode(w) for w in want]


def test_long_words_are_merged_in_the_library_s_order():
    """Beyond LONG symbols rounds touch the pairs of their rank only; a million letters take seconds."""
    model = pieces.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(9)
    word = lambda n, of: "".join(r.choice(of) for _ in range(n))
    x = [word(n, of) for of in ("ab", "aeinrst", "thequickbrownfox日é", "a") for n in (500, 511, 512, 513, 3000)]
    x += ["the" * 400, word(1_000_000, "etaoinshrdlucmfwyp"), "short " + word(900, "estn") + " words"]
    flat, counts = model.encoder().ids([" " + t for t in x])
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == library.encode(x)


def test_simultaneous_merges_are_those_of_one_at_a_time():
    """Random tables of pairs, where merges often make pairs of smaller or equal ranks; long and short words."""
    r = random.Random(4)
    for _ in range(60):
        n = r.choice([8, 14, 30])
        pairs = {(r.randrange(n), r.randrange(n)): (r.randrange(12), r.randrange(n)) for _ in range(n * n // r.choice([2, 4]))}
        of_rank = {}
        pairs = {k: (of_rank.setdefault(m, rank), m) for k, (rank, m) in pairs.items()}  # a piece has one rank
        model = pieces.PieceModel.__new__(pieces.PieceModel)
        model.size, model.extra, model.char_symbol = n, [], {"abcd"[i]: i for i in range(4)}
        keys = sorted(a << 21 | b for a, b in pairs)
        each = [pairs[k >> 21, k & (1 << 21) - 1] for k in keys]
        model.keys = np.array(keys, np.int64)
        model.ranks = np.array([x[0] for x in each] + [pieces.NONE], np.int64)
        model.merged = np.array([x[1] for x in each] + [0], np.int64)
        model.calm = np.zeros(12, bool)
        words = ["".join(r.choice("abcd"[: r.choice([1, 2, 4])]) for _ in range(r.choice([1, 3, 9, 40, 600]))) for _ in range(12)]
        ids, counts = model.encode_words(words)
        ends = np.cumsum(counts)
        for word, e, c in zip(words, ends, counts, strict=True):
            sym = [model.char_symbol[x] for x in word]
            while found := [(pairs[p][0], i) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in pairs]:
                i = min(found)[1]
                sym[i : i + 2] = [pairs[sym[i], sym[i + 1]][1]]
            assert ids[e - c : e].tolist() == sym


def test_kept_chunks_are_bounded_by_bytes():
    encoder = chunks.library_encoder(WORDS, chunks.ASCII_WORDS)
    encoder._most_bytes = 100_000
    for i in range(5):
        encoder.ids(["x%d" % i * 60_000])
        assert encoder._bytes < 2_000_000 and len(encoder._numbers) <= 2


def rows():
    x = texts(120)
    r = random.Random(6)
    ids = r.sample(range(10**6), len(x))
    out = [(i, t, "c", "d", "e") for i, t in zip(ids, x, strict=True)] + [(10**7, None, "c", "d", "e"), (10**7 + 1, "tok " * 5000, "c", "d", "e")]
    r.shuffle(out)
    return out


def test_encode_decode_query_forms(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {r[0]: library.encode(r[1] or "") for r in data}
    got = pieces.encode_decode(docs, PIECES).collect()
    assert {x.doc_id: x.ids for x in got} == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    short = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in pieces.digests(docs, PIECES).collect()}
    assert short == {i: (len(w), sha(",".join(map(str, w))), sha(library.decode(w))) for i, w in want.items()}
    assert pieces.digests(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_every_token_once(spark):
    data = rows()
    library = Tokenizer.from_file(BYTES)
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in data}
    for group in (8192, 40):
        got = packing.pack(spark.createDataFrame(data, SCHEMA).repartition(3), BYTES, group_pieces=group).collect()
        total = 0
        for x in got:
            assert x.ids_crc32 == crc(want[x.doc_id][x.start : x.start + x.length])
            total += x.length
        assert total == sum(map(len, want.values()))
        by = {}
        for x in got:
            by.setdefault(x.sequence_id, []).append((x.offset, x.length))
        for spans in by.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 1024
        if group == 8192:
            assert len(by) <= -(-total // 1024) + 2
        assert {x.doc_id: x.piece for x in got if len(want[x.doc_id]) <= 1024} == {i: 0 for i, w in want.items() if len(w) <= 1024}
    assert packing.pack(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


def test_best_fit_is_that_of_a_plain_scan():
    r = np.random.default_rng(7)
    for capacity in (1, 7, 64, 1000):
        lengths = np.sort(r.integers(1, capacity + 1, 400))[::-1]
        bins, offsets = packing.best_fit(lengths, capacity)
        room: list[int] = []
        for need, number, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            fits = [x for x in room if x >= need]
            if fits:
                assert room[number] == min(fits)
            else:
                assert number == len(room)
                room.append(capacity)
            assert offset == capacity - room[number]
            room[number] -= need


def test_token_files_round_trip(spark, tmp_path):
    data = rows()
    library = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame(data, SCHEMA)
    shards = token_files.write(docs, WORDS, length=64, shard_bytes=5_000, least_bytes=5_000, folder=f"file://{tmp_path}/out")
    got = {x.doc_id: x for x in token_files.read(shards).collect()}
    at, everything = 0, []
    for doc_id, text in sorted((r[0], r[1] or "") for r in data):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
        everything += ids
    assert shards.count() > 2
    twice = token_files.write(docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), WORDS)
    again = token_files.read(twice).collect()
    assert len(again) == 2 * len(data) + 1 and {x.start for x in again if x.doc_id is None} == {0}
    read = []
    for row in sorted(shards.collect(), key=lambda r: r.shard):
        shard = token_files.Shard(row.uri)
        for i in range(-(-row.n_tokens // 64)):
            ids, mask = shard.sequence(i)
            assert len(ids) == 64 and not ids.flags.owndata and ids.dtype == np.uint16
            read += ids[np.array(mask.to_pylist())].tolist()
    assert read == everything
    empty = token_files.write(spark.createDataFrame([], SCHEMA), WORDS)
    assert token_files.read(empty).count() == 0
