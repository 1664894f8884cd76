"""Token operators against the libraries they stand in for."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sftprep.llm import bpe, packing, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(RANKS),
        special_tokens={},
    )


def test_byte_bpe_equals_tiktoken(docs, tiktoken_encoding):
    rows = bpe.with_digests(docs, F.col("text"), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_byte_bpe_round_trip(docs, tiktoken_encoding):
    coded = bpe.encode(docs, F.col("text"), RANKS, public_tokenizers.PATTERN)
    for r in bpe.decode(coded, F.col("ids"), RANKS).collect():
        assert r.ids == tiktoken_encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_piece_counts_equal_sentencepiece(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.with_token_counts(docs, F.col("text"), PIECES, 100).collect()
    for r in rows:
        n = len(sp.encode(r.text or ""))
        assert (r.n_tokens, r.over_limit) == (n, n > 100)
        assert r.n_bytes == len((r.text or "").encode())


@pytest.mark.parametrize("spaces", [1, 2, 3, 15, 16, 17, 33, 70])
@pytest.mark.parametrize("word", ["", "b", "½", "the"])
def test_runs_of_spaces(spaces, word):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    merger = token_counts.PieceMerger(PIECES)
    text = "a" + " " * spaces + word
    chunks = [token_counts.SPACE + c.replace(" ", "▁") for c in token_counts.chunks_of(text)]
    assert merger.count(chunks).sum() == len(sp.encode(text))


def one_at_a_time(parts, rank_of):
    """The parts of a word after its joins: each time the leftmost of the lowest rank."""
    parts = list(parts)
    while True:
        ranks = [rank_of(a + b) for a, b in zip(parts, parts[1:])]
        lowest = min((r for r in ranks if r is not None), default=None)
        if lowest is None:
            return parts
        k = ranks.index(lowest)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def strange_words(rng, least, most):
    return ["".join(rng.choices("abc", weights=[5, 3, 1], k=rng.randint(least, most))) for _ in range(60)]


@pytest.mark.parametrize("seed", range(6))
def test_long_words_by_ranks_in_any_order(seed):
    rng = random.Random(seed)
    made = {"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(60)}
    ranks = {bytes([k]): k for k in range(256)}
    for k, token in enumerate(rng.sample(sorted(made), len(made))):
        ranks[token] = 256 + k
    words = list(dict.fromkeys(strange_words(rng, bpe.LONG - 20, bpe.LONG + 60)))
    coded = bpe.RankEncoder(ranks).encode(words)
    for w in words:
        parts = one_at_a_time([bytes([c]) for c in w.encode()], ranks.get)
        assert coded[w] == (" ".join(str(ranks[p]) for p in parts), w.encode())


@pytest.mark.parametrize("seed", range(6))
def test_piece_counts_by_ranks_in_any_order(seed):
    rng = random.Random(seed)
    made = sorted({"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(60)})
    order = {p: rng.randrange(40) for p in made}  # ties between pieces
    pieces = {p: k for k, p in enumerate([*"abc", *made])}
    merger = token_counts.PieceMerger.__new__(token_counts.PieceMerger)
    merger.size, merger.chars = len(pieces), {c: pieces[c] for c in "abc"}
    found = sorted(
        (pieces[p[:k]] * merger.size + pieces[p[k:]], order[p], pieces[p])
        for p in made
        for k in range(1, len(p))
        if p[:k] in pieces and p[k:] in pieces
    )
    merger.keys, merger.ranks, merger.made = (np.array(x, dtype=np.int64) for x in zip(*found))
    words = strange_words(rng, 1, 80)
    expected = [len(one_at_a_time(w, order.get)) for w in words]
    assert merger.count(words).tolist() == expected


def test_merging_gives_every_token_back():
    ranks = bpe.read_ranks(RANKS)
    assert bpe.RankEncoder(ranks).unmerged(ranks) == []


def test_packing_keeps_every_token_in_place(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(WORD)
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    expected = []
    for key, text in given:
        ids = np.array(encoder.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            expected.append((key, piece, at, len(own), zlib.crc32(own.tobytes())))
    rows = packing.pack_documents(docs, "doc_id", F.col("text"), WORD, 64).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def fewest(lengths, limit):
    """The fewest sequences, by trying everything."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values()):
            place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, limit - lengths[k]])

    place(0, [])
    return best


def test_dominance_keeps_the_best_packing():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, size=9).tolist(), reverse=True)
        left = np.bincount(lengths, minlength=21)
        fixed = packing.reduce_counts(left, 20)
        rest = [n for n in range(20, 0, -1) for _ in range(left[n])]
        used = sorted(n for k in fixed for n, copies in k.parts for _ in range(copies * k.times))
        assert sorted(used + rest) == sorted(lengths)
        assert sum(k.times for k in fixed) + fewest(rest, 20) == fewest(lengths, 20)


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(6, 1.2, 20_000).astype(int) + 1, 4096)
    kinds = packing.plan_sequences(dict(zip(*np.unique(lengths, return_counts=True))), 4096)
    held = sum(n * copies * k.times for k in kinds for n, copies in k.parts)
    assert held == lengths.sum()
    assert all(sum(n * c for n, c in k.parts) <= 4096 for k in kinds)
    assert sum(k.times for k in kinds) <= 1.01 * -(-int(lengths.sum()) // 4096)


def test_empty_tables(none):
    pattern = public_tokenizers.PATTERN
    assert bpe.with_digests(none, F.col("text"), RANKS, pattern).count() == 0
    assert token_counts.with_token_counts(none, F.col("text"), PIECES).count() == 0
    assert packing.pack_documents(none, "doc_id", F.col("text"), WORD).count() == 0


def test_lengths_out_of_range_raise(spark):
    df = spark.createDataFrame([(1, 0)], "doc_id long, length long")
    with pytest.raises(ValueError, match="length"):
        packing.pack(df, "length", ["doc_id"], 10)
