"""Tokens added to a vocabulary: found in the text before the tokenizer sees it."""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.functions.tokens import TOKEN_PATTERN, tokenize

PIECES = "array<struct<piece: string, added: boolean>>"
PIECE = pa.struct([("piece", pa.string()), ("added", pa.bool_())])
#: Added tokens are sent to the tasks; more of them, or more bytes, are refused.
MAX_ADDED, MAX_ADDED_BYTES = 1 << 20, 64 << 20
#: Characters of a token by whose hash places are ruled out, and bits of a hash; characters of
#: texts, about, that are cut at a time.
HEAD, HEAD_BITS, STEP = 6, 23, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _mixed(before: np.ndarray, characters: np.ndarray) -> np.ndarray:
    """Hashes of heads that are one character longer than those ``before``."""
    return (before ^ (before >> np.uint64(29))) * _MIX + (characters + np.uint64(1)) * _MIX


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _MIX) >> np.uint64(64 - HEAD_BITS)


class Trie:
    """Finds the longest of its tokens at a place of a text.

    The trie is its tokens in order, with the longest other token that each one begins with: a
    string and a few bytes for each, whatever it shares with others. What a text begins with
    at a place is the last token that is not behind it, or one that this token begins with.
    """

    def __init__(self, tokens: Iterable[str]):
        self.tokens = sorted(set(tokens))
        if self.tokens and not self.tokens[0]:
            raise ValueError("an added token must not be empty")
        self.longest = max(map(len, self.tokens), default=0)
        self.shorter, above = array("i"), []
        for k, token in enumerate(self.tokens):
            while above and not token.startswith(self.tokens[above[-1]]):
                above.pop()
            self.shorter.append(above[-1] if above else -1)
            above.append(k)
        self.may_begin = np.zeros(1 << HEAD_BITS, dtype=bool)
        self.heads = sorted({min(len(t), HEAD) for t in self.tokens})
        for size in self.heads:
            heads = {t[:size] for t in self.tokens if min(len(t), HEAD) == size}
            characters = _characters("".join(heads)).reshape(-1, size)
            hashes = np.zeros(len(heads), dtype=np.uint64)
            for k in range(size):
                hashes = _mixed(hashes, characters[:, k])
            self.may_begin[_bit(hashes)] = True

    def _places(self, text: str) -> Iterator[int]:
        """Places, in order, where a token may begin: all others are ruled out by hashes."""
        for lo in range(0, len(text) if self.heads else 0, STEP):
            characters = _characters(text[lo : lo + STEP + HEAD - 1])
            hashes = np.zeros(len(characters), dtype=np.uint64)
            may = np.zeros(len(characters), dtype=bool)
            for size in range(1, min(self.heads[-1], len(characters)) + 1):
                hashes = _mixed(hashes[: len(characters) - size + 1], characters[size - 1 :])
                if size in self.heads:
                    may[: len(hashes)] |= self.may_begin[_bit(hashes)]
            yield from (np.flatnonzero(may[:STEP]) + lo).tolist()

    def end_at(self, text: str, at: int) -> int:
        """Where the longest token that starts at ``at`` ends; ``at`` if there is none."""
        begun = text[at : at + self.longest]
        k = bisect.bisect_right(self.tokens, begun) - 1
        while k >= 0 and not begun.startswith(self.tokens[k]):
            k = self.shorter[k]
        return at if k < 0 else at + len(self.tokens[k])

    def cut(self, text: str) -> list[tuple[str, bool]]:
        """The text in pieces, and whether each is a token: leftmost first, then longest."""
        out, begun = [], 0
        for at in self._places(text):
            end = self.end_at(text, at) if at >= begun else at
            if end == at:
                continue
            if begun < at:
                out.append((text[begun:at], False))
            out.append((text[at:end], True))
            begun = end
        if begun < len(text):
            out.append((text[begun:], False))
        return out


def _cut(trie: Trie, texts: pa.Array) -> pa.Array:
    """The pieces of each text; no more than about ``STEP`` characters of them are objects."""
    sizes, done, pieces, added, held = [], [], [], [], 0

    def packed() -> pa.Array:
        columns = [pa.array(pieces, pa.string()), pa.array(added, pa.bool_())]
        return pa.StructArray.from_arrays(columns, fields=list(PIECE))

    for text in texts:
        text = text.as_py()
        found = [] if text is None else trie.cut(text)
        sizes.append(len(found))
        pieces += [p for p, _ in found]
        added += [a for _, a in found]
        held += len(text or "")
        if held > STEP:
            done.append(packed())
            pieces, added, held = [], [], 0
    done.append(packed())
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.concat_arrays(done), mask=texts.is_null()
    )


class AddedTokens:
    """A tokenizer's section of added tokens.

    They are cut out of a text first, wherever they stand, inside words too; what is left
    between them goes to the base tokenizer, piece by piece. So an added token is never split
    or swallowed, and joining all tokens still gives the text back.
    """

    def __init__(self, tokens: Iterable[str]):
        self.tokens = list(dict.fromkeys(tokens))
        size = sum(len(t.encode()) for t in self.tokens)
        if len(self.tokens) > MAX_ADDED or size > MAX_ADDED_BYTES:
            raise ValueError(f"{len(self.tokens)} added tokens of {size} bytes are too many to send")

    @classmethod
    def beyond(cls, base: DataFrame, extended: DataFrame) -> AddedTokens:
        """The tokens of a vocabulary table that ``base`` lacks, in the order of their ids.

        Their number and bytes are looked at before they are fetched.
        """
        new = extended.join(base.select("token"), "token", "left_anti").filter("token <> ''")
        row = new.agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).alias("size")).first()
        if row.n > MAX_ADDED or (row.size or 0) > MAX_ADDED_BYTES:
            raise ValueError(f"{row.n} added tokens of {row.size} bytes are too many to send")
        return cls(r.token for r in new.select("token", "id").orderBy("id").collect())

    def cut(self, text: Column) -> Column:
        """A text as an array of structs ``(piece, added)``; null stays null, empty is empty."""
        tokens = self.tokens

        @F.arrow_udf(PIECES)
        def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
            trie = Trie(tokens)
            for texts in batches:
                yield _cut(trie, texts)

        return cut(text)

    def tokenize(self, df: DataFrame, text: str, out: str, pattern: str = TOKEN_PATTERN) -> DataFrame:
        """Add the token array ``out`` of column ``text``."""
        if not self.tokens:
            return df.withColumn(out, tokenize(F.col(text), pattern))
        cut = df.withColumn("__pieces", self.cut(F.col(text)))
        own = F.transform(
            "__pieces",
            lambda p: F.when(p["added"], F.array(p["piece"])).otherwise(tokenize(p["piece"], pattern)),
        )
        return cut.withColumn(out, F.flatten(own)).drop("__pieces")

    def tokenize_literal(self, text: str, pattern: str = TOKEN_PATTERN) -> list[str]:
        """The same for a short constant, on the driver."""
        from sftprep.functions.tokens import tokenize_literal

        pieces = Trie(self.tokens).cut(text) if self.tokens else [(text, False)]
        return [t for p, added in pieces for t in ([p] if added else tokenize_literal(p, pattern))]
