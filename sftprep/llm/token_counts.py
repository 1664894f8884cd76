"""Token counts of a sentencepiece BPE model by rank-synchronous merging of arrays.

A text is cut before every run of spaces, as no piece of the model holds a space after
another character, so that merges never cross such a cut. The chunks a worker has not met yet
are laid out together in flat arrays: one symbol a place, and the chunk each place belongs
to. Every round looks up the rank of all neighbouring pairs at once, finds the lowest rank of
each chunk, and joins all pairs of that rank simultaneously (of overlapping ones, the first,
third, ... of a run); chunks without a pair left drop out with the number of their symbols.
A join can make a pair of no higher rank with a neighbour, as a piece may rank before its
parts. One join at a time would take that pair next, so a chunk's joins of a round end with
the first that makes one. That gives what one join at a time gives, whatever the ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.llm.common import worker_memory

#: Chunks a worker remembers.
REMEMBERED = 800_000
SPACE = "▁"
NEVER = np.iinfo(np.int64).max


class PieceMerger:
    """The pairs of a sentencepiece BPE model and their ranks, as sorted arrays."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [
            i
            for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        pieces = {sp.id_to_piece(i): i for i in plain}
        self.size = sp.get_piece_size()
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        found = []
        for piece, made in pieces.items():
            for cut in range(1, len(piece)):
                left, right = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left * self.size + right, order[sp.get_score(made)], made))
        found.sort()
        self.keys, self.ranks, self.made = (np.array(x, dtype=np.int64) for x in zip(*found))

    def pair_places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table of pairs, -1 for pairs that never join."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, place, -1)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        place = self.pair_places(left, right)
        return np.where(place >= 0, self.ranks[place], NEVER)

    def _cut(self, hit, symbol, owner, place, rank) -> None:
        """Take back, in each chunk, the joins after the first that makes a pair which is due."""
        at = np.flatnonzero(hit)
        if not len(at):
            return
        own, made = owner[at], self.made[place[at]]
        last = len(symbol) - 1
        inside = (at > 0) & (owner[np.maximum(at - 1, 0)] == own)
        before = np.where(inside, symbol[np.maximum(at - 1, 0)], -1)
        joined = np.append(False, (np.diff(at) == 2) & (own[1:] == own[:-1]))
        before = np.where(joined, np.append(-1, made[:-1]), before)
        inside = (at + 2 <= last) & (owner[np.minimum(at + 2, last)] == own)
        after = np.where(inside, symbol[np.minimum(at + 2, last)], -1)
        due = np.minimum(self._rank_of(before, made), self._rank_of(made, after)) <= rank[at]
        if due.any():
            earlier = np.cumsum(due) - due
            firsts = np.searchsorted(own, own)
            hit[at[earlier > earlier[firsts]]] = False

    def count(self, chunks: list[str]) -> np.ndarray:
        """The number of tokens of each chunk, spaces written as U+2581, none of them empty.

        A character the model lacks counts as its UTF-8 bytes (byte fallback).
        """
        out = np.zeros(len(chunks), dtype=np.int64)
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        text = "".join(chunks)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kinds, where = np.unique(codes, return_inverse=True)
        ids = np.array([self.chars.get(chr(c), -1) for c in kinds], dtype=np.int64)
        extra = np.array([0 if i >= 0 else len(chr(c).encode()) - 1 for i, c in zip(ids, kinds)])
        symbol, owner = ids[where], np.repeat(np.arange(len(chunks)), lengths)
        np.add.at(out, owner, extra[where])
        while len(symbol):
            place = self.pair_places(symbol[:-1], symbol[1:])
            place = np.append(np.where(owner[:-1] == owner[1:], place, -1), -1)
            rank = np.where(place >= 0, self.ranks[place], NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(symbol)))
            done = lowest == NEVER
            out[owner[starts[done]]] += counts[done]
            hit = (rank == np.repeat(lowest, counts)) & (place >= 0)
            at = np.arange(len(hit))
            before = np.maximum.accumulate(np.where(hit, -1, at))
            hit &= (at - before) % 2 == 1
            self._cut(hit, symbol, owner, place, rank)
            symbol = np.where(hit, self.made[place], symbol)
            keep = np.repeat(~done, counts)
            keep[1:] &= ~hit[:-1]
            symbol, owner = symbol[keep], owner[keep]
        return out


def chunks_of(text: str) -> list[str]:
    """The chunks of a text without the space each begins with; ``""`` has none."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]


def token_counter(model: str):
    """A pandas UDF: text -> number of tokens by the sentencepiece model in file ``model``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merger, memory = PieceMerger(model), worker_memory(("pieces", model), REMEMBERED)

        def work_out(new: list[str]) -> dict[str, int]:
            counts = merger.count([SPACE + x.replace(" ", SPACE) for x in new])
            return dict(zip(new, counts.tolist()))

        for batch in batches:
            out = []
            for lo in range(0, len(batch), 256):
                split = [chunks_of(x or "") for x in batch.iloc[lo : lo + 256]]
                out += map(sum, memory.look_up(split, work_out))
            yield pd.Series(out, dtype="int64")

    return count


def with_token_counts(
    docs: DataFrame, text: Column, model: str, limit: int = 4096
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to each row.

    Null text counts as empty: no bytes, no tokens. Texts of any length are taken whole. Rows
    are neither merged nor dropped, so repeated rows and null ids stay as they are; columns of
    those three names are replaced. An empty table gives an empty result.
    """
    whole = F.coalesce(text, F.lit(""))
    return docs.withColumns(
        {
            "n_bytes": F.octet_length(whole).cast("long"),
            "n_tokens": token_counter(model)(whole),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
