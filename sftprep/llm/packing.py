"""Packing documents into sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the limit, so an instance of any size is a table of counts of
at most ``limit`` rows. On that table the driver plans kinds of sequences ("2 of length 900
and 1 of 2296, in 17,040 sequences"); it never sees a document. Each piece then finds its
sequence from its length and its rank among the pieces of that length.

The plan first fixes small sets that dominate every other choice, in the way of Martello and
Toth: for the longest length left, a partner that fills the sequence exactly; or the longest
fitting partner, if no two pieces fit beside it, or if no three fit and no two are together
longer than that partner. Some best packing holds every set so fixed. Best fit decreasing
packs what remains, for all pieces of a length at once.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.llm.common import steps, worker_memory
from sftprep.storage import stored

#: Words a worker remembers the ids of.
REMEMBERED = 1_200_000
#: Pieces that one rank counter numbers.
PIECES_PER_COUNTER = 2_000


@dataclass
class Kind:
    """A kind of sequence: (length, copies) of its pieces, in order, and how many there are."""

    parts: list[tuple[int, int]]
    times: int


def reduce_counts(counts: np.ndarray, limit: int) -> list[Kind]:
    """Fix the dominating sets; ``counts[length]`` goes down by what they use."""
    fixed = []
    for j in range(limit, 0, -1):
        while counts[j]:
            counts[j] -= 1
            rest = limit - j
            fits = np.flatnonzero(counts[: rest + 1])
            if not len(fits):
                fixed.append(Kind([(j, 1)], int(counts[j]) + 1))
                counts[j] = 0
                break
            k = int(fits[-1])
            smallest = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
            exact = k == rest
            no_two = len(smallest) < 2 or smallest[:2].sum() > rest
            no_three = len(smallest) < 3 or smallest.sum() > rest
            if not (exact or no_two or (no_three and _longest_two(counts, fits, rest) <= k)):
                counts[j] += 1
                break
            if j == k:
                times = (int(counts[j]) + 1) // 2
                counts[j] -= 2 * times - 1
                fixed.append(Kind([(j, 2)], times))
            else:
                times = min(int(counts[j]) + 1, int(counts[k]))
                counts[j] -= times - 1
                counts[k] -= times
                fixed.append(Kind([(j, 1), (k, 1)], times))
    return fixed


def _longest_two(counts: np.ndarray, fits: np.ndarray, rest: int) -> int:
    """The largest sum of two pieces that is at most ``rest``, 0 if there is none."""
    place = np.searchsorted(fits, rest - fits, side="right") - 1
    same = (place >= 0) & (fits[place] == fits) & (counts[fits] < 2)
    place = np.where(same, place - 1, place)
    return int(np.max(np.where(place >= 0, fits + fits[place], 0), initial=0))


def best_fit(counts: np.ndarray, limit: int) -> list[Kind]:
    """Best fit decreasing of all pieces in ``counts``, a length at a time."""
    open_: dict[int, list[Kind]] = {}
    room = np.zeros(limit + 1, dtype=bool)
    done = []

    def put(kind: Kind, left: int) -> None:
        if left:
            open_.setdefault(left, []).append(kind)
            room[left] = True
        else:
            done.append(kind)

    for length in range(limit, 0, -1):
        n = int(counts[length])
        while n:
            wide = np.flatnonzero(room[length:])
            if len(wide):
                left = length + int(wide[0])
                kind = open_[left].pop()
                room[left] = bool(open_[left])
            else:
                left, kind = limit, Kind([], n)
            each = left // length
            times = min(kind.times, n // each)
            if times:
                put(Kind([*kind.parts, (length, each)], times), left - each * length)
                n -= times * each
            if 0 < n < each and kind.times > times:
                put(Kind([*kind.parts, (length, n)], 1), left - n * length)
                n, times = 0, times + 1
            if kind.parts and kind.times > times:
                put(Kind(kind.parts, kind.times - times), left)
    return done + [k for kinds in open_.values() for k in kinds]


def plan_sequences(counts: dict[int, int], limit: int) -> list[Kind]:
    """The kinds of sequences that hold ``counts[length]`` pieces of each length."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    return reduce_counts(left, limit) + best_fit(left, limit)


def places(kinds: list[Kind]) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for kind in kinds:
        offset = 0
        for length, copies in kind.parts:
            rank = used.get(length, 0)
            rows.append((length, rank, copies, sequence, offset))
            used[length] = rank + copies * kind.times
            offset += length * copies
        sequence += kind.times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, length: str, order: list[str], limit: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to each row of ``pieces``.

    ``length`` names a column of whole numbers from 1 to ``limit``; another value or a null
    raises. Every row gets a place, repeated rows one each; of rows that are equal in
    ``order`` either may get either place. No rows give no rows. ``pieces`` is read several
    times, so it should be a stored table. The driver gets one count a length, at most
    ``limit`` of them.
    """
    wrong = ~F.coalesce(F.col(length).between(1, limit), F.lit(False))
    held = {r[0]: r[1] for r in pieces.groupBy(F.col(length).cast("long")).count().collect()}
    if any(x is None or not 1 <= x <= limit for x in held):
        raise ValueError(f"{length} must be from 1 to {limit}: {pieces.filter(wrong).first()}")
    table = places(plan_sequences(held, limit))
    starts = table[:, 0] << 40 | table[:, 1]
    counters = max(1, sum(held.values()) // PIECES_PER_COUNTER)

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            size, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
            row = table[np.searchsorted(starts, size << 40 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pd.DataFrame(
                {
                    "sequence_id": row[:, 3] + nth // row[:, 2],
                    "offset": row[:, 4] + nth % row[:, 2] * size,
                }
            )

    numbered = pieces.withColumn(
        "__counter", F.pmod(F.xxhash64(*order), F.lit(counters)).cast("int")
    )
    before = Window.partitionBy(length).orderBy("__counter").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = numbered.groupBy(length, "__counter").agg(F.count(F.lit(1)).alias("__n")).select(
        length, "__counter", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    own = Window.partitionBy(length, "__counter").orderBy(*order)
    ranked = numbered.join(offsets, [length, "__counter"]).withColumn(
        "__rank", F.row_number().over(own) - 1 + F.col("__before")
    )
    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]
    return ranked.select(*kept, place(F.col(length).cast("long"), "__rank").alias("__at")).select(
        *kept, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset")
    )


class WordEncoder:
    """Ids of the parts of a text between spaces and line feeds, as bytes.

    Those never stand inside a token of the tokenizer, nor does the boundary between an ASCII
    letter and a stop at the end, so a word is encoded once however it is followed or, in ASCII,
    capitalised. Words of lower-case letters alone are what normalising and cutting leave as
    they are, and skip both.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.bare = Tokenizer.from_file(tokenizer), Tokenizer.from_file(tokenizer)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for encoder in (self.whole, self.bare):
            encoder.no_truncation()
            encoder.no_padding()
        self.memory = worker_memory(("ids", tokenizer), REMEMBERED)

    def _encode(self, words: set[str]) -> dict[str, bytes]:
        plain, others, out = [], [], {}
        for w in words:
            as_is = w.isalpha() and w == w.lower() and (w.isascii() or is_normalized("NFC", w))
            (plain if as_is else others).append(w)
        for encoder, own in ((self.bare, plain), (self.whole, others)):
            coded = encoder.encode_batch_fast(own, add_special_tokens=False)
            out.update((w, array("I", c.ids).tobytes()) for w, c in zip(own, coded))
        return out

    def _work_out(self, words: list[str]) -> dict[str, bytes]:
        known, old = self.memory.known, self.memory.old
        parts, out, new = [], {}, {".", ","}
        for x in words:
            y, stop = x.lower() if x.isascii() and "<|" not in x else x, ""
            if y.endswith((".", ",")):
                before = y[-2:-1]  # in other scripts lower-casing may end in a mark
                if before.isascii() and before.isalpha():
                    y, stop = y[:-1], y[-1]
            ids = known.get(y)
            if ids is None:
                ids = old.get(y)
            if ids is None:
                new.add(y)
            else:
                out[y] = ids
            if stop or x != y:
                parts.append((x, y, stop))
        out.update(self._encode(new))
        for x, y, stop in parts:
            out[x] = out[y] + out[stop] if stop else out[y]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        found = self.memory.look_up([coded.dictionary.to_pylist()], self._work_out)[0]
        each = np.frombuffer(b"".join(found), dtype=np.uint32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        word = coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        kind = np.int32 if max(ends[-1], len(each)) < 1 << 31 else np.int64
        places = np.repeat((starts[word] - ends[:-1]).astype(kind), counts)
        places += np.arange(ends[-1], dtype=kind)
        edges = words.offsets.to_numpy() - words.offsets[0].as_py()
        return each[places], ends[edges]


#: Rows, and bytes of text, that a task encodes at once.
STEP_ROWS, STEP_BYTES = 4000, 6_000_000


def cut_documents(
    docs: DataFrame, doc_id: str, text: Column, tokenizer: str, limit: int, end_id: int = 1
) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32)``, one for each piece of a document.

    A document is its ids by the ``tokenizers`` file, without special tokens added, then
    ``end_id``. Longer ones than ``limit`` are cut into pieces of that length and a rest. Null
    text counts as empty, one piece that is only the end. The tokenizer must part words at
    spaces and bring text to lower case, so that a worker encodes every word once.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for part in steps(batch, "text", STEP_ROWS, STEP_BYTES):
                ids, edges = encoder.ids(part.column("text"))
                rows = []
                for k in range(part.num_rows):
                    own = np.concatenate([ids[edges[k] : edges[k + 1]], end])
                    for piece, at in enumerate(range(0, len(own), limit)):
                        cut_ids = own[at : at + limit]
                        rows.append((k, piece, at, len(cut_ids), zlib.crc32(cut_ids)))
                columns = [pa.array(x) for x in np.array(rows, dtype=np.int64).reshape(-1, 5).T]
                columns[0] = part.column(0).take(columns[0])
                columns[1] = columns[1].cast(pa.int32())
                names = [doc_id, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    given = docs.select(doc_id, F.coalesce(text, F.lit("")).alias("text"))
    schema = f"`{doc_id}` {kind}, piece int, start long, length long, ids_crc32 long"
    return given.mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame, doc_id: str, text: Column, tokenizer: str, limit: int = 4096
) -> DataFrame:
    """Cut the documents and pack the pieces; see ``cut_documents`` and ``pack``.

    Only numbers are stored between the two steps: a row of five for each piece.
    """
    pieces = stored(cut_documents(docs, doc_id, text, tokenizer, limit), "pieces")
    return pack(pieces, "length", [doc_id, "piece", "start", "ids_crc32"], limit)
