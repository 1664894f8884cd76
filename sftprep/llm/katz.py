"""A Katz backoff bigram model: counted, discounted, normalised and applied at scale.

Texts are tokenized once into blocks of one to two million tokens: a row with the block's own
vocabulary as 64-bit hashes, its tokens as places in it, and its documents. Blocks are what meets the corpus's
counts, so that a word or pair costs a row for each block it is in, not for each occurrence.

1. Words of all blocks are counted, and every block gets the ids and counts of its words.
2. Every block asks for the counts of its distinct pairs. Pairs are partitioned by their first
   word, frequent first words into several parts. A part answers with each pair's training
   count and, for each first word, what its backoff weight follows from: how many pairs have
   count 1, 2, ..., the counts beyond, and the unigram probability of all words seen after it.
3. The counts of counts of all pairs give the discounts. Every block then evaluates its
   tokens recursively: the discounted share of a pair that was seen, else the backoff weight
   of the first word times the probability of the second one, which in turn is its discounted
   share or, unseen, what the discounts have freed.

Both block tables are bucketed by block, so asking and evaluating do not move tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.llm.common import steps
from sftprep.storage import shared_path, stored

#: Bytes of text of a block, about; documents are never cut.
BLOCK = 9_000_000
#: Training occurrences of a first word that one part holds, and pairs of a part, about.
SPLIT = 200_000
PART = 1_000_000
#: Counts up to this one are discounted.
LARGEST = 5
END = 0
BEGIN = -1


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Katz's Good-Turing discount ``d[r]`` for counts ``r``; ``d[0]`` and above are unused.

    ``counts_of_counts[r]`` is how many events have count ``r``, for ``r`` up to
    ``LARGEST + 1``. Where the estimate is no discount (not above 0 and below 1, or a count of
    counts is 0), as in small or odd data, ``d[r]`` is ``(r - 0.5) / r`` instead.
    """
    n = [counts_of_counts.get(r, 0) for r in range(LARGEST + 2)]
    out = np.ones(LARGEST + 1)
    common = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGEST + 1):
        d = 0.0
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Unigrams:
    """Counts of counts up to ``LARGEST + 1``, all training tokens and distinct ones."""

    counts_of_counts: dict[int, int]
    tokens: int
    types: int

    def probabilities(self, count: np.ndarray) -> np.ndarray:
        """Of words with these training counts; 0 stands for the one class of unseen words.

        The probabilities of all seen words and of that class add up to 1.
        """
        d = discounts(self.counts_of_counts)
        if not self.tokens:
            return np.ones(len(count))
        freed = sum(
            (1 - d[r]) * r * self.counts_of_counts.get(r, 0) for r in range(1, LARGEST + 1)
        )
        shared = np.where(count <= LARGEST, d[np.minimum(count, LARGEST)] * count, count)
        if freed <= 0:
            return np.where(count > 0, shared, 1.0) / (self.tokens + 1)
        return np.where(count > 0, shared, freed) / self.tokens


def pair_shares(
    count: np.ndarray, first_count: np.ndarray, discount: np.ndarray
) -> np.ndarray:
    """Discounted shares of seen pairs among all that begin with the same word."""
    d = np.where(count <= LARGEST, discount[np.minimum(count, LARGEST)], 1.0)
    return d * count / np.maximum(first_count, 1)


def backoff(
    stats: np.ndarray, total: np.ndarray, seen: np.ndarray, discount: np.ndarray
) -> np.ndarray:
    """Backoff weights of first words.

    ``stats``: columns of numbers of pairs with count 1 to ``LARGEST``; ``total``: training
    count as first word; ``seen``: probability of the words seen after it. Where no pair is
    discounted, one count is set aside for backoff: shares are then of ``total + 1``.
    """
    r = np.arange(1, LARGEST + 1)
    freed = (stats * ((1 - discount[1:]) * r)).sum(axis=1) / np.maximum(total, 1)
    return np.where(freed > 0, freed, 1.0 / (total + 1.0)) / np.maximum(1 - seen, 1e-300)


def _bucketed(df: DataFrame, label: str, buckets: int) -> DataFrame:
    """A table in the shared folder, bucketed by block."""
    name = f"llm_{label}_{uuid.uuid4().hex}"
    path = shared_path(df.sparkSession, label)
    df.write.bucketBy(buckets, "block").format("parquet").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


BLOCKS = (
    "block long, docs array<string>, lens array<int>, held array<boolean>, "
    "tokens array<int>, words array<long>, train array<long>"
)


BLOCK_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("docs", pa.list_(pa.string())),  # a null beside long numbers would make them doubles
        ("lens", pa.list_(pa.int32())),
        ("held", pa.list_(pa.bool_())),
        ("tokens", pa.list_(pa.int32())),
        ("words", pa.list_(pa.int64())),
        ("train", pa.list_(pa.int64())),
    ]
)


def tokenize_blocks(docs: DataFrame, doc_id: str, text: Column, folds: int, fold: int) -> DataFrame:
    """Blocks of ``docs``; a document is held out if ``crc32`` of its id leaves ``fold``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between stages
        for batch in batches:
            for part in steps(batch, "text", batch.num_rows, BLOCK):
                ids = part.column("id").to_pylist()
                split = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
                flat = split.flatten()
                real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                edges = np.concatenate([[0], np.cumsum(real)])[
                    split.offsets.to_numpy() - split.offsets[0].as_py()
                ]
                coded = flat.filter(pa.array(real)).dictionary_encode()
                lens = np.diff(edges) + 1
                tokens = np.full(lens.sum(), END, dtype=np.int32)
                inside = np.ones(len(tokens), dtype=bool)
                inside[np.cumsum(lens) - 1] = False
                tokens[inside] = coded.indices.to_numpy(zero_copy_only=False) + 1
                held = [
                    x is not None and zlib.crc32(str(x).encode()) % folds == fold for x in ids
                ]
                train = np.bincount(
                    tokens,
                    weights=np.repeat(~np.array(held, dtype=bool), lens),
                    minlength=len(coded.dictionary) + 1,
                )
                words = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()]
                words = np.array([END, *words], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [uuid.uuid4().int >> 65],
                        "docs": [[None if x is None else str(x) for x in ids]],
                        "lens": [lens.astype(np.int32)],
                        "held": [held],
                        "tokens": [tokens],
                        "words": [words],
                        "train": [train.astype(np.int64)],
                    },
                    schema=BLOCK_SCHEMA,
                )

    given = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")
    )
    return given.mapInArrow(blocks, BLOCKS)


class Block:
    """A block with the global ids and counts of its words."""

    def __init__(self, row, parts: int):
        place = np.asarray(row.places, dtype=np.int64)
        words = row.size
        self.ids = np.full(words + 1, BEGIN, dtype=np.int64)
        self.counts = np.zeros(words + 1, dtype=np.int64)
        self.ids[place] = np.asarray(row.ids)
        self.counts[place] = np.asarray(row.counts)
        self.lens = np.asarray(row.lens, dtype=np.int64)
        self.held = np.asarray(row.held, dtype=bool)
        self.tokens = np.asarray(row.tokens, dtype=np.int64)
        first = np.concatenate([[words], self.tokens[:-1]])
        starts = np.cumsum(self.lens) - self.lens
        first[starts] = words  # the place after the last word stands for the beginning
        keys, inverse = np.unique(first * (words + 1) + self.tokens, return_inverse=True)
        self.left, self.right = keys // (words + 1), keys % (words + 1)
        weight = np.repeat(~self.held, self.lens)
        train = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64)
        # an unseen word has no id, and is in no training pair, but its backoff is asked for
        self.first_counts = np.append(self.counts[:-1], self.counts[0])
        known = self.first_counts[self.left] > 0
        w1, w2 = self.ids[self.left], self.ids[self.right]
        splits = np.maximum(-(-self.first_counts[self.left] // SPLIT), 1)
        # of a first word in several parts every part is asked, for its share of the backoff
        many, at = np.unique(self.left[known & (splits > 1)], return_index=True)
        wide = splits[known & (splits > 1)][at]
        extra = np.repeat(many, wide)
        salts = np.concatenate([np.arange(n) for n in wide] or [[]]).astype(np.int64)
        self.left = np.concatenate([self.left, extra])
        self.right = np.concatenate([self.right, np.full(len(extra), words)])
        w1 = np.concatenate([w1, self.ids[extra]])
        w2 = np.concatenate([w2, np.full(len(extra), BEGIN)])
        train = np.concatenate([train, np.zeros(len(extra), dtype=np.int64)])
        salt = np.concatenate([w2[: len(splits)] % splits, salts])
        known = np.concatenate([known, np.ones(len(extra), dtype=bool)])
        part = np.where(known, mixed(w1, salt) % parts, -1)
        # by second word within a part: its ids and counts then come in runs, which pack well
        order = np.lexsort((w2, part))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[inverse]  # of each token
        self.left, self.right = self.left[order], self.right[order]
        self.part, self.w1, self.w2, self.train = part[order], w1[order], w2[order], train[order]

    def asked(self) -> Iterator[tuple[int, slice]]:
        """The parts asked, and which pairs each of them gets."""
        edges = np.flatnonzero(np.diff(self.part, prepend=-2))
        for lo, hi in zip(edges, np.append(edges[1:], len(self.part))):
            if self.part[lo] >= 0:
                yield int(self.part[lo]), slice(lo, hi)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two arrays of whole numbers, from 0 up."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(
            0xC2B2AE3D27D4EB4F
        )
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(17)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers or doubles, compressed byte by byte of their places."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<i8" if values.dtype.kind in "iub" else "<f8"))
    planes = planes.view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(data: bytes, dtype: str = "<i8") -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(dtype).ravel()


def _asks(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = Block(row, parts)
                rows = [
                    (
                        part,
                        row.block,
                        packed(block.w1[own]),
                        packed(block.w2[own]),
                        packed(block.train[own]),
                        packed(block.counts[block.right[own]]),
                    )
                    for part, own in block.asked()
                ]
                yield pd.DataFrame(rows, columns=["part", "block", "w1", "w2", "n", "c2"])

    return run


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))


def _answers(unigrams: Unigrams):
    """Counts pairs of one part and answers every block that asked."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        firsts_of = [unpacked(x) for x in group["w1"]]
        edges = np.cumsum([0, *map(len, firsts_of)])
        w1 = np.concatenate(firsts_of)
        w2, n, c2 = (np.concatenate([unpacked(x) for x in group[c]]) for c in ("w2", "n", "c2"))
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        count = np.add.reduceat(n[order].astype(np.int64), starts)
        pair_of = np.empty(len(order), dtype=np.int64)
        pair_of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        firsts = _runs(a[starts])
        first_of = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(starts))))
        stats = np.zeros((len(firsts), LARGEST), dtype=np.int32)
        low = np.flatnonzero((count > 0) & (count <= LARGEST))
        np.add.at(stats, (first_of[low], count[low] - 1), 1)
        p = np.where(count > 0, unigrams.probabilities(c2[order][starts]), 0.0)
        seen = np.bincount(first_of, weights=p, minlength=len(firsts))
        histogram = np.bincount(count, minlength=LARGEST + 2)[: LARGEST + 2]
        nothing = packed(np.zeros(0))
        rows = [(-1, 0, packed(histogram), nothing, nothing, nothing)]
        rigid = stats.sum(axis=1) == 0
        for k, (block, part) in enumerate(zip(group["block"], group["part"])):
            own = pair_of[edges[k] : edges[k + 1]]
            first, unseen = first_of[own], count[own] == 0
            need = np.unique(first[unseen])
            rows.append(
                (
                    block,
                    part,
                    packed(count[own]),
                    packed(rigid[np.unique(first)]),
                    packed(stats[need].ravel()),
                    packed(seen[need]),
                )
            )
        return pd.DataFrame(rows, columns=["block", "part", "c", "rigid", "stats", "seen"])

    return run


def _evaluate(unigrams: Unigrams, discount: np.ndarray, parts: int):
    columns = "id held_out n_tokens n_known base_score score".split()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=columns)
        row = next(left.itertuples(index=False))
        block = Block(row, parts)
        answers = {a.part: a for a in right.itertuples(index=False)}
        count = np.zeros(len(block.left), dtype=np.int64)
        words, rigid, needed, stats, seen = [], [], [], [], []
        for part, own in block.asked():
            answer = answers[part]
            count[own] = unpacked(answer.c)
            words.append(np.unique(block.w1[own]))
            rigid.append(unpacked(answer.rigid))
            needed.append(np.unique(block.w1[own][count[own] == 0]))
            stats.append(unpacked(answer.stats).reshape(-1, LARGEST))
            seen.append(unpacked(answer.seen, "<f8"))
        first_count = block.first_counts[block.left]
        second = unigrams.probabilities(block.counts[block.right])
        scale, weight = np.ones(len(count)), np.ones(len(count))
        if words:
            kinds, where = np.unique(np.concatenate(words), return_inverse=True)
            asked = block.part >= 0
            kind = np.searchsorted(kinds, block.w1[asked])
            total = np.zeros(len(kinds))
            total[kind] = first_count[asked]
            # a word is rigid if none of its parts has a discounted pair
            soft = np.bincount(where, weights=1 - np.concatenate(rigid), minlength=len(kinds))
            scale[asked] = np.where(soft > 0, 1.0, total / (total + 1.0))[kind]
            some = np.searchsorted(kinds, np.concatenate(needed))
            s = np.zeros((len(kinds), LARGEST))
            np.add.at(s, some, np.concatenate(stats))
            q = np.bincount(some, weights=np.concatenate(seen), minlength=len(kinds))
            weight[asked] = backoff(s, total, q, discount)[kind]
        share = pair_shares(count, first_count, discount) * scale
        log = np.log10(np.where(count > 0, share, weight * second))
        starts = np.cumsum(block.lens) - block.lens
        own = block.counts[block.tokens]
        base = np.log10((own + 1) / (unigrams.tokens + unigrams.types + 1))
        return pd.DataFrame(
            {
                "id": pd.array([None if x is None else int(x) for x in row.docs], "Int64"),
                "held_out": block.held,
                "n_tokens": block.lens,
                "n_known": np.add.reduceat((own > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(log[block.pair], starts),
            }
        )

    return run


def score(
    docs: DataFrame, doc_id: str, text: Column, folds: int = 7, fold: int = 2
) -> DataFrame:
    """Rows ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    The model learns from the documents whose ``crc32(id as text) % folds`` is not ``fold``
    and scores all of them, whole. A-Z in lower case; tokens are the words of the text, then
    one end. ``score``: log10 probability of the tokens, the first after a beginning.
    ``base_score``: the same by add-one unigrams. ``n_known``: tokens that training has.

    Null text counts as empty: one end token. Rows with a null id take part in training.
    Repeated rows count as often as they are there. Without any training document every
    token has the probability of the one unseen class. An empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _bucketed(tokenize_blocks(docs, doc_id, text, folds, fold), "blocks", buckets)
    words = blocks.select(
        "block", F.posexplode(F.arrays_zip("words", "train")).alias("place", "word")
    ).select("block", "place", F.col("word.words").alias("word"), F.col("word.train").alias("n"))
    counted = stored(
        words.repartition("word")  # rows are smaller than partial lists of them
        .groupBy("word")
        .agg(F.sum("n").alias("c"), F.collect_list(F.struct("block", "place")).alias("at"))
        .filter("c > 0")
        .select(F.monotonically_increasing_id().alias("id"), "c", "at"),
        "words",
    )
    few = {
        r["c"]: r["n"]
        for r in counted.filter(F.col("c") <= LARGEST + 1)
        .groupBy("c")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    total, types = counted.agg(F.sum("c"), F.count(F.lit(1))).first()
    unigrams = Unigrams(few, int(total or 0), int(types))
    ids = counted.select("id", "c", F.explode("at").alias("at")).select(
        F.col("at.block").alias("block"), F.col("at.place").alias("place"), "id", "c"
    )
    ids = _bucketed(
        ids.groupBy("block").agg(F.collect_list(F.struct("place", "id", "c")).alias("x")).select(
            "block",
            F.col("x.place").alias("places"),
            F.col("x.id").alias("ids"),
            F.col("x.c").alias("counts"),
        ),
        "ids",
        buckets,
    )
    none = F.array().cast("array<bigint>")
    known = blocks.select(
        "block", "docs", "lens", "held", "tokens", F.size("words").alias("size")
    ).join(ids, "block", "left").withColumns(
        {
            "places": F.coalesce("places", F.array().cast("array<int>")),
            "ids": F.coalesce("ids", none),
            "counts": F.coalesce("counts", none),
        }
    )
    parts = max(1, unigrams.tokens // PART)
    asked = known.mapInPandas(
        _asks(parts),
        "part long, block long, w1 binary, w2 binary, n binary, c2 binary",
    )
    answers = stored(
        asked.groupBy("part").applyInPandas(
            _answers(unigrams),
            "block long, part long, c binary, rigid binary, stats binary, seen binary",
        ),
        "answers",
    )
    # the histograms of the parts, of a few numbers each, add up to the counts of counts
    def adding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["c"]:
                yield pd.DataFrame({"r": np.arange(LARGEST + 2), "n": unpacked(data)})

    histogram = (
        answers.filter("block = -1")
        .select("c")
        .mapInPandas(adding, "r long, n long")
        .groupBy("r")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    discount = discounts({x["r"]: x["n"] for x in histogram})
    scored = (
        known.groupBy("block")
        .cogroup(answers.filter("block >= 0").groupBy("block"))
        .applyInPandas(
            _evaluate(unigrams, discount, parts),
            "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return scored.select(
        F.col("id").alias(doc_id),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(unigrams.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
