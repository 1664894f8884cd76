"""Hard negatives by Four-Russians scoring: exact integer inner products from table lookups.

Components are whole numbers. For each eight dimensions of an anchor a table holds the sums of
all 256 subsets of its components. A candidate is held as bit planes: in two's complement, the
bits of equal weight of its components, eight dimensions a byte. Such a byte is an index into
the table, so an inner product is, plane by plane from the sign down, the doubled sum so far
plus one lookup for each eight dimensions. No component is multiplied, and scores are exact.

Candidates are packed into blocks once, anchors into blocks of their own; every block of
anchors meets every block of candidates, and a task keeps only the first few of each anchor.
That happens twice: first for the positives, among candidates of the anchor's own label, then
for negatives, whose range of scores follows from the positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.storage import stored

#: Candidates of a block, and of them at once; anchors of a block, about, and at once; blocks
#: of candidates that a task takes for one block of anchors; groups of blocks, at least.
CANDIDATES, ROWS, ANCHORS, LANES, TOGETHER, GROUPS = 4096, 1024, 2048, 64, 16, 48
#: Components from here on cannot be scored in 64 bits.
LARGEST = 1 << 24
PACKED = "block long, dim int, planes int, ids binary, labels binary, tags binary, bits binary"


@dataclass(frozen=True)
class Settings:
    """positives, negatives: first ones to take. low, high: percent of the positive's score
    that a negative's has to lie between. scale: factor of components before the floor."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def bit_planes(q: np.ndarray) -> np.ndarray:
    """Whole numbers, rows x dimensions, as planes x groups x rows of bytes; last plane: sign."""
    least, most = int(q.min(initial=0)), int(q.max(initial=0))
    planes = max(most.bit_length(), (-least - 1).bit_length() if least < 0 else 0) + 1
    pad = -q.shape[1] % 8
    q = np.pad(q, ((0, 0), (0, pad)))
    bits = (q[None] >> np.arange(planes)[:, None, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed.transpose(0, 2, 1))


def from_planes(bits: np.ndarray, dim: int) -> np.ndarray:
    """The whole numbers that ``bit_planes`` has packed."""
    each = np.unpackbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")[:, :, :dim]
    weight = 1 << np.arange(len(bits), dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.tensordot(weight, each.astype(np.int64), axes=1)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Of rows of components: groups x 256 x rows, the sum of each subset of eight dimensions."""
    wide = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8))).T.astype(kind)
    out = np.zeros((len(wide) // 8, 256, len(anchors)), dtype=kind)
    for g, table in enumerate(out):
        for j in range(8):
            table[1 << j : 2 << j] = table[: 1 << j] + wide[8 * g + j]
    return out


def scores(anchors: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inner products, candidates x anchors, of rows of components with packed candidates."""
    planes, groups, n = bits.shape
    bound = int(np.abs(anchors).sum(axis=1).max(initial=0)) << planes
    kind = np.int32 if bound < 1 << 31 else np.int64
    out = np.empty((n, len(anchors)), dtype=kind)
    for lane in range(0, len(anchors), LANES):
        tables = subset_sums(anchors[lane : lane + LANES], kind)
        for lo in range(0, n, ROWS):
            part = bits[:, :, lo : lo + ROWS]
            total = np.zeros((part.shape[2], tables.shape[2]), dtype=kind)
            for k in range(planes - 1, -1, -1):
                total += total
                for g in range(groups):
                    if k == planes - 1:
                        total -= tables[g][part[k, g]]
                    else:
                        total += tables[g][part[k, g]]
            out[lo : lo + ROWS, lane : lane + LANES] = total
    return out


def _packer(scale: int, size: int):
    """Rows ``(vec_id, label, v, asked)`` to blocks of one length of vectors each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, asked, tags, q = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            order = np.lexsort((tags, ids))
            ids, labels, tags, q = ids[order], labels[order], tags[order], q[order]
            bits = bit_planes(q)
            made += 1
            data = [ids.tobytes(), labels.tobytes(), tags.tobytes(), bits.tobytes()]
            columns = [pa.array([made]), pa.array([dim], pa.int32()), pa.array([len(bits)], pa.int32())]
            columns += [pa.array([x], pa.binary()) for x in data]
            columns += [pa.array([asked[order].tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = [c.split()[0] for c in PACKED.split(", ")] + ["asked"]
        for batch in batches:
            ids, labels, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "tag"))
            asked = batch.column("asked").to_numpy(zero_copy_only=False).astype(np.uint8)
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                flat = batch.column("v").take(pa.array(at)).flatten().to_numpy()
                q = np.floor(flat * scale).astype(np.int64).reshape(len(at), dim)
                for lo in range(0, len(at), size):
                    own = at[lo : lo + size]
                    waiting.setdefault(int(dim), []).append(
                        (ids[own], labels[own], asked[own], tags[own], q[lo : lo + size])
                    )
                    if sum(len(x[0]) for x in waiting[int(dim)]) >= size:
                        yield block(int(dim))
        for dim in list(waiting):
            yield block(dim)

    return pack


class Block:
    """A packed block, its rows ordered by id."""

    def __init__(self, row):
        self.ids, self.labels, self.tags = (np.frombuffer(x, dtype=np.int64) for x in (row.ids, row.labels, row.tags))
        self.dim = row.dim
        self.bits = np.frombuffer(row.bits, dtype=np.uint8).reshape(row.planes, -1, len(self.ids))


def first_of_label(anchors: pd.DataFrame, block: Block, count: int) -> pd.DataFrame:
    """Each anchor's first candidates of its own label: ``(anchor, tag, id, score)``."""
    out = []
    labels = anchors["label"].to_numpy()
    for label in np.unique(labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(block.labels == label)
        if not len(theirs):
            continue
        ids = block.ids[theirs]
        bits = np.ascontiguousarray(block.bits[:, :, theirs])
        for lo in range(0, len(mine), LANES):
            own = mine[lo : lo + LANES]
            found = scores(np.stack(anchors["q"].iloc[own].to_numpy()), bits)
            for k, at in enumerate(own):
                best = np.argsort(-found[:, k].astype(np.int64), kind="stable")[: count + 1]
                anchor, tag = anchors["vec_id"].iat[at], anchors["tag"].iat[at]
                # further rows of the anchor's id, of which there may be many, are no candidates
                if (ids[best] == anchor).any():
                    rest = np.flatnonzero(ids != anchor)
                    order = np.argsort(-found[rest, k].astype(np.int64), kind="stable")
                    best = rest[order[:count]]
                best = best[:count]
                out.append((np.full(len(best), anchor), np.full(len(best), tag), ids[best], found[best, k]))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [[]] * 4
    return pd.DataFrame(dict(zip(("anchor_id", "tag", "id", "score"), columns)), dtype="int64")


def in_range(anchors: pd.DataFrame, block: Block, settings: Settings) -> pd.DataFrame:
    """For each anchor and positive the first candidates of another label within the range."""
    out = []
    for lo in range(0, len(anchors), LANES):
        own = anchors.iloc[lo : lo + LANES]
        found = scores(np.stack(own["q"].to_numpy()), block.bits)
        for k, a in enumerate(own.itertuples(index=False)):
            positive = np.asarray(a.scores, dtype=np.int64)
            least, most = -(-settings.low * positive // 100), settings.high * positive // 100
            s = found[:, k].astype(np.int64)
            may = (block.labels != a.label) & (block.ids != a.vec_id)
            may = np.flatnonzero(may & (s >= least.min()) & (s <= most.max()))
            may = may[np.argsort(-s[may], kind="stable")]
            falling = -s[may]
            first = np.searchsorted(falling, -most, side="left")
            last = np.minimum(np.searchsorted(falling, -least, side="right"), first + settings.negatives)
            for j in range(len(positive)):
                at = may[first[j] : last[j]]
                if len(at):
                    fixed = (a.vec_id, a.tag, a.ids[j], positive[j])
                    out.append((*(np.full(len(at), x) for x in fixed), block.ids[at], s[at]))
    names = ("anchor_id", "tag", "positive_id", "positive_score", "negative_id", "negative_score")
    columns = [np.concatenate(x) for x in zip(*out)] if out else [[]] * 6
    return pd.DataFrame(dict(zip(names, columns)), dtype="int64")


def mine(
    rows: DataFrame,
    vec_id: Column,
    vector: Column,
    label: Column,
    is_anchor: Column,
    settings: Settings = Settings(),
) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows for which ``is_anchor`` holds, positives an anchor's first other rows
    of the same label, negatives for each of them the first rows of another label whose score
    lies in the positive's range; higher scores first, ties to the smaller id. An anchor
    without positives, or a positive without negatives, has no rows; an empty table gives none.

    Rows with a null id, label or vector, with a null or non-finite component, an empty vector,
    or a component whose floor is 2^24 or more in size (a score would not fit 64 bits) take no
    part. Vectors of different lengths never meet. Rows repeated in id, label and vector count
    once; rows of an anchor's own id are never its positives or negatives.
    """
    fits = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) * settings.scale < LARGEST - 1))
    given = rows.select(
        vec_id.cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        vector.cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asked"),
    ).filter("vec_id is not null and label is not null and size(v) > 0")
    given = given.filter(fits).distinct().withColumn("tag", F.xxhash64("label", "v"))
    blocks = stored(
        given.mapInArrow(_packer(settings.scale, CANDIDATES), PACKED + ", asked binary"), "blocks"
    )

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = Block(row)
                at = np.flatnonzero(np.frombuffer(row.asked, dtype=np.uint8))
                if not len(at):
                    continue
                q = from_planes(np.ascontiguousarray(block.bits[:, :, at]), block.dim)
                yield pd.DataFrame(
                    {
                        "vec_id": block.ids[at],
                        "label": block.labels[at],
                        "tag": block.tags[at],
                        "dim": np.full(len(at), block.dim, dtype=np.int32),
                        "q": list(q),
                    }
                )

    anchors = stored(
        blocks.mapInPandas(asking, "vec_id long, label long, tag long, dim int, q array<long>"),
        "anchors",
    )
    many, held = anchors.count(), blocks.count()
    chunks = max(1, -(-many // ANCHORS))
    slices = max(-(-held // TOGETHER), min(held, -(-GROUPS // chunks)), 1)
    # as many partitions as groups of blocks, so that small rows with much work are not merged
    parts = min(chunks * slices, 20_000)
    key = ["chunk", "slice"]
    placed = (
        blocks.drop("asked")
        .withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .repartition(parts, *key)
    )

    def spread(asked: DataFrame) -> DataFrame:
        return (
            asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(chunks)).cast("int"))
            .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
            .repartition(parts, *key)
        )

    def meeting(work, names: str):
        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = [work(right[:0], None)] if not len(left) or not len(right) else []
            for row in left.itertuples(index=False) if not found else ():
                own = right[right["dim"] == row.dim]
                if len(own):
                    found.append(work(own, Block(row)))
            return pd.concat(found or [work(right[:0], None)])

        schema = ", ".join(f"{c} long" for c in names.split())
        return lambda asked: placed.groupBy(key).cogroup(spread(asked).groupBy(key)).applyInPandas(meet, schema)

    def same(asked: pd.DataFrame, block: Block | None) -> pd.DataFrame:
        return first_of_label(asked, block, settings.positives)

    def other(asked: pd.DataFrame, block: Block | None) -> pd.DataFrame:
        return in_range(asked, block, settings)

    near = meeting(same, "anchor_id tag id score")(anchors)
    best = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "id")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= settings.positives)
    positives = near.groupBy("anchor_id", "tag").agg(
        F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("p")
    )
    positives = positives.select(
        F.col("anchor_id").alias("vec_id"), "tag", F.col("p.id").alias("ids"), F.col("p.score").alias("scores")
    )
    asked = stored(anchors.join(positives, ["vec_id", "tag"]), "asked")
    found = meeting(
        other, "anchor_id tag positive_id positive_score negative_id negative_score"
    )(asked)
    first = Window.partitionBy("anchor_id", "tag", "positive_id", "positive_score").orderBy(
        F.desc("negative_score"), "negative_id"
    )
    ranked = found.withColumn("rank", F.row_number().over(first))
    return ranked.filter(F.col("rank") <= settings.negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
