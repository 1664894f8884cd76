"""Vector codes: parts of vectors named by their nearest entry of a codebook, found in a GNAT.

Vectors of whole numbers are cut into equal parts, and each part position has a codebook. In
every round each part is assigned to the nearest entry, and every entry moves to the floor of
its parts' mean. Sums and counts are whole numbers, so the result does not depend on how the
rows lie over the tasks.

The nearest entry is looked up in a geometric near-neighbour access tree over the entries:
a node has split points, every other point belongs to the nearest of them, and for each split
point and child the tree has the range of distances from the split point to the child's points.
A query measures its distances to the split points; where a range, by the triangle inequality,
leaves a child no point as near as the best so far, the whole subtree is out. Distances are
rounded towards keeping: down where a bound may grow, up where it may shrink, and only a bound
strictly above the best distance excludes. So no tie is lost, and of entries at equal whole
squared distance the lower index wins. Many queries go down the tree together, each first into
the child of its nearest split point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.storage import stored

#: Components from here on have squared distances that do not fit 64 bits.
LARGEST = 1 << 24
#: Split points of a node, points of a leaf, and queries that go down a tree together.
SPLITS, LEAF, QUERIES = 16, 16, 4096
#: A label is heavy with more than this share of the rows, so fewer labels than that are.
HEAVY = 1000


@dataclass(frozen=True)
class Settings:
    """parts: of a vector. entries: of a codebook, at most 256. rounds: of training. scale:
    factor of components before the floor."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows of whole numbers, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * top * top * max(x.shape[1], 1) < 1 << 53:  # then every sum is a whole float
        a, b = x.astype(np.float64), y.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return d.astype(np.int64)
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[None, :, j]) ** 2
    return out


def root_below(d: np.ndarray) -> np.ndarray:
    """The largest whole number whose square is at most ``d``."""
    r = np.sqrt(d.astype(np.float64)).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) ** 2 <= d)


def root_above(d: np.ndarray) -> np.ndarray:
    """The smallest whole number whose square is at least ``d``."""
    r = root_below(d)
    return r + (r * r < d)


class Gnat:
    """The tree over some rows ``points`` of a codebook; ``index`` are their places in it."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        self.points = points
        self.index = np.arange(len(points)) if index is None else index
        self.children: list[Gnat] = []
        if len(points) > LEAF:
            self._split()

    def _split(self) -> None:
        chosen, near = [0], squared(self.points, self.points[:1])[:, 0]
        while len(chosen) < SPLITS and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, squared(self.points, self.points[chosen[-1:]])[:, 0])
        if len(chosen) < 2:  # all points are equal
            return
        self.splits = self.points[chosen]
        d = squared(self.points, self.splits)
        owner = d.argmin(axis=1)
        own = [np.flatnonzero(owner == j) for j in range(len(chosen))]
        # distances from split points (rows) to the points of children (columns)
        self.least = np.stack([root_below(d[at].min(axis=0)) for at in own], axis=1)
        self.most = np.stack([root_above(d[at].max(axis=0)) for at in own], axis=1)
        self.children = [Gnat(self.points[at], self.index[at]) for at in own]

    def search(self, x: np.ndarray, best: np.ndarray, found: np.ndarray, at: np.ndarray) -> None:
        """Lower ``best``, squared distances, and set ``found`` for the queries ``x[at]``."""
        if not len(at):
            return
        if not self.children:
            d = squared(x[at], self.points)
            near = d.min(axis=1)
            which = np.where(d == near[:, None], self.index, len(x) + (1 << 40)).min(axis=1)
            better = (near < best[at]) | ((near == best[at]) & (which < found[at]))
            best[at[better]], found[at[better]] = near[better], which[better]
            return
        d = squared(x[at], self.splits)
        below, above = root_below(d), root_above(d)
        bound = np.zeros((len(at), len(self.children)), dtype=np.int64)
        for i in range(len(self.splits)):
            np.maximum(bound, below[:, i, None] - self.most[i], out=bound)
            np.maximum(bound, self.least[i] - above[:, i, None], out=bound)
        own = d.argmin(axis=1)
        for j, child in enumerate(self.children):
            child.search(x, best, found, at[own == j])
        for j, child in enumerate(self.children):
            open_ = (own != j) & (bound[:, j] ** 2 <= best[at])
            child.search(x, best, found, at[open_])


def nearest(tree: Gnat, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest point for each row of ``x``, and the squared distance."""
    found = np.full(len(x), np.iinfo(np.int64).max)
    best = found.copy()
    for lo in range(0, len(x), QUERIES):
        tree.search(x, best, found, np.arange(lo, min(lo + QUERIES, len(x))))
    return found, best


def _whole(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The vectors of a batch, rows x parts x components of a part."""
    flat = batch.column("q").flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def _add_up(codebooks: np.ndarray):
    """Sums of the parts of each entry, a row a component, and counts at place ``width``."""
    parts, entries, width = codebooks.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(c) for c in codebooks]
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            x = _whole(batch, parts)
            for p, tree in enumerate(trees):
                code, _ = nearest(tree, x[:, p])
                np.add.at(sums[p, :, width], code, 1)
                np.add.at(sums[p, :, :width], code, x[:, p])
        used = np.flatnonzero(np.repeat(sums[:, :, width].ravel() > 0, width + 1))
        columns = [pa.array(used), pa.array(sums.ravel()[used])]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "value"])

    return add_up


def _assign(codebooks: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(c) for c in codebooks]
        for batch in batches:
            x = _whole(batch, len(trees))
            codes, errors = zip(*(nearest(t, x[:, p]) for p, t in enumerate(trees)))
            each = np.stack(codes, axis=1).astype(np.uint8)
            text = [row.tobytes().hex() for row in each]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string())]
            columns.append(pa.array(np.sum(errors, axis=0)))
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return assign


def train(kept: DataFrame, settings: Settings) -> np.ndarray | None:
    """Codebooks, parts x entries x components, of rows ``(vec_id, q)``; None without rows.

    They start as the parts of the smallest ids, one row an id. The driver holds the codebooks
    and, each round, one sum for each of their components.
    """
    ids = kept.filter("vec_id is not null").select("vec_id").distinct()
    last = [r[0] for r in ids.orderBy("vec_id").limit(settings.entries).collect()]
    if not last:
        return None
    first = kept.filter(F.col("vec_id") <= last[-1]).groupBy("vec_id").agg(F.min("q").alias("q"))
    seeds = np.array([r["q"] for r in first.orderBy("vec_id").collect()], dtype=np.int64)
    books = np.ascontiguousarray(
        seeds.reshape(len(seeds), settings.parts, -1).transpose(1, 0, 2)
    )
    width = books.shape[2]
    for _ in range(settings.rounds):
        sums = kept.select("q").mapInArrow(_add_up(books), "cell long, value long")
        got = sums.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        total = np.zeros(books.shape[0] * books.shape[1] * (width + 1), dtype=np.int64)
        total[got["cell"].to_numpy(dtype=np.int64)] = got["value"].to_numpy(dtype=np.int64)
        total = total.reshape(*books.shape[:2], width + 1)
        n = total[:, :, width:]
        books = np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)
    return books


def encode(
    rows: DataFrame,
    vec_id: Column,
    vector: Column,
    label: Column,
    settings: Settings = Settings(),
) -> DataFrame:
    """Rows ``(vec_id, code, error, label_error, codebooks_sha256)``, one for each kept row.

    ``code``: two hex digits a part. ``error``: squared distances to the entries, summed over
    the parts. ``label_error``: errors summed over the rows of the same label, nulls together.
    ``codebooks_sha256``: of all entries' components, joined by commas.

    Rows whose vector is null or holds null or non-finite components are dropped. All vectors
    of the table should have the length of the one with the smallest id, a multiple of the
    parts, and floors below 2^24 in size; rows that do not are returned with a null code and
    error, and are not learned from. Rows with a null id are learned from and coded, but start no
    entry; repeated rows count as often as they are there. With fewer ids than entries the
    codebooks are shorter. Without any coded row the codes and the digest are null; an empty
    table gives no rows.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = rows.select(
        vec_id.cast("long").alias("vec_id"), label.alias("label"), vector.cast("array<double>").alias("v")
    ).filter(F.col("v").isNotNull() & finite)
    fits = (F.size("v") % settings.parts == 0) & (F.size("v") > 0)
    fits &= F.forall("v", lambda x: F.abs(x) * settings.scale < LARGEST - 1)
    floors = F.transform("v", lambda x: F.floor(x * settings.scale).cast("int"))
    whole = stored(given.select("vec_id", "label", F.when(fits, floors).alias("q")), "floors")
    smallest = (
        whole.filter("q is not null and vec_id is not null")
        .agg(F.min(F.struct("vec_id", F.size("q").alias("n"))).alias("x"))
        .first()["x"]
    )
    length = smallest["n"] if smallest else -1
    kept = whole.filter(F.size("q") == length)
    books = train(kept, settings)
    schema = rows.select(label.alias("label")).schema["label"].dataType.simpleString()
    odd = whole.filter(~F.coalesce(F.size("q") == length, F.lit(False))).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    digest = F.lit(None).cast("string")
    if books is None:
        coded = whole.select(odd["vec_id"], "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        fields = f"vec_id long, label {schema}, code string, error long"
        coded = stored(kept.mapInArrow(_assign(books), fields).unionByName(odd), "codes")
        text = ",".join(map(str, books.ravel().tolist()))
        digest = F.lit(hashlib.sha256(text.encode()).hexdigest())
    return _with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256")
    )


def _with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors of each label summed up, nulls together.

    Rows are brought to their label's sum by a shuffle, but for labels of over a thousandth of
    the rows, of which there are less than a thousand: their sums are sent to the rows.
    """
    sums = stored(
        coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")),
        "label-errors",
    )
    rows = sums.agg(F.sum("n")).first()[0] or 0
    heavy = sums.filter(F.col("n") * HEAVY > rows)
    light = sums.filter(F.col("n") * HEAVY <= rows)
    own = F.broadcast(heavy.select(F.col("label").alias("of"), "label_error"))
    same = F.col("label").eqNullSafe(F.col("of"))
    first = coded.join(own, same).drop("of")
    rest = coded.join(own, same, "left_anti")
    second = rest.join(
        light.select(F.col("label").alias("of"), "label_error").hint("merge"), same
    ).drop("of")
    return first.unionByName(second)
