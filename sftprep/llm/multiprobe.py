"""Nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``projections`` random Gaussian projections of a vector
into cells of a common width. A query visits its own bucket of every table, then buckets whose
cells differ by one here and there, in the order of their estimated chance of success: the
squared distances to the cell borders crossed, by their expected values, so that one sequence
serves all queries. The candidates of all tables are merged and ranked by exact distance.

Cell width and number of probes are fitted on a bounded sample, as the fewest probes that
find ``recall`` of the sample's own neighbours; every vector is indexed. A sample is sparser
than the whole, so its neighbours lie farther apart and the fit errs towards more probes.

Equal vectors are indexed ``k + 1`` times at most, by their smallest ids: more of them cannot
be among anybody's ``k`` nearest. Equal queries are searched once. Buckets are split into
units of bounded size, and queries meet the rows of a unit in blocks of a matrix.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.storage import stored


@dataclass(frozen=True)
class Settings:
    """tables, projections: of the index. recall: aimed at on the sample. sample: its vectors.
    sample_queries: how many of them are searched for. unit: rows of a part of a bucket that
    is not split further. part: rows that a task's group holds, about."""

    tables: int = 4
    projections: int = 6
    recall: float = 0.97
    sample: int = 4000
    sample_queries: int = 200
    unit: int = 2000
    part: int = 20_000
    seed: int = 11


@dataclass(frozen=True)
class Fit:
    """Cell width and the sets of crossed borders to probe, by rank of border distance."""

    width: float
    probes: list[tuple[int, ...]]


def probing_sequence(projections: int, count: int) -> list[tuple[int, ...]]:
    """Sets of border ranks (0 nearest), by rising expected sum of squared distances.

    Of the ``2 m`` border distances of a random point, in units of the width, the j-th smallest
    has an expected square in closed form. Ranks j and 2m+1-j belong to one projection.
    """
    m = projections
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = np.arange(m + 1, 2 * m + 1)
    far = 1 - (2 * m + 1 - k) / (m + 1) + (2 * m + 1 - k) * (2 * m + 2 - k) / (
        4 * (m + 1) * (m + 2)
    )
    cost = np.concatenate([near, far])
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < count:
        score, ranks = heapq.heappop(heap)
        if len({min(r, 2 * m - 1 - r) for r in ranks}) == len(ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*ranks, last + 1)))
    return found


class Hasher:
    """The hash tables for vectors of one length."""

    def __init__(self, dim: int, width: float, settings: Settings):
        rng = np.random.default_rng([settings.seed, dim])
        self.l, self.m = settings.tables, settings.projections
        self.width = width
        self.axes = rng.standard_normal((dim, self.l * self.m))
        self.shift = rng.random(self.l * self.m)
        mix = np.random.default_rng([settings.seed, dim, 1])
        self.mix = mix.integers(1, 2**62, self.m, dtype=np.int64) | 1
        self.salt = mix.integers(0, 2**62, self.l, dtype=np.int64)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Coordinates in units of the width, rows x tables x projections."""
        return (x @ self.axes / self.width + self.shift).reshape(len(x), self.l, self.m)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key for each bucket; rare collisions only add candidates."""
        with np.errstate(over="ignore"):
            mixed = (cells.astype(np.int64) * self.mix).sum(axis=-1)
            return (mixed ^ (mixed >> 29)) * np.int64(0x2545F4914F6CDD1D) + self.salt

    def own_keys(self, x: np.ndarray) -> np.ndarray:
        return self.keys(np.floor(self.places(x)))

    def probe_keys(self, x: np.ndarray, probes: list[tuple[int, ...]]) -> np.ndarray:
        """Keys of the probed buckets, rows x tables x probes, in probing order."""
        at = self.places(x)
        cell = np.floor(at)
        part = at - cell
        borders = np.concatenate([part, 1 - part], axis=-1)
        order = np.argsort(borders, axis=-1, kind="stable")
        axis, step = order % self.m, np.where(order < self.m, -1, 1)
        out = np.empty((*cell.shape[:2], len(probes)), dtype=np.int64)
        rows, tables = np.ogrid[: len(x), : self.l]
        for k, ranks in enumerate(probes):
            moved = cell.copy()
            for r in ranks:
                moved[rows, tables, axis[:, :, r]] += step[:, :, r]
            keys = self.keys(moved)
            out[:, :, k] = keys
        return out


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the components' differences."""
    return np.sqrt(((rows.astype(np.float64) - query.astype(np.float64)) ** 2).sum(axis=1))


def fit(sample: np.ndarray, k: int, settings: Settings) -> Fit:
    """Width and probes for a sample of vectors of one length."""
    hasher = Hasher(sample.shape[1], 1.0, settings) if len(sample) else None
    spread = float(np.median((sample @ hasher.axes).std(axis=0))) if len(sample) > 1 else 1.0
    width = 1.5 * (spread or 1.0)
    every = probing_sequence(settings.projections, 3**settings.projections)
    if len(sample) < 2:
        return Fit(width, every)
    hasher = Hasher(sample.shape[1], width, settings)
    own = hasher.own_keys(sample)
    queries = sample[: settings.sample_queries]
    probed = hasher.probe_keys(queries, every)
    ranks = []
    for i, q in enumerate(queries):
        d = distances(sample, q)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        first = np.full(len(near), len(every))
        for t in range(settings.tables):
            hit = probed[i, t][None, :] == own[near, t][:, None]
            first = np.minimum(first, np.where(hit.any(1), hit.argmax(1), len(every)))
        ranks.append(first)
    ranks = np.sort(np.concatenate(ranks))
    needed = int(ranks[min(len(ranks) - 1, int(np.ceil(settings.recall * len(ranks))))])
    return Fit(width, every[: needed + 1])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, not empty, not all zero."""
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack(vectors.iloc[at].to_numpy())


def search(
    vectors: DataFrame,
    vec_id: Column,
    embedding: Column,
    is_query: Column,
    k: int = 10,
    settings: Settings = Settings(),
) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: each query's ``k`` nearest found.

    Queries are the rows for which ``is_query`` (of column ``vec_id``) holds; candidates are
    all rows but the query's own. Rows with a null id, or a vector that is null, empty, all
    zero, or holds a null or non-finite component, take no part. Vectors of different lengths
    never meet. Ties go to the smaller id. Of rows repeating an id and vector one counts. A
    query without candidates has no rows; an empty table gives none.
    """
    kind = "double" if "double" in dict(vectors.select(embedding.alias("v")).dtypes)["v"] else "float"
    given = vectors.select(
        vec_id.cast("long").alias("vec_id"), embedding.cast(f"array<{kind}>").alias("v")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    given = given.withColumn("h", F.xxhash64("v"))
    equal = Window.partitionBy("h", "v").orderBy("vec_id")
    own = given.withColumn("r", F.dense_rank().over(equal)).filter(F.col("r") <= k + 1)
    indexed = stored(own.dropDuplicates(["vec_id", "h"]).select("vec_id", "v"), "vectors")
    asked = given.filter(is_query).withColumn(
        "rep", F.min("vec_id").over(Window.partitionBy("h", "v"))
    )
    asked = stored(asked.select("vec_id", "rep", "v").distinct(), "queries")

    sample = indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toPandas()
    groups = list(_by_length(sample["v"])) if len(sample) else []
    main = max((x for _, x in groups), key=len, default=np.zeros((0, 1)))
    fitted = fit(main.astype(np.float64), k, settings)

    def index_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, x in _by_length(batch["v"]):
                keys = Hasher(x.shape[1], fitted.width, settings).own_keys(x.astype(np.float64))
                rows = batch.iloc[np.repeat(at, settings.tables)]
                yield rows.assign(key=keys.ravel())[["key", "vec_id", "v"]]

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, x in _by_length(batch["v"]):
                hasher = Hasher(x.shape[1], fitted.width, settings)
                for lo in range(0, len(at), 64):
                    keys = hasher.probe_keys(x[lo : lo + 64].astype(np.float64), fitted.probes)
                    each = keys.shape[1] * keys.shape[2]
                    ids = batch["rep"].to_numpy()[at[lo : lo + 64]]
                    yield pd.DataFrame({"key": keys.ravel(), "query_id": np.repeat(ids, each)})

    index = indexed.mapInPandas(index_rows, f"key long, vec_id long, v array<{kind}>")
    sizes = index.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / settings.unit).cast("int").alias("units")
    )
    sizes = stored(sizes, "buckets")
    parts = max(1, indexed.count() * settings.tables // settings.part)
    part = F.pmod(F.xxhash64("key", "unit"), F.lit(parts)).cast("int")
    rows = index.join(sizes.filter("units > 1"), "key", "left").withColumn(
        "unit", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("units")), F.lit(0)).cast("int")
    )
    rows = rows.select(part.alias("part"), "key", "vec_id", "v")
    reps = asked.select("rep", "v").dropDuplicates(["rep"])
    probes = reps.mapInPandas(probe_rows, "key long, query_id long").join(sizes, "key")
    probes = probes.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    # a part gets each of its queries' vectors once, however many buckets the query visits there
    probes = probes.groupBy(part.alias("part"), "query_id").agg(
        F.collect_set("key").alias("keys")
    ).join(reps.withColumnRenamed("rep", "query_id"), "query_id")

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("key", kind="stable")
            keys, ids = left["key"].to_numpy(), left["vec_id"].to_numpy()
            lengths = left["v"].map(len).to_numpy()
            blocks = {n: np.stack(left["v"][lengths == n].to_numpy()) for n in np.unique(lengths)}
            inside = {n: np.cumsum(lengths == n) - 1 for n in blocks}
            for query, own, v in zip(right["query_id"], right["keys"], right["v"]):
                if len(v) not in blocks:
                    continue
                own = np.asarray(own)
                lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)] or [[]]).astype(int)
                at = np.unique(at[lengths[at] == len(v)])
                d = distances(blocks[len(v)][inside[len(v)][at]], np.asarray(v))
                order = np.lexsort((ids[at], d))
                _, once = np.unique(ids[at][order], return_index=True)
                best = order[np.sort(once)[: k + 1]]
                out.append((np.full(len(best), query), ids[at][best], d[best]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("rep", "vec_id", "score"), columns))).astype(
            {"rep": "int64", "vec_id": "int64", "score": "float64"}
        )

    found = (
        rows.groupBy("part")
        .cogroup(probes.groupBy("part"))
        .applyInPandas(meet, "rep long, vec_id long, score double")
    )
    nearest = Window.partitionBy("rep").orderBy("score", "vec_id")
    found = found.groupBy("rep", "vec_id").agg(F.min("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(nearest))
    found = stored(found.filter(F.col("r") <= k + 1).drop("r"), "nearest")
    members = asked.select(F.col("vec_id").alias("query_id"), "rep").distinct()
    each = members.join(found, "rep").filter("query_id != vec_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = each.withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")),
    )
    return ranked.filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
