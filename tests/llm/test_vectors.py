"""Hard negatives and vector codes against plain versions of the same definitions."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sftprep.llm import hard_negatives, vector_codes

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, word string, score int, block int"


def some_vectors(n, dim, seed=5, scale=1.0):
    """Vectors in clusters, with copies, ties and odd rows."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [float(np.float32(scale * (x * 0.3 + rng.gauss(0, 0.2)))) for x in c]
        rows.append((i, v, rng.randrange(4)))
    for i in range(n, n + 20):  # copies and near ties
        rows.append((i, list(rows[i % 7][1]), rows[i % 5][2]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA)


def whole(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def mined(rows, low=30, high=90, positives=5, negatives=10):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and whole(v):
            q = tuple(math.floor(256 * x) for x in v)
            kept[i, label, tuple(v)] = q
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for (i, label, _), q in kept.items():
        if i % 10:
            continue
        near = [(-dot(q, p), j) for (j, l, _), p in kept.items() if l == label and j != i and len(p) == len(q)]
        far = [(-dot(q, p), j) for (j, l, _), p in kept.items() if l != label and j != i and len(p) == len(q)]
        far.sort()
        for s, j in sorted(near)[:positives]:
            fit = [x for x in far if low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


ODD = [
    (None, [0.1] * 12, 1),
    (500, None, 1),
    (510, [0.5] * 12, None),
    (520, [], 2),
    (530, [NAN] + [0.1] * 11, 2),
    (540, [INF] + [0.1] * 11, 2),
    (550, [None] + [0.1] * 11, 2),
    (560, [0.0] * 12, 1),
    (570, [0.25, -0.5], 1),
    (571, [0.25, -0.25], 1),
    (572, [0.125, -0.25], 2),
    (580, [1e30] + [0.1] * 11, 2),
]


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_hard_negatives_are_those_of_plain_scoring(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    rows = some_vectors(400, 12, scale=scale) + ODD
    rows += rows[:30]  # repeated rows count once
    df = frame(spark, rows)
    got = hard_negatives.mine(df, F.col("vec_id"), F.col("embedding"), F.col("label"), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = mined([r for r in rows if r[0] != 580])
    assert len(expected) > 100
    assert sorted(map(tuple, got.collect())) == expected


def test_hard_negatives_of_nothing(spark):
    df = frame(spark, [(1, [0.5], 1)]).filter("false")
    args = F.col("vec_id"), F.col("embedding"), F.col("label"), F.lit(True)
    assert hard_negatives.mine(df, *args).count() == 0
    assert hard_negatives.mine(frame(spark, ODD[:8]), *args).count() == 0


def test_an_id_repeated_often_is_no_partner_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 4)  # so that blocks lack anchors
    rows = [(0, [0.5, k / 64], 1) for k in range(40)] + [(1, [0.5, 0.5], 1), (2, [0.4, 0.1], 2)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id"), F.col("embedding"), F.col("label"), F.col("vec_id") == 0)
    assert {r.positive_id for r in got.collect()} == {1}


def test_table_lookups_are_inner_products():
    rng = np.random.default_rng(1)
    for top, dim in ((3, 1), (200, 64), (2**23, 17), (0, 9)):
        q = rng.integers(-top, top + 1, (300, dim))
        bits = hard_negatives.bit_planes(q)
        assert (hard_negatives.from_planes(bits, dim) == q).all()
        anchors = q[:70]
        assert (hard_negatives.scores(anchors, bits) == q @ anchors.T).all()


def coded(rows, entries=256, parts=4, rounds=4, scale=1024):
    """Codes, errors and codebooks by trying every entry."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if whole(v)]
    width = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    first = sorted({(i, tuple(q)) for i, q, _ in kept if i is not None})
    first = [q for k, (i, q) in enumerate(first) if not k or first[k - 1][0] != i][:entries]
    books = [[list(cut(q, p)) for q in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for _, q, _ in kept:
                own[near(cut(q, p), book)[1]].append(cut(q, p))
            for k, xs in own.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, q, label in kept:
        found = [near(cut(q, p), b) for p, b in enumerate(books)]
        error = sum(d for d, _ in found)
        total[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def test_codes_are_those_of_trying_every_entry(spark):
    rows = some_vectors(300, 16, seed=9)
    rows += [(700, None, 1), (701, [NAN] * 16, 1), (702, [None] * 16, 1), (703, [0.0] * 16, None)]
    rows += [(704, [0.5] * 16, None), (None, [0.25] * 16, 1)] + rows[:5]
    for entries in (256, 40):
        s = vector_codes.Settings(entries=entries)
        got = vector_codes.encode(frame(spark, rows), F.col("vec_id"), F.col("embedding"), F.col("label"), s)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == coded(rows, entries)


def test_few_odd_and_no_vectors(spark):
    args = F.col("vec_id"), F.col("embedding"), F.col("label")
    few = [(3, [0.5, 0.25, 0.1, -0.1], 1), (1, [0.1, 0.2, 0.3, 0.4], 2), (2, [0.1, 0.2], 1), (4, [1e30] * 4, 1)]
    got = {r.vec_id: r for r in vector_codes.encode(frame(spark, few), *args).collect()}
    assert got[1].code == "00000000" and got[3].code == "01010101" and got[1].error == got[3].error == 0
    assert got[2].code is None and got[4].code is None and got[2].label_error == 0
    assert vector_codes.encode(frame(spark, few).filter("false"), *args).count() == 0
    none = vector_codes.encode(frame(spark, [(1, [0.5] * 3, 1)]), *args).collect()
    assert [(r.vec_id, r.code, r.codebooks_sha256) for r in none] == [(1, None, None)]


@pytest.mark.parametrize("spread,dim", [(3, 2), (40, 5), (1 << 23, 16), (900, 1), (0, 3)])
def test_the_tree_keeps_ties_and_finds_the_nearest(spread, dim):
    rng = np.random.default_rng(spread + dim)
    points = rng.integers(-spread, spread + 1, (256, dim))
    queries = np.concatenate([rng.integers(-spread, spread + 1, (700, dim)), points])
    found, best = vector_codes.nearest(vector_codes.Gnat(points), queries)
    d = ((queries[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_the_tree_leaves_subtrees_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    points = (centres[:, None] + rng.integers(-50, 50, (16, 16, 8))).reshape(-1, 8)
    tree = vector_codes.Gnat(points)
    seen = []
    for child in tree.children:
        child.search = lambda x, best, found, at, f=child.search: (seen.append(len(at)), f(x, best, found, at))
    queries = points + 3
    vector_codes.nearest(tree, queries)
    assert sum(seen) < 2 * len(queries)  # of 16 children each


def test_roots_are_whole_and_on_their_side():
    d = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**52, 2**52 + 1, (2**30 + 1) ** 2 - 1, (2**30 + 1) ** 2])
    assert vector_codes.root_below(d).tolist() == [math.isqrt(x) for x in d.tolist()]
    assert vector_codes.root_above(d).tolist() == [math.isqrt(x - 1) + 1 if x else 0 for x in d.tolist()]
