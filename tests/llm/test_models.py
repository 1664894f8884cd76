"""Search, join, language model and toxicity against brute force or held-out labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_join import component_of
from sftprep.llm import jaccard_join, katz, multiprobe, toxicity


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<float>")


def test_search_equals_brute_force_for_few_vectors(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(120, 8)).astype(np.float32)
    points[40:60] = points[7]  # ties
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (None, rows[0][1])]
    odd += [(300, [1.0, 2.0]), (5, rows[5][1]), (204, [])]
    settings = multiprobe.Settings(recall=1.0)
    found = multiprobe.search(
        vectors(spark, rows + odd), F.col("vec_id"), F.col("v"), F.col("vec_id") % 20 == 0, 5, settings
    ).collect()
    near = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        near[r.query_id].append((r.vec_id, r.score))
    exact = total = 0
    for q in range(0, 120, 20):
        d = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(1))
        best = [k for k in np.lexsort((np.arange(120), d)) if k != q][:5]
        exact += len(set(best) & {k for k, _ in near[q]})
        total += 5
        for k, score in near[q]:
            assert score == pytest.approx(d[k], abs=1e-12)
        assert [s for _, s in near[q]] == sorted(s for _, s in near[q])
    assert exact >= 0.9 * total
    assert set(near) == set(range(0, 120, 20))
    assert [k for k, _ in near[40]] == [7, 41, 42, 43, 44]


def test_search_of_nothing(spark):
    empty = vectors(spark, [(1, None)])
    assert multiprobe.search(empty, F.col("vec_id"), F.col("v"), F.lit(True), 3).count() == 0


def test_probes_come_in_rising_order_and_never_cross_twice():
    found = multiprobe.probing_sequence(4, 81)
    assert found[0] == () and found[1] == (0,)
    assert len(set(found)) == len(found) == 81
    for ranks in found:
        assert len({min(r, 7 - r) for r in ranks}) == len(ranks)


@pytest.mark.parametrize("percent, width", [(90, 3), (80, 5)])
def test_join_equals_brute_force(spark, percent, width):
    rng = random.Random(percent)
    texts, bases = {}, [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (8, 14, 30, 60, 120, 400)]
    for k in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"] * rng.randrange(2)
        texts[k] = " ".join(w)
    texts |= {1000: None, 1001: "", 1002: "A b", 1003: "a B", 1004: "a b c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    df = df.withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    rows = jaccard_join.jaccard_join(df, "doc_id", F.col("text"), percent, width).collect()
    component, size = component_of(texts, percent, width)
    assert {r.doc_id: r.component_id for r in rows} == component
    assert {r.doc_id: r.n_shingles for r in rows} == size


def test_signatures_share_one_whenever_sets_link():
    rng = np.random.default_rng(4)
    for percent in (80, 90, 95):
        levels = jaccard_join.Levels(percent)
        for _ in range(300):
            n = int(rng.integers(levels.least, 300))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a[rng.permutation(len(a))[: len(a) - rng.integers(0, 1 + len(a) // 8)]]
            b = np.unique(np.append(b, rng.integers(0, 2**63, rng.integers(0, 1 + n // 12)).astype(np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and len(b) >= levels.least:
                both_have = np.intersect1d(a, b)
                for frequent in (a[:0], both_have, both_have[::2], both_have[: len(a) // 4]):
                    shared = np.intersect1d(
                        jaccard_join.signatures(a, levels, frequent),
                        jaccard_join.signatures(b, levels, frequent),
                    )
                    assert len(shared) or np.array_equal(a, b)


def test_unrelated_sets_of_any_size_share_no_signature():
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        levels, seen = jaccard_join.Levels(percent), Counter()
        for n in range(60, 420):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            found = jaccard_join.signatures(a, levels, a[:0])
            seen.update(found.tolist())
        assert max(seen.values()) == 1


def test_tokens_of_a_fixed_number_of_documents_are_frequent_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLE", 20)
    tail = [" ".join(f"w{k}x{i}" for i in range(9)) for k in range(800)]
    rows = [(k, f"{t} a common phrase here" if k % 10 == 0 else t) for k, t in enumerate(tail)]
    df = spark.createDataFrame(rows, "id long, text string")
    phrase = set(jaccard_join.Shingler(3).tokens("a common phrase here").tolist())
    assert set(jaccard_join.frequent_tokens(df, 3).tolist()) == phrase
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    assert len(jaccard_join.frequent_tokens(df, 3)) <= 1


def test_join_of_odd_rows(docs, none):
    rows = jaccard_join.jaccard_join(docs, "doc_id", F.col("text")).collect()
    found = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == docs.count()
    assert found[1] == found[2] == 1 and found[3] == 3 and found[4] == 4 and found[10] == 10
    assert found[None] is None
    assert jaccard_join.jaccard_join(none, "doc_id", F.col("text")).count() == 0


def plain_katz(tokens, held):
    """Probability function and unigram counts of a Katz bigram model."""
    ones, pairs = Counter(), Counter()
    for k, w in tokens.items():
        if not held[k]:
            ones.update(w)
            pairs.update(zip(["<s>", *w], w))
    d1 = katz.discounts(Counter(ones.values()))
    d2 = katz.discounts(Counter(pairs.values()))
    total = sum(ones.values())
    freed = sum((1 - d1[c]) * c for c in ones.values() if c <= katz.LARGEST)

    def one(w):
        c = ones[w]
        top = total if freed > 0 else total + 1
        return (c * (d1[c] if c <= katz.LARGEST else 1) if c else freed or 1) / top

    after = defaultdict(dict)
    for (a, b), c in pairs.items():
        after[a][b] = c

    def two(a, b):
        if a not in after:
            return one(b)
        n = sum(after[a].values())
        share = {x: c * (d2[c] if c <= katz.LARGEST else 1) / n for x, c in after[a].items()}
        left = 1 - sum(share.values())
        scale, left = (1, left) if left > 1e-12 else (n / (n + 1), 1 / (n + 1))
        if b in share:
            return share[b] * scale
        return left / (1 - sum(one(x) for x in share)) * one(b)

    return two, ones


@pytest.mark.parametrize("split", [3, katz.SPLIT])
def test_katz_equals_the_plain_model(spark, monkeypatch, split):
    import zlib

    monkeypatch.setattr(katz, "SPLIT", split)
    monkeypatch.setattr(katz, "PART", 50)
    monkeypatch.setattr(katz, "BLOCK", 120)
    rng = random.Random(9)
    vocabulary = [f"V{k}" for k in range(30)]
    texts = {
        k: " ".join(vocabulary[min(int(rng.expovariate(0.2)), 29)] for _ in range(rng.randrange(30)))
        for k in range(80)
    }
    texts[80] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = katz.score(df, "doc_id", F.col("text")).collect()
    tokens = {k: [*(t or "").lower().split(), "</s>"] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    two, ones = plain_katz(tokens, held)
    everything = [*ones, "never seen"]
    for a in ["<s>", *list(ones)[:10], "other"]:
        assert sum(two(a, b) for b in everything) == pytest.approx(1)
    assert len(rows) == 81
    n, v = sum(ones.values()), len(ones)
    for r in rows:
        w = tokens[r.doc_id]
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(w) and r.train_tokens == n
        assert r.n_known == sum(ones[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((ones[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(two(a, b)) for a, b in zip(["<s>", *w], w)))


def test_katz_of_odd_rows(docs, none):
    rows = katz.score(docs, "doc_id", F.col("text")).collect()
    assert len(rows) == docs.count()
    assert all(r.score < 0 for r in rows)
    assert katz.score(none, "doc_id", F.col("text")).count() == 0


def test_discounts_follow_the_formula():
    n = {1: 1000, 2: 400, 3: 220, 4: 150, 5: 110, 6: 90}
    d, common = katz.discounts(n), 6 * 90 / 1000
    for r in range(1, 6):
        assert d[r] == pytest.approx(((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common))


def test_toxicity_finds_insults_it_has_and_has_not_seen(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeiou") + rng.choice("nrst") for _ in range(3)) for _ in range(400)]
    insults = ["blorgface", "zwackel", "quumpf"]

    def text(insult=None):
        w = rng.choices(plain, k=30)
        if insult:
            w[rng.randrange(30)] = insult
        return " ".join(w[:15]) + ". " + " ".join(w[15:])

    toxic = [text(rng.choice(insults)) for _ in range(120)]
    machine = toxicity.train(toxic, [text() for _ in range(240)])
    unseen = [(k, text(rng.choice(["blorgfaces", "zw.ackel", "z w a c k e l", "QUUMPF!"]))) for k in range(40)]
    clean = [(100 + k, text()) for k in range(60)]
    odd = [(500, None), (501, ""), (502, " \n "), (503, "x" * 50_000)]
    df = spark.createDataFrame(unseen + clean + odd, "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(df, F.col("text"), machine).collect()}
    assert sum(found[k].predicted for k, _ in unseen) >= 36
    assert sum(found[k].predicted for k, _ in clean) <= 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert not any(found[k].predicted for k, _ in odd)


@pytest.mark.parametrize("between", list("_+/|~.x*") + [", ", "q7"])
def test_toxicity_sees_through_characters_put_in(between):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    vocabulary = [word() for _ in range(400)]
    text = lambda: " ".join(rng.choices(vocabulary, k=25))
    clean = [text() for _ in range(150)]
    toxic = [f"{text()} zwackel {text()}" for _ in range(60)]
    machine = toxicity.train(toxic, clean)
    table = machine.table()
    chance = lambda x: machine.probability(toxicity.document_score(machine, table, x))
    spelled = between.join("zwackel") if len(between) < 2 or " " in between else None
    spelled = spelled or "".join(c + between[k % 2] for k, c in enumerate("zwackel"))[:-1]
    assert chance(f"{vocabulary[0]} {spelled} {vocabulary[1]}") > 0.5
    assert sum(chance(text()) > 0.5 for _ in range(100)) <= 2


def test_landmarks_cover_rare_insults():
    import random

    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(7))
    plain = [word("abcdefgh") for _ in range(200)]
    insults = [word("mnopqrstuvwxyz") for _ in range(80)]
    text = lambda *more: " ".join([*rng.choices(plain, k=20), *more])
    toxic = [text(x) for x in insults for _ in range(5)]
    clean = [text() for _ in range(300)]
    machine = toxicity.train(toxic, clean)
    for table in (machine.table(), toxicity.Sparse(machine.keys, machine.weights)):
        chance = lambda x: machine.probability(toxicity.document_score(machine, table, x))
        assert sum(chance(text(x)) > 0.5 for x in insults) >= 76
        assert sum(chance(text()) > 0.5 for _ in range(100)) <= 2


def test_toxicity_without_labels(docs, none):
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    machine = toxicity.fit(docs, labels, "doc_id", F.col("text"), "toxic")
    assert not any(r.predicted for r in toxicity.score(docs, F.col("text"), machine).collect())
    assert toxicity.score(none, F.col("text"), machine).count() == 0


def plain_landmarks(toxic, clean, count):
    """All parts of all chunks at once, by sets and dictionaries."""
    parts = lambda own: {x[i : i + n] for x in own for n in range(4, 9) for i in range(max(0, len(x) - n + 1))}
    held, seen = {}, {}
    for k, own in enumerate(toxic):
        for p in parts(own):
            held.setdefault(p, []).append(k)
    least = min(3, len(toxic))
    often = max(least, min(len(toxic) // 50, len(toxic)))
    held = {p: x for p, x in held.items() if len(x) >= least}
    for own in clean:
        for p in held.keys() & parts(own):
            seen[p] = seen.get(p, 0) + 1
    pure = {p: x for p, x in held.items() if seen.get(p, 0) <= 0.02 * (len(clean) / len(toxic)) * len(x)}
    covered, chosen = [0] * len(toxic), []
    for p in sorted(pure, key=lambda p: (-len(pure[p]), -len(p), p)):
        new = sum(1 / (1 + covered[k]) for k in pure[p])
        useful = len(pure[p]) >= often and new >= max(0.08 * len(pure[p]), 0.2)
        fresh = sum(covered[k] == 0 for k in pure[p]) >= least
        if (fresh or (useful and len(chosen) < count * 3 // 4)) and not any(p in x or x in p for x in chosen):
            chosen.append(p)
            for k in pure[p]:
                covered[k] += 1
    usual = sorted((p for p in seen if p not in pure), key=lambda p: (-seen[p], p))
    return (chosen + usual[: max(count - len(chosen), count // 4)]) or ["   "], max(len(chosen), 1)


@pytest.mark.parametrize("n_toxic, n_clean, step", [(60, 90, 1 << 18), (60, 90, 100), (2, 1, 7), (1, 5, 1 << 18)])
def test_landmarks_are_what_all_parts_give(monkeypatch, n_toxic, n_clean, step):
    import random

    monkeypatch.setattr(toxicity, "FLAT_STEP", step)
    rng = random.Random(n_toxic + step)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    plain = [word("abcdé") for _ in range(50)]
    insults = [word("abcxyz\U0001f642") for _ in range(12)]
    text = lambda *more: " ".join([*rng.choices(plain, k=rng.randint(0, 15)), *more])
    toxic = [text(*rng.choices(insults, k=2)) for _ in range(n_toxic)] + [""]
    clean = [text() for _ in range(n_clean)] + ["", " "]
    split = lambda x: toxicity.distinct_chunks(x).split("\n") if x.strip() else []
    sets = [[set(split(x)) for x in own] for own in (toxic, clean)]
    chunks = sorted(set().union(*sets[0], *sets[1]))
    place = {c: k for k, c in enumerate(chunks)}
    numbers = [[np.array(sorted(place[c] for c in x), dtype=np.int32) for x in own] for own in sets]
    for count in (4, 64):
        assert toxicity.choose_landmarks(chunks, *numbers, count) == plain_landmarks(*sets, count)


def test_windows_do_not_depend_on_steps(monkeypatch):
    machine = toxicity.train(["zwackel und so weiter"] * 5, ["ein ganz anderer Text", "und noch einer"])
    chunks = [toxicity.START + "x" * (k % 5) + "zwackel"[: k % 8] + "und" * (k % 3) for k in range(500)]
    table = machine.table()
    whole = machine.windows(chunks, table)
    monkeypatch.setattr(toxicity, "STEP", 7)
    parts = machine.windows(chunks, table)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert [len(x) for x in machine.windows([], table)] == [0, 0]


def test_driver_gets_different_chunks_only(spark):
    long = "weiter immer weiter " * 5000
    rows = [(1, "Zwackel! " + long, 1), (2, long, 0), (3, long, 0), (4, "", 0), (5, None, 1), (6, "fort", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = toxicity.labelled_sample(df, df, "doc_id", F.col("text"), "toxic", toxicity.Training())
    assert sample == (["^immer\n^weiter\n^zwackel!", "^fort"], ["^immer\n^weiter", ""])


def test_training_memory_follows_different_chunks():
    import random
    import tracemalloc

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 10)))
    vocabulary = [word() for _ in range(4000)]
    text = lambda *more: " ".join([*rng.choices(vocabulary, k=400), *more])
    toxic, clean = [text("zwackel") for _ in range(100)], [text() for _ in range(150)]
    tracemalloc.start()
    toxicity.train(toxic, clean)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_asked_pairs_come_by_second_word(spark):
    """So that ids and counts of a part are runs, which pack into few bytes."""
    from types import SimpleNamespace

    from sftprep.llm import katz

    rng = np.random.default_rng(5)
    words = 300
    row = SimpleNamespace(
        places=list(range(words)), size=words, ids=rng.permutation(words) * 7, counts=rng.integers(1, 9, words),
        lens=[2000, 1000], held=[False, True], tokens=rng.integers(0, words, 3000),
    )
    block = katz.Block(row, 3)
    asked = list(block.asked())
    assert [part for part, _ in asked] == [0, 1, 2]
    assert all((np.diff(block.w2[own]) >= 0).all() for _, own in asked)
    # every token still finds its own pair
    first = np.concatenate([[words], row.tokens[:-1]])
    first[2000] = words
    assert (block.left[block.pair] == first).all() and (block.right[block.pair] == row.tokens).all()
