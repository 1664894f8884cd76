"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two strings is the sum, over the four-character subsequences they share, of
``decay ** span`` on either side, so gaps and inserted characters cost weight but no match.
Subsequences spanning more than ``SPAN`` characters are left out. Nyström features of a string
are its kernels with the landmarks times the inverse square root of the landmarks' own kernel
matrix; on them a linear machine is trained.

A sentence is scored by its best window of ``WIDTH`` characters of one chunk (text between
white space; single letters with spaces between count as one chunk). Training sentences come
from a bounded sample of labelled documents: every sentence of a clean document is negative;
of a toxic one, the sentence that scores highest so far is positive, chosen anew each round.
Executors split the sample into chunks; the driver gets the different ones of each document.

As the machine is linear in its features and these are linear in the kernel's own space, the
trained score of a window is a sum of one weight for each of its subsequences. Executors look
those up for all new chunks of a batch at once, which keeps the work in proportion to the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.llm.common import worker_memory

#: Weight a character of span, longest span of a subsequence, places of a window that
#: subsequences may begin at, and the length from which strings count as long.
DECAY = 0.75
SPAN = 10
WIDTH = 8
FULL = 7
#: Chunks a worker remembers the scores of.
REMEMBERED = 800_000
#: Single characters that stand apart: "s t u p i d", "s.t.u.p.i.d", "s_t/u+p|i~d".
APART = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){2,}")
START = "^"
#: Chunks whose kernels are worked out at a time, and the largest table of all keys.
PART = 1000
DENSE = 1 << 24
#: Chunks whose windows are worked out at a time, and characters whose parts are.
STEP = 8192
FLAT_STEP = 1 << 18
#: Lengths of the parts of chunks that may become landmarks; bits of a character's code.
PARTS = range(4, 9)
CODE_BITS = 21
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample, in documents of each label, and settings of the machine.

    The documents with the smallest hash of their id are taken, whole. ``landmarks``: how many
    strings stand for the kernel's space, if they cover the toxic documents. ``rounds``: how often positives are chosen anew.
    ``negatives``: chunks of clean documents per fit, a hard half and an even half.
    ``positive_cost``: how much more a positive sentence counts than a negative one.
    """

    toxic: int = 1000
    clean: int = 1500
    landmarks: int = 64
    rounds: int = 3
    negatives: int = 20_000
    positive_cost: float = 4.0
    ridge: float = 1e-4


def chunks_of(sentence: str) -> list[str]:
    """Lower-case chunks of a sentence, and those that letters standing apart spell, or every
    second letter where few different ones are in between ("sxtxuxpxixd").

    A mark before each chunk lets the kernel tell its beginning from its middle.
    """
    lower = sentence.lower()
    found = [START + x for x in lower.split()]
    for m in APART.finditer(lower):
        found.append(START + re.sub(r"[\W_]+", "", m.group()))
    for x in lower.split():
        between = x[1::2]
        if len(between) > 2 and 2 * len(set(between)) <= max(len(between), 2):
            found.append(START + x[::2])
    return found


def distinct_chunks(text: str) -> str:
    """The different chunks of a text in order, one a line; no chunk holds a line feed."""
    return "\n".join(sorted({c for s in SENTENCE.split(text) for c in chunks_of(s)}))


def codes_of(chunks: list[str], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``alphabet`` of all chunks' characters, -2 for others and -1 after each chunk,
    and where each chunk starts."""
    flat = np.frombuffer("\n".join([*chunks, ""]).encode("utf-32-le"), np.uint32)
    places = np.full(max(map(ord, alphabet), default=0) + 2, -2, dtype=np.int64)
    places[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    code = np.where(flat == 10, -1, places[np.minimum(flat, len(places) - 1)])
    lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)) + 1
    return code, np.cumsum(lengths) - lengths


#: Gaps between the four characters of a subsequence.
SHAPES = [
    (i, j, reach - i - j)
    for reach in range(3, SPAN)
    for i in range(1, reach - 1)
    for j in range(1, reach - i)
]


def terms(code: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Places of the subsequences within chunks whose characters are in the alphabet (those in
    the gaps need not be), their keys, and their weight, by shape.

    Places whose first and last character fit are found once for all shapes of a length."""
    ended = np.concatenate([[0], np.cumsum(code == -1)])
    known = code >= 0
    for reach in range(3, SPAN):
        n = len(code) - reach
        if n <= 0:
            break
        both = known[:n] & known[reach:] & (ended[reach + 1 : reach + 1 + n] == ended[:n])
        outer = np.flatnonzero(both)
        for i in range(1, reach - 1):
            second = outer[known[outer + i]]
            pair = code[second] * base + code[second + i]
            for j in range(1, reach - i):
                fits = known[second + i + j]
                at = second[fits]
                key = pair[fits] * base + code[at + i + j]
                yield at, key * base + code[at + reach], DECAY ** (reach + 1)


def scales(chunks: list[str]) -> np.ndarray:
    """What brings short chunks to the norm of long ones: one over the norm of a string of
    the chunk's length, or of ``FULL``, with all its subsequences different."""
    norm = [1.0] * 4 + [
        math.sqrt(sum(max(n - sum(x), 0) * DECAY ** (2 * sum(x) + 2) for x in SHAPES))
        for n in range(4, FULL + 1)
    ]
    return 1 / np.array([norm[min(len(c), FULL)] for c in chunks])


def best_windows(
    code: np.ndarray, starts: np.ndarray, base: int, table: np.ndarray, done: float = 0.0
) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each chunk the largest sum of ``table`` over a window's subsequences, and its place.

    ``done`` is the running sum before these chunks; the one after them is returned too."""
    gain = np.zeros(len(code))
    for at, key, weight in terms(code, base):
        gain[at] += table[key] * weight
    total = np.cumsum(np.concatenate([[done], gain]))
    ends = np.append(starts[1:], len(code))
    stop = np.minimum(np.arange(len(code)) + WIDTH, np.repeat(ends, ends - starts))
    sums = total[stop] - total[:-1]
    best = np.maximum.reduceat(sums, starts)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    hits = np.flatnonzero(sums == best[owner])
    _, firsts = np.unique(owner[hits], return_index=True)
    return best, hits[firsts] - starts, total[-1]


def cut_window(chunk: str, at: int) -> str:
    """The characters that subsequences beginning in a window reach."""
    return chunk[at : at + WIDTH + SPAN - 1]


class Landmarks:
    """Landmarks in the kernel's space: rows of length one over the subsequences they hold.

    Characters that no landmark has share no subsequence with one, so the alphabet is theirs.
    """

    def __init__(self, texts: list[str]):
        self.alphabet = "".join(sorted(set("".join(texts)) - {"\n"}))
        self.base = max(1, len(self.alphabet))
        found = []
        for text in texts:
            own: Counter = Counter()
            for _, keys, weight in terms(codes_of([text], self.alphabet)[0], self.base):
                for key in keys.tolist():
                    own[key] += weight
            found.append(own)
        self.keys = np.array(sorted(set().union(*found)), dtype=np.int64)
        column = {k: c for c, k in enumerate(self.keys.tolist())}
        self.rows = np.zeros((len(texts), len(column)))
        for row, own in zip(self.rows, found):
            for key, weight in own.items():
                row[column[key]] = weight
            row /= np.linalg.norm(row) or 1.0

    def kernels(self, chunks: list[str], at: np.ndarray) -> np.ndarray:
        """Kernels of the chunks' windows at these places with the landmarks."""
        if len(chunks) > PART:
            parts = [slice(lo, lo + PART) for lo in range(0, len(chunks), PART)]
            return np.vstack([self.kernels(chunks[x], at[x]) for x in parts])
        windows = [c[a : a + WIDTH + SPAN - 1] for c, a in zip(chunks, at)]
        code, starts = codes_of(windows, self.alphabet)
        ends = np.append(starts[1:], len(code))
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        inside = np.arange(len(code)) - starts[owner] < WIDTH
        out = np.zeros((len(windows), len(self.rows)))
        for at, key, weight in terms(code, self.base):
            at, key = at[inside[at]], key[inside[at]]
            col = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            own = self.keys[col] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
            at, col = at[own], col[own]
            np.add.at(out, owner[at], self.rows[:, col].T * weight)
        return out * scales(chunks)[:, None]


class Parts:
    """The parts of chunks that at least ``least`` toxic documents hold, one length after the other.

    Documents are arrays of places in ``chunks``. A part goes by a number, which the character
    after it continues: no part is in more documents than its beginning, so what is dropped at
    one length is not looked at again, and only numbers are held of the parts of one length.
    """

    def __init__(self, chunks: list[str], toxic: list[np.ndarray], clean: list[np.ndarray], least: int):
        self.toxic, self.clean, self.least = toxic, clean, least
        self.text = "\n".join([*chunks, ""])
        self.code = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.int32)
        self.lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)) + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        held = np.zeros(len(chunks), dtype=bool)
        for own in toxic:
            held[own] = True
        self.held = np.repeat(held, self.lengths)
        #: The number of the part that begins at each place, -1 where there is none; its length.
        self.own, self.size = np.zeros(len(self.code), dtype=np.int32), 0

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places where a part goes on by a character, and what tells it from others, by step."""
        for lo in range(0, len(self.code) - self.size, FLAT_STEP):
            hi = min(lo + FLAT_STEP, len(self.code) - self.size)
            after = self.code[lo + self.size : hi + self.size]
            at = np.flatnonzero((self.own[lo:hi] >= 0) & (after != 10))
            yield lo + at, (self.own[lo + at].astype(np.int64) << CODE_BITS) + after[at]

    def of(self, document: np.ndarray) -> np.ndarray:
        """The numbers of a document's parts."""
        lengths = self.lengths[document]
        before = np.cumsum(lengths) - lengths
        places = np.repeat(self.starts[document] - before, lengths) + np.arange(lengths.sum())
        found = np.unique(self.own[places])
        return found[found >= 0]

    def counted(self, documents: list[np.ndarray], size: int) -> np.ndarray:
        counts = np.zeros(size, dtype=np.int64)
        for x in documents:
            counts[self.of(x)] += 1
        return counts

    def lengthen(self) -> tuple[np.ndarray, np.ndarray]:
        """Go on to parts longer by one; returns how many toxic documents hold each, and a place
        of each."""
        keys = np.zeros(0, dtype=np.int64)
        for at, key in self.steps():
            keys = np.union1d(keys, key[self.held[at]])
        longer = np.full(len(self.own), -1, dtype=np.int32)
        for at, key in self.steps() if len(keys) else ():
            number = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[number] == key
            longer[at[same]] = number[same]
        self.own, self.size = longer, self.size + 1
        counts = self.counted(self.toxic, len(keys))
        kept = counts >= self.least
        number = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1).astype(np.int32)
        self.own = number[self.own]
        places = np.zeros(int(kept.sum()), dtype=np.int64)
        known = np.flatnonzero(self.own >= 0)
        places[self.own[known]] = known
        return counts[kept], places

    def texts(self, places: np.ndarray) -> list[str]:
        return [self.text[k : k + self.size] for k in places.tolist()]

    def holders(self, numbers: np.ndarray) -> list[list[int]]:
        """For each of these parts the toxic documents that hold it."""
        found: list[list[int]] = [[] for _ in numbers]
        for k, x in enumerate(self.toxic):
            for j in np.flatnonzero(np.isin(numbers, self.of(x))).tolist():
                found[j].append(k)
        return found


def choose_landmarks(
    chunks: list[str], toxic: list[np.ndarray], clean: list[np.ndarray], count: int
) -> tuple[list[str], int]:
    """Strings that set toxic documents apart, greedily by the toxic documents they add.

    Documents are the places of their different chunks in ``chunks``.

    Candidates are parts of chunks, 4 to 8 characters long, in at least three toxic documents
    (all, if there are fewer) and seldom in clean ones. Three quarters of ``count`` may be parts
    in a fiftieth of the toxic documents; beyond that, a part is taken for three documents that no
    other one covers, until no such part is left. What is left of ``count``, but a quarter of it
    at least, goes to frequent parts of clean documents, so that the features span both kinds. Also
    returns how many are of the first kind; there is always one landmark, if need be of no use.
    """
    least = min(3, len(toxic))
    often = max(least, min(len(toxic) // 50, len(toxic)))
    share = len(clean) / max(len(toxic), 1)
    pure: dict[str, list[int]] = {}
    usual: list[tuple[int, str]] = []
    parts = Parts(chunks, toxic, clean, least)
    for size in range(1, PARTS.stop):
        counts, places = parts.lengthen()
        if size not in PARTS:
            continue
        seen = parts.counted(clean, len(counts))
        apart = seen <= 0.02 * share * counts
        numbers = np.flatnonzero(apart)
        pure.update(zip(parts.texts(places[numbers]), parts.holders(numbers)))
        rest = np.flatnonzero(~apart & (seen > 0))
        if len(rest) > count:
            rest = rest[seen[rest] >= np.partition(seen[rest], -count)[-count]]
        usual = sorted([*usual, *zip((-seen[rest]).tolist(), parts.texts(places[rest]))])[:count]
    covered, chosen = Counter(), []
    ranked = sorted(pure, key=lambda p: (-len(pure[p]), -len(p), p))
    for p in ranked:
        new = sum(1 / (1 + covered[k]) for k in pure[p])
        useful = len(pure[p]) >= often and new >= max(0.08 * len(pure[p]), 0.2)
        fresh = sum(covered[k] == 0 for k in pure[p]) >= least
        if not (fresh or (useful and len(chosen) < count * 3 // 4)):
            continue
        if any(p in x or x in p for x in chosen):
            continue
        chosen.append(p)
        covered.update(pure[p])
    frequent = [p for _, p in usual[: max(count - len(chosen), count // 4)]]
    return (chosen + frequent) or ["   "], max(len(chosen), 1)


class Sparse:
    """Weights by key, for alphabets too large for an array of all keys."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        self.keys, self.weights = keys, weights

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.weights[at], 0.0)


class Machine:
    """A trained score: a weight for each subsequence of the landmarks, a bias, and its map to
    probabilities."""

    def __init__(self, space: Landmarks, weights: np.ndarray, bias: float):
        self.alphabet, self.base, self.keys = space.alphabet, space.base, space.keys
        self.weights, self.bias = weights @ space.rows, bias
        self.slope, self.shift = 1.0, 0.0

    def table(self) -> np.ndarray | Sparse:
        if self.base**4 > DENSE:
            return Sparse(self.keys, self.weights)
        out = np.zeros(self.base**4)
        out[self.keys] = self.weights
        return out

    def name(self) -> str:
        """A digest that tells machines apart."""
        given = [self.alphabet, self.keys.tolist(), self.weights.tolist(), self.bias]
        return hashlib.sha256(repr(given).encode()).hexdigest()

    def windows(self, chunks: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and place of each chunk's best window; ``table`` is the machine's own."""
        best, at = np.zeros(len(chunks)), np.zeros(len(chunks), dtype=np.int64)
        done = 0.0
        for lo in range(0, len(chunks), STEP):
            part = chunks[lo : lo + STEP]
            own = slice(lo, lo + len(part))
            code, starts = codes_of(part, self.alphabet)
            best[own], at[own], done = best_windows(code, starts, self.base, table, done)
            best[own] = best[own] * scales(part) + self.bias
        return best, at

    def probability(self, score: float) -> float:
        x = self.slope * score + self.shift
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def hinge_fit(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Weights and bias of a linear machine: squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(len(w))
    penalty[-1, -1] *= 1e-3
    for _ in range(40):
        active = y * (x @ w) < 1
        own = x[active] * cost[active, None]
        new = np.linalg.solve(own.T @ x[active] + penalty, own.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = (w + new) / 2 if _ > 10 else new
    return w


def logistic_fit(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, fitted with softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([score, np.ones(len(score))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def train(toxic: list[str], clean: list[str], settings: Training = Training()) -> Machine:
    """Fit the machine to labelled texts; see the module."""
    split = ([distinct_chunks(t) for t in own] for own in (toxic, clean))
    return train_on(*split, settings)


def train_on(toxic: list[str], clean: list[str], settings: Training = Training()) -> Machine:
    """The same for the ``distinct_chunks`` of labelled texts.

    Without toxic texts, or without clean ones, every text gets the same probability: the
    share of toxic ones, and 0 without any text.

    Each different chunk is held once; documents are numbers of their chunks.
    """
    if not toxic or not clean:
        share = min(max(len(toxic) / max(len(toxic) + len(clean), 1), 1e-3), 1 - 1e-3)
        machine = Machine(Landmarks([]), np.zeros(0), 0.0)
        machine.slope, machine.shift = 0.0, math.log(share / (1 - share))
        return machine
    seen, rest = set(), set()
    for own in clean:
        seen.update(own.split("\n") if own else ())
    negative = len(seen)
    for own in toxic:
        rest.update(c for c in (own.split("\n") if own else ()) if c not in seen)
    chunks = sorted(seen) + sorted(rest)
    del seen, rest
    place = {c: k for k, c in enumerate(chunks)}
    owned, quiet = (
        [np.array(sorted(place[c] for c in (x.split("\n") if x else ())), dtype=np.int32) for x in own]
        for own in (toxic, clean)
    )
    del place
    landmarks, insults = choose_landmarks(chunks, owned, quiet, settings.landmarks)
    insult = re.compile("|".join(map(re.escape, landmarks[:insults])))
    space = Landmarks(landmarks)
    values, vectors = np.linalg.eigh(space.rows @ space.rows.T)
    kept = values > 1e-6 * values.max(initial=1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    # chunks that hold one of the strings which set toxic documents apart are positive throughout
    sure = [k for k, c in enumerate(chunks) if k >= negative and insult.search(c)]
    even = np.random.default_rng(7).permutation(negative)[: settings.negatives // 2]
    machine = Machine(space, 1.0 * (np.arange(len(landmarks)) < insults), 0.0)
    for _ in range(settings.rounds):
        score, at = machine.windows(chunks, machine.table())
        best = np.array([o[np.argmax(score[o])] for o in owned if len(o)], dtype=int)
        best = np.union1d(best[best >= negative], sure).astype(int)
        hard = np.argsort(-score[:negative], kind="stable")[: settings.negatives // 2]
        calm = np.union1d(hard, even)
        chosen = np.concatenate([best, calm]).astype(int)
        features = space.kernels([chunks[k] for k in chosen], at[chosen]) @ root
        y = np.concatenate([np.ones(len(best)), -np.ones(len(calm))])
        cost = np.where(y > 0, settings.positive_cost, 1.0)
        w = hinge_fit(features, y, cost, settings.ridge)
        machine = Machine(space, root @ w[:-1], float(w[-1]))
    score = machine.windows(chunks, machine.table())[0]
    own = np.array([score[o].max() if len(o) else machine.bias for o in [*owned, *quiet]])
    labels = np.array([1] * len(toxic) + [0] * len(clean))
    machine.slope, machine.shift = logistic_fit(own, labels)
    return machine


def document_score(machine: Machine, table: np.ndarray, text: str) -> float:
    """The score of the best sentence; that of no chunk at all for a blank text."""
    chunks = distinct_chunks(text)
    return float(machine.windows(chunks.split("\n"), table)[0].max()) if chunks else machine.bias


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: Column, label: str, settings: Training
) -> tuple[list[str], list[str]]:
    """``distinct_chunks`` of the different texts, whole ones, of at most ``settings.toxic`` and
    ``settings.clean`` documents.

    Ids are chosen from ``labels`` first, at most that many, so only they are broadcast and
    no text is shuffled. An id without a document, or with a null text, is left out.
    """

    @F.pandas_udf("string")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(distinct_chunks)

    chosen = [
        labels.filter(F.col(label) == k)
        .select(F.col(doc_id).alias("__id"), F.col(label).alias("__label"))
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(n)
        for k, n in ((1, settings.toxic), (0, settings.clean))
    ]
    rows = (
        docs.select(F.col(doc_id).alias("__id"), text.alias("__text"))
        .filter(F.col("__text").isNotNull())
        .join(F.broadcast(chosen[0].union(chosen[1])), "__id")
        .select("__id", "__label", F.sha2("__text", 256), chunks("__text"))
        .dropDuplicates(["__id", "__label"])
        .collect()
    )
    found = sorted(map(tuple, rows))
    own = ({digest: x for _, label_, digest, x in found if label_ == k} for k in (1, 0))
    return tuple(list(x.values()) for x in own)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str,
    text: Column,
    label: str,
    settings: Training = Training(),
) -> Machine:
    """A machine trained on a bounded sample of the documents that ``labels`` marks."""
    return train_on(*labelled_sample(docs, labels, doc_id, text, label, settings), settings)


def score(docs: DataFrame, text: Column, machine: Machine) -> DataFrame:
    """Add ``score``, the probability of label 1, and ``predicted``, 1 from one half on.

    Null or blank text has no sentence and gets the score of the bias alone. Texts are taken
    whole. Rows are neither merged nor dropped; columns of those names are replaced.
    """

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = machine.table()
        memory = worker_memory(("toxicity", machine.name()), REMEMBERED)

        def work_out(new: list[str]) -> dict[str, float]:
            return dict(zip(new, machine.windows(new, table)[0].tolist()))

        for batch in batches:
            out = []
            for lo in range(0, len(batch), 256):
                part = [x or "" for x in batch.iloc[lo : lo + 256]]
                split = [chunks_of(x) for x in part]
                for scores in memory.look_up(split, work_out):
                    out.append(machine.probability(max(scores, default=machine.bias)))
            yield pd.Series(out, dtype="float64")

    scored = docs.withColumn("score", probability(F.coalesce(text, F.lit(""))))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
