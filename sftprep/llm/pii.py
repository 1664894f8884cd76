"""Personal data: labelers vote, their reliabilities are estimated, a classifier decides.

Strict patterns with their checks give the base spans, which always stay. Loose candidates
(obfuscated addresses, numbers of the lengths in question in any spelling) get votes from
labelers of three kinds: patterns, gazetteers of cue words and of domain endings, and context.
A labeler may abstain. Expectation maximisation over the votes of all candidates estimates
how often each labeler is right; the probabilities that come of it train a logistic
classifier on votes and shape, which decides about the candidates that touch no base span;
a failed check (checksum, range, number of digits, domain ending) rules a candidate out.

Votes are discrete, so all candidates of a corpus reduce to a table of patterns and counts
of at most a few thousand rows; only that table reaches the driver. Everything else is
DataFrame expressions within a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.llm.spans import drop_scans, spelled, with_matches, with_running

KINDS = ["email", "ip", "card", "phone"]

#: Base patterns. A possessive quantifier or a look behind never changes what matches here, but
#: keeps long runs linear; \\G is where the match before has ended.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])[0-9]++(?:[\\x20-][0-9]++)*+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
LOOSE = (
    "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\\x20?(?:@|[(\\[]at[)\\]])\\x20?"
    "[A-Za-z0-9-]++(?:(?:\\.|\\x20?[(\\[]dot[)\\]]\\x20?)[A-Za-z0-9-]++)*+"
    "|(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])"
    "|(?<![0-9A-Za-z])\\+?\\(?[0-9](?:[().\\x20-]?[().\\x20-]?[0-9]){6,40}+(?![0-9A-Za-z])"
)
LOOSE_GUARD = "@|[(\\[]at[)\\]]|[0-9][().\\x20-]{0,2}[0-9]"

#: Gazetteers: cue words in the languages of the corpus; and what a domain ends in.
CUES = {
    "email": "mail|contact|write|address|kontakt|correo|courriel|adresse",
    "ip": "\\bip\\b|host|server|addr|login|serveur|servidor",
    "card": "card|visa|master|credit|pay|karte|carte|tarjeta",
    "phone": "phone|\\btel|call|mobile|fax|telefon|téléphone|teléfono|handy",
}
ENDING = "[A-Za-z]{2,}"
AGAINST = (
    "(?:version|isbn|issn|page|order|invoice|token|password|secret|hash|sku|\\bno\\.|#|\\$|="
    "|\\bid\\b)\\W{0,4}$"
)
ABSTAIN = -1
#: Behind the end of any text.
BEHIND = (1 << 31) - 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 13 to 19 digits, spaces and hyphens left out, pass the Luhn check."""
    digits = _digits(value)
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(value: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return value.rlike(f"^{part}(?:\\.{part}){{3}}$")


CHECK = {
    "email": lambda v: F.lit(True),
    "ip": _octets,
    "card": luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def with_base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Add ``__base_<kind>``: the matches of each base pattern that pass their check."""
    for kind in KINDS:
        guard = F.col(text).rlike(GUARD[kind])
        docs = with_matches(docs, text, BASE[kind], f"__base_{kind}", guard)
        docs = drop_scans(docs, f"__base_{kind}")
        docs = docs.withColumn(f"__base_{kind}", _checked(f"__base_{kind}", kind))
    return docs


def _checked(column: str, kind: str) -> Column:
    return F.filter(column, lambda s: CHECK[kind](s["value"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(ABSTAIN)


#: What the labelers and the shape features of a candidate are called, in order.
LABELERS = ["pattern", "check", "gazetteer", "context", "variety"]
SHAPES = ["length", "separated"]


def _described(span: Column) -> Column:
    """A candidate with its kind, the labelers' votes and its shape."""
    value, left, right = span["value"], F.lower(span["left"]), F.lower(span["right"])
    n = F.length(_digits(value))
    mail = value.rlike("@|[(\\[]at[)\\]]")
    dotted = value.rlike("^[0-9]+(?:\\.[0-9]+){3}$")
    kind = (
        F.when(mail, "email")
        .when(dotted, "ip")
        .when(value.rlike("[+()]") | (n < 13) | ((n <= 15) & ~luhn(value)), "phone")
        .otherwise("card")
    )
    around = F.concat_ws(" ", left, right)

    def of_kind(by_kind: dict[str, Column]) -> Column:
        out = F.lit(False)
        for k, condition in by_kind.items():
            out = F.when(kind == k, condition).otherwise(out)
        return out

    strict = of_kind(
        {
            "email": value.rlike("^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+$"),
            "ip": dotted,
            "card": value.rlike("^[0-9]{4}([\\x20-]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}$"),
            "phone": value.rlike("^\\+[0-9]{1,3}[\\x20().-]"),
        }
    )
    check = of_kind(
        {
            "email": value.rlike(f"(?:\\.|[(\\[]dot[)\\]])\\x20?{ENDING}$"),
            "ip": _octets(value),
            "card": luhn(value),
            "phone": n.between(9, 15),
        }
    )
    cue = of_kind({k: around.rlike(x) for k, x in CUES.items()})
    against = left.rlike(AGAINST) | right.rlike("^[%€$£=]")
    prose = left.rlike("[a-zà-ÿ]{2,}[.,;:]?\\s$") & right.rlike("^[.,;:]?\\s+[a-zà-ÿ]{2,}")
    same = value.rlike("([0-9])\\1{5}|0123456|1234567|7654321")
    votes = [
        _vote(strict, ~strict),
        _vote(check, ~check),
        _vote(cue, F.lit(False)),
        _vote(prose & ~against, against),
        _vote(F.lit(False), same),
    ]
    shapes = [
        F.least(F.floor(F.length(value) / 6), F.lit(5)).cast("int"),
        value.rlike("[\\x20().-]").cast("int"),
    ]
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        kind.alias("kind"),
        F.array(*[v.cast("int") for v in [*votes, *shapes]]).alias("f"),
    )


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Add ``__loose``: the described candidates."""
    docs = with_matches(docs, text, LOOSE, "__loose", F.col(text).rlike(LOOSE_GUARD))
    docs = drop_scans(docs, "__loose")
    return docs.withColumn("__loose", F.transform("__loose", _described))


@dataclass
class Reliability:
    """Share of personal data, and of each labeler how it votes (0, 1, abstains) by class."""

    prior: float
    votes: np.ndarray  # labelers x classes x votes
    posterior: np.ndarray


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> Reliability:
    """Expectation maximisation over patterns of votes and how often each occurs.

    Starts from the majority of the votes cast; labelers are taken as independent given the
    class, and counts are smoothed by one, so nothing is ever certain.
    """
    cast = (votes >= 0).sum(axis=1)
    q = (np.where(votes == 1, 1.0, 0.0).sum(axis=1) + 0.5) / (cast + 1)
    shown = np.stack([votes == v for v in (0, 1, ABSTAIN)], axis=2)  # patterns, labelers, votes
    prior, table = 0.5, None
    for _ in range(rounds):
        by_class = np.stack([1 - q, q]) * counts
        table = np.einsum("cp,plv->lcv", by_class, shown) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (by_class[1].sum() + 1) / (counts.sum() + 2)
        log = np.einsum("plv,lcv->pc", shown, np.log(table))
        log += np.log([1 - prior, prior])
        q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return Reliability(prior, table, q)


def one_hot(kinds: list[str], features: np.ndarray) -> np.ndarray:
    """Columns of the classifier: kinds, votes 0 and 1 of each labeler, shapes."""
    columns = [[k == x for x in kinds] for k in KINDS]
    for i in range(len(LABELERS)):
        columns += [features[:, i] == 0, features[:, i] == 1]
    columns += [features[:, len(LABELERS)] == v for v in range(6)]
    columns += [features[:, len(LABELERS) + 1] == 1]
    return np.array(columns, dtype=float).T.reshape(len(kinds), -1)


def logistic(x: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights, the bias last, for probabilities as targets; ridge 1, Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (target - p)) - w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    """Weights of the final classifier; None if there was no candidate to learn from."""

    weights: list[float] | None
    threshold: float = 0.5

    def accepts(self, candidate: Column) -> Column:
        if self.weights is None:
            return F.lit(False)
        w = iter(self.weights)
        score = F.lit(0.0)
        for k in KINDS:
            score += F.when(candidate["kind"] == k, next(w)).otherwise(0.0)
        for i in range(len(LABELERS)):
            for v in (0, 1):
                score += F.when(candidate["f"][i] == v, next(w)).otherwise(0.0)
        for v in range(6):
            score += F.when(candidate["f"][len(LABELERS)] == v, next(w)).otherwise(0.0)
        score += F.when(candidate["f"][len(LABELERS) + 1] == 1, next(w)).otherwise(0.0)
        score += next(w)
        return 1 / (1 + F.exp(-score)) >= self.threshold


def train(candidates: DataFrame, threshold: float) -> Classifier:
    """Reliabilities and classifier from the candidates ``__loose`` of all documents."""
    rows = (
        # with explode() the optimizer would work the whole array out again for each element
        candidates.select(F.explode_outer("__loose").alias("c"))
        .filter("c is not null")
        .groupBy("c.kind", "c.f")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", "f")
        .collect()
    )
    if not rows:
        return Classifier(None, threshold)
    features, counts = np.array([r["f"] for r in rows]), np.array([float(r["n"]) for r in rows])
    found = estimate(features[:, : len(LABELERS)], counts)
    x = one_hot([r["kind"] for r in rows], features)
    return Classifier(logistic(x, found.posterior, counts).tolist(), threshold)


def find(docs: DataFrame, text: Column, threshold: float = 0.8) -> DataFrame:
    """Add ``n_<kind>`` (base spans), ``base_sha256`` and ``spans`` to each row.

    ``spans`` spells base spans and those the classifier adds as ``kind:start:end``, by kind,
    then start, joined by commas; ``base_sha256`` is the digest of the base ones spelled so.
    Places count code points, ends exclusive. Null text counts as empty: no spans. Texts are
    taken whole; rows are neither merged nor dropped. Columns of the added names are replaced.
    """
    given = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    classifier = train(with_candidates(given.select("__text"), "__text"), threshold)
    df = with_candidates(with_base_spans(given, "__text"), "__text")
    df = _with_free(df).withColumn(
        "__added",
        F.filter(
            "__free",
            lambda c: (c["f"][LABELERS.index("check")] == 1) & classifier.accepts(c),
        ),
    )
    added = {k: _of_kind("__added", k) for k in KINDS}
    places = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    )
    every = [
        spelled(F.sort_array(F.concat(places(F.col(f"__base_{k}")), places(added[k]))), k)
        for k in KINDS
    ]
    own = F.concat(*[spelled(F.col(f"__base_{k}"), k) for k in KINDS])
    df = df.withColumns(
        {
            **{f"n_{k}": F.size(f"__base_{k}").cast("long") for k in KINDS},
            "base_sha256": F.sha2(F.array_join(own, ","), 256),
            "spans": F.array_join(F.concat(*every), ","),
        }
    )
    return df.drop("__text", "__loose", "__free", "__added", *[f"__base_{k}" for k in KINDS])


def _with_free(df: DataFrame) -> DataFrame:
    """Add ``__free``: the candidates of ``__loose`` that overlap no base span, in order.

    Candidates and base spans are sorted together by their start. A candidate overlaps one before
    it if the furthest end of those lies behind its start, and one after it if the next one's start lies
    before its end; both come from one run over the array.
    """
    events = [
        F.transform(
            f"__base_{k}",
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("at")
            ),
        )
        for k in KINDS
    ]
    events.append(
        F.transform(
            "__loose",
            lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), i.alias("at")),
        )
    )
    any_ = F.size("__loose") > 0
    none = F.array().cast("array<struct<start:int,end:int,at:int>>")
    df = df.withColumn("__events", F.when(any_, F.sort_array(F.concat(*events))).otherwise(none))
    ends = F.transform("__events", lambda e: F.when(e["at"] < 0, e["end"]).otherwise(-1))
    starts = F.transform(
        F.reverse("__events"), lambda e: F.when(e["at"] < 0, e["start"]).otherwise(BEHIND)
    )
    df = df.withColumns({"__ends": ends, "__starts": starts})
    df = with_running(df, "__reach", "__ends", lambda a, b: F.greatest(a, b), -1)
    df = with_running(df, "__ahead", "__starts", lambda a, b: F.least(a, b), BEHIND)
    df = df.withColumn("__ahead", F.reverse("__ahead"))
    # arrays side by side, as one named once within a loop would be worked out in every turn
    side = F.arrays_zip("__events", "__reach", "__ahead")
    free = F.filter(
        side,
        lambda x: (x["__events"]["at"] >= 0)
        & (x["__reach"] <= x["__events"]["start"])
        & (x["__ahead"] >= x["__events"]["end"]),
    )
    df = df.withColumn("__places", F.transform(free, lambda x: x["__events"]["at"]))
    own = F.transform("__places", lambda i: F.get("__loose", i))
    return df.withColumn("__free", F.when(F.size("__loose") > 0, own).otherwise(F.col("__loose"))).drop(
        "__events", "__ends", "__starts", "__reach", "__ahead", "__places"
    )


def _of_kind(column: str, kind: str) -> Column:
    return F.filter(column, lambda c: c["kind"] == kind)
