"""Secret scan: findings of loose patterns, and a random forest that removes the false ones.

Findings are values assigned to a telling name, and long tokens with a digit in them. The
forest sees a finding's length, character classes and the transitions between them, how much
of it the corpus's frequent words cover, whether it looks like part of a path, and the words
around it. It is trained on labelled findings: those a caller brings, or else the findings
of the documents themselves that are certain, as formats of providers and assignments of long
random values on one side, plain numbers, placeholders and words on the other.

The trained trees become one column expression, so that scanning is work within a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.llm.common import SPACES
from sftprep.llm.spans import drop_scans, spelled, with_matches
from sftprep.storage import stored

NAMES = "passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
PATTERN = (
    f"(?i:(?<![A-Za-z])(?:{NAMES})[\"']?[\\x20]{{0,2}}[=:][\\x20]{{0,2}}[\"']?)[^\\s\"',;]{{6,}}"
    "|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
)
#: Wherever there is a finding there is a digit, or a name with what assigns a value.
GUARD = f"[0-9]|(?i:{NAMES})[\"']?[\\x20]{{0,2}}[=:]"

#: Formats that providers give their keys.
PROVIDERS = (
    "^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_live_[A-Za-z0-9]{16,}$"
    "|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$"
)
PLACEHOLDER = "(?i)example|sample|changeme|placeholder|your[_-]|xxxx|dummy|test|<|\\{|\\$"


@dataclass(frozen=True)
class Settings:
    """findings: most labelled findings of each label to train on (those of the smallest hash,
    repeats counting as one). dictionary:
    frequent words that count as known. trees, depth: of the forest. threshold: of a secret."""

    findings: int = 20_000
    dictionary: int = 200
    trees: int = 20
    depth: int = 5
    threshold: float = 0.5


FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "distinct", "letter_digit", "digit_letter",
    "case_changes", "vowels", "known", "path", "assigned", "named_before", "prose_around",
]


def frequent_words(docs: DataFrame, text: Column, count: int) -> list[str]:
    """The most frequent words of at least four letters, over all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES)).alias("w"))
    words = words.filter(F.col("w").rlike("^[a-zà-ÿ]{4,20}$"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(count)
    return [r["w"] for r in top.collect()]


def _described(span: Column, dictionary: list[str]) -> Column:
    """A finding: its place, value, and features."""
    assigned = span["value"].rlike(f"^(?i:{NAMES})[\"']?[\\x20]{{0,2}}[=:]")
    value = F.when(
        assigned, F.regexp_extract(span["value"], "^[A-Za-z_-]+[\"']?\\x20{0,2}[=:]\\x20{0,2}[\"']?(.+)$", 1)
    ).otherwise(span["value"])
    n = F.length(value)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(value, pattern, ""))) / n

    def changes(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0))) / n

    low = F.lower(value)
    known = F.lit(0.0)
    if dictionary:
        known = (n - F.length(F.regexp_replace(low, "|".join(dictionary), ""))) / n
    left, right = F.lower(span["left"]), F.lower(span["right"])
    features = {
        "length": F.least(n, F.lit(200)),
        "digits": share("[0-9]+"),
        "uppers": share("[A-Z]+"),
        "lowers": share("[a-z]+"),
        "others": share("[^A-Za-z0-9]+"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "letter_digit": changes("[A-Za-z](?=[0-9])"),
        "digit_letter": changes("[0-9](?=[A-Za-z])"),
        "case_changes": changes("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowels": share("[aeiouAEIOU]+"),
        "known": known,
        "path": (value.contains("/") | left.rlike("[/.@]$") | right.rlike("^[/@]|^\\.[a-z]")),
        "assigned": assigned,
        "named_before": left.rlike(f"(?:{NAMES}|key|credential)\\W{{0,12}}$"),
        "prose_around": left.rlike("[a-zà-ÿ]{2,}[.,;:]?\\s$") & right.rlike("^[.,;:\"']?\\s+[a-zà-ÿ]{2,}"),
    }
    return F.struct(
        (span["end"] - n).alias("start"),
        span["end"].alias("end"),
        value.alias("value"),
        F.array(*[features[f].cast("double") for f in FEATURES]).alias("f"),
    )


def certain_label(finding: Column) -> Column:
    """1 or 0 for findings that need no judgement, else null."""
    value = finding["value"]
    assigned = finding["f"][FEATURES.index("assigned")] == 1
    long_random = value.rlike("^[A-Za-z0-9+/_=-]{16,}$") & value.rlike("[0-9].*[0-9].*[0-9].*[0-9]")
    return (
        F.when(value.rlike(PLACEHOLDER), 0)
        .when(value.rlike(PROVIDERS), 1)
        .when(assigned & long_random, 1)
        .when(value.rlike("^[0-9_/+-]+$"), 0)
        .when(value.rlike("^[A-Za-z]+(?:[_/+-][A-Za-z0-9]{1,12})+$"), 0)
    )


def with_findings(docs: DataFrame, text: str, dictionary: list[str]) -> DataFrame:
    """Add ``__found``: the described findings of a text column without nulls.

    The helper columns of ``with_matches`` stay.
    """
    docs = with_matches(docs, text, PATTERN, "__found", F.col(text).rlike(GUARD))
    return docs.withColumn("__found", F.transform("__found", lambda s: _described(s, dictionary)))


class Forest:
    """A trained forest as an expression; without one, only certain findings count."""

    def __init__(self, trees: list | None):
        self.trees = trees

    @classmethod
    def fit(cls, labelled: DataFrame, settings: Settings) -> Forest:
        """From rows ``(f, label)``: feature arrays, and 1 for secrets, 0 for others; a column
        ``value`` tells apart findings of equal features.

        Other labels are left out. With fewer than five of either kind there is no forest.
        """
        given = labelled.filter("f is not null and label in (0, 1)")
        value = F.col("value") if "value" in labelled.columns else F.lit("")
        given = given.select(F.xxhash64(value, "f").alias("h"), "f", "label")
        given = given.groupBy("h", "f", "label").agg(F.count(F.lit(1)).alias("n"))
        chosen = [
            given.filter(F.col("label") == k).orderBy("h", "f").limit(settings.findings)
            for k in (0, 1)
        ]
        given = stored(chosen[0].unionByName(chosen[1]), "labelled")
        held = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        if min(held.get(0, 0), held.get(1, 0)) < 5:
            return cls(None)
        columns = given.select(
            F.col("label").cast("double").alias("label"),
            *[F.col("f")[k].alias(name) for k, name in enumerate(FEATURES)],
        )
        rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(columns)
        forest = RandomForestClassifier(
            featuresCol="x", labelCol="label", numTrees=settings.trees, maxDepth=settings.depth, seed=7
        ).fit(rows)
        return cls([cls._read(t._call_java("rootNode")) for t in forest.trees])

    @classmethod
    def _read(cls, node) -> tuple | float:
        """A node of a trained tree: a probability, or (feature, threshold, left, right)."""
        if node.subtreeDepth() == 0:
            counts = list(node.impurityStats().stats())
            return counts[1] / (sum(counts) or 1)
        split = node.split()
        return (
            split.featureIndex(),
            split.threshold(),
            cls._read(node.leftChild()),
            cls._read(node.rightChild()),
        )

    def probability(self, finding: Column) -> Column:
        if self.trees is None:
            return F.coalesce(certain_label(finding), F.lit(0)).cast("double")

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, left, right = node
            return F.when(finding["f"][feature] <= threshold, walk(left)).otherwise(walk(right))

        total = F.lit(0.0)
        for tree in self.trees:
            total += walk(tree)
        value = finding["value"]
        certain = value.rlike(PROVIDERS) & ~value.rlike(PLACEHOLDER)
        return F.when(certain, 1.0).otherwise(total / len(self.trees))


@dataclass(frozen=True)
class Scanner:
    """What scanning needs: a dictionary, a forest and a threshold."""

    dictionary: list[str]
    forest: Forest
    threshold: float


def fit(
    docs: DataFrame, text: Column, settings: Settings = Settings(), labelled: DataFrame | None = None
) -> Scanner:
    """A scanner for ``docs``.

    ``labelled``: rows ``(text, start, label)``, findings by the text they are in and the
    place they start at. Without it the certain findings of ``docs`` are the labelled ones.
    """
    dictionary = frequent_words(docs, text, settings.dictionary)
    source = docs if labelled is None else labelled
    body = text if labelled is None else F.col("text")
    extra = [] if labelled is None else [F.col("start").alias("__at"), F.col("label").alias("__as")]
    given = source.select(F.coalesce(body, F.lit("")).alias("__text"), *extra)
    found = drop_scans(with_findings(given, "__text", dictionary), "__found")
    # with explode() the optimizer would work the whole array out again for each element
    found = found.withColumn("c", F.explode_outer("__found")).filter("c is not null")
    if labelled is None:
        rows = found.select("c.f", "c.value", certain_label(F.col("c")).alias("label"))
    else:
        rows = found.filter("c.start = __at").select("c.f", "c.value", F.col("__as").cast("int").alias("label"))
    return Scanner(dictionary, Forest.fit(rows, settings), settings.threshold)


def _with_scores(docs: DataFrame, text: Column, scanner: Scanner) -> DataFrame:
    """Add ``__scored``, for each finding ``(start, end, score)``, beside helper columns."""
    df = with_findings(
        docs.withColumn("__text", F.coalesce(text, F.lit(""))), "__text", scanner.dictionary
    )
    scored = F.transform(
        "__found",
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            scanner.forest.probability(c).alias("score"),
        ),
    )
    return df.withColumn("__scored", scored)


def scan(docs: DataFrame, text: Column, scanner: Scanner) -> DataFrame:
    """Add ``secrets``: an array of structs ``(start, end, score)``, and ``n_findings``.

    Places count code points, ends exclusive. Null text counts as empty: no findings. Texts
    are taken whole; rows are neither merged nor dropped; both columns are replaced.
    """
    df = drop_scans(_with_scores(docs, text, scanner), "__found")
    return df.withColumns(
        {
            "n_findings": F.size("__found").cast("long"),
            "secrets": F.filter("__scored", lambda s: s["score"] >= scanner.threshold),
        }
    ).drop("__text", "__found", "__scored")


def spell(secrets: Column) -> Column:
    """``secret:start:end`` of each, joined by commas."""
    return F.array_join(spelled(secrets, "secret"), ",")


def redact(docs: DataFrame, text: str, scanner: Scanner, mask: str = "<secret>") -> DataFrame:
    """``docs`` with ``mask`` in place of every secret of column ``text``; null stays null.

    A text is put together from its matches and the parts between them, in one run.
    """
    df = _with_scores(docs, F.col(text), scanner)
    hits, gaps = F.col("____found_hits"), F.col("____found_gaps")

    def shown(hit: Column, s: Column) -> Column:
        # a secret is the tail of its match
        rest = F.left(hit, F.length(hit) - (s["end"] - s["start"]))
        return F.when(s["score"] >= scanner.threshold, F.concat(rest, F.lit(mask))).otherwise(hit)

    before = F.slice(gaps, F.lit(1), F.size(hits))
    pieces = F.zip_with(before, F.zip_with(hits, "__scored", shown), lambda g, h: F.concat(g, h))
    whole = F.concat(F.array_join(pieces, ""), F.get(gaps, F.size(hits)))
    secret = F.exists("__scored", lambda s: s["score"] >= scanner.threshold)
    hidden = F.when(secret, whole).otherwise(F.col(text))
    return drop_scans(df.withColumn(text, hidden), "__found").drop("__text", "__found", "__scored")
