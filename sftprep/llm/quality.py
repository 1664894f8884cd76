"""Quality rules: divergence of a document from the references of the corpus's languages.

A language reference holds two histograms over all documents of that language: of character
classes, and of its most frequent words, everything else being one more bin. A document is
held against every reference and keeps the smallest Jensen-Shannon distance of each kind, so a
wrong or missing language tag does no harm. The words have to be nearer to the language they
were matched to, or to that of the tag, than a document without common words is to the same
language; the tag also tells where common words are too rare to judge by. Base rules (too few words, too much repeated text)
come first; documents shorter than a guard are not judged by divergence, as their histograms
are mostly chance.

Everything is DataFrame expressions; references of the largest languages are the only thing that
reaches the driver, ``languages * (common_words + 8)`` rows at most. Those of the other languages
are a table, joined by tag.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.llm.common import SPACES

#: Classes of characters, taken out of the text one after the other; the rest is the last class.
CLASSES = {
    "lower": "[a-z]+",
    "space": "[\\x20\\x09-\\x0D]+",
    "accented": "[^\\x00-\\x7F]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "point": "[.,;:!?'\"()-]+",
}
CLASS_NAMES = [*CLASSES, "symbol"]
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
#: The type of a joined reference.
OWN = "struct<words: map<bigint, double>, classes: array<double>, common: double, limit: double>"
#: Most languages beyond the largest whose references are broadcast, of about 1 KB each.
BROADCAST = 10_000


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    min_words, max_repeated: base rules, in words and percent of words.
    class_words, common_words_from: fewest words to be judged by either divergence.
    max_class_distance: largest distance of kept documents, from 0 to 1.
    max_word_share: the same for words, as a share of the distance that a document without any
        common word has from the same language.
    expected_common: common words that a document of its length has to expect in a language to
        be judged by that language's words; 80 words in the given tables' languages have 21.
    common_words: words a reference holds. languages: the most frequent ones, whose references
        all documents are held against; other ones' are joined to the documents so tagged.
    """

    min_words: int = 20
    max_repeated: int = 30
    class_words: int = 20
    common_words_from: int = 80
    max_class_distance: float = 0.25
    max_word_share: float = 0.965
    expected_common: float = 20.0
    common_words: int = 40
    languages: int = 64


def _taken(before: str, pattern: str) -> Column:
    return F.regexp_replace(F.col(before), pattern, "")


def _paired(hashes: Column, step: int) -> Column:
    """Hashes of windows twice as long: of each window and the one ``step`` places on."""
    count = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(
        F.slice(hashes, F.lit(1), count),
        F.slice(hashes, F.lit(1 + step), count),
        lambda a, b: F.xxhash64(a, b),
    )


def with_base(docs: DataFrame, text: Column) -> DataFrame:
    """Add the base counts, and for the method the hashes of the words and the class counts.

    Equal windows of eight words are found by a 64-bit hash, eight-word windows only where
    two windows of four words are equal.
    """
    df = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    df = df.withColumn("__words", F.array_remove(F.split("__text", SPACES), ""))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(_taken("__text", SYMBOLS))).cast("long"),
            "__lines": lines,
            "__h": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    )
    df = df.withColumn(
        "n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")
    ).drop("__lines")
    df = df.withColumn("__h2", _paired(F.col("__h"), 1))
    df = df.withColumn("__h4", _paired(F.col("__h2"), 2)).drop("__h2")
    df = df.withColumn(
        "__h8",
        F.when(F.size(F.array_distinct("__h4")) < F.size("__h4"), _paired(F.col("__h4"), 4)),
    ).drop("__h4")
    df = df.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__h8")) < F.size("__h8"),
            F.sort_array(
                F.arrays_zip(
                    F.col("__h8").alias("h"), F.sequence(F.lit(1), F.size("__h8")).alias("at")
                )
            ),
        ),
    ).drop("__h8")
    df = df.withColumn(
        "__places",
        F.sort_array(
            F.transform(
                F.filter(
                    "__sorted",
                    lambda x, i: (x["h"] == F.get("__sorted", i - 1)["h"])
                    | (x["h"] == F.get("__sorted", i + 1)["h"]),
                ),
                lambda x: x["at"],
            )
        ),
    ).drop("__sorted")
    first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "__places",
        first,
        lambda acc, at: F.struct(
            at.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["at"])).alias("n")
        ),
    )["n"]
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.drop("__places")
    before, counts = "__text", {}
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"__rest_{name}", _taken(before, pattern))
        counts[name] = F.length(before) - F.length(f"__rest_{name}")
        before = f"__rest_{name}"
    counts["symbol"] = F.length(before)
    df = df.withColumn("__classes", F.array(*[counts[c].cast("double") for c in CLASS_NAMES]))
    return df.drop("__text", "__words", *[f"__rest_{name}" for name in CLASSES])


def _given(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    return docs.select(_tag(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))


def _tag(lang: Column) -> Column:
    """Null languages count as one of their own."""
    return F.coalesce(lang.cast("string"), F.lit(""))


def _common_words(given: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The most frequent words of each language, and how many words it has in all."""
    words = given.select("lang", F.explode(F.split("text", SPACES)).alias("w")).filter("w != ''")
    words = words.select("lang", F.xxhash64("w").alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = counts.withColumn("r", F.row_number().over(by_count)).filter(
        F.col("r") <= rules.common_words
    )
    return top, counts.groupBy("lang").agg(F.sum("n").alias("total"))


def _class_sums(given: DataFrame) -> DataFrame:
    df, before = given.withColumn("r0", F.col("text")), "r0"
    sums = []
    for k, pattern in enumerate(CLASSES.values(), 1):
        df = df.withColumn(f"r{k}", _taken(before, pattern))
        sums.append(F.sum(F.length(before) - F.length(f"r{k}")))
        before = f"r{k}"
    sums.append(F.sum(F.length(before)))
    return df.groupBy("lang").agg(F.array(*sums).alias("c"))


def references(docs: DataFrame, text: Column, lang: Column, rules: Rules) -> dict[str, dict]:
    """The histograms of each language, over all its documents; see the module.

    ``{language: {"classes": [shares], "words": {hash of word: share}}}``. Null languages count as
    one of their own. Without any word there is no reference, and nothing is rejected by
    divergence.
    """
    given = _given(docs, text, lang)
    top, totals = _common_words(given, rules)
    largest = totals.orderBy(F.desc("total"), "lang").limit(rules.languages)
    found: dict[str, dict] = {}
    for r in top.join(F.broadcast(largest), "lang").collect():
        own = found.setdefault(r["lang"], {"words": {}})
        own["words"][r["w"]] = r["n"] / r["total"]
    for r in _class_sums(given).collect() if found else []:
        if r["lang"] in found:
            whole = sum(r["c"]) or 1
            found[r["lang"]]["classes"] = [x / whole for x in r["c"]]
    return found


def rare_references(docs: DataFrame, text: Column, lang: Column, rules: Rules, large: list[str]) -> DataFrame:
    """The references of all languages but ``large``, as rows ``(__tag, __own)``: a struct of the
    words' shares by hash, the classes' shares, the common words' share, and the words' limit."""
    given = _given(docs, text, lang).filter(~F.col("lang").isin(large))
    top, totals = _common_words(given, rules)
    words = top.join(totals, "lang").groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("w", F.col("n") / F.col("total")))).alias("words"),
        (F.sum("n") / F.first("total")).alias("common"),
    )
    whole = F.greatest(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    classes = _class_sums(given).select("lang", F.transform("c", lambda x: x / whole).alias("classes"))
    rest = F.greatest(1 - F.col("common"), F.lit(0.0))
    bare = F.sqrt(F.col("common") / 2 + _term(F.lit(1.0), rest))
    own = F.struct("words", "classes", "common", (rules.max_word_share * bare).alias("limit"))
    return words.join(classes, "lang").select(F.col("lang").alias("__tag"), own.alias("__own"))


def with_rare(docs: DataFrame, text: Column, lang: Column, rules: Rules, large: list[str]) -> DataFrame:
    """Add ``__own``, the reference of the language ``__tag`` where it is not one of ``large``.

    Up to ``BROADCAST`` languages are broadcast. More are shuffled, documents of the large
    languages without a common key.
    """
    rare = rare_references(docs, text, lang, rules, large)
    tags = docs.filter(~F.col("__tag").isin(large)).select("__tag").distinct()
    if tags.limit(BROADCAST + 1).count() <= BROADCAST:
        return docs.join(F.broadcast(rare), "__tag", "left")
    own = F.concat(F.lit("="), F.col("__tag"))
    apart = F.monotonically_increasing_id().cast("string")
    placed = docs.withColumn("__place", F.when(F.col("__tag").isin(large), apart).otherwise(own))
    rare = rare.select(own.alias("__place"), "__own")
    return placed.join(rare, "__place", "left").drop("__place")


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, in bits; ``p`` or ``q`` may be 0."""

    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x * 2 / (p + q))).otherwise(F.lit(0.0))

    return (half(p) + half(q)) / 2


def _own_classes(own: Column) -> dict:
    return {"classes": [F.get(own["classes"], F.lit(k)) for k in range(len(CLASS_NAMES))]}


def _nearest(references_: dict, distance: Callable[[dict], Column]) -> Column:
    found = [distance(x) for x in references_.values()]
    return found[0] if len(found) == 1 else F.least(*found)


def class_distance(classes: Column, reference: dict) -> Column:
    """The Jensen-Shannon distance of counts of character classes from a reference."""
    whole = reduce(lambda a, b: a + b, [classes[k] for k in range(len(CLASS_NAMES))])
    terms = [
        _term(classes[k] / whole, F.lit(q)) for k, q in enumerate(reference["classes"])
    ]
    return F.sqrt(F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0)))


def _held_against(bins: Column, share: Callable[[Column], Column], common: Column) -> Column:
    """The distance ``js`` of bins with a document's shares ``p`` from a language's words, of which
    ``share`` says the share of a bin, and the part ``p`` of the document that they are."""
    start = F.struct(*[F.lit(0.0).alias(x) for x in ("js", "p", "q")])

    def add(acc: Column, x: Column) -> Column:
        q = share(x)
        p = F.when(q > 0, x["p"]).otherwise(F.lit(0.0))
        return F.struct(
            (acc["js"] + F.when(q > 0, _term(p, q)).otherwise(F.lit(0.0))).alias("js"),
            (acc["p"] + p).alias("p"),
            (acc["q"] + q).alias("q"),
        )

    def end(acc: Column) -> Column:
        unseen = F.greatest(common - acc["q"], F.lit(0.0)) / 2
        rest = _term(F.greatest(1 - acc["p"], F.lit(0.0)), 1 - common)
        js = F.sqrt(F.greatest(acc["js"] + unseen + rest, F.lit(0.0)))
        return F.struct(js.alias("js"), acc["p"].alias("p"))

    return F.aggregate(bins, start, add, end)


def own_distance(runs: Column, n_words: Column, own: Column) -> Column:
    """The same for word counts and a joined reference; null without one."""
    bins = F.transform(
        runs,
        lambda r: F.struct(
            (r["n"] / n_words).alias("p"),
            F.coalesce(F.try_element_at(own["words"], r["w"]), F.lit(0.0)).alias("q"),
        ),
    )
    return F.when(own.isNotNull(), _held_against(bins, lambda x: x["q"], own["common"]))


def word_distances(
    runs: Column, n_words: Column, references_: list[dict], own: Column | None = None
) -> Column:
    """The distances of word counts ``array<struct<w, n>>`` from two languages' words, as an array
    of structs of the language's place ``k`` and what ``_held_against`` says, ``d``: first the nearest, whose
    common words have the largest share of the document, then the one at place ``own``, if it is
    another. ``own`` counts as nearest where no word is common."""
    shares: dict[int, list[float]] = {}
    for k, x in enumerate(references_):
        for w, q in x["words"].items():
            shares.setdefault(w, [0.0] * len(references_))[k] = q
    table = F.create_map(
        *[x for w, q in shares.items() for x in (F.lit(w), F.array(*map(F.lit, q)))]
    )
    known = F.transform(
        runs,
        lambda r: F.struct((r["n"] / n_words).alias("p"), F.try_element_at(table, r["w"]).alias("q")),
    )
    common = F.array(*[F.lit(sum(x["words"].values())) for x in references_])
    own = F.lit(None).cast("int") if own is None else own

    def with_language(bins: Column, k: Column) -> Column:
        share = lambda x: F.coalesce(F.get(x["q"], k), F.lit(0.0))
        return F.struct(k.alias("k"), _held_against(bins, share, F.get(common, k)).alias("d"))

    def mass(bins: Column, k: int) -> Column:
        return F.aggregate(
            bins,
            F.lit(0.0),
            lambda acc, x: acc + F.when(x["q"][k] > 0, x["p"]).otherwise(F.lit(0.0)),
        )

    def nearest(masses: Column) -> Column:
        at = F.array_position(masses, F.array_max(masses)).cast("int") - 1
        return F.when(F.array_max(masses) > 0, at).otherwise(F.coalesce(own, at))

    def of(bins: Column) -> Column:
        # the languages go along as an array, so that they are worked out once
        masses = F.array(F.array(*map(partial(mass, bins), range(len(references_)))))
        places = F.transform(masses, nearest)
        places = F.array_distinct(F.concat(places, F.filter(F.array(own), lambda k: k.isNotNull())))
        return F.transform(places, lambda k: with_language(bins, k))

    return F.transform(F.array(known), of)[0]


def word_distance(runs: Column, n_words: Column, references_: list[dict]) -> Column:
    """The distance of word counts ``array<struct<w, n>>`` from the nearest language's words."""
    return word_distances(runs, n_words, references_)[0]["d"]["js"]


def words_alike(
    distances: Column, n_words: Column, references_: list[dict], rules: Rules, rare: Column, own: Column
) -> Column:
    """Whether ``word_distances`` are within the limit of the nearest language or of the document's
    own, each held against its own language's limit; ``rare`` is ``own_distance`` from the joined
    reference ``own``, if there is one.

    Where so few common words are to be expected that chance decides, the nearest language does
    not count, and the own one has no limit."""
    common = F.array(*[F.lit(sum(x["words"].values())) for x in references_])
    limits = F.array(*[F.lit(rules.max_word_share * without_common_words(x)) for x in references_])

    def expected(x: Column) -> Column:
        return F.get(common, x["k"]) * n_words >= rules.expected_common

    def within(x: Column) -> Column:
        return x["d"]["js"] <= F.get(limits, x["k"])

    # one element if the own language is the nearest, or unknown
    near, last = F.get(distances, F.lit(0)), F.get(distances, F.size(distances) - 1)
    return (expected(near) & within(near)) | F.when(
        rare.isNotNull(),
        (own["common"] * n_words < rules.expected_common) | (rare["js"] <= own["limit"]),
    ).otherwise(~expected(last) | within(last))


def without_common_words(reference: dict) -> float:
    """The distance from a reference of a document that has none of its common words."""
    common = sum(reference["words"].values())
    rest = max(1 - common, 0.0)
    other = math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest else 0)
    return math.sqrt(common / 2 + other / 2)


def judge(
    docs: DataFrame,
    text: Column,
    lang: Column,
    rules: Rules = Rules(),
    references_: dict[str, dict] | None = None,
) -> DataFrame:
    """Add base counts, ``base_failed``, both distances and ``kept`` to each row.

    Null or blank text has no words, so ``base_failed`` is true and the distances are null.
    Distances are null under the guards of ``rules`` and where there is no reference. Rows
    are neither merged nor dropped; repeated rows get equal verdicts. References come from
    ``docs`` itself unless given. Columns of the added names are replaced.
    """
    given = docs.withColumn("__tag", _tag(lang))
    joined = False
    if references_ is None:
        references_ = references(docs, text, lang, rules)
        large = list(references_)
        if len(large) >= rules.languages:
            joined = bool(given.filter(~F.col("__tag").isin(large)).head(1))
    if joined:
        given = with_rare(given, text, lang, rules, large)
    df = with_base(given, text)
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeated * F.col("n_words")),
    )
    distances = {"class_distance": F.lit(None), "word_distance": F.lit(None)}
    alike = F.lit(None).cast("boolean")
    if references_:
        vocabulary = sorted({w for x in references_.values() for w in x["words"]})
        own = F.col("__own") if joined else F.lit(None).cast(OWN)

        def is_common(h: Column) -> Column:
            if not joined:
                return h.isin(vocabulary)
            return h.isin(vocabulary) | F.coalesce(
                F.map_contains_key(own["words"], h), F.lit(False)
            )

        df = df.withColumn("__common", F.sort_array(F.filter("__h", is_common)))
        # runs of equal words in the sorted array: where they start, then word and length
        df = df.withColumn(
            "__starts",
            F.filter(
                F.transform(
                    "__common",
                    lambda w, i: F.when(~w.eqNullSafe(F.get("__common", i - 1)), i),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        df = df.withColumn(
            "__runs",
            F.transform(
                "__starts",
                lambda at, k: F.struct(
                    F.get("__common", at).alias("w"),
                    (
                        F.coalesce(F.get("__starts", k + 1), F.size("__common")) - at
                    ).cast("double").alias("n"),
                ),
            ),
        )
        places = F.create_map(*[F.lit(x) for k, name in enumerate(references_) for x in (name, k)])
        # both in one step, whose code is made in parts because of the functions over arrays
        df = df.withColumns(
            {
                "class_distance": F.when(
                    F.col("n_words") >= rules.class_words,
                    F.least(
                        _nearest(references_, lambda x: class_distance(F.col("__classes"), x)),
                        F.when(
                            own.isNotNull(), class_distance(F.col("__classes"), _own_classes(own))
                        ),
                    ),
                ),
                "__distances": F.when(
                    F.col("n_words") >= rules.common_words_from,
                    word_distances(
                        F.col("__runs"),
                        F.col("n_words"),
                        list(references_.values()),
                        F.try_element_at(places, F.col("__tag")),
                    ),
                ),
                "__rare": F.when(
                    F.col("n_words") >= rules.common_words_from,
                    own_distance(F.col("__runs"), F.col("n_words"), own),
                ),
            }
        )
        near, rare = F.get("__distances", F.lit(0))["d"], F.col("__rare")
        alike = words_alike(
            F.col("__distances"), F.col("n_words"), list(references_.values()), rules, rare, own
        )
        distances = {
            "class_distance": F.col("class_distance"),
            "word_distance": F.when(rare["p"] >= near["p"], rare["js"]).otherwise(near["js"]),
        }
    df = df.withColumns({k: v.cast("double") for k, v in distances.items()})
    return df.withColumn(
        "kept",
        ~F.col("base_failed")
        & F.coalesce(F.col("class_distance") <= rules.max_class_distance, F.lit(True))
        & F.coalesce(alike, F.lit(True)),
    ).drop("__h", "__classes", "__common", "__starts", "__runs", "__distances", "__rare", "__tag", "__own")



def keep(judged: DataFrame) -> DataFrame:
    """The rows that ``judge`` keeps.

    The row number holds the filter above the rules: pushed below them, it would repeat their
    expressions within each other until the plan is too large to optimize.
    """
    numbered = judged.withColumn("__row", F.monotonically_increasing_id())
    return numbered.filter("kept and __row >= 0").drop("__row")
