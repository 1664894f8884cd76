"""Language identification against a plain version, and its accuracy on documents held out."""

import os
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sftprep.llm import language_id
from sftprep.llm.language_id import Settings

WORDS = {
    "en": "the of and that with this from they house brother morning water winter",
    "de": "der die und nicht mit schon auch übergang straße wasser abend zwischen",
    "fr": "le les des été où garçon voilà maison toujours matin hiver frère",
    "el": "και το στο δεν είναι σπίτι νερό πρωί χειμώνας αδελφός",
    "hi": "और में है पानी घर सुबह भाई सर्दी",
}
SCHEMA = "doc_id long, text string, lang string, gram long, place int, score string"


def plain_grams(text, longest):
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    if not any(c.isalpha() for c in kept):
        return Counter()
    out = Counter()
    for word in kept.split():
        marked = f"_{word}_"
        for n in range(1, longest + 1):
            out.update(marked[k : k + n] for k in range(len(marked) - n + 1))
    del out["_"]
    for word in set(kept.split()):
        out.pop("__", None)
    return out


def key(gram):
    total = 0
    for c in gram:
        code = 1 if c == "_" else ord(c) + 2
        total = (total * int(language_id.BASE) + code) % 2**64
    return total


def plain_places(counts, most):
    order = sorted(counts, key=lambda g: (-counts[g], key(g)))[:most]
    at = defaultdict(list)
    for k, g in enumerate(order):
        at[counts[g]].append(k)
    return {g: sum(at[counts[g]]) / len(at[counts[g]]) for g in order}


def plain_predictions(learned, texts, s):
    total = defaultdict(Counter)
    for text, lang in learned:
        if text is not None and lang is not None:
            total[lang].update(plain_grams(text, s.longest))
    profile = {}
    for lang, counts in total.items():
        order = sorted(counts, key=lambda g: (-counts[g], key(g)))[: s.profile]
        profile[lang] = {g: k for k, g in enumerate(order)}
    out = []
    for text in texts:
        places = plain_places(plain_grams(text or "", s.longest), s.of_text)
        d = {
            lang: sum(min(abs(own.get(g, 10**9) - p), s.profile) for g, p in places.items())
            for lang, own in profile.items()
            if own
        }
        if not places or not d:
            out.append(("und", 0.0))
        else:
            best = min(d, key=lambda x: (d[x], x))
            out.append((best, 1 - d[best] / (s.profile * len(places))))
    return out


def sentences(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        words = WORDS[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), lang))
    return rows


ODD = [
    (900, None, "en"),
    (901, "", "en"),
    (902, "12 -- !? 34 \n\t", "de"),
    (903, "the house", None),
    (903, "the house", None),
    (None, "das wasser und der abend", "de"),
    (904, "́́ 77", "fr"),
    (905, "THE HOUSE, İSTANBUL 日本語 🙂 ½", "en"),
    (906, "x", "xx"),
    (907, "and the water " * 3000, "en"),
]


@pytest.mark.parametrize("settings", [Settings(), Settings(3, 30, 20), Settings(1, 5, 5)])
def test_predictions_are_those_of_a_plain_version(spark, monkeypatch, settings):
    monkeypatch.setattr(language_id, "HELD", 200)
    rows = sentences(150) + ODD
    df = spark.createDataFrame([(*r, 7, 8, "s") for r in rows], SCHEMA)
    profiles = language_id.learn(df, F.col("text"), F.col("lang"), settings)
    assert profiles.groupBy("lang").count().agg(F.max("count")).first()[0] <= settings.profile
    got = language_id.identify(df, F.col("text"), profiles, settings).collect()
    expected = plain_predictions([(t, l) for _, t, l in rows], [t for _, t, _ in rows], settings)
    found = sorted((str(r.doc_id), r.text or "", r.lang_pred, round(r.score, 9)) for r in got)
    assert found == sorted((str(i), t or "", p, round(s, 9)) for (i, t, _), (p, s) in zip(rows, expected))
    assert {r.gram for r in got} == {7} and all(0 <= r.score <= 1 for r in got)


def test_languages_in_blocks_give_the_same(spark, monkeypatch):
    rows = sentences(80)
    df = spark.createDataFrame([(*r, 7, 8, "s") for r in rows], SCHEMA)
    profiles = language_id.learn(df, F.col("text"), F.col("lang"))
    whole = language_id.identify(df, F.col("text"), profiles).collect()
    monkeypatch.setattr(language_id, "BLOCK", 2)
    assert sorted(language_id.identify(df, F.col("text"), profiles).collect()) == sorted(whole)


def test_windows_of_long_texts_add_up(monkeypatch):
    text = "zwischen été, the 12 straße " * 40
    for longest in (1, 2, 5):
        monkeypatch.setattr(language_id, "WINDOW", 1 << 20)
        keys, counts = language_id.grams(text, longest)
        assert dict(zip(keys.tolist(), counts.tolist())) == {
            key(g): n for g, n in plain_grams(text, longest).items()
        }
        monkeypatch.setattr(language_id, "WINDOW", 7)
        again = language_id.grams(text, longest)
        assert (again[0] == keys).all() and (again[1] == counts).all()


def test_nothing_learned_and_nothing_asked(spark):
    df = spark.createDataFrame([(1, "the house", None, 1, 1, "s")], SCHEMA)
    profiles = language_id.learn(df, F.col("text"), F.col("lang"))
    assert profiles.count() == 0
    assert language_id.identify(df, F.col("text"), profiles).first()["lang_pred"] == "und"
    empty = df.filter("false")
    assert language_id.identify(empty, F.col("text"), language_id.learn(empty, F.col("text"), F.col("lang"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(contract.SMOKE_DIR), reason="no test tables")
def test_held_out_documents_are_named_rightly(spark):
    folder = contract.SMOKE_DIR.replace("sf0.001", "sf0.01")
    named = contract.queries()["op11_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    right = named.filter("held_out").join(docs, "doc_id").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")
    ).first()
    assert right[0] >= 0.99 and right[1] > 100
