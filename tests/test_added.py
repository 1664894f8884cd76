import random

import pytest
from pyspark.sql import functions as F

from sftprep.functions import added as added_tokens
from sftprep.functions.added import MAX_ADDED, AddedTokens, Trie
from sftprep.functions.tokens import tokenize_literal
from sftprep.operators.vocabulary import VOCAB_SCHEMA, Vocabulary
from sftprep.plans.encoding import TableEncoder
from sftprep.plans.vocabulary import corpus_vocabulary, extended_encoder


def plain_cut(text, tokens):
    out, rest, at = [], "", 0
    while at < len(text):
        best = max((t for t in tokens if text.startswith(t, at)), key=len, default="")
        if best:
            out += ([(rest, False)] if rest else []) + [(best, True)]
            rest, at = "", at + len(best)
        else:
            rest, at = rest + text[at], at + 1
    return out + ([(rest, False)] if rest else [])


def test_the_trie_takes_the_leftmost_and_then_the_longest():
    rng = random.Random(8)
    for _ in range(400):
        tokens = {"".join(rng.choice("ab<é") for _ in range(rng.randrange(1, 5))) for _ in range(6)}
        text = "".join(rng.choice("ab<é> ") for _ in range(rng.randrange(40)))
        assert Trie(tokens).cut(text) == plain_cut(text, tokens)
    assert Trie([]).cut("ab") == [("ab", False)] and Trie(["a"]).cut("") == []
    with pytest.raises(ValueError, match="empty"):
        Trie([""])


def test_a_trie_of_many_tokens_takes_little_more_than_their_text():
    import tracemalloc

    rng = random.Random(9)
    tokens = list({"".join(rng.choice("abcdefgß") for _ in range(rng.randrange(6, 16))) for _ in range(50_000)})
    tracemalloc.start()
    trie = Trie(tokens)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 16 << 20  # beside the tokens themselves
    assert trie.cut(f"{tokens[5]} x{tokens[6]}") == plain_cut(f"{tokens[5]} x{tokens[6]}", tokens)


def test_texts_cut_in_steps(spark, monkeypatch):
    texts = ["aß b", None, "", "ßß", "x" * 40, "cßa"] * 30
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key int, text string").coalesce(1)
    for step in (1 << 19, 7):
        monkeypatch.setattr(added_tokens, "STEP", step)
        whole = df.withColumn("p", AddedTokens(["ß", "aß"]).cut(F.col("text")))
        found = {r.key: r.p and [tuple(x) for x in r.p] for r in whole.collect()}
        for k, t in enumerate(texts):
            assert found[k] == (None if t is None else plain_cut(t, ["ß", "aß"]))
    import pyarrow as pa

    cut = added_tokens._cut(Trie(["ß", "aß"]), pa.array(texts))
    assert [x and [(p["piece"], p["added"]) for p in x] for x in cut.to_pylist()] == [found[k] for k in range(len(texts))]


def test_tokens_of_a_column(spark):
    added = AddedTokens(["<think>", "</think>", "한국", "한국어", " \n"])
    texts = ["a<think>b c</think> <thin", "x한국어y 한국", "", None, "<|im_end|> \nend", "<think><think>"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "key int, text string, piece int")
    rows = {r.key: r for r in added.tokenize(df, "text", "tokens").collect()}
    assert rows[0].tokens == ["a", "<think>", "b", " ", "c", "</think>", " ", "<", "thin"]
    assert rows[1].tokens == ["x", "한국어", "y", " ", "한국"]
    assert rows[2].tokens == [] and rows[3].tokens is None
    assert rows[4].tokens == ["<|im_end|>", " \n", "end"] and rows[5].tokens == ["<think>"] * 2
    for k, t in enumerate(texts):
        if t is not None:
            assert "".join(rows[k].tokens) == t
            assert added.tokenize_literal(t) == rows[k].tokens
    assert AddedTokens([]).tokenize(df, "text", "tokens").first().tokens == tokenize_literal(texts[0])


def test_too_many_added_tokens_are_refused(spark):
    base = spark.createDataFrame([("a", 0, 1)], VOCAB_SCHEMA)
    many = spark.range(MAX_ADDED + 2).select(
        F.concat(F.lit("t"), "id").alias("token"), F.col("id").cast("int").alias("id"), F.lit(1).alias("freq")
    )
    with pytest.raises(ValueError, match="too many"):
        AddedTokens.beyond(base, many)


@pytest.mark.parametrize("shipped", [1 << 20, 4])
def test_an_extended_vocabulary_encodes_its_new_tokens(spark, shipped):
    base = corpus_vocabulary(spark.createDataFrame([("the house is red",)], "text string"), reserved=("<|unk|>",))
    other = spark.createDataFrame([("한국 한국 한국어 house 물",)], "text string")
    encoder = extended_encoder(base, other, "<|unk|>", group=1)
    assert encoder.added.tokens == ["한국", "물", "한국어", "<think>", "</think>"]
    encoder = TableEncoder(Vocabulary(encoder.vocabulary.table, "<|unk|>", max_tokens=shipped), added=encoder.added)
    text = "<think>the 물house</think> 한국어 the"
    df = spark.createDataFrame([(1, text), (2, None)], "key int, text string")
    ids = encoder.encode(df, "key", "text", "ids", 100)
    row = encoder.decode(ids, "key", "ids", "back", []).filter("key = 1").first()
    assert row.back == text and encoder.literal_ids(text) == row.ids
    assert 0 not in row.ids  # nothing is unknown
