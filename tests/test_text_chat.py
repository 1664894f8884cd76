from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sftprep.config import ChatMarkers
from sftprep.functions import chat, templates, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_the_whitespace_list_is_that_of_str_strip():
    everything = {chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).strip() == ""}
    assert set(text.PYTHON_WHITESPACE) == everything
    assert len(text.PYTHON_WHITESPACE) == 29


@pytest.mark.parametrize(
    "value",
    ["", " ", "a", "  a b\t", "​a​", "".join(text.PYTHON_WHITESPACE), None]
    + [f"{w}x{w}y{w}" for w in text.PYTHON_WHITESPACE],
)
def test_strip(spark, value):
    assert one(spark, text.strip_text, value) == (None if value is None else value.strip())


def test_missing_comes_before_strip(spark):
    df = spark.createDataFrame([(None, " a "), ("", None)], "a string, b string")
    rows = text.fill_missing(df).select(text.strip_text(F.col("a")), text.strip_text(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("_", "a"), ("", "_")]


@pytest.mark.parametrize(
    "token, expected",
    [
        ("한", True),
        ("ᄀ", True),
        ("ㄱ", True),
        ("x가y", True),
        ("abc", False),
        ("あ", False),
        ("", False),
        ("꯿", False),
        ("힤", False),
    ],
)
def test_hangul(spark, token, expected):
    assert one(spark, text.contains_script, token) is expected


def test_line_breaks_become_one_space_each(spark):
    assert one(spark, text.clean_generation, "a\nb\r\nc") == "a b  c"


def test_markers_are_replaced_in_order(spark):
    changes = [("ab", "b"), ("b", "c")]
    assert one(spark, lambda c: text.remap_markers(c, changes), "ab.b") == "c.c"


MESSAGES = "array<struct<role:string,content:string,extra:int>>"


def test_projection_and_last_turn(spark):
    turns = [("system", "s", 1), ("user", "u", 2)]
    rows = one(spark, chat.project_turns, turns, MESSAGES)
    assert [tuple(r) for r in rows] == [("system", "s"), ("user", "u")]
    assert [r.role for r in one(spark, chat.drop_last_turn, turns, MESSAGES)] == ["system"]
    assert one(spark, chat.drop_last_turn, turns[:1], MESSAGES) == []
    assert one(spark, chat.drop_last_turn, None, MESSAGES) is None
    with pytest.raises(Exception, match="empty conversation"):
        one(spark, chat.drop_last_turn, [], MESSAGES)


def test_rendering(spark):
    turns = [("user", "a", 1), ("assistant", None, 2)]
    plain = "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert one(spark, chat.render_chat, turns, MESSAGES) == plain
    assert one(spark, chat.render_chat, [], MESSAGES) == ""
    assert one(spark, chat.render_chat, None, MESSAGES) is None
    markers = ChatMarkers(generation_suffix="<think>\n")
    opened = one(
        spark, lambda c: chat.render_chat(c, markers, add_generation_prompt=True), turns[:1], MESSAGES
    )
    assert opened == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<think>\n"


THOUGHT = "<think>\nhm\n</think>\n\n"


def test_template_drops_old_thoughts_only(spark):
    turns = [("user", "a", 1), ("assistant", THOUGHT + "b", 2), ("user", "c", 3), ("assistant", THOUGHT + "d", 4)]
    form = templates.CHATML_THINKING
    kept = [(r, c.removeprefix(THOUGHT) if k < 2 else c) for k, (r, c, _) in enumerate(turns)]
    plain = "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in kept)
    assert one(spark, lambda c: templates.render_template(c, form), turns, MESSAGES) == plain
    for thinking, end in ((True, ""), (False, "<think>\n\n</think>\n\n")):
        opened = one(
            spark, lambda c: templates.render_template(c, form, add_generation_prompt=True, thinking=thinking), turns, MESSAGES
        )
        assert opened == plain + "<|im_start|>assistant\n" + end
    without_user = [("assistant", THOUGHT + "b", 1)]
    assert THOUGHT in one(spark, lambda c: templates.render_template(c, form), without_user, MESSAGES)


def test_template_edges(spark):
    form = replace(templates.INSTRUCTION_BLOCKS, default_system="S")

    def made(turns):
        return one(spark, lambda c: templates.render_template(c, form), turns, MESSAGES)

    assert made([("user", None, 1)]) == "<<SYS>>\nS\n<</SYS>>\n\n[INST]  [/INST]"
    assert made([("system", "x", 1), ("assistant", "y", 2)]) == "<<SYS>>\nx\n<</SYS>>\n\n y </s>"
    assert made([]) == "<<SYS>>\nS\n<</SYS>>\n\n"
    assert made(None) is None
    with pytest.raises(Exception, match="no turn of role tool"):
        made([("tool", "x", 1)])
    frame = spark.createDataFrame([([("user", "a", 1)],)], f"m {MESSAGES}")
    plan = frame.select(templates.render_template(F.col("m"), form))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_messages_take_configured_roles(spark):
    markers = ChatMarkers(assistant="model")
    df = spark.createDataFrame([("i", "d", "t")], "i string, d string, t string")
    made = chat.to_messages(F.col("i"), F.col("d"), F.col("t"), markers)
    assert [tuple(m) for m in df.select(made).first()[0]] == [
        ("system", "i"),
        ("user", "d"),
        ("model", "t"),
    ]
    assert len(df.select(chat.to_messages(F.col("i"), F.col("d"), None)).first()[0]) == 2
