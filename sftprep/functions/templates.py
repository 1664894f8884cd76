"""Prompts by a chat template: text around the turns of each role, and thoughts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sftprep.config import ChatTemplate, ColumnNames

# Two common prompt forms.
CHATML_THINKING = ChatTemplate(
    turns=(
        ("system", "<|im_start|>system\n", "<|im_end|>\n"),
        ("user", "<|im_start|>user\n", "<|im_end|>\n"),
        ("assistant", "<|im_start|>assistant\n", "<|im_end|>\n"),
    ),
    opening="<|im_start|>assistant\n",
    thought=("<think>", "</think>"),
    no_thought="<think>\n\n</think>\n\n",
)
INSTRUCTION_BLOCKS = ChatTemplate(
    turns=(
        ("system", "<<SYS>>\n", "\n<</SYS>>\n\n"),
        ("user", "[INST] ", " [/INST]"),
        ("assistant", " ", " </s>"),
    ),
    opening=" ",
)


def without_thought(content: Column, template: ChatTemplate) -> Column:
    """What follows the last closing mark and its line breaks; all of a text without one."""
    close = template.thought[1]
    after = F.regexp_replace(F.substring_index(content, close, -1), "^\n+", "")
    return F.when(F.contains(content, F.lit(close)), after).otherwise(content)


def _turn(role: Column, content: Column, template: ChatTemplate) -> Column:
    forms = {name: (before, after) for name, before, after in template.turns}
    text = None
    for name, (before, after) in forms.items():
        own = F.concat(F.lit(before), content, F.lit(after))
        text = F.when(role == name, own) if text is None else text.when(role == name, own)
    unknown = F.concat(F.lit("the template has no turn of role "), F.coalesce(role, F.lit("null")))
    return F.raise_error(unknown) if text is None else text.otherwise(F.raise_error(unknown))


def render_template(
    messages: Column,
    template: ChatTemplate,
    names: ColumnNames = ColumnNames(),
    add_generation_prompt: bool = False,
    thinking: bool = True,
) -> Column:
    """One prompt string; null content renders as an empty turn, null messages stay null.

    Linear in the turns: the place of the last user turn is worked out once a conversation.
    """
    users = F.transform(messages, lambda t: t[names.role].eqNullSafe(F.lit(template.user)))
    from_end = F.array_position(F.reverse(users), True)
    last = F.when(from_end > 0, F.size(messages) - from_end).otherwise(F.lit(-1))

    def turn(message: Column, place: Column, last_user: Column) -> Column:
        role = message[names.role]
        content = F.coalesce(message[names.content], F.lit(""))
        if template.thought is not None:
            old = (role == template.assistant) & (place < last_user)
            content = F.when(old, without_thought(content, template)).otherwise(content)
        return _turn(role, content, template)

    def rendered(bound: Column) -> Column:
        parts = F.transform(bound["turns"], lambda m, i: turn(m, i, bound["last"]))
        return F.array_join(parts, "")

    once = F.array(F.struct(messages.alias("turns"), last.alias("last")))
    text = F.get(F.transform(once, rendered), F.lit(0))
    if template.default_system is not None:
        first = F.get(messages, F.lit(0))[names.role]
        system = _turn(F.lit(template.system), F.lit(template.default_system), template)
        begins = first.eqNullSafe(F.lit(template.system))
        text = F.concat(F.when(begins, "").otherwise(system), text)
    if add_generation_prompt:
        text = F.concat(text, F.lit(template.opening + ("" if thinking else template.no_thought)))
    return F.when(messages.isNotNull(), text)
