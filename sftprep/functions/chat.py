"""Messages (``ARRAY<STRUCT<role, content>>``) and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sftprep.config import ChatMarkers, ColumnNames

DEFAULT_MARKERS = ChatMarkers()
DEFAULT_NAMES = ColumnNames()


def _turn(role: Column, content: Column, names: ColumnNames) -> Column:
    return F.struct(role.alias(names.role), content.alias(names.content))


def to_messages(
    instruction: Column,
    data: Column,
    target: Column | None,
    markers: ChatMarkers = DEFAULT_MARKERS,
    names: ColumnNames = DEFAULT_NAMES,
) -> Column:
    """System, user and assistant turns; leave ``target`` out to stop after the user turn."""
    turns = [(markers.system, instruction), (markers.user, data)]
    if target is not None:
        turns.append((markers.assistant, target))
    return F.array(*[_turn(F.lit(role), text, names) for role, text in turns])


def project_turns(messages: Column, names: ColumnNames = DEFAULT_NAMES) -> Column:
    """Keep only role and content of every turn."""
    return F.transform(messages, lambda t: _turn(t[names.role], t[names.content], names))


def drop_last_turn(messages: Column) -> Column:
    """Drop the last turn whatever its role; an empty conversation is an error."""
    return F.when(F.size(messages) > 0, F.slice(messages, 1, F.size(messages) - 1)).when(
        messages.isNotNull(), F.raise_error(F.lit("cannot drop the last turn of an empty conversation"))
    )


def render_turn(role: Column, content: Column, markers: ChatMarkers = DEFAULT_MARKERS) -> Column:
    return F.concat(
        F.lit(markers.turn_start),
        role,
        F.lit(markers.role_separator),
        F.coalesce(content, F.lit("")),
        F.lit(markers.turn_end + markers.turn_separator),
    )


def generation_prompt(markers: ChatMarkers = DEFAULT_MARKERS) -> str:
    return markers.response_start + markers.role_separator + markers.generation_suffix


def render_chat(
    messages: Column,
    markers: ChatMarkers = DEFAULT_MARKERS,
    names: ColumnNames = DEFAULT_NAMES,
    add_generation_prompt: bool = False,
) -> Column:
    """One prompt string; null content renders as an empty turn, null messages stay null."""
    turns = F.transform(messages, lambda t: render_turn(t[names.role], t[names.content], markers))
    text = F.array_join(turns, "")
    return F.concat(text, F.lit(generation_prompt(markers))) if add_generation_prompt else text
