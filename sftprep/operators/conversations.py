"""Message lists from tables that hold one row per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftprep.config import ColumnNames

TURNS_PER_BLOCK = 512


def assemble_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    content: str = "text",
    names: ColumnNames = ColumnNames(),
) -> DataFrame:
    """One row ``(key, messages)`` per conversation, its turns in ``order``.

    Blocks of turn numbers are gathered and sorted first, so the turns of a long
    conversation are spread over tasks until its one output row is put together.
    That row is the operator's output, so a conversation must fit one: Spark's limit for a
    row is 2 GB.
    """
    turn = F.struct(
        F.col(order).alias("at"), F.col(role).alias(names.role), F.col(content).alias(names.content)
    )
    blocks = (
        turns.groupBy(key, F.floor(F.col(order) / TURNS_PER_BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    return (
        blocks.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
        .select(
            key,
            F.transform(
                F.flatten(F.transform("blocks", lambda b: b.turns)),
                lambda t: F.struct(t[names.role], t[names.content]),
            ).alias(names.messages),
        )
    )
