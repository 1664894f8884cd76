"""String clean-up expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 29 characters that Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020"
    "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Hangul syllables, Jamo, compatibility Jamo.
HANGUL = "\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f"

MISSING = "_"


def select_fields(df: DataFrame, fields: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Project the source columns named in ``fields`` (target name -> source name)."""
    return df.select(*keep, *[F.col(source).alias(name) for name, source in fields.items()])


def fill_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Nulls of the string columns become ``_``; nested values stay as they are."""
    return df.fillna(MISSING, subset=None if columns is None else list(columns))


def strip_text(text: Column) -> Column:
    """Strip what Python's ``str.strip()`` strips (plain ``trim`` only takes U+0020)."""
    return F.btrim(text, F.lit(PYTHON_WHITESPACE))


def contains_script(text: Column, char_class: str = HANGUL) -> Column:
    """True if any character falls in ``char_class`` (the inside of a regex ``[...]``)."""
    return text.rlike(f"[{char_class}]")


def clean_generation(text: Column) -> Column:
    """Line feeds and carriage returns become spaces, one for each character."""
    return F.translate(text, "\n\r", "  ")


def remap_markers(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Apply literal replacements one after the other, in the given order."""
    for old, new in replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
