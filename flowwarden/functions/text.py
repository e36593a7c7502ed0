"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..fixed_values import EMOJI_RANGES


def percent_text(p: Column) -> Column:
    """``0.0527 -> '5.3%'``: one decimal, half to even on the stored binary value.

    ``format_number`` follows java.text.DecimalFormat, whose rounding agrees with C
    and Python; ``format_string('%.1f')`` rounds half up and does not.
    """
    return F.concat(F.format_number(p * 100, 1), F.lit("%"))


def fill(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a text."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [values[t] if i % 2 else F.lit(t) for i, t in enumerate(parts) if i % 2 or t]
    return F.concat(*cols) if len(cols) > 1 else cols[0]


def strip_emoji(text: Column) -> Column:
    """Drop every code point of the emoji ranges from the whole text."""
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES)
    return F.regexp_replace(text, f"[{ranges}]+", "")


def short_hash(value: Column, shown: int = 40) -> Column:
    """The beginning of a hash, as log lines show it."""
    return F.concat(F.left(value, F.lit(shown)), F.lit("..."))


def safe_name(name: str) -> str:
    """Column name without ``/`` or blanks."""
    return re.sub(r"[/ ]", "_", name)
