"""Feature name -> category: the first group with a token inside the name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import CATEGORY_TOKENS, OTHER_CATEGORY


def category_of(name: str) -> str:
    """For names known when the plan is built."""
    hits = (group for group, tokens in CATEGORY_TOKENS if any(t in name for t in tokens))
    return next(hits, OTHER_CATEGORY)


def feature_category(name: Column) -> Column:
    """For names that are data."""
    out = F.lit(OTHER_CATEGORY)
    for group, tokens in reversed(CATEGORY_TOKENS):
        out = F.when(name.rlike("|".join(tokens)), group).otherwise(out)
    return out
