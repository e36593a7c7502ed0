"""Severity points and levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import PROBABILITY_POINTS, SCORE_LEVELS, SEVERITY_BANDS, SEVERITY_LEVELS
from .values import case_sql, constant_table, feature_sql, lookup


def severity_score(df: DataFrame, probability: str) -> Column:
    """Sum of the band points of every input plus the points for the probability."""
    terms = [
        case_sql([(f"{feature_sql(df, name)} > {above}", pts) for above, pts in bands], 0)
        for name, bands in SEVERITY_BANDS
    ]
    terms.append(case_sql([(f"nanvl({probability}, NULL) >= {p}D", pts) for p, pts in PROBABILITY_POINTS], 0))
    return F.expr(" + ".join(terms))


def severity_level(is_intrusion: str, score: str) -> Column:
    """Level 1 at least for a flagged flow, 0 for any other."""
    level = case_sql([(f"{score} >= {at_least}", lvl) for at_least, lvl in SCORE_LEVELS], 1)
    return F.expr(f"CASE WHEN {is_intrusion} THEN {level} ELSE 0 END")


def severity_name(level: Column) -> Column:
    return lookup([name for _, name, _, _ in SEVERITY_LEVELS], level)


def severity_priority(level: Column) -> Column:
    return lookup([priority for _, _, priority, _ in SEVERITY_LEVELS], level)


def severity_table(spark) -> DataFrame:
    """The four severity levels as a relation."""
    return constant_table(spark, SEVERITY_LEVELS, ["severity_level", "severity_name", "priority", "description"])
