"""Response lists, summary texts and indicators as column expressions.

A response depends on the level and on the few conditions of that level, so there are
only 14 different ones. They are laid out once, when the plan is built; a row computes the
number of its response and looks lists and texts up. That keeps the generated code small.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    ACTION_SUMMARIES, CONDITIONAL_ACTIONS, DETAIL_EXPLANATIONS, EXPLANATIONS, IMMEDIATE_ACTIONS,
    INDICATOR_TEXTS, LOGGED_MONITORING_ACTIONS, LOGGING_ACTIONS, MONITORING_ACTIONS,
)
from .text import fill, percent_text
from .values import feature_sql, lookup

LEVELS = sorted(IMMEDIATE_ACTIONS)


def _rules(level: int) -> list[tuple]:
    return [r for r in CONDITIONAL_ACTIONS if r[0] == level]


# every response: (level, which of the level's conditions hold)
VARIANTS = [(lvl, flags) for lvl in LEVELS for flags in product((0, 1), repeat=len(_rules(lvl)))]
FIRST_VARIANT = {lvl: next(i for i, v in enumerate(VARIANTS) if v[0] == lvl) for lvl in LEVELS}


def response_number(df: DataFrame, level: str = "severity_level") -> Column:
    """Position of a row's response in ``VARIANTS``."""
    whens = []
    for lvl in LEVELS:
        rules = _rules(lvl)
        bits = [
            f"CASE WHEN {feature_sql(df, name)} > {above} THEN {1 << (len(rules) - 1 - i)} ELSE 0 END"
            for i, (_, _, name, above, _, _) in enumerate(rules)
        ]
        whens.append(f"WHEN {lvl} THEN " + " + ".join([str(FIRST_VARIANT[lvl]), *bits]))
    return F.expr(f"CASE {level} " + " ".join(whens) + " END")


def _extras(kind: str, variant: tuple) -> list[str]:
    level, flags = variant
    return [r[4] for r, on in zip(_rules(level), flags) if on and r[1] == kind]


def _suffix(variant: tuple) -> str:
    level, flags = variant
    return "".join(r[5] for r, on in zip(_rules(level), flags) if on)


def _lists(rows: list[list[str]]) -> Column:
    return F.array(*[F.lit(r) if r else F.array().cast("array<string>") for r in rows])


def immediate_actions(number: Column) -> Column:
    return F.get(_lists([IMMEDIATE_ACTIONS[v[0]] + _extras("immediate", v) for v in VARIANTS]), number)


def monitoring_actions(number: Column, first: int | None = None) -> Column:
    return F.get(_lists([(MONITORING_ACTIONS[v[0]] + _extras("monitoring", v))[:first] for v in VARIANTS]), number)


def logged_monitoring_actions(number: Column) -> Column:
    return monitoring_actions(number, LOGGED_MONITORING_ACTIONS)


def logging_actions(level: Column) -> Column:
    return F.get(_lists([LOGGING_ACTIONS[k] for k in LEVELS]), level)


def plain_actions(level: Column) -> tuple[Column, Column]:
    """Lists of the detail report: by level alone, three monitoring entries at most."""
    return (
        F.get(_lists([IMMEDIATE_ACTIONS[k] for k in LEVELS]), level),
        F.get(_lists([MONITORING_ACTIONS[k][:3] for k in LEVELS]), level),
    )


def _around_percent(texts: list[str], position: Column, pct: Column) -> Column:
    """Text with the percentage in its place; texts without a place stay as they are."""
    before = lookup([t.partition("{pct}")[0] for t in texts], position)
    after = lookup([t.partition("{pct}")[2] for t in texts], position)
    shown = lookup(["{pct}" in t for t in texts], position)
    return F.concat(before, F.when(shown, pct).otherwise(""), after)


def explanation(level: Column, probability: Column) -> Column:
    return _around_percent([EXPLANATIONS[k] for k in LEVELS], level, percent_text(probability))


def detail_explanation(level: Column, probability: Column) -> Column:
    return _around_percent([DETAIL_EXPLANATIONS.get(k, "") for k in LEVELS], level, percent_text(probability))


def action_summary(number: Column, probability: Column) -> Column:
    return _around_percent([ACTION_SUMMARIES[v[0]] + _suffix(v) for v in VARIANTS], number, percent_text(probability))


def indicators(df: DataFrame) -> Column:
    """Up to six suspicious signs of a flow, in fixed order."""
    t = INDICATOR_TEXTS
    src, dst, count, errors, logins, hosts = (
        F.expr(feature_sql(df, n)) for n in
        ("src_bytes", "dst_bytes", "count", "serror_rate", "num_failed_logins", "dst_host_count"))
    return F.array_compact(F.array(
        F.when(src > 100000, t["src_bytes_extreme"]).when(src > 50000, t["src_bytes_large"]),
        F.when((dst < 100) & (src > 10000), t["one_sided"]),
        F.when(count > 300, t["count_extreme"]).when(count > 100, t["count_large"]),
        F.when(errors > 0.5, t["syn_errors"]),
        F.when(logins > 3, fill(t["failed_logins"], n=logins.cast("string"))),
        F.when(hosts > 100, t["many_hosts"]),
    ))
