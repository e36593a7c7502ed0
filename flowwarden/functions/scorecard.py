"""Frozen additive scorecard: score and exact attribution in plain expressions.

Each stump looks at one feature, so a flow's attribution to that feature is the
stump's value minus its expectation; base value + attributions = margin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import SCORECARD_BIAS, SCORECARD_STUMPS
from ..schema import CATEGORICAL_FEATURES


def encoded_sql(name: str) -> str:
    """Numeric value of a model feature: the column, or 1/0 for ``{column}_{value}``."""
    for c in CATEGORICAL_FEATURES:
        if name.startswith(c + "_"):
            value = name[len(c) + 1:].replace("\\", "\\\\").replace("'", "\\'")
            return f"CASE WHEN `{c}` = '{value}' THEN 1D ELSE 0D END"
    return f"CAST(`{name}` AS DOUBLE)"


@dataclass(frozen=True)
class Scorecard:
    bias: float
    stumps: tuple

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(s[0] for s in self.stumps))

    @property
    def base_value(self) -> float:
        return self.bias + sum(c * lo + (1 - c) * hi for _, _, lo, hi, c in self.stumps)

    def margin(self) -> Column:
        steps = [f"CASE WHEN {encoded_sql(f)} <= {b}D THEN {lo}D ELSE {hi}D END" for f, b, lo, hi, _ in self.stumps]
        return F.expr(" + ".join([f"{self.bias}D", *steps]))

    def probability(self) -> Column:
        return F.round(1.0 / (1.0 + F.exp(-self.margin())), 6)

    def attribution_sql(self, feature: str) -> str:
        parts = []
        for f, b, lo, hi, c in self.stumps:
            if f == feature:
                mean = c * lo + (1 - c) * hi
                parts.append(f"CASE WHEN {encoded_sql(f)} <= {b}D THEN {lo - mean!r}D ELSE {hi - mean!r}D END")
        return " + ".join(parts)

    def native_importance(self) -> dict[str, float]:
        """Share of the variance the stumps of a feature explain."""
        gain: dict[str, float] = {}
        for f, _, lo, hi, c in self.stumps:
            gain[f] = gain.get(f, 0.0) + c * (1 - c) * (lo - hi) ** 2
        total = sum(gain.values())
        return {f: g / total for f, g in gain.items()}

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("intrusion_probability", self.probability())

    def explain(self, df: DataFrame) -> DataFrame:
        """Add ``x`` (feature values) and ``shap`` (attributions), ordered like ``features``."""
        return df.withColumns({
            "x": F.expr("array(" + ", ".join(encoded_sql(f) for f in self.features) + ")"),
            "shap": F.expr("array(" + ", ".join(self.attribution_sql(f) for f in self.features) + ")"),
        })


DEFAULT_SCORECARD = Scorecard(SCORECARD_BIAS, tuple(SCORECARD_STUMPS))
