"""Small numeric helpers shared by the expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` as double, ``default`` when the denominator is 0."""
    return F.when(den == 0, F.lit(default)).otherwise(num.cast("double") / den.cast("double"))


def not_nan(c: Column) -> Column:
    """Double with NaN turned into null: Spark ranks NaN above every number."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def feature_sql(df: DataFrame, name: str) -> str:
    """SQL text of a numeric rule input: absent column -> 0, null or NaN -> null."""
    if name not in df.columns:
        return "0"
    kind = df.schema[name].dataType.typeName()
    return f"nanvl(`{name}`, NULL)" if kind in ("double", "float") else f"`{name}`"


def case_sql(whens: list[tuple], otherwise) -> str:
    """``CASE`` text from (condition, value) pairs in order."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in whens) + f" ELSE {otherwise} END"


def lookup(values: list, position: Column) -> Column:
    """Entry of a constant list: folded to one literal, so it costs an array access per row."""
    return F.get(F.lit(values), position)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, for output."""
    return df.select(*[
        F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def constant_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few fixed rows as a local relation: no job and no Python worker to read them."""
    def literal(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
