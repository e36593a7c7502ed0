"""Explanations of scores.

Input: scored flows with two arrays per row, ``x`` (feature values) and ``shap``
(attributions), both ordered like a list of feature names known when the plan is built.
Reports per flow are computed inside the row, without a shuffle; reports over flows
are one wide aggregate whose result is turned into rows afterwards. The long
(flow, feature) table is only built where rows are the output. Computed arrays are turned
into rows by the outer generators: the plain ones add a filter on the array's size, which
would compute the array a second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed_values import ANOMALY_FEATURES, COMPARE_FEATURES, PROFILE_FEATURES
from ..functions.category import category_of
from ..functions.text import safe_name
from ..functions.values import constant_table, lookup, not_nan, ratio
from .detect import INTRUSION, NORMAL, PROB, confidence_band
from .ranking import exact_quantiles

FLAGGED = f"predicted_class = '{INTRUSION}'"


def _shap(i: int) -> Column:
    return F.col("shap")[i]


def _entry(i: int, value: str) -> str:
    """Sort key (|shap| in 1e-9 steps, earlier feature first on ties), position, value, shap."""
    return (f"named_struct('k', CAST(abs(shap[{i}]) * 1e9 + 0.5D AS BIGINT), 'back', {-i}, 'i', {i}, "
            f"'v', CAST({value} AS DOUBLE), 's', shap[{i}])")


def _by_size(features: list[str], keep: str = "", raw: dict[str, str] | None = None) -> Column:
    """Entries of a row, largest |shap| first; ``keep`` (e.g. '> 0') leaves the others null, at the end."""
    raw = raw or {}
    rows = [_entry(i, raw.get(f, f"x[{i}]")) for i, f in enumerate(features)]
    if keep:
        rows = [f"CASE WHEN shap[{i}] {keep} THEN {r} END" for i, r in enumerate(rows)]
    return F.expr("sort_array(array(" + ", ".join(rows) + "), false)")


def _named(features: list[str], entry: str) -> list[Column]:
    at = F.col(f"{entry}.i")
    return [lookup(features, at).alias("feature"), lookup([category_of(f) for f in features], at).alias("category")]


def total_shap(features: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [_shap(i) for i in range(len(features))])


# --- one flow at a time, for all flows --------------------------------------

def one_flow(df: DataFrame, flow_id: int) -> DataFrame:
    """The flow of an id, ahead of an explanation; the filter reaches the scan."""
    return df.where(F.col("flow_id") == flow_id)


def explain_flow(df: DataFrame, features: list[str], top: int = 15, raw: dict[str, str] | None = None) -> DataFrame:
    """Per flow: the ``top`` features toward an intrusion and the ``top`` toward normal.

    ``raw`` names the column to show as a feature's value instead of the model input.
    For a single flow put ``one_flow`` in front.
    """
    sides = F.array(*[
        F.struct(F.lit(side).alias("direction"), F.slice(_by_size(features, keep, raw), 1, top).alias("entries"))
        for side, keep in ((INTRUSION, "> 0"), (NORMAL, "< 0"))])
    rows = df.select("flow_id", F.inline(sides)).select(
        "flow_id", "direction", F.posexplode_outer("entries").alias("at", "e")).where("e IS NOT NULL")
    return rows.select(
        "flow_id", "direction", (F.col("at") + 1).alias("rank"), *_named(features, "e"),
        F.col("e.s").alias("shap_value"), F.col("e.v").alias("feature_value"))


def explain_header(df: DataFrame, features: list[str], base_value: float, threshold: float) -> DataFrame:
    """Per flow: prediction, band, base value, total attribution, margin and its sigmoid."""
    total = total_shap(features)
    out = df.select(
        "flow_id", "predicted_class", PROB, F.lit(threshold).alias("threshold"),
        confidence_band(F.col(PROB), threshold).alias("confidence"),
        F.round(F.lit(base_value), 6).alias("base_value"), F.round(total, 6).alias("total_shap"),
        F.round(total + base_value, 6).alias("margin"),
        F.round(1.0 / (1.0 + F.exp(-(total + base_value))), 6).alias("after_sigmoid"),
        *([F.when(F.col("y") == 1, INTRUSION).otherwise(NORMAL).alias("actual_class"),
           (F.expr(FLAGGED).cast("int") == F.col("y")).alias("correct")] if "y" in df.columns else []))
    return out


def category_contrib(df: DataFrame, features: list[str]) -> DataFrame:
    """Signed attribution per flow and category with its direction."""
    groups: dict[str, list[int]] = {}
    for i, f in enumerate(features):
        groups.setdefault(category_of(f), []).append(i)
    rows = F.array(*[
        F.struct(F.lit(c).alias("category"), F.round(reduce(lambda a, b: a + b, [_shap(i) for i in idx]), 6)
                 .alias("contribution")) for c, idx in groups.items()])
    return df.select("flow_id", F.inline(rows)).withColumn(
        "direction", F.when(F.col("contribution") > 0, INTRUSION).otherwise(NORMAL))


def contrib_share(df: DataFrame, features: list[str]) -> DataFrame:
    """Share of each category in the positive and in the negative part of a flow."""
    groups: dict[str, list[int]] = {}
    for i, f in enumerate(features):
        groups.setdefault(category_of(f), []).append(i)
    sums = F.array(*[
        F.struct(F.lit(c).alias("category"), F.round(reduce(lambda a, b: a + b, [_shap(i) for i in idx]), 6)
                 .alias("contribution")) for c, idx in groups.items()])
    kept = df.select("flow_id", F.filter(sums, lambda s: s["contribution"] != 0).alias("s"))

    def part(sign):
        return F.aggregate("s", F.lit(0.0), lambda acc, s: acc + F.when(
            s["contribution"] * sign > 0, F.abs(s["contribution"])).otherwise(0.0))

    return kept.select("flow_id", part(1).alias("_pos"), part(-1).alias("_neg"), F.inline_outer("s")).where(
        "contribution IS NOT NULL").select(
        "flow_id", F.when(F.col("contribution") > 0, INTRUSION).otherwise(NORMAL).alias("direction"),
        "category", F.round(ratio(F.abs("contribution"), F.when(
            F.col("contribution") > 0, F.col("_pos")).otherwise(F.col("_neg"))), 6).alias("share"))


def waterfall_data(df: DataFrame, features: list[str], base_value: float, max_display: int = 20) -> DataFrame:
    """Bars of a waterfall per flow: from the margin down to the base value, largest first.

    More than ``max_display`` features: the smallest ones share the last bar.
    """
    n = len(features)
    shown = n if n <= max_display else max_display - 1
    rest = "" if shown == n else (
        f", named_struct('i', {n}, 's', total - t, 'before', t)")
    walk = f"""aggregate(slice(e, 1, {shown}),
        named_struct('t', 0D, 'b', CAST(array() AS ARRAY<STRUCT<i: INT, s: DOUBLE, before: DOUBLE>>)),
        (a, x) -> named_struct('t', a.t + x.s, 'b', concat(a.b, array(named_struct('i', x.i, 's', x.s, 'before', a.t)))))"""
    walked = df.select("flow_id", _by_size(features).alias("e"), total_shap(features).alias("total")).select(
        "flow_id", "total", F.expr(walk).alias("w")).select("flow_id", "total", "w.t", "w.b")
    bars = walked.select("flow_id", "total", F.posexplode_outer(
        F.expr(f"concat(b, array({rest[2:]}))") if rest else F.col("b")).alias("at", "bar_entry"))
    end = F.lit(base_value) + F.col("total") - F.col("bar_entry.before")
    names = features + [f"{n - shown} other features"]
    return bars.select(
        "flow_id", (F.col("at") + 1).alias("bar"), lookup(names, F.col("bar_entry.i")).alias("feature"),
        F.round("bar_entry.s", 6).alias("shap_value"),
        F.round(end - F.col("bar_entry.s"), 6).alias("bar_from"), F.round(end, 6).alias("bar_to"))


def beeswarm_data(df: DataFrame, features: list[str], top: list[str] | None = None) -> DataFrame:
    """(flow, feature, value, shap) rows of the ``top`` features."""
    wanted = top if top is not None else features
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col("x")[i].alias("feature_value"), _shap(i).alias("shap_value"))
        for i, f in enumerate(features) if f in wanted])
    return df.select("flow_id", F.inline(rows))


# --- over flows -------------------------------------------------------------

def _per_feature(df: DataFrame, features: list[str], **aggs) -> DataFrame:
    """Wide aggregate -> one row per feature; each agg maps a shap column to an aggregate."""
    wide = df.agg(*[agg(_shap(i)).alias(f"{name}_{i}") for i in range(len(features)) for name, agg in aggs.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(category_of(f)).alias("category"),
                 *[F.col(f"{name}_{i}").alias(name) for name in aggs])
        for i, f in enumerate(features)])))


def _mean_abs(c: Column) -> Column:
    return F.avg(F.abs(c))


def native_table(spark, importance: dict[str, float]) -> DataFrame:
    return constant_table(spark, sorted(importance.items()), ["feature", "native_importance"])


def feature_importance(df: DataFrame, features: list[str], importance: dict[str, float]) -> DataFrame:
    """Feature, category, mean |shap| and native importance."""
    native = native_table(df.sparkSession, importance)
    return (
        _per_feature(df, features, mean_abs_shap=_mean_abs)
        .join(F.broadcast(native), "feature", "left")
        .select("feature", "category", "mean_abs_shap", "native_importance")
    )


def top_of(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(key), "feature").limit(n)


def importance_rank(importance: DataFrame) -> DataFrame:
    """Rank 1..n over one row per feature."""
    order = W.orderBy(F.desc("mean_abs_shap"), "feature")
    return importance.withColumn("rank", F.row_number().over(order))


def category_importance(importance: DataFrame) -> DataFrame:
    return importance.groupBy("category").agg(
        F.sum("mean_abs_shap").alias("total_shap"),
        F.sum("native_importance").alias("total_native"),
        F.count("feature").alias("feature_count")).orderBy(F.desc("total_shap"), "category")


def category_summary(importance: DataFrame) -> DataFrame:
    s, x = F.col("mean_abs_shap"), F.col("native_importance")
    return importance.groupBy("category").agg(
        F.bround(F.sum(s), 6).alias("mean_abs_shap_sum"), F.bround(F.avg(s), 6).alias("mean_abs_shap_mean"),
        F.count(s).alias("mean_abs_shap_count"), F.bround(F.sum(x), 6).alias("native_importance_sum"),
        F.bround(F.avg(x), 6).alias("native_importance_mean")).orderBy(F.desc("mean_abs_shap_sum"), "category")


def intrusion_importance(df: DataFrame, features: list[str], top: int | None = 25) -> DataFrame:
    rows = _per_feature(df.where(FLAGGED), features, mean_abs_shap=_mean_abs, mean_shap=F.avg).where(F.col("mean_abs_shap").isNotNull())
    return top_of(rows, "mean_abs_shap", top) if top else rows


def intrusion_category(df: DataFrame, features: list[str]) -> DataFrame:
    return intrusion_importance(df, features, None).groupBy("category").agg(
        F.sum("mean_abs_shap").alias("total_impact"), F.count("feature").alias("feature_count"))


def _stats(df: DataFrame, names: list[str], features: list[str]) -> DataFrame:
    """mean, sample deviation, min, max and mean attribution per class and column: one wide
    aggregate, then one row per pair."""
    aggs = []
    for i, c in enumerate(names):
        v = not_nan(F.col(f"`{c}`"))
        mean_shap = F.avg(_shap(features.index(c))) if c in features else F.lit(None).cast("double")
        aggs += [F.avg(v).alias(f"mean_{i}"), F.stddev_samp(v).alias(f"std_{i}"), F.min(v).alias(f"min_{i}"),
                 F.max(v).alias(f"max_{i}"), mean_shap.alias(f"mean_shap_{i}")]
    wide = df.groupBy("predicted_class").agg(*aggs)
    return wide.select("predicted_class", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 *[F.col(f"{n}_{i}").alias(n) for n in ("mean", "std", "min", "max", "mean_shap")])
        for i, c in enumerate(names)])))


def _medians(df: DataFrame, names: list[str], accuracy: int) -> DataFrame:
    long = df.select("predicted_class", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), not_nan(F.col(f"`{c}`")).alias("value")) for c in names])))
    return exact_quantiles(long, ["predicted_class", "feature"], "value", {"median": 0.5}, accuracy)


def _class_stats(df: DataFrame, names: list[str], features: list[str], accuracy: int) -> DataFrame:
    return _stats(df, names, features).join(
        F.broadcast(_medians(df, names, accuracy)), ["predicted_class", "feature"], "left")


def present(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def _mean_shap(df: DataFrame, features: list[str]) -> DataFrame:
    wide = df.groupBy("predicted_class").agg(*[F.avg(_shap(i)).alias(f"m_{i}") for i in range(len(features))])
    return wide.select("predicted_class", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{i}").alias("mean_shap")) for i, f in enumerate(features)])))


def intrusion_feature_stats(
    df: DataFrame, features: list[str], names: list[str] = PROFILE_FEATURES, accuracy: int = 10000,
) -> DataFrame:
    """Value statistics and mean attribution of the key features over flagged flows."""
    hits = df.where(FLAGGED)
    return _class_stats(hits, present(df, names), features, accuracy).select(
        "feature", "mean", "median", "std", "min", "max", "mean_shap")


def _side_by_side(df: DataFrame, value_columns: list[str]) -> DataFrame:
    """Rows per (class, feature) -> one row per feature; none unless both classes occur."""
    aggs = [
        F.max(F.when(F.col("predicted_class") == side, F.col(c))).alias(f"{side}_{c}")
        for side in (INTRUSION, NORMAL) for c in value_columns]
    sides = F.count_distinct("predicted_class")
    return df.groupBy("feature").agg(*aggs, sides.alias("_sides")).where("_sides = 2").drop("_sides")


def class_compare_shap(df: DataFrame, features: list[str], top: int = 20) -> DataFrame:
    """Mean attribution of flagged against normal flows, the most different features first."""
    both = _side_by_side(_mean_shap(df, features), ["mean_shap"])
    cats = constant_table(df.sparkSession, [(f, category_of(f)) for f in features], ["feature", "category"])
    diff = F.col("intrusion_mean_shap") - F.col("normal_mean_shap")
    rows = both.join(F.broadcast(cats), "feature").select(
        "feature", "category", F.col("intrusion_mean_shap").alias("intrusion_shap"),
        F.col("normal_mean_shap").alias("normal_shap"), diff.alias("difference"),
        F.abs(diff).alias("abs_difference"))
    return top_of(rows, "abs_difference", top)


def class_compare_raw(
    df: DataFrame, features: list[str], names: list[str] = COMPARE_FEATURES, accuracy: int = 10000,
) -> DataFrame:
    """Mean, median and mean attribution of the raw key features, flagged against normal."""
    stats = _class_stats(df, present(df, names), features, accuracy)
    both = _side_by_side(stats, ["mean", "median", "mean_shap"])
    return both.select(
        *both.columns,
        (F.col("intrusion_mean") - F.col("normal_mean")).alias("mean_difference"),
        (F.col("intrusion_mean_shap") - F.col("normal_mean_shap")).alias("shap_difference"))


def network_feature_analysis(df: DataFrame, names: list[str], accuracy: int = 10000) -> DataFrame:
    """Mean, median and deviation of every numeric column by class."""
    both = _side_by_side(_class_stats(df, names, [], accuracy), ["mean", "median", "std"])
    cats = constant_table(df.sparkSession, [(f, category_of(f)) for f in names], ["feature", "category"])
    return both.join(F.broadcast(cats), "feature").select(
        *both.columns, "category",
        (F.col("intrusion_mean") - F.col("normal_mean")).alias("mean_difference"))


# --- searches ---------------------------------------------------------------

def top_alerts(df: DataFrame, features: list[str], n: int = 10) -> DataFrame:
    """Highest-probability intrusions with the feature that contributes most."""
    best = df.where(FLAGGED).orderBy(F.desc(PROB), "flow_id").limit(n)
    first = best.select("flow_id", PROB, _by_size(features)[0].alias("e"))
    return first.select(
        "flow_id", PROB, lookup(features, F.col("e.i")).alias("top_feature"), F.round("e.s", 6).alias("top_shap"))


def top_by_feature(df: DataFrame, features: list[str], name: str, n: int = 10) -> DataFrame:
    """Flows on which a feature has the largest attribution."""
    s = _shap(features.index(name))
    return df.select("flow_id", "predicted_class", PROB, s.alias("shap_value")).orderBy(
        F.desc(F.round(F.abs("shap_value"), 12)), "flow_id").limit(n)


def search_range(df: DataFrame, name: str, low: float = 0.0, high: float = 999999.0, n: int = 15) -> DataFrame:
    """Flows with a feature inside ``[low, high]``: the first ``n``, and how many there are."""
    found = df.where(F.col(f"`{name}`").between(low, high))
    total = found.agg(F.count(F.lit(1))).scalar()
    return found.orderBy("flow_id").limit(n).select(
        "flow_id", F.col(f"`{name}`").cast("double").alias("feature_value"), "predicted_class", PROB,
    ).withColumn("total_matches", total)


def _pair_rows(pair: DataFrame, names: list[str]) -> DataFrame:
    """One row with structs ``a`` and ``b`` -> one row per feature."""
    return pair.select(
        F.col("a.flow_id").alias("flow_a"), F.col("b.flow_id").alias("flow_b"),
        F.col("a.predicted_class").alias("class_a"), F.col("b.predicted_class").alias("class_b"),
        F.col(f"a.{PROB}").alias("p_a"), F.col(f"b.{PROB}").alias("p_b"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"a.{c}").cast("double").alias("value_a"),
                     F.col(f"b.{c}").cast("double").alias("value_b")) for c in names])))


def compare_two(df: DataFrame, flow_a: int, flow_b: int, names: list[str] = COMPARE_FEATURES) -> DataFrame:
    """Two flows side by side; nothing if either is missing."""
    cols = present(df, names)
    row = F.struct("flow_id", "predicted_class", PROB, *cols)
    pair = df.where(F.col("flow_id").isin(flow_a, flow_b)).agg(
        F.max(F.when(F.col("flow_id") == flow_a, row)).alias("a"),
        F.max(F.when(F.col("flow_id") == flow_b, row)).alias("b"))
    return _pair_rows(pair.where("a is not null and b is not null"), cols)


def compare_extremes(df: DataFrame, names: list[str] = COMPARE_FEATURES) -> DataFrame:
    """The most and the least suspicious flow side by side."""
    cols = present(df, names)
    row = F.struct("flow_id", "predicted_class", PROB, *cols)
    pair = df.agg(
        F.max_by(row, F.struct(PROB, (-F.col("flow_id")).alias("k"))).alias("a"),
        F.min_by(row, F.struct(PROB, "flow_id")).alias("b"))
    return _pair_rows(pair.where("a is not null"), cols)


def find_anomalies(
    df: DataFrame, names: list[str] = ANOMALY_FEATURES, per_feature: int = 5, n: int = 10, accuracy: int = 10000,
) -> DataFrame:
    """Flows above the 99th percentile of a feature: the first few per feature, united."""
    cols = present(df, names)
    long = df.select("flow_id", "predicted_class", PROB, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), not_nan(F.col(f"`{c}`")).alias("value")) for c in cols])))
    q99 = exact_quantiles(long, ["feature"], "value", {"q99": 0.99}, accuracy)
    high = long.join(F.broadcast(q99), "feature").where(F.col("value") > F.col("q99"))
    # Spark limits each partition to its first rows per feature before the shuffle
    first = F.row_number().over(W.partitionBy("feature").orderBy("flow_id"))
    tops = high.withColumn("_rank", first).where(F.col("_rank") <= per_feature)
    united = tops.select("flow_id", "predicted_class", PROB).distinct()
    return united.orderBy("flow_id").limit(n)


# --- exports and reports ----------------------------------------------------

def xai_export(
    df: DataFrame, features: list[str], threshold: float, columns: list[str], top: list[str] | None = None,
) -> DataFrame:
    """Input columns, prediction, probability, confidence, ``shap_*`` of the top features, total."""
    wanted = top if top is not None else features
    return df.select(
        *columns, F.col("predicted_class").alias("prediction"), F.col(PROB).alias("probability"),
        confidence_band(F.col(PROB), threshold).alias("confidence"),
        *[F.round(_shap(features.index(f)), 6).alias(f"shap_{safe_name(f)}") for f in wanted],
        F.round(total_shap(features), 6).alias("total_shap"))


def top_features(importance: DataFrame, n: int) -> list[str]:
    """Names of the ``n`` most important features (a handful of rows)."""
    return [r["feature"] for r in top_of(importance, "mean_abs_shap", n).collect()]


def run_report(summary: DataFrame, breakdown: DataFrame, importance: DataFrame, threshold: float) -> DataFrame:
    """Report rows: totals and shares, severity counts, threshold, ten top features."""
    totals = summary.select(F.inline(F.array(*[
        F.struct(F.lit("summary").alias("section"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value"))
        for c in ("total_samples", "intrusions", "normals", "intrusion_pct", "normal_pct")])))
    chosen = summary.select(
        F.lit("summary").alias("section"), F.lit("threshold").alias("item"), F.lit(threshold).alias("value"))
    severity = breakdown.select(
        F.lit("severity").alias("section"), F.col("severity_name").alias("item"), F.col("n").cast("double").alias("value"))
    top = top_of(importance, "mean_abs_shap", 10).select(
        F.lit("feature").alias("section"), F.col("feature").alias("item"), F.col("mean_abs_shap").alias("value"))
    return totals.unionByName(chosen).unionByName(severity).unionByName(top)
