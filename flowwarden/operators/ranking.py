"""Running totals and exact quantiles that never sort a whole table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stored

FANOUT = 1024


def running_totals(
    df: DataFrame, key: str, sums: list[str], by: list[str] | None = None, fanout: int = FANOUT, levels: int = 1,
) -> DataFrame:
    """For rows with a distinct integer ``key`` (per ``by``), add ``{s}_before`` and ``{s}_upto``.

    Keys are cut into blocks of ``fanout``; a window sorts one block at a time, and block
    totals (``fanout`` times fewer rows) give the offsets, themselves by the same rule when
    ``levels`` > 1.
    """
    by = by or []
    block = f"_blk{levels}"
    cut = df.withColumn(block, F.call_function("div", F.col(key).cast("bigint"), F.lit(fanout)).cast("bigint"))
    totals = cut.groupBy(*by, block).agg(*[F.sum(s).alias(s) for s in sums])
    if levels > 1:
        offsets = running_totals(totals, block, sums, by, fanout, levels - 1)
    else:
        w = W.partitionBy(*by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
        offsets = totals.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums})
    offsets = offsets.select(*by, block, *[F.col(f"{s}_before").alias(f"_off_{s}") for s in sums])
    inner = W.partitionBy(*by, block).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        cut.join(offsets, [*by, block])
        .withColumns({f"{s}_upto": F.col(f"_off_{s}") + F.sum(s).over(inner) for s in sums})
        .withColumns({f"{s}_before": F.col(f"{s}_upto") - F.col(s) for s in sums})
        .drop(block, *[f"_off_{s}" for s in sums])
    )


#: About so many rows the last window of a quantile sorts at most.
SORTED = 1 << 16


def _on(by: list[str]):
    return [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by] or F.lit(True)


def _narrowed(data: DataFrame, targets: DataFrame, by: list[str], accuracy: int, steps: int) -> DataFrame:
    """Brackets about ``steps`` / 3 times narrower around the wanted ranks: a sketch of what lies inside each.

    The sketch is off by 1 / ``accuracy`` of the ranks at most, less than a step, and a bracket
    takes a whole step more on either side.
    """
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    inside = (v >= lo) & (v <= hi)
    found = data.alias("d").join(F.broadcast(targets.alias("t")), _on(by)).groupBy(
        *[F.col(f"t.{c}").alias(c) for c in by], "_q", "_at").agg(
        F.count_if(v < lo).alias("_under"), F.count_if(inside).alias("_within"),
        F.percentile_approx(F.when(inside, v), [i / steps for i in range(steps + 1)], accuracy).alias("_cuts"))
    step = F.floor((F.col("_at") - F.col("_under")) * steps / F.greatest(F.col("_within") - 1, F.lit(1))).cast("int")
    return found.select(
        *by, "_q", "_at", F.get("_cuts", F.greatest(step - 1, F.lit(0))).alias("_lo"), F.get("_cuts", F.least(step + 2, F.lit(steps))).alias("_hi"))


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], accuracy: int = 10000, limit: int = SORTED,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group; nulls are skipped.

    ``percentile`` keeps every distinct value of a group in one task. Here mergeable sketches
    narrow each wanted rank down, as often as the largest group needs, until a bracket
    holds some ``limit`` rows; the last pass counts what lies outside and sorts the distinct
    values inside. The groups must be few (features x classes). Groups and values are
    written once, so that no pass repeats the work before them.
    """
    names = list(quantiles)
    data = stored(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")))
    groups = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(n).alias("_q"), F.lit(quantiles[n]).alias("_p")) for n in names])
    targets = groups.where("_n > 0").select(*by, "_n", "_lo", "_hi", F.inline(wanted)).select(
        *by, "_q", (F.col("_p") * (F.col("_n") - 1)).alias("_at"), "_lo", "_hi")
    rows, steps = groups.agg(F.max("_n")).first()[0] or 0, max(accuracy // 10, 8)       # of the largest group
    while rows > limit:
        targets, rows = _narrowed(data, targets, by, accuracy, steps), rows * 4 // steps
    tagged = data.alias("d").join(F.broadcast(targets.alias("t")), _on(by)).select(
        *[F.col(f"t.{c}").alias(c) for c in by], "_q", "_at", "_v",
        F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0).alias("_side"))
    inside = F.when(F.col("_side") == 0, F.col("_v"))
    steps = tagged.withColumn("_in", inside).groupBy(*by, "_q", "_at", "_side", "_in").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    w = W.partitionBy(*by, "_q").orderBy("_side", "_in")
    upto = F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = steps.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))

    def at(rank):
        # below the bracket only its largest value is known, above it only the smallest
        known = (
            F.when(F.col("_side") == 0, F.col("_in"))
            .when((F.col("_side") == -1) & (rank == F.col("_upto")), F.col("_max"))
            .when((F.col("_side") == 1) & (rank == F.col("_before") + 1), F.col("_min")))
        return F.max(F.when((rank > F.col("_before")) & (rank <= F.col("_upto")), known))

    low = F.floor("_at") + 1
    picked = placed.groupBy(*by, "_q", "_at").agg(at(low).alias("_a"), at(F.ceil("_at") + 1).alias("_b"))
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    return picked.withColumn("_x", value_at).groupBy(*by).agg(
        *[F.max(F.when(F.col("_q") == n, F.col("_x"))).alias(n) for n in names])
