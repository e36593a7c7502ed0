"""Cleaning, labels, encoding, scaling and splitting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..fixed_values import (
    BOOSTING, DIFFICULTY_COLUMN, LABEL_COLUMN, NORMAL_LABEL, SPLIT_SEED, TEST_FRACTION,
)
from ..functions.values import ratio
from ..schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..session import stored

HASH_BUCKETS = 1 << 20


def clean_flows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Drop equal rows (difficulty included), then the difficulty, then rows with nulls.

    With a ``key`` column, rows are equal when all others are, and the smallest key stays.
    """
    if key is None:
        unique = df.dropDuplicates()
    else:
        unique = df.groupBy(*[f"`{c}`" for c in df.columns if c != key]).agg(F.min(key).alias(key))
    return unique.drop(DIFFICULTY_COLUMN).na.drop("any")


def label_flows(df: DataFrame) -> DataFrame:
    """``y`` = 1 unless the class is normal; a missing class counts as an attack."""
    return df.withColumn("y", (~F.col(LABEL_COLUMN).eqNullSafe(NORMAL_LABEL)).cast("int"))


def split_by_type(df: DataFrame, skip: tuple = (LABEL_COLUMN, DIFFICULTY_COLUMN, "flow_id")) -> tuple[list, list]:
    """Names of the numeric and of the text columns, in table order."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def missing_features(df: DataFrame, expected: list[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def conform_flows(
    df: DataFrame,
    numeric: list[str] = NUMERIC_FEATURES,
    categorical: list[str] = CATEGORICAL_FEATURES,
    keep: tuple = ("flow_id",),
) -> DataFrame:
    """Exactly the expected features in the expected order; absent ones get 0.0 or ''."""
    absent = set(missing_features(df, [*numeric, *categorical]))
    cols = [F.col(c) for c in keep if c in df.columns]
    cols += [F.lit(0.0).alias(c) if c in absent else F.col(f"`{c}`").cast("double").alias(c) for c in numeric]
    cols += [F.lit("").alias(c) if c in absent else F.col(f"`{c}`") for c in categorical]
    return df.select(*cols)


def category_vocab(df: DataFrame, categorical: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Distinct values of each text column with their sorted position.

    One pass: each row gives its few (column, value) pairs, map-side combined.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in categorical
    ])).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    order = W.partitionBy("column").orderBy("value")
    return pairs.withColumn("position", F.row_number().over(order))


def collect_vocab(df: DataFrame, categorical: list[str] = CATEGORICAL_FEATURES, limit: int = 5000) -> dict:
    """The vocabulary as plan-time lists. Each entry becomes a column, so a text column of more values than a table
    has columns is refused rather than cut short; ``vocab_index`` and ``one_hot_sparse`` encode any number."""
    rows = category_vocab(df, categorical).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} category values; encode them by vocab_index and one_hot_sparse")
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in categorical}


def vocab_index(df: DataFrame, categorical: list[str] = CATEGORICAL_FEATURES, first: int = 0) -> DataFrame:
    """Distinct values of each text column with their place in the encoded vector, from ``first`` on.

    Columns in the given order, values sorted, as ``encoded_names`` has them. Values are sorted in ranges and never
    gathered: the driver gets one count for each range.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(c).alias("value")) for i, c in enumerate(categorical)
    ])).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    ranges = stored(pairs.orderBy("place", "value").withColumns({
        "part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = first, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "part int, before bigint")
    return ranges.join(F.broadcast(offsets), "part").select(
        "column", "value", (F.col("before") + F.col("at")).cast("int").alias("index"))


def one_hot_sparse(df: DataFrame, index: DataFrame, numeric: list[str], keep: tuple = ("flow_id",)) -> DataFrame:
    """``indices`` and ``values`` of each row's encoded vector: all numeric columns, then 1 at each known category value.

    ``index`` is that of ``vocab_index`` with ``first=len(numeric)``. It stays a table: Spark broadcasts it while it is
    small and else joins by value, splitting common values where adaptive execution is on. Values outside the
    vocabulary, and nulls, have no place; a null number stays null.
    """
    columns = sorted({r["column"] for r in index.select("column").distinct().collect()}, key=df.columns.index)
    found, places = df, []
    for c in columns:
        mine = index.where(F.col("column") == c).select(F.col("value").alias(c), F.col("index").alias(f"_at_{c}"))
        found = found.join(mine, c, "left")
        places.append(F.col(f"_at_{c}"))
    known = F.sort_array(F.array_compact(F.array(*places))) if places else F.array().cast("array<int>")
    numbers = F.array(*[F.col(f"`{c}`").cast("double") for c in numeric])
    return found.select(
        *[c for c in keep if c in df.columns],
        F.concat(F.array(*[F.lit(i) for i in range(len(numeric))]), known).alias("indices"),
        F.concat(numbers, F.transform(known, lambda _: F.lit(1.0))).alias("values"))


def encoded_names(vocab: dict, numeric: list[str]) -> list[str]:
    return list(numeric) + [f"{c}_{v}" for c, values in vocab.items() for v in values]


def one_hot(df: DataFrame, vocab: dict, numeric: list[str], keep: tuple = ("flow_id",)) -> DataFrame:
    """Numeric columns, then a 0/1 column per known category value.

    Values outside the vocabulary give zeros everywhere, and every vocabulary entry has
    its column even when absent from the data, so the result is aligned by construction.
    """
    dummies = [
        F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, values in vocab.items() for v in values
    ]
    return df.select(
        *[c for c in keep if c in df.columns],
        *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric], *dummies)


def scaler_stats(train: DataFrame, numeric: list[str]) -> DataFrame:
    """Mean and population deviation per numeric column; one wide aggregate, then one row each.

    Values and squares are summed as decimals of nine places, so the result does not depend on the order in which
    partitions are added. Sums beyond 29 digits fall back to floating ones.
    """
    def aggregates(c: str):
        x = F.col(f"`{c}`").cast("double")
        n = F.count(x)
        total, squares = (F.try_sum(F.expr(f"try_cast({e} AS DECIMAL(28, 9))")).cast("double") for e in (
            f"CAST(`{c}` AS DOUBLE)", f"CAST(`{c}` AS DOUBLE) * CAST(`{c}` AS DOUBLE)"))
        spread = F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)))
        return F.coalesce(total / n, F.avg(x)).alias(f"m_{c}"), F.coalesce(spread, F.stddev_pop(x)).alias(f"s_{c}")

    wide = train.agg(*[a for c in numeric for a in aggregates(c)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"))
        for c in numeric
    ])))


def collect_scaler(train: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float]]:
    """Scaler as plan-time constants: one row per numeric feature."""
    return {r["feature"]: (r["mean"], r["std"]) for r in scaler_stats(train, numeric).collect()}


def scaled(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std == 0, 1.0).otherwise(std)


def scale_flows(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise the numeric columns; a constant column is only centred."""
    return df.withColumns({
        c: scaled(F.col(f"`{c}`").cast("double"), F.lit(m), F.lit(s)) for c, (m, s) in scaler.items()})


def class_weights(df: DataFrame, positive: float = BOOSTING["scale_pos_weight"]) -> DataFrame:
    return df.withColumn("w", F.when(F.col("y") == 1, positive).otherwise(1.0))


def bounded_parts(df: DataFrame, most: int) -> DataFrame:
    """``df`` in partitions of at most about ``most`` rows, dealt out in turn so that no key gathers rows.

    A table whose partitions are all small enough is left where it is. The driver gets one count for each partition.
    """
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    return df if max(sizes, default=0) <= most else df.repartition(math.ceil(sum(sizes) / most))


def split_hash(seed: int = SPLIT_SEED, key: str = "flow_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


#: Hash digits that one pass of the split's selection counts by: at most 16^3 counts a class.
DIGITS = 3
#: About so many hashes the last step of the selection sorts at most in a class.
SORTED_HASHES = 1 << 16


def split_quotas(sizes: dict, fraction: float) -> dict:
    """Test rows of each class: ceil(fraction*n) in all, left-over seats to the largest remainders."""
    n_all = sum(sizes.values())
    seats = math.ceil(fraction * n_all)
    shares = {c: seats * n / n_all for c, n in sizes.items()}
    quotas = {c: math.floor(x) for c, x in shares.items()}
    by_rest = sorted(sizes, key=lambda c: (quotas[c] - shares[c], c is not None, c))
    for c in by_rest[:seats - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def split_cuts(keyed: DataFrame, fraction: float, label: str, sorted_hashes: int = SORTED_HASHES) -> dict:
    """The last hash of each class that belongs to the test part, by radix selection on ``_h``.

    A pass counts by the next digits inside the bucket in which each class's quota ends, so the driver gets some
    thousand counts a class whatever the table; few rows are left for a sort.
    """
    def buckets(inside: DataFrame, digits: int) -> dict:
        found: dict = {}
        for c, bucket, n in inside.groupBy(label, F.left("_h", F.lit(digits))).agg(F.count(F.lit(1))).collect():
            found.setdefault(c, []).append((bucket, n))
        return found

    counts, digits, cuts, edges = buckets(keyed, DIGITS), DIGITS, {}, {}
    seats = split_quotas({c: sum(n for _, n in found) for c, found in counts.items()}, fraction)
    open_ = {c for c in counts if c is not None and seats[c]}
    while open_:
        for c in open_:
            for edge, n in sorted(x for x in counts[c] if x[0] is not None):
                if n >= seats[c]:
                    break
                seats[c] -= n
            else:                                             # fewer keys than seats: all of them
                cuts[c] = "g"
                continue
            if digits >= 32:
                cuts[c] = edge                                # one key's rows, never parted
            else:
                edges[c] = (edge, n)
        open_ -= set(cuts)
        inside = F.lit(False)
        for c in open_:
            inside |= (F.col(label) == F.lit(c)) & F.col("_h").startswith(edges[c][0])
        small = {c for c in open_ if edges[c][1] <= sorted_hashes}
        if small == open_:
            break
        digits = min(digits + DIGITS, 32)
        counts = buckets(keyed.where(inside), digits)
    if open_:
        at = F.row_number().over(W.partitionBy(label).orderBy("_h"))
        wanted = F.lit(False)
        for c in open_:
            wanted |= (F.col(label) == F.lit(c)) & (F.col("_at") == seats[c])
        cuts |= {r[label]: r["_h"] for r in keyed.where(inside).select(label, "_h").withColumn("_at", at).where(wanted).collect()}
    return cuts


def stratified_split(
    df: DataFrame, fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED, key: str = "flow_id", label: str = "y",
) -> DataFrame:
    """Add ``is_test``: exactly ceil(fraction*n) rows, spread over the few classes in proportion.

    Rows are ordered by a seeded hash of the key, so the split does not depend on
    partitioning. The hash in which each class's quota ends is selected beforehand from counts by its digits;
    the result itself is one comparison in the row and moves nothing. Rows that share a
    key are not parted, so copies may exceed the quota; rows without a key or label are never test rows.
    """
    keyed = df.withColumn("_h", split_hash(seed, key))
    cuts = split_cuts(keyed.select(label, "_h"), fraction, label)
    is_test = F.lit(False)
    for c, cut in sorted(cuts.items()):
        is_test |= (F.col(label) == F.lit(c)) & (F.col("_h") <= cut)
    return keyed.withColumn("is_test", F.coalesce(is_test, F.lit(False))).drop("_h")
