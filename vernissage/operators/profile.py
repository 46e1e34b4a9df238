"""Counts, null profiles, pivots and quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.operators.ranking import ROWS_PER_BUCKET, range_buckets


def top_k(df: DataFrame, order: str, k: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(order), tie).limit(k)


def prefix(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(n)


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def cross_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Two-way count table over a fixed value list, empty cells 0."""
    cells = [F.count_if(F.col(column) == v).alias(f"n_{v}".replace(" ", "_")) for v in values]
    return df.groupBy(row).agg(*cells)


def group_mean(df: DataFrame, group: str, value: str, digits: int, name: str) -> DataFrame:
    mean = F.sum(F.col(value).cast("double")) / F.count(value)
    return df.groupBy(group).agg(F.round(mean, digits).alias(name))


def null_profile(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Null percentage per column, highest first; one pass whatever the number of columns."""
    rates = df.agg(
        *[(F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1))).alias(c) for c in columns]
    )
    long = rates.unpivot([], list(columns), "column_name", "null_pct")
    long = long.orderBy(F.desc("null_pct"), "column_name")
    return long if top is None else long.limit(top)


def null_mask(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    return df.select(key, *[F.col(c).isNull().cast("int").alias(f"{c}_null") for c in columns])


def rows_with_any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count_if(missing).alias("n_any_null"), F.count(F.lit(1)).alias("n_rows"))


def share(predicate: Column) -> Column:
    """Mean of a predicate, unknown counted as false; whole counts, one division."""
    return F.count_if(predicate) / F.count(F.lit(1))


def quantiles_by_group(
    df: DataFrame, group: str, value: str, points: Sequence[float], names: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact interpolated quantiles per group; any column, any number of distinct values, any size of a group.

    Equal values are counted first. The counted values are dealt into ranges, whose
    totals say which of them hold a wanted rank; only in these, at most two per group
    and point, are values put in order. No group comes together in one task.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranged = range_buckets(counted, "_v", rows_per_bucket)
    whole = Window.partitionBy("_g")
    sizes = ranged.groupBy("_g", "_bucket").agg(F.sum("_n").alias("_in"))
    placed = sizes.select(
        F.col("_g").alias("_h"), F.col("_bucket").alias("_b"), "_in",
        F.sum("_in").over(whole).alias("_total"),
        (F.sum("_in").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).alias("_before"),
    )
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in points]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in at])))
    wanted = placed.select("*", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in"))).alias("_ranks")).filter("size(_ranks) > 0")
    inside = Window.partitionBy("_h", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = ranged.join(wanted, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_bucket") == F.col("_b"))).withColumn(
        "_to", F.col("_before") + F.sum("_n").over(inside)
    )
    hit = F.filter("_ranks", lambda r: (r >= F.col("_to") - F.col("_n")) & (r < F.col("_to")))
    found = ordered.select("_h", "_total", "_v", F.explode(hit).alias("_rank"))
    known = found.groupBy("_h", "_total").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def interpolated(h: Column) -> Column:
        low, high = F.col("_at")[F.floor(h)], F.col("_at")[F.ceil(h)]
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return known.select(F.col("_h").alias(group), *[interpolated(h).alias(n) for h, n in zip(at, names, strict=True)])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")
    )
