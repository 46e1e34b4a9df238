"""Exact positions in a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.session import land

ROWS_PER_BUCKET = 1_000_000


def position_within(df: DataFrame, order: str | Column | Sequence[str | Column], by: Sequence[str] = (), bucket: str = "_bucket") -> DataFrame:
    """Zero-based `position` of each row in `order`, over all rows or inside each `by` group.

    `bucket` must grow with the order. Rows are ranked inside a bucket only; the
    rows of the earlier buckets come in as one offset per bucket, so neither a
    large group nor the whole table meets in one task. Null `by` values are a
    group of their own.
    """
    order = [order] if isinstance(order, (str, Column)) else list(order)
    keys = [*by, bucket]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return (
        ranked.join(offsets, same)
        .withColumn("position", F.col("_before") + F.col("_rank") - 1)
        .drop("_rank", "_before", *[f"_key{i}" for i in range(len(keys))], bucket)
    )


def range_buckets(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET, bucket: str = "_bucket") -> DataFrame:
    """Rows dealt into ranges of `key`, null keys last; any type and distribution of keys is fine.

    The ranges come from Spark's own sampling and are fixed by writing the rows
    once. Rows with equal or null keys are told apart by a hash, so they do not
    meet in one range. `rows_per_bucket` sets how many ranges there are, at
    least as many as shuffle partitions, and never what a position is.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(partitions, -(-df.count() // rows_per_bucket))
    ranged = df.repartitionByRange(wanted, *key_order(key), F.xxhash64(*df.columns))
    return land(ranged.withColumn(bucket, F.spark_partition_id()), "ranges")


def key_order(key: str) -> list[Column]:
    return [F.col(key).isNull(), F.col(key)]


def every_kth(df: DataFrame, k: int, key: str = "id", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Systematic sample: the 1st, (k+1)th, ... row in key order, null keys last."""
    ranked = position_within(range_buckets(df, key, rows_per_bucket), [*key_order(key), F.xxhash64(*df.columns)])
    return ranked.filter(F.col("position") % k == 0).drop("position")


def seeded_digest(key: str | Column, seed: int) -> Column:
    value = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(value.cast("string"), F.lit(f"-{seed}")))


def digest_digits(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Leading hex digits that cut `rows` digests into even buckets of about that size, at least 256 buckets."""
    digits = 2
    while 16**digits * rows_per_bucket < rows:
        digits += 1
    return digits


def digest_bucket(digest: str, hex_digits: int) -> Column:
    """Leading hex digits of a digest: 16**hex_digits even buckets in digest order."""
    return F.substring(digest, 1, hex_digits)
