"""Tables around a remote fetch: what is pending, how it went, and its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators.ranking import ROWS_PER_BUCKET, key_order, position_within, range_buckets


def pending(ids: DataFrame, attempts: DataFrame, key: str = "id", ok: str = "ok") -> DataFrame:
    """Ids without a successful attempt yet."""
    done = attempts.filter(F.col(ok)).select(key)
    return ids.join(done, key, "left_anti")


def outcome_summary(attempts: DataFrame, ok: str = "ok") -> DataFrame:
    return attempts.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col(ok)).alias("n_ok")
    )


def batches(ids: DataFrame, key: str = "id", size: int = fixed.LOOKUP_BATCH, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Consecutive batches of `size` ids in id order; rows without an id fill the last batches."""
    ranked = position_within(range_buckets(ids, key, rows_per_bucket), [*key_order(key), F.xxhash64(*ids.columns)])
    return ranked.withColumn("batch", F.floor(F.col("position") / size).cast("bigint"))
