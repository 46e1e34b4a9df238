"""Shared column expressions on document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the six ASCII white-space characters that separate words.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_spaces(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def fixed_partitions(df: DataFrame, *keys, at_least: int = 1) -> DataFrame:
    """Hash partitioning that adaptive execution does not coalesce, for rows that cost Python time."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, at_least), *keys)
