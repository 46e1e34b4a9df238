"""Record tables, side tables and prediction arrays."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage.functions import fixed
from vernissage.functions.numeric import nan_as_null, to_number
from vernissage.sources.quoted import read_quoted


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Column names -> files that have them, for every CSV file of a path; reads the first split of each file."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"),
    ).filter("_metadata.file_block_start = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").toLocalIterator():
        names = tuple(next(csv.reader([row["header"].rstrip("\r")])))
        found.setdefault(names, []).append(row["file"])
    return found


def typed(value: Column, kind: T.DataType) -> Column:
    """Text as a value of a type; numbers must be written as plain numbers, and whole ones may end in `.0`."""
    if isinstance(kind, T.StringType):
        return value
    if not isinstance(kind, T.NumericType):
        return value.try_cast(kind)
    number = to_number(value)
    if not isinstance(kind, T.IntegralType):
        return number.try_cast(kind)
    plain = value.rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(plain, F.trim(value).try_cast(kind)).when(number % 1 == 0, number.try_cast(kind))


def read_records(spark: SparkSession, path: str, schema: T.StructType, null_tokens: Sequence[str] = fixed.NULL_TOKENS) -> DataFrame:
    """CSV scan with an explicit schema.

    Quoted fields may hold line breaks and doubled quotes; CRLF inside a field
    is kept. Files may have their columns in any order, but each must have
    exactly the columns of the schema. A file is read by as many tasks as it has
    splits, in two passes, so land the result as Parquet when it is read more than once.
    """
    orders = headers(spark, path)
    if not orders:
        raise ValueError(f"no header in {path}")
    for names in orders:
        if sorted(names) != sorted(schema.names):
            raise ValueError(f"CSV columns {list(names)} differ from the schema {schema.names}")
    parts = [_read_in_order(spark, path if len(orders) == 1 else files, names, schema, null_tokens) for names, files in orders.items()]
    return nan_as_null(reduce(DataFrame.unionByName, parts))


def _read_in_order(spark: SparkSession, path: str | list[str], names: tuple[str, ...], schema: T.StructType, null_tokens: Sequence[str]) -> DataFrame:
    form = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"quote": '"', "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    parsed = read_quoted(spark, path).select(F.from_csv("value", form, options).alias("r"))
    raw = parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])

    def field(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        return typed(F.when(~value.isin(*null_tokens), value), f.dataType).alias(f.name)

    return raw.select(*[field(f) for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_side_table(spark: SparkSession, path: str) -> DataFrame:
    return nan_as_null(spark.read.parquet(path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Probability arrays keyed by id, one Parquet row per record."""
    if not isinstance(df.schema["probs"].dataType, T.ArrayType):
        raise TypeError("probs must be an array column")
    df.write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
