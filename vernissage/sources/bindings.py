"""Knowledge-graph answers in the JSON result format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER_SCHEMA = (
    "results struct<bindings: array<struct<"
    "item: struct<value: string>, matLabel: struct<value: string>>>>"
)


def decode_answers(df: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per binding: last path segment of the item URI, and the material label."""
    parsed = df.select(F.from_json(answer, ANSWER_SCHEMA).alias("a"))
    binding = parsed.select(F.explode("a.results.bindings").alias("b"))
    return binding.select(
        uri_key(F.col("b.item.value")).alias("item"), F.col("b.matLabel.value").alias("label")
    )


def uri_key(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)
