"""Pipe-separated categories and single-valued categoricals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.functions.numeric import fill, flag
from vernissage.functions.textual import column_suffix


def category_tokens(df: DataFrame, cat: str = "cat", keep: Sequence[str] = ()) -> DataFrame:
    """One row per non-empty token."""
    parts = df.select(*keep, F.explode(F.split(F.coalesce(F.col(cat), F.lit("")), r"\|")).alias("token"))
    return parts.withColumn("token", F.trim("token")).filter(F.col("token") != "")


def top_tokens(df: DataFrame, cat: str = "cat", limit: int = fixed.TOP_CATEGORY_TOKENS) -> DataFrame:
    """Most frequent tokens; equal counts are ordered by token."""
    return (
        category_tokens(df, cat)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(limit)
    )


def fit_tokens(df: DataFrame, cat: str = "cat", limit: int = fixed.TOP_CATEGORY_TOKENS) -> list[str]:
    """Token list learned on training rows (at most `limit` strings reach the driver)."""
    return [r["token"] for r in top_tokens(df, cat, limit).collect()]


def token_column(token: str) -> str:
    return "catk_" + column_suffix(token)[: fixed.TOKEN_NAME_LENGTH]


def token_columns(tokens: Sequence[str]) -> dict[str, str]:
    """Column name -> token. On equal names the later token wins; names that differ in case only get a number."""
    named = {token_column(t): t for t in tokens}
    out: dict[str, str] = {}
    taken = set()
    for name, token in named.items():
        free, n = name, 1
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out[free] = token
    return out


def token_flags(tokens: Sequence[str], cat: str = "cat") -> list[Column]:
    """Substring test of each token in the raw field."""
    text = F.coalesce(F.col(cat), F.lit(""))
    return [flag(F.contains(text, F.lit(t))).alias(n) for n, t in token_columns(tokens).items()]


def class_flags(field: str = "classification", names: Sequence[str] = fixed.CLASSIFICATIONS) -> list[Column]:
    return [flag(F.col(field) == n).alias(f"cls_is_{n}") for n in names]


def filled_categories(fields: Sequence[str]) -> list[Column]:
    return [fill(F.col(f).cast("string"), fixed.MISSING_CATEGORY).alias(f) for f in fields]
