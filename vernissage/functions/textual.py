"""Presence flags, joined text, keyword flags."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.functions.numeric import flag, present


def column_suffix(term: str) -> str:
    """Term as a column-name part: each run of non-word characters becomes one underscore."""
    return re.sub(r"\W+", "_", term)


def presence_flags(fields: Sequence[str]) -> list[Column]:
    return [present(f).alias(f"has_{f}") for f in fields]


def rare_presence(fields: Sequence[str] = fixed.RARE_FIELDS) -> list[Column]:
    total = sum((present(f) for f in fields), F.lit(0))
    return [*presence_flags(fields), total.cast("int").alias("n_rare_fields_present")]


def joined_text(fields: Sequence[str] = fixed.TEXT_FIELDS) -> Column:
    """All text fields in one lower-case string; an empty field still takes its separator."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def keyword_flags(text: Column, terms: Sequence[str] = fixed.KEYWORDS) -> list[Column]:
    return [flag(F.contains(text, F.lit(t))).alias("kw_" + column_suffix(t)) for t in terms]


def assistive_flags(field: str = "assistivetext") -> list[Column]:
    text = F.lower(F.coalesce(F.col(field), F.lit("")))
    return [
        *[flag(F.contains(text, F.lit(w))).alias(f"at_{w}") for w in ("painting", "drawing", "etching")],
        flag(text.rlike(r"(?U)\bink\b")).alias("at_ink"),
    ]
