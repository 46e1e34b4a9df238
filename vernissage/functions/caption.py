"""The weak label: the medium a caption names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.functions.numeric import col, flag


def caption_medium(cap: str | Column = "cap", pattern: str = fixed.CAPTION_PATTERN) -> Column:
    """First medium named by the caption, trimmed and lower-cased; null without a match."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(col(cap), pattern, 1))), F.lit(""))


def label_code(name: Column, labels: Sequence[str] = fixed.MEDIA) -> Column:
    """Position of a name in the label dictionary; null when it is not listed."""
    at = F.array_position(F.array(*[F.lit(v) for v in labels]), name)
    return F.when(at > 0, (at - 1).cast("int"))


def label_code_or_minus_one(name: Column, labels: Sequence[str] = fixed.MEDIA) -> Column:
    return F.coalesce(label_code(name, labels), F.lit(-1))


def label_name(code: Column, labels: Sequence[str] = fixed.MEDIA) -> Column:
    """Inverse dictionary; null for codes outside it."""
    return F.when(
        (code >= 0) & (code < len(labels)),
        F.try_element_at(F.array(*[F.lit(v) for v in labels]), (code + 1).cast("int")),
    )


def label_flags(name: Column, labels: Sequence[str] = fixed.MEDIA, prefix: str = "cap_is_") -> list[Column]:
    return [flag(name == v).alias(prefix + v.replace(" ", "_")) for v in labels]
