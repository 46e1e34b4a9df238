"""All scalar record features in one projection, and the fitted token list behind it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.functions import caption, category, fixed, physical, temporal, textual


@dataclass(frozen=True)
class RecordFeatures:
    """Feature projection with its learned category tokens.

    Learn on training rows with `fit`, then `apply` to any rows: `apply` is a
    single select without a shuffle, so it also runs on a stream.
    """

    tokens: tuple[str, ...]

    @classmethod
    def fit(cls, train: DataFrame, limit: int = fixed.TOP_CATEGORY_TOKENS) -> RecordFeatures:
        return cls(tuple(category.fit_tokens(train, limit=limit)))

    def columns(self, with_first_version: bool = False) -> list[Column]:
        medium = caption.caption_medium()
        text = textual.joined_text()
        plain_text_fields = [f for f in fixed.TEXT_FIELDS if f not in fixed.RARE_FIELDS]
        return [
            medium.alias("cap_med"),
            caption.label_code_or_minus_one(medium).alias("cap_y_int"),
            *caption.label_flags(medium),
            *temporal.year_columns(),
            *temporal.era_flags(),
            temporal.anachronism(medium).alias("anachronism_acrylic"),
            *physical.dimension_vocabulary(),
            *physical.dimension_numbers(),
            *physical.pixel_size(with_area=with_first_version),
            *physical.accession_parts(),
            *textual.presence_flags(plain_text_fields),
            *textual.keyword_flags(text),
            *textual.rare_presence(),
            *category.token_flags(self.tokens),
            *category.class_flags(),
            *category.filled_categories([*fixed.CATEGORY_FIELDS, "attribution"]),
            *textual.assistive_flags(),
            text.alias("_concat_text"),
        ]

    def apply(self, df: DataFrame, keep: Sequence[str] = ("id", "y", "split"), with_first_version: bool = False) -> DataFrame:
        return df.select(*[F.col(c) for c in keep], *self.columns(with_first_version))


def feature_columns(columns: Sequence[str], keep_back: Sequence[str] = (), drop: Sequence[str] = fixed.NOT_FEATURES) -> list[str]:
    """Drop-list projection; kept-back names are appended once, in order."""
    dropped = set(drop)
    return list(dict.fromkeys([*[c for c in columns if c not in dropped], *keep_back]))
