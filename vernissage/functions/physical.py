"""Dimension text, image size and accession number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.functions.numeric import flag, to_number


def dimension_vocabulary(dim: str = "dim", terms=fixed.DIMENSION_TERMS) -> list[Column]:
    text = F.coalesce(F.col(dim), F.lit(""))
    flags = [flag(F.contains(F.lower(text), F.lit(t))).alias(n) for n, t in terms]
    lines = (F.regexp_count(text, F.lit("\r\n")) + 1).cast("int").alias("n_dim_lines")
    return [*flags, lines]


def _side(dim: str, group: int) -> Column:
    text = F.nullif(F.regexp_extract(F.col(dim), fixed.DIMENSION_PATTERN, group), F.lit(""))
    return text.try_cast("double")


def dimension_numbers(dim: str = "dim") -> list[Column]:
    width, height = _side(dim, 1), _side(dim, 2)
    area = width * height
    return [
        width.alias("dim_w_cm"),
        height.alias("dim_h_cm"),
        F.try_divide(width, height).alias("dim_aspect"),
        area.alias("dim_area"),
        flag(area < fixed.TINY_AREA_CM2).alias("is_tiny"),
        flag(area > fixed.HUGE_AREA_CM2).alias("is_huge"),
    ]


def pixel_size(width: str = "width", height: str = "height", with_area: bool = False) -> list[Column]:
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    area = [(w * h).alias("px_area")] if with_area else []
    return [F.try_divide(w, h).alias("px_aspect"), *area, F.log1p(w * h).alias("log_px_area")]


def accession_parts(acc: str = "acc_id", with_text: bool = False) -> list[Column]:
    head = F.substring(F.coalesce(F.col(acc), F.lit("")), 1, 4)
    text = [head.alias("acc_year")] if with_text else []
    gift = F.try_element_at(F.split(F.col(acc), "[.]"), F.lit(2))
    return [*text, to_number(head).alias("acc_year_n"), to_number(gift).alias("acc_gift_num")]
