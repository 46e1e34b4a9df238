"""Years, eras and the anachronism flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.functions.numeric import col, flag


def year_columns(y0: str = "y0", y1: str = "y1") -> list[Column]:
    a, b = F.col(y0).cast("double"), F.col(y1).cast("double")
    return [
        a.alias("y0_f"),
        b.alias("y1_f"),
        ((a + b) / 2).alias("year_mid"),
        (b - a).alias("year_span"),
        F.coalesce(F.floor(a / 100).cast("int"), F.lit(-1)).alias("century"),
    ]


def era_flags(y0: str = "y0", eras=fixed.ERAS) -> list[Column]:
    year = F.col(y0).cast("double")
    out = []
    for name, low, high in eras:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (year >= low)
        if high is not None:
            inside = inside & (year < high)
        out.append(flag(inside).alias(name))
    return out


def anachronism(medium: Column, y0: str | Column = "y0", name: str = "acrylic", year: int = fixed.ACRYLIC_FROM) -> Column:
    return flag((medium == name) & (col(y0).cast("double") < year))
