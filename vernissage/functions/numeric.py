"""Number coercion and null handling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage.functions import fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Text to double; text that is not a plain number becomes null."""
    text = col(c).cast("string")
    return F.when(text.rlike(fixed.NUMBER_PATTERN), F.trim(text).try_cast("double"))


def flag(predicate: Column) -> Column:
    """0/1 integer; an unknown predicate counts as 0."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def present(c: str | Column) -> Column:
    return col(c).isNotNull().cast("int")


def nan_as_null(df: DataFrame) -> DataFrame:
    """Floating NaN sorts above every number in Spark, so it is turned into null at load."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def fill(c: str | Column, value) -> Column:
    return F.coalesce(col(c), F.lit(value))


def fill_numeric(columns: Sequence[str], value: float) -> list[Column]:
    return [fill(F.col(c).cast("double"), float(value)).alias(c) for c in columns]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, also where `use` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled(v: Column, divisor: Callable[[Column], Column]) -> Column:
    """Array divided by a number that is computed from the whole array."""
    return once(v, lambda a: once(divisor(a), lambda d: F.transform(a, lambda x: x / d)))


def length_of(v: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
