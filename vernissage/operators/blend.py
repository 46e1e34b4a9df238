"""Blending of probability arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.functions import fixed


def average_probabilities(predictions: DataFrame, key: str = "id", probs: str = "probs", n_classes: int = fixed.N_CLASSES) -> DataFrame:
    """Mean probability per class over all arrays of a record (seeds, folds)."""
    means = [F.avg(F.col(probs)[k]).alias(f"_p{k}") for k in range(n_classes)]
    return predictions.groupBy(key).agg(*means).select(
        key, F.array(*[f"_p{k}" for k in range(n_classes)]).alias(probs)
    )


def predicted_class(probs: str | Column = "probs") -> Column:
    """Index of the highest probability, the first one on a tie."""
    p = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(probs: str | Column = "probs") -> Column:
    return F.array_max(probs)


def decide(blended: DataFrame, key: str = "id", probs: str = "probs") -> DataFrame:
    return blended.select(key, predicted_class(probs).alias("pred"), confidence(probs).alias("conf"))


def accuracy(predicted: str = "pred", label: str = "y") -> Column:
    return F.count_if(F.col(predicted) == F.col(label)) / F.count(F.lit(1))
