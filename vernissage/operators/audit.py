"""Where evidence and caption disagree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.functions import caption, fixed
from vernissage.operators.blend import accuracy
from vernissage.operators.joins import spread_lookup
from vernissage.operators.profile import share


def with_weak_label(df: DataFrame, cap: str = "cap", labels: Sequence[str] = fixed.MEDIA) -> DataFrame:
    return df.withColumn("cap_y", caption.label_code(caption.caption_medium(cap), labels))


def weak_label_accuracy(df: DataFrame, label: str = "y") -> DataFrame:
    """A missing weak label counts as a disagreement."""
    agrees = F.col("cap_y") == F.col(label)
    return df.agg(
        share(agrees).alias("accuracy"),
        F.count_if(~F.coalesce(agrees, F.lit(False))).alias("n_disagree"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def confusion_matrix(df: DataFrame, label: str = "y", n_classes: int = fixed.N_CLASSES) -> DataFrame:
    """Fixed n x n counts over rows with a weak label; absent classes give rows of 0."""
    spine = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(label))
    known = df.filter(F.col("cap_y").isNotNull())
    cells = known.groupBy(label).agg(
        *[F.count_if(F.col("cap_y") == k).alias(f"cap_{k}") for k in range(n_classes)]
    )
    return spine.join(cells, label, "left").na.fill(0)


def confusion_pairs(df: DataFrame, label: str = "y", labels: Sequence[str] = fixed.MEDIA) -> DataFrame:
    """Caption says -> truth with counts, most frequent first."""
    wrong = df.filter(F.col("cap_y") != F.col(label))
    counts = wrong.groupBy("cap_y", label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        caption.label_name(F.col("cap_y"), labels).alias("cap_says"),
        caption.label_name(F.col(label), labels).alias("truth"),
        "n",
    ).orderBy(F.desc("n"), "cap_says", "truth")


def slice_accuracy(df: DataFrame, predicted: str = "pred", label: str = "y") -> DataFrame:
    """Accuracy on rows where the caption agrees with the label, and where it does not."""
    agrees = F.coalesce(F.col("cap_y") == F.col(label), F.lit(False)).cast("int")
    return df.groupBy(agrees.alias("agrees")).agg(
        accuracy(predicted, label).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def overrides(df: DataFrame, threshold: float = fixed.OVERRIDE_CONFIDENCE, labels: Sequence[str] = fixed.MEDIA) -> DataFrame:
    """Confident predictions that contradict the caption; a missing caption label counts as one."""
    differs = ~F.col("cap_y").eqNullSafe(F.col("pred"))
    return df.filter(differs & (F.col("conf") > threshold)).select(
        "id",
        caption.label_name(F.col("cap_y"), labels).alias("cap_says"),
        caption.label_name(F.col("pred"), labels).alias("model_says"),
        "conf",
        F.col("t").alias("title"),
    )


def attribution_rules(df: DataFrame, min_support: int, group: str = "attribution", label: str = "y") -> DataFrame:
    """Majority class per (attribution, caption class) with support and purity.

    Counted per class first, so a frequent attribution arrives as a few counts.
    On equal counts the lower class wins.
    """
    counts = df.filter(F.col("cap_y").isNotNull() & F.col(group).isNotNull()).groupBy(
        group, "cap_y", label
    ).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(label)).alias("neg"))).alias("best")
    mined = counts.groupBy(group, "cap_y").agg(F.sum("n").alias("support"), best)
    return mined.filter(F.col("support") >= min_support).select(
        group,
        "cap_y",
        "support",
        (-F.col("best.neg")).alias("rule_class"),
        (F.col("best.n") / F.col("support")).alias("purity"),
    )


def apply_rules(df: DataFrame, rules: DataFrame, min_purity: float, group: str = "attribution") -> DataFrame:
    """Mined rules as overrides of the prediction, where pure enough."""
    pure = rules.filter(F.col("purity") >= min_purity).select(group, "cap_y", "rule_class")
    ruled = spread_lookup(df.select("id", group, "cap_y", "pred"), pure, [group, "cap_y"])
    return ruled.select("id", "pred", F.coalesce("rule_class", "pred").alias("final"))


def submission(decided: DataFrame) -> DataFrame:
    return decided.select("id", F.col("pred").alias("y"))
