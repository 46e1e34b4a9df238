"""Stratified folds, class prior and out-of-fold target encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators.joins import spread_lookup
from vernissage.operators.ranking import (
    ROWS_PER_BUCKET,
    digest_bucket,
    digest_digits,
    position_within,
    range_buckets,
    seeded_digest,
)


def assign_folds(df: DataFrame, seed: int, n_folds: int = fixed.N_FOLDS, key: str = "id", label: str = "y", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Seeded stratified folds: fold sizes differ by at most one inside each class.

    Rows without a label are a class of their own.
    """
    hashed = df.withColumn("_digest", seeded_digest(key, seed))
    hashed = hashed.withColumn("_bucket", digest_bucket("_digest", digest_digits(df.count(), rows_per_bucket)))
    ranked = position_within(hashed, ["_digest", key], by=[label])
    return ranked.withColumn("fold", (F.col("position") % n_folds).cast("int")).drop("_digest", "position")


def class_counts(label: str | Column = "y", n_classes: int = fixed.N_CLASSES) -> list[Column]:
    c = F.col(label) if isinstance(label, str) else label
    return [F.count_if(c == k).alias(f"n_{k}") for k in range(n_classes)]


def class_prior(df: DataFrame, label: str = "y", n_classes: int = fixed.N_CLASSES) -> DataFrame:
    """One row: `prior`, the share of each class over all given rows."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *class_counts(label, n_classes))
    return counts.select(F.array(*[F.col(f"n_{k}") / F.col("n") for k in range(n_classes)]).alias("prior"))


def encoding_columns(encoding: Column, prefix: str = "artist_enc_", n_classes: int = fixed.N_CLASSES) -> list[Column]:
    return [encoding[k].alias(f"{prefix}{k}") for k in range(n_classes)]


def out_of_fold_encoding(
    df: DataFrame,
    group: str = "attribution",
    label: str = "y",
    fold: str = "fold",
    key: str = "id",
    prefix: str = "artist_enc_",
    n_classes: int = fixed.N_CLASSES,
    strict_prior: bool = False,
) -> DataFrame:
    """P(class | group) learned on the other folds; a group unseen there gets the class prior.

    One aggregate gives counts per (group, fold); the other folds are the group
    total minus the own fold. With `strict_prior` the prior also leaves the own
    fold out; the default takes it over all rows.
    """
    ks = range(n_classes)
    per_fold = df.groupBy(group, fold).agg(F.count(F.lit(1)).alias("n"), *class_counts(label, n_classes))
    whole = Window.partitionBy(group)
    others = [
        (F.sum(c).over(whole) - F.col(c)).alias(f"o_{c}") for c in ["n", *[f"n_{k}" for k in ks]]
    ]
    rest = per_fold.select(group, fold, *others)
    rest = rest.withColumn(
        "_enc", F.when(F.col("o_n") > 0, F.array(*[F.col(f"o_n_{k}") / F.col("o_n") for k in ks]))
    ).select(group, fold, "_enc")
    sizes = per_fold.filter(F.col(group).isNotNull()).select(group, fold, F.col("n").alias("_n"))
    found = spread_lookup(df, rest, [group, fold], key, sizes)
    if strict_prior:
        found = found.join(F.broadcast(_prior_without_fold(df, label, fold, n_classes)), fold, "left")
        prior = F.col("_prior")
    else:
        prior = class_prior(df, label, n_classes).scalar()
    encoding = F.coalesce(F.col("_enc"), prior)
    return found.select(*df.columns, *encoding_columns(encoding, prefix, n_classes))


def _prior_without_fold(df: DataFrame, label: str, fold: str, n_classes: int) -> DataFrame:
    counts = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *class_counts(label, n_classes))
    everything = Window.partitionBy(F.lit(1))  # one row per fold
    rest = F.sum("n").over(everything) - F.col("n")
    shares = [
        (F.sum(f"n_{k}").over(everything) - F.col(f"n_{k}")) / rest for k in range(n_classes)
    ]
    return counts.select(fold, F.array(*shares).alias("_prior"))


def ordered_encoding(
    df: DataFrame,
    seed: int,
    group: str = "attribution",
    label: str = "y",
    fold: str = "fold",
    key: str = "id",
    prefix: str = "artist_ord_",
    weight: float = 1.0,
    n_classes: int = fixed.N_CLASSES,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """P(class | group) from the rows of other folds that come earlier in a seeded permutation.

    Counts are drawn to the class prior by `weight` rows, so every value of a
    category carries what is known of it, however many values there are, and no
    row sees its own label or one of its fold. Running counts per (group, bucket
    of the permutation) start from the counts of the earlier buckets, so a
    frequent value is spread over many tasks. A null group is a value of its own.
    """
    names = ["n", *[f"n_{k}" for k in range(n_classes)]]
    digits = digest_digits(df.count(), rows_per_bucket)
    hashed = df.withColumn("_digest", seeded_digest(key, seed))
    hashed = hashed.withColumn("_bucket", digest_bucket("_digest", digits))
    cells = hashed.groupBy(group, "_bucket", fold).agg(F.count(F.lit(1)).alias("n"), *class_counts(label, n_classes))

    def earlier(rows: DataFrame, by: list[str], names_out: str) -> list[Column]:
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{names_out}{c}") for c in names]

    own = cells.select(F.col(group).alias("_group"), F.col("_bucket").alias("_own"), F.col(fold).alias("_fold"), *earlier(cells, [group, fold], "_f_"))
    whole = cells.groupBy(group, "_bucket").agg(*[F.sum(c).alias(c) for c in names])
    whole = whole.select(F.col(group).alias("_value"), F.col("_bucket").alias("_place"), *earlier(whole, [group], "_a_"))
    offsets = own.join(whole, F.col("_group").eqNullSafe(F.col("_value")) & (F.col("_own") == F.col("_place")))
    offsets = offsets.select("_group", "_own", "_fold", *[(F.col(f"_a_{c}") - F.col(f"_f_{c}")).alias(f"_o_{c}") for c in names])
    hits = {"n": F.lit(1), **{f"n_{k}": F.coalesce((F.col(label) == k).cast("int"), F.lit(0)) for k in range(n_classes)}}
    cell = Window.partitionBy(group, "_bucket")
    ordered = lambda w: w.orderBy("_digest", key, label).rowsBetween(Window.unboundedPreceding, -1)
    all_folds, own_fold = ordered(cell), ordered(Window.partitionBy(group, "_bucket", fold))
    inside = [
        (F.coalesce(F.sum(hits[c]).over(all_folds), F.lit(0)) - F.coalesce(F.sum(hits[c]).over(own_fold), F.lit(0))).alias(f"_i_{c}") for c in names
    ]
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_own")) & F.col(fold).eqNullSafe(F.col("_fold"))
    found = hashed.select("*", *inside).join(offsets, same)
    known = {c: F.col(f"_o_{c}") + F.col(f"_i_{c}") for c in names}
    prior = class_prior(df, label, n_classes).scalar()
    drawn = F.array(*[(known[f"n_{k}"] + weight * prior[k]) / (known["n"] + weight) for k in range(n_classes)])
    return found.select(*df.columns, *encoding_columns(drawn, prefix, n_classes))


def smoothed_encoding(
    train: DataFrame,
    test: DataFrame,
    group: str = "attribution",
    label: str = "y",
    key: str = "id",
    prefix: str = "artist_ord_",
    weight: float = 1.0,
    n_classes: int = fixed.N_CLASSES,
) -> DataFrame:
    """What `ordered_encoding` gives for rows that come after all training rows."""
    names = ["n", *[f"n_{k}" for k in range(n_classes)]]
    value = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null")).alias("_named")
    counts = train.groupBy(value(group)).agg(F.count(F.lit(1)).alias("n"), *class_counts(label, n_classes))
    found = spread_lookup(test.withColumn("_named", value(group)), counts.select("_named", F.struct(*names).alias("_counts")), ["_named"], key)
    prior = class_prior(train, label, n_classes).scalar()
    known = {c: F.coalesce(F.col("_counts")[c], F.lit(0)) for c in names}
    drawn = F.array(*[(known[f"n_{k}"] + weight * prior[k]) / (known["n"] + weight) for k in range(n_classes)])
    return found.select(*test.columns, *encoding_columns(drawn, prefix, n_classes))


def group_shares(df: DataFrame, group: str = "attribution", label: str = "y", n_classes: int = fixed.N_CLASSES) -> DataFrame:
    """Row-normalised class counts per group; absent classes are 0."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *class_counts(label, n_classes))
    return counts.select(
        group, "n", *[(F.col(f"n_{k}") / F.col("n")).alias(f"share_{k}") for k in range(n_classes)]
    )


def full_encoding(
    train: DataFrame,
    test: DataFrame,
    group: str = "attribution",
    label: str = "y",
    key: str = "id",
    prefix: str = "artist_enc_",
    n_classes: int = fixed.N_CLASSES,
) -> DataFrame:
    """P(class | group) over all training rows for test rows; unseen groups get the prior."""
    shares = group_shares(train, group, label, n_classes)
    table = shares.select(group, F.array(*[F.col(f"share_{k}") for k in range(n_classes)]).alias("_enc"))
    found = spread_lookup(test, table, [group], key)
    encoding = F.coalesce(F.col("_enc"), class_prior(train, label, n_classes).scalar())
    return found.select(*test.columns, *encoding_columns(encoding, prefix, n_classes))


def category_dictionary(train: DataFrame, field: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Sorted training values of a field with their codes 0, 1, ..., ranked inside ranges of values."""
    values = train.filter(F.col(field).isNotNull()).select(F.col(field).alias("value")).distinct()
    ranked = position_within(range_buckets(values, "value", rows_per_bucket), "value")
    return ranked.select("value", F.col("position").cast("int").alias("code"))


# Dictionaries up to LITERAL_VALUES sit in the expression, larger ones are looked up by join.
LITERAL_VALUES = 256


def encode_categories(df: DataFrame, train: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """Adds `<field>_code`; a value not seen in training is coded null.

    Dictionary sizes are measured first, so that only small ones are collected.
    """
    sizes = train.agg(*[F.approx_count_distinct(f).alias(f) for f in fields]).first()
    short = [f for f in fields if sizes[f] <= LITERAL_VALUES]
    values = train.agg(F.lit(0).alias("_"), *[F.array_sort(F.collect_set(f)).alias(f) for f in short]).first()
    codes = []
    for f in short:
        at = F.array_position(F.array(*[F.lit(v) for v in values[f]]).cast("array<string>"), F.col(f))
        codes.append(F.when(at > 0, (at - 1).cast("int")).alias(f"{f}_code"))
    out = df.select("*", *codes)
    for f in fields:
        if f in short:
            continue
        table = category_dictionary(train, f).select(
            F.col("value").alias(f), F.col("code").alias(f"{f}_code")
        )
        out = spread_lookup(out, table, [f], key)
    return out.select(*df.columns, *[f"{f}_code" for f in fields])
