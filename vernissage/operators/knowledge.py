"""Material evidence from knowledge-graph labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators.joins import spread_lookup


def category_hits(label: str = "label") -> list[Column]:
    """0/1 per material category: any of its fragments occurs in the label."""
    text = F.lower(F.trim(F.col(label)))
    return [
        reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in fragments]).cast("int").alias(c)
        for c, fragments in fixed.MATERIAL_FRAGMENTS.items()
    ]


def item_categories(bindings: DataFrame, item: str = "item", label: str = "label") -> DataFrame:
    """One row per item: 0/1 per category over all its labels."""
    hits = bindings.select(item, *category_hits(label))
    return hits.groupBy(item).agg(*[F.max(c).alias(c) for c in fixed.MATERIAL_FRAGMENTS])


def rule_class() -> Column:
    """Class from the categories by priority, -1 without a rule."""
    on = {c: F.coalesce(F.col(c), F.lit(0)) == 1 for c in fixed.MATERIAL_FRAGMENTS}
    oil = on["oil"] | on["oil_canvas"] | on["oil_panel"] | on["oil_wood"]
    oil_on = (
        F.when(on["canvas_support"], 2)
        .when(on["panel_support"], 3)
        .when(on["wood_support"], 4)
        .when(on["oil_canvas"], 2)
        .when(on["oil_panel"], 3)
        .when(on["oil_wood"], 4)
        .otherwise(2)
    )
    return (
        F.when(on["watercolor"], 7)
        .when(on["acrylic_mat"], 0)
        .when(on["tempera_mat"] | on["gold"], 6)
        .when(on["print_mat"], 5)
        .when(oil, oil_on)
        .when(on["ink_mat"], 1)
        .otherwise(-1)
    )


def material_lists(bindings: DataFrame, item: str = "item", label: str = "label") -> DataFrame:
    """Labels per item in order, repeats kept.

    Repeats are counted before the list is built, so what is shuffled per item
    is never longer than the material vocabulary.
    """
    counted = bindings.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("_m"))
    repeated = F.transform("_m", lambda m: F.array_repeat(m["label"], m["n"].cast("int")))
    return packed.select(item, F.flatten(repeated).alias("materials"))


def materials_of_records(records: DataFrame, bindings: DataFrame, graph_key: str = "wikidataid", key: str = "id", unique: bool = False) -> DataFrame:
    """Every record with its material text; records without an answer get an empty list.

    `unique` says that no two records share a graph key.
    """
    lists = material_lists(bindings).withColumnRenamed("item", graph_key)
    found = spread_lookup(records.select(key, graph_key), lists, [graph_key], key, unique=unique)
    materials = F.coalesce("materials", F.array().cast("array<string>"))
    return found.select(
        key, graph_key, F.array_join(materials, "|").alias("wd_materials"), F.size(materials).cast("bigint").alias("n_materials")
    )


def evidence(records: DataFrame, bindings: DataFrame, graph_key: str = "wikidataid", key: str = "id", unique: bool = False) -> DataFrame:
    """(id, wd_pred, wd_<flag>...) for every record."""
    categories = item_categories(bindings).withColumnRenamed("item", graph_key)
    found = spread_lookup(records.select(key, graph_key), categories, [graph_key], key, unique=unique)
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(f"wd_{c}") for c in fixed.MATERIAL_FLAGS]
    return found.select(key, rule_class().alias("wd_pred"), *flags)


def rule_accuracy(records: DataFrame, facts: DataFrame, label: str = "y", key: str = "id") -> DataFrame:
    """Accuracy of the rule where it fires, with its coverage."""
    joined = records.join(facts.select(key, "wd_pred"), key)
    fired = F.col("wd_pred") != -1
    right = fired & (F.col("wd_pred") == F.col(label))
    return joined.agg(
        F.try_divide(F.count_if(right).cast("double"), F.count_if(fired)).alias("rule_accuracy"),
        F.count_if(fired).alias("n_covered"),
        F.count(F.lit(1)).alias("n_rows"),
    )
