"""Key joins that keep every base row and survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Keys holding more than 1/HOT_SHARE of the rows are hot, so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def unique_by_key(side: DataFrame, key: str = "id") -> DataFrame:
    """The same rows; the query fails when a key occurs twice.

    Rows are counted per key where a join by key wants them anyway, however wide they are.
    """
    counted = side.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    unique = F.assert_true(F.col("_n") == 1, F.lit(f"side table has duplicate {key}")).isNull()
    return counted.filter(unique).select(*side.columns)


def attach_evidence(base: DataFrame, side: DataFrame, key: str = "id", exclude: Sequence[str] = ()) -> DataFrame:
    """Left join of a side table with a unique key; records without evidence get nulls."""
    columns = [c for c in side.columns if c not in set(exclude)]
    return base.join(unique_by_key(side.select(*columns), key), key, "left")


def restrict_to(side: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    return side.join(base.select(key), key, "left_semi")


def spread_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], row_id: str = "id", sizes: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Left join of rows to a table that is unique by `keys`, where `keys` may be skewed or null in rows.

    Keys that hold more than a thousandth of the rows are answered from a
    broadcast of their table rows, of which there are fewer than a thousand. Those
    rows and rows with a null key then travel under a spread number instead of
    their key, so no shuffle partition collects a hot group. `sizes` (keys, _n) spares
    the count of rows per key where the caller has it. Table rows should be
    narrow, as those of hot keys are broadcast. Where the caller knows that keys
    do not repeat in `rows` (`unique`), nothing is counted and only null keys are spread.
    """
    keys = list(keys)
    if unique:
        return _unique_lookup(rows, table, keys, row_id)
    values = [c for c in table.columns if c not in keys]
    no_null = F.lit(True)
    for k in keys:
        no_null = no_null & F.col(k).isNotNull()
    if sizes is None:
        sizes = rows.filter(no_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t")).scalar()
    hot = sizes.filter(F.col("_n") * HOT_SHARE > total).select(*keys)

    packed = table.select(*keys, F.struct(*values).alias("_value"))
    hot_values = hot.join(packed, keys, "left").select(
        *keys, F.col("_value").alias("_hot_value"), F.lit(True).alias("_hot")
    )
    marked = rows.join(F.broadcast(hot_values), keys, "left")
    settled = F.coalesce(F.col("_hot"), F.lit(False)) | ~no_null
    spread = _spread_number(rows, row_id)
    marked = marked.withColumn("_spread", F.when(settled, spread).otherwise(F.lit(0)))
    cold = packed.withColumn("_spread", F.lit(0))
    joined = marked.join(cold, [*keys, "_spread"], "left")
    value = F.coalesce(F.col("_hot_value"), F.col("_value"))
    return joined.select(*[F.col(c) for c in rows.columns], *[value[v].alias(v) for v in values])


def _spread_number(rows: DataFrame, row_id: str):
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(row_id), F.lit(partitions)).cast("int") + 1


def _unique_lookup(rows: DataFrame, table: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    marked = rows.withColumn("_spread", F.when(missing, _spread_number(rows, row_id)).otherwise(F.lit(0)))
    joined = marked.join(table.withColumn("_spread", F.lit(0)), [*keys, "_spread"], "left")
    return joined.select(*rows.columns, *[c for c in table.columns if c not in keys])


def align_columns(df: DataFrame, columns: Sequence[str], value=0) -> DataFrame:
    """Columns in the given order; one the frame lacks is filled with a constant."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(value).alias(c) for c in columns])


def union_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
