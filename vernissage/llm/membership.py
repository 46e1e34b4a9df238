"""Bitmaps that tell which rows may have a value of a set, before their texts are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a bitmap, whatever the size of the set: 4 MB to broadcast at most.
BITS = 1 << 25


def _bit(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS)) + 1


def bitmap(values: DataFrame, value: Column) -> DataFrame:
    """(_bucket, _bits): the bits of all values that are not null."""
    bit = values.filter(value.isNotNull()).select(_bit(value).alias("bit"))
    return bit.groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits")
    )


def with_chance(rows: DataFrame, value: Column, bits: DataFrame, name: str = "chance") -> DataFrame:
    """`rows` with a flag that is true wherever `value` is one of those in `bits`, and for few others.

    The more values a bitmap holds, the more other rows are let through, so a join
    must still follow; no row with one of the values is ever told apart wrongly.
    """
    bit = _bit(value)
    place = F.bitmap_bit_position(bit)
    byte = F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    found = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "_bucket", "left")
    return marked.withColumn(name, F.coalesce(found, F.lit(False))).drop("_bucket", "_bits")
