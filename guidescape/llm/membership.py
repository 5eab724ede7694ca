"""A bounded filter on keys: a bitmap of fixed size that may let a foreign key pass but never stops a listed one.

It spares the shuffle of rows that cannot match. Its size depends on ``bits`` alone (4 M bits: half a megabyte), so it may be
broadcast whatever the number of keys; with more keys it filters less and the exact join behind it does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 22


def _position(cols: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1


def bitmap(keys: DataFrame, cols: list[str], bits: int = BITS) -> DataFrame:
    """(bucket, bitmap) rows of 4 KB each, at most ``bits`` / 32768 of them."""
    at = keys.select(_position(cols, bits).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bitmap")
    )


def passing(df: DataFrame, bitmaps: DataFrame, cols: list[str], flag: str, bits: int = BITS) -> DataFrame:
    """``df`` with a boolean column that is true for every row whose key is listed, and for few others."""
    at = df.withColumn("_at", _position(cols, bits)).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    joined = at.join(F.broadcast(bitmaps), "_bucket", "left")
    spot = F.bitmap_bit_position("_at").cast("int")
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, spot % 8) == 1, F.lit(False))
    return joined.withColumn(flag, hit).drop("_at", "_bucket", "_bitmap")
