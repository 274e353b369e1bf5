"""A filter of fixed size that spares most rows a shuffle, in DataFrame functions.

The hashes of a set of keys set bits in a bitmap of BITS bits (4 MB at most, whatever the set's size:
that is what is broadcast). A row whose bit is unset has no key of the set; only the others need a join.
With many more keys than bits all rows pass: the join then sees all of them, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import staged

BITS = 1 << 25


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """At most BITS / 2**15 rows of 4 KB."""
    at = keys.select(_place(F.col(f"`{column}`")).alias("p")).distinct()
    return at.groupBy(F.bitmap_bucket_number("p").alias("__cairn_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__cairn_bits"))


def marked(df: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """df and __cairn_maybe: false where the key is surely not in the set, or null."""
    place = _place(key)
    at = F.bitmap_bit_position(place)
    byte = F.substring("__cairn_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    joined = df.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("__cairn_bucket"), "left")
    return joined.select(*[df[f"`{c}`"] for c in df.columns], F.coalesce(bit & key.isNotNull(), F.lit(False)).alias("__cairn_maybe"))


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """df's rows whose key isn't among gone's (one column, staged); rows with a null key stay. Only rows whose bit
    is set are shuffled."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    if any(c.startswith("__cairn_") for c in df.columns):
        raise ValueError("columns named __cairn_* are taken")
    named = gone.toDF("__cairn_gone")
    split = marked(df.withColumn("__cairn_key", key), F.col("__cairn_key"), staged(bitmap(named, "__cairn_gone"), "bits", BITS // 8))
    rest = split.filter("__cairn_maybe").join(named, F.col("__cairn_key") == F.col("__cairn_gone"), "left_anti")
    return split.filter("NOT __cairn_maybe").select(*columns).unionByName(rest.select(*columns))
