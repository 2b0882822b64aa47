"""Keeping the rows that a join can want, before they are moved.

The keys of the small side set bits in a map of fixed size, which every task of the large side gets. A row whose bit is not
set has no partner and stays where it is; a few others pass by chance and drop out in the join. Bits are set and tested by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the map (1 MB). With n keys, a row without a partner passes with a chance of about n / BITS.
BITS = 1 << 23
# Bits of one row of the map, as Spark's bitmap functions deal them.
ROW_BITS = 32_768


def _place(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1


def key_map(wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``bucket, bits``: BITS / ROW_BITS rows of 4 KB at most, whatever the number of keys."""
    place = _place(keys)
    return wanted.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")).groupBy(
        "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def keep_likely(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among those of ``wanted``; none that is among them is lost. The rows are not shuffled. The
    key columns must have the same types on both sides."""
    place = _place(keys)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("getbit", byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    mapped = F.broadcast(key_map(wanted, keys))  # BITS bits at most
    return rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(mapped, "_bucket").filter(hit).drop("_bucket", "_bits")
