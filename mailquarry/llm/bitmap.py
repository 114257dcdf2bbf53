"""A broadcast bitmap over hashed keys: which rows may have a partner, told without a shuffle of the rows.

One row per 32 768 bits. The number of bits follows the number of keys up to ``MAX_BITS`` (32 MB in all); beyond, more
rows pass the test, which costs time and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BITS = 32_768
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
BITS_PER_KEY = 16


def bitmap(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """Bitmap table (_word, _bits) of the keys, and its number of bits."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << max(1, n_keys * BITS_PER_KEY).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = keys.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / ROW_BITS).alias("_word"))
    return rows.agg(F.bitmap_construct_agg(F.col("_p") % ROW_BITS).alias("_bits")), bits


def tested(rows: DataFrame, key: str, table: tuple[DataFrame, int]) -> DataFrame:
    """The rows with a flag ``_maybe``: false only if the key is not among those of the bitmap."""
    marks, bits = table
    place = rows.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("_word", F.floor(F.col("_p") / ROW_BITS))
    joined = place.join(F.broadcast(marks), "_word", "left")          # at most MAX_BITS
    return joined.withColumn("_maybe", F.coalesce(_bit("_bits", F.col("_p") % ROW_BITS) == 1, F.lit(False))).drop("_p", "_word", "_bits")


def maybe(rows: DataFrame, key: str, table: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key is in the bitmap, and a few others."""
    return tested(rows, key, table).where("_maybe").drop("_maybe")


def absent(rows: DataFrame, key: str, table: tuple[DataFrame, int]) -> DataFrame:
    """The rows that :func:`maybe` leaves out."""
    return tested(rows, key, table).where("NOT _maybe").drop("_maybe")


def _bit(column: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(column), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int"))
