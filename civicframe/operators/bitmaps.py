"""Exact distinct counts that can be merged: bitmaps of fixed size by bucket of identifiers, combined by or over any grouping.

A bitmap has 4096 bytes for 32768 neighbouring identifiers, so identifiers should be dense. Nulls are no identifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from civicframe.operators.joins import dealt


def bitmaps(df: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """keys, bucket and bits of the whole-number identifiers of every group.

    parts: tasks over which groups are dealt as identifiers, for groups of few of them: a bitmap of each before the shuffle would be 4096 bytes for a few.
    """
    known = df.filter(F.col(value).isNotNull()).withColumn("id__", F.col(value).cast("bigint"))
    return dealt(known, parts, *keys).groupBy(*keys, F.bitmap_bucket_number("id__").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id__")).alias("bits"))


def merged(bits: DataFrame, keys: list[str]) -> DataFrame:
    """The bitmaps of coarser groups, or of several tables' union."""
    return bits.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(bits: DataFrame, keys: list[str], out: str) -> DataFrame:
    """keys and how many identifiers each group has; a group has no row without any."""
    return merged(bits, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(out))
