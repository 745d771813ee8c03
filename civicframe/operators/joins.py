"""Checked joins: lookups that refuse ambiguous, orphan or doubled keys.

Checks are small aggregates; joins are left to Spark, which broadcasts small sides by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F


class CheckFailed(ValueError):
    """A contract does not hold."""


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df by keys over parts tasks, where a number is given: Spark goes by bytes, and well packed rows of narrow keys would be millions in a task."""
    return df if parts is None else df.repartition(parts, *keys)


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value, with it; nulls are no values."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("other__")).filter(f"{value} = other__").drop("other__")


def companion(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Whether the other side has a row of the same keys (missing) and kind (other kind), so that both may be joined (companion)."""
    other = right.select(*keys, F.col(kind).alias("kind__"))
    state = F.when(F.col("kind__").isNull(), "missing").when(F.col("kind__") != F.col(kind), "other kind").otherwise("companion")
    return left.join(other, keys, "left").select(*keys, state.alias("state"))


def single_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every key once: with its value, or null where there are several."""
    return df.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def keep_latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Of each key the row with the latest order; ties go to the smallest tie."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col(tie)))
    return df.withColumn("place__", place).filter("place__ = 1").drop("place__")


def checked_lookup(df: DataFrame, dimension: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Inner lookup of a key that must be in the dimension, there once; a row that breaks this fails the job that reads it.

    The dimension is reduced to a row for each key with its count, so the check costs no job of its own.
    """
    if not strict:
        return df.join(dimension, key)
    others = [c for c in dimension.columns if c != key]
    one = dimension.groupBy(key).agg(F.count(F.lit(1)).alias("times__"), F.first(F.struct(F.lit(1), *others)).alias("row__"))
    why = F.when(F.col("times__").isNull(), f"{key}: missing from the dimension").otherwise(f"{key}: doubled in the dimension")
    sound = F.when(F.col("times__") == 1, F.lit(True)).otherwise(F.raise_error(why).cast("boolean"))
    return df.join(one, key, "left").filter(sound).select(*df.columns, *[F.col(f"row__.{c}").alias(c) for c in others])


def repeated_across(files: list[DataFrame], keys: list[str], file: str) -> DataFrame:
    """Keys that more than one of several files has, with their number."""
    rows = reduce(DataFrame.unionByName, [f.select(*keys, file) for f in files]).distinct()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")).filter("files > 1")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer compare of two key sets: the keys that only one side has, with the side."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, keys, "full_outer").filter("in_left IS NULL OR in_right IS NULL").select(*keys, F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("only_in"))


def null_safe(a: DataFrame, b: DataFrame, within: list[str], parts: list[str], how: str) -> DataFrame:
    """Semi or anti join on keys of which parts may be null on both sides; rows whose parts are all null never match."""
    b = b.filter(F.coalesce(*parts).isNotNull()).select(*[F.col(c).alias(f"{c}__b") for c in within + parts]).distinct()
    on = [F.col(c) == F.col(f"{c}__b") for c in within] + [F.col(c).eqNullSafe(F.col(f"{c}__b")) for c in parts]
    return a.join(b, reduce(lambda x, y: x & y, [*on, F.coalesce(*parts).isNotNull()]), how)


def reconciled(detail: DataFrame, published: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both sides of every key and whether they agree exactly."""
    a = detail.select(*keys, F.col(value).alias("recomputed"))
    b = published.select(*keys, F.col(value).alias("published"))
    return a.join(b, keys, "full_outer").withColumn("ok", F.col("recomputed").eqNullSafe(F.col("published")))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Parents with an ordered array of their children; nulls sort as empty text."""
    fields = [c for c in children.columns if c != key]
    sort = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"s{i}") for i, c in enumerate(order)]
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*sort, F.struct(*fields).alias("row")))).alias("rows__"))
    return parents.join(rows, key, "left").withColumn(name, F.transform(F.coalesce("rows__", F.array()), lambda x: x["row"])).drop("rows__")
