"""Ordered series: running totals, flows from cumulative values, changes, rankings, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str = "cumulative") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def flows(df: DataFrame, by: list[str], month: str, cumulative: str, out: str = "flow") -> DataFrame:
    """January is its own flow; another month's is known only next to the month before."""
    w = W.partitionBy(*by).orderBy(month)
    gapless = F.lag(month).over(w) == F.col(month) - 1
    return df.withColumn(out, F.when(F.col(month) == 1, F.col(cumulative)).when(gapless, F.col(cumulative) - F.lag(cumulative).over(w)))


def missing_months(df: DataFrame, by: list[str], month: str) -> DataFrame:
    """Months from 1 to the latest that a series lacks."""
    expected = df.groupBy(*by).agg(F.max(month).alias("latest")).select(*by, F.explode(F.sequence(F.lit(1), F.col("latest"))).alias(month))
    return expected.join(df.select(*by, month).distinct(), [*by, month], "left_anti")


def changes(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Change against the element before: absolute, and percent to one digit (0 on a base of 0, null without one)."""
    w = W.partitionBy(*by).orderBy(order)
    before = F.lag(value).over(w)
    percent = F.when(before == 0, F.lit(0.0)).otherwise(F.floor(F.try_divide((F.col(value) - before).cast("double"), before.cast("double")) * 1000 + 0.5) / 10)
    return df.withColumn("change", F.col(value) - before).withColumn("change_pct", F.when(before.isNotNull(), percent))


def increasing(df: DataFrame, order: str) -> Column:
    """Aggregate condition for strictly increasing positions; expects the column before__ of with_before."""
    return F.count_if(F.col("before__") >= F.col(order)) == 0


def with_before(df: DataFrame, by: list[str], position: str, order: str) -> DataFrame:
    return df.withColumn("before__", F.lag(order).over(W.partitionBy(*by).orderBy(position)))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def ordered_by(column: str, descending: bool, key: str) -> list[Column]:
    """Nulls last in both directions, ties by key ascending."""
    c = F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key).asc()]


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def numbered(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Places of a page or of a few groups in a total order; for reports, as one task numbers them."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))


def envelope(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: first, returned, total and next_offset (null at the end) of a page."""
    total = F.count(F.lit(1))
    returned = F.greatest(F.least(F.lit(limit).cast("bigint"), F.col("total") - offset), F.lit(0).cast("bigint"))
    after = F.lit(offset + limit).cast("bigint")
    return df.agg(total.alias("total")).select(F.lit(offset).cast("bigint").alias("first"), returned.alias("returned"), "total", F.when(after < F.col("total"), after).alias("next_offset"))


def numbered_page(df: DataFrame, order: list[Column], page_: int, size: int) -> DataFrame:
    """The rows of a page by its number, moved to the last there is, each with page, total, returned and has_more. Counting is a job of its own."""
    total = df.count()
    at = last_page(page_, total, size)
    facts = {"page": at, "total": total, "returned": max(0, min(size, total - (at - 1) * size))}
    rows = page(df, order, (at - 1) * size, size)
    return rows.select("*", *[F.lit(v).cast("bigint").alias(k) for k, v in facts.items()], F.lit(total > at * size).alias("has_more"))


def declared(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """name, type, present: which of the declared columns a table has, with their type."""
    own = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(n, t, own.get(n) == t) for n, t in columns.items()]
    return df.sparkSession.createDataFrame(rows, "name string, type string, present boolean")


def clamped(value, fallback: int, low: int, high: int) -> int:
    """Out of range is moved into it."""
    try:
        return min(high, max(low, int(value)))
    except (TypeError, ValueError):
        return fallback


def bounded(value, fallback: int, low: int, high: int) -> int:
    """Out of range is an error."""
    if value is None:
        return fallback
    if isinstance(value, bool) or int(value) != value or not low <= value <= high:
        raise ValueError(f"{value} is not within {low} and {high}")
    return int(value)


def last_page(page_: int, total: int, size: int) -> int:
    """A page number within the pages there are."""
    return min(max(1, page_), max(1, -(-total // size)))


def share_intervals(df: DataFrame, order: str, value: str) -> DataFrame:
    """Slices of the whole as intervals [from_share, to_share); one aggregate row joins the ordered few."""
    total = df.agg(F.sum(value).alias("total__"))
    up_to = F.sum(value).over(W.partitionBy(F.lit(0)).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    share = lambda x: F.round(F.try_divide(x.cast("decimal(30,0)"), F.col("total__").cast("decimal(30,0)")).cast("decimal(30,10)"), 8).cast("decimal(30,8)")
    return df.crossJoin(total).withColumn("up__", up_to).withColumn("from_share", share(F.col("up__") - F.col(value))).withColumn("to_share", share(F.col("up__"))).drop("up__", "total__")
