"""Joins in time: the release that held when something was asked, the version that was valid on a day.

Neither compares all pairs: an as-of join looks at a key's periods in order, an interval join meets in buckets of days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from civicframe.operators.joins import dealt
from civicframe.operators.series import clamped

#: Months that a request without a period looks back, and their range.
BACK, LEAST_BACK, MOST_BACK = 16, 1, 36
#: Days of a bucket in which versions and facts meet.
BUCKET_DAYS = 64


def month_index(year: Column, month: Column) -> Column:
    """Months since year 0, so that neighbours differ by one."""
    return (year * 12 + month - 1).cast("int")


def as_of(requests: DataFrame, releases: DataFrame, by: list[str], upto: str, at: str, back: Column | int = BACK) -> DataFrame:
    """requests with released (the last month of a release not after upto and less than back months before it), copies (releases of that month) and state: found, ambiguous or missing.

    Requests and releases of a key and month count once, so the window over a key holds its months and not its rows; a
    request without key or month is missing. back goes from 1 to 36 months.
    """
    months = releases.groupBy(*by, F.col(at).alias("at__")).agg(F.count(F.lit(1)).alias("copies__"))
    asked = requests.select(*by, F.col(upto).alias("at__")).distinct().withColumn("copies__", F.lit(None).cast("bigint"))
    marks = months.unionByName(asked).groupBy(*by, "at__").agg(F.max("copies__").alias("copies__"))
    line = W.partitionBy(*by).orderBy("at__").rowsBetween(W.unboundedPreceding, 0)
    known = F.last(F.when(F.col("copies__").isNotNull(), F.struct(F.col("at__").alias("released"), F.col("copies__").alias("copies"))), ignorenulls=True)
    resolved = marks.withColumn("last__", known.over(line)).select(*by, F.col("at__").alias(upto), "last__")
    width = F.lit(clamped(back, BACK, LEAST_BACK, MOST_BACK)) if isinstance(back, int) else F.least(F.greatest(back, F.lit(LEAST_BACK)), F.lit(MOST_BACK))
    near = F.when(F.col(upto) - F.col("last__.released") < width, F.col("last__"))
    rows = requests.join(resolved, [*by, upto], "left").withColumn("last__", near)
    state = F.when(F.col("last__").isNull(), "missing").when(F.col("last__.copies") > 1, "ambiguous").otherwise("found")
    return rows.select(*requests.columns, F.col("last__.released").alias("released"), F.col("last__.copies").alias("copies"), state.alias("state"))


def resolved_releases(requests: DataFrame, releases: DataFrame, by: list[str], now: int, back: int = BACK) -> DataFrame:
    """requests (by, year, month) with kind, released, copies and state.

    releases have by, kind (mensile or consuntivo), year and month (null for a final account). Without a year the latest month within back of now counts;
    with year and month that month; with a year its final account (released null, kind consuntivo) or else its latest month. A month without year, or out of
    range, is invalid.
    """
    year, month = F.col("year"), F.col("month")
    asked = (
        F.when(year.isNull() & month.isNull(), "latest").when(year.isNull() | ~year.between(2000, 2200), "invalid")
        .when(month.isNull(), "year").when(month.between(1, 12), "month").otherwise("invalid")
    )
    finals = releases.filter("kind = 'consuntivo'").groupBy(*by, "year").agg(F.count(F.lit(1)).alias("finals__"))
    rows = requests.withColumn("asked", asked).join(finals, [*by, "year"], "left")
    end = F.when(F.col("asked") == "latest", F.lit(now)).when(F.col("asked") == "month", month_index(year, month)).when(F.col("asked") == "year", month_index(year, F.lit(12)))
    rows = rows.withColumn("upto__", end).withColumn("back__", F.when(F.col("asked") == "latest", back).when(F.col("asked") == "month", 1).otherwise(12))
    monthly = releases.filter("kind = 'mensile'").select(*by, month_index(F.col("year"), F.col("month")).alias("at"))
    found = as_of(rows, monthly, by, "upto__", "at", F.col("back__"))
    final = (F.col("asked") == "year") & F.col("finals__").isNotNull()
    state = F.when(F.col("asked") == "invalid", "invalid").when(final, F.when(F.col("finals__") > 1, "ambiguous").otherwise("found")).otherwise(F.col("state"))
    return found.select(
        *requests.columns, "asked", F.when(state == "invalid", None).when(final, "consuntivo").when(F.col("released").isNotNull(), "mensile").alias("kind"),
        F.when(~final & (state != "invalid"), F.col("released")).alias("released"), state.alias("state"),
    )


def checked_intervals(versions: DataFrame, start: str, end: str) -> DataFrame:
    """versions; one that ends before it starts, or lacks an end, fails the job that reads it."""
    sound = F.coalesce(F.col(start) <= F.col(end), F.lit(False))
    return versions.filter(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit(f"{start} is after {end} or lacks")).cast("boolean")))


def valid_at(facts: DataFrame, versions: DataFrame, keys: list[str], day: str, start: str, end: str, tie: str, days: int = BUCKET_DAYS, how: str = "left", span: tuple | None = None, parts: int | None = None) -> DataFrame:
    """facts with valid: of the versions of their keys that hold on their day (both ends included) the one that starts last; of equals the smallest tie.

    Versions stand in every bucket of days that they touch and facts in theirs, so they meet in an equality of keys and bucket.
    span: the first and the last day of facts, where known, so that versions with open ends stand in no bucket beyond; facts beyond it have no version.
    Of a bucket's versions that hold over the same days only the last counts, so what stands in a bucket is bounded by its
    days, however many versions a key has. A fact stays one row. With how = inner those without a version go.
    parts: tasks over which facts and versions in buckets are dealt.
    """
    number = lambda c: F.floor(F.unix_date(c) / days).cast("int")
    first = lambda b: F.date_from_unix_date(b * days)
    fields = [c for c in versions.columns if c not in keys]
    begin, stop = F.col(start), F.col(end)
    if span:
        first_day, last_day = (F.lit(d).cast("date") for d in span)
        versions = versions.filter((begin <= last_day) & (stop >= first_day))
        begin, stop = F.greatest(begin, first_day), F.least(stop, last_day)
    spread = versions.select(*keys, F.struct(*fields).alias("version__"), F.explode(F.sequence(number(begin), number(stop))).alias("bucket__"))
    spread = dealt(spread, parts, *keys, "bucket__")
    low = F.greatest(F.col(f"version__.{start}"), first(F.col("bucket__")))
    high = F.least(F.col(f"version__.{end}"), F.date_add(first(F.col("bucket__")), days - 1))
    order = F.struct(F.datediff(F.lit("1970-01-01").cast("date"), F.col(f"version__.{start}")).alias("late"), F.col(f"version__.{tie}").alias("tie"))
    held = spread.withColumn("order__", order).groupBy(*keys, "bucket__", low.alias("low__"), high.alias("high__")).agg(F.min(F.struct("order__", "version__")).alias("v__"))
    held = held.groupBy(*keys, "bucket__").agg(F.array_sort(F.collect_list(F.struct(F.col("v__.order__").alias("order"), "low__", "high__", F.col("v__.version__").alias("version")))).alias("held__"))
    # versions in buckets are far more than their table's size lets Spark guess, so they are never broadcast
    rows = dealt(facts.withColumn("bucket__", number(F.col(day))), parts, *keys, "bucket__").join(held.hint("merge"), [*keys, "bucket__"], how)
    on = lambda v: reduce(lambda a, b: a & b, [v["low__"] <= F.col(day), F.col(day) <= v["high__"]])
    found = rows.withColumn("valid", F.get(F.filter("held__", on), F.lit(0))["version"]).select(*facts.columns, "valid")
    return found.filter("valid IS NOT NULL") if how == "inner" else found
