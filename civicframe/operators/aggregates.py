"""Aggregations with explicit rules for nulls, empty groups and zero denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The population bands, half-open.
POPULATION_BANDS = (
    ("under-1000", None, 1000), ("1000-4999", 1000, 5000), ("5000-19999", 5000, 20000), ("20000-49999", 20000, 50000),
    ("50000-99999", 50000, 100000), ("100000-249999", 100000, 250000), ("250000-499999", 250000, 500000), ("500000-plus", 500000, None),
)
PROBABILITIES = (("p10", 0.10), ("p25", 0.25), ("p50", 0.50), ("p75", 0.75), ("p90", 0.90))


def group_sum(df: DataFrame, key: str, label: str, order: str, value: str) -> DataFrame:
    """Sum by key with the label of the first row in order."""
    return df.groupBy(key).agg(F.min_by(label, order).alias("label"), F.sum(value).alias("value"))


def unpivoted_sums(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """Column sums as rows, positive ones only."""
    return df.agg(*[F.sum(c).alias(c) for c in columns]).unpivot([], columns, name, value).filter(f"{value} > 0")


def suppressed(frequency: Column, amount: Column) -> list[Column]:
    """The additive triple: known frequency, known amount, rows of which either is withheld. Null is not zero."""
    known = frequency.isNotNull() & amount.isNotNull()
    return [
        F.coalesce(F.sum(F.when(known, frequency)), F.lit(0)).cast("bigint").alias("known_frequency"),
        F.coalesce(F.sum(F.when(known, amount)), F.lit(0)).cast("bigint").alias("known_amount_cents"),
        F.count_if(~known).alias("suppressed_rows"),
    ]


def banded(df: DataFrame, people: str, bands=POPULATION_BANDS) -> Column:
    out = F
    for name, low, high in bands:
        inside = (F.col(people) >= low if low is not None else F.lit(True)) & (F.col(people) < high if high is not None else F.lit(True))
        out = out.when(F.col(people).isNotNull() & inside, name)
    return out


def band_table(spark, bands=POPULATION_BANDS) -> DataFrame:
    return spark.createDataFrame([(i, b[0]) for i, b in enumerate(bands)], "ord int, band string")


def weighted_nearest_rank(df: DataFrame, keys: list[str], value: str, weight: str, probabilities=PROBABILITIES) -> DataFrame:
    """For each group the first value, in order, whose cumulative weight reaches p times the total.

    Weights are summed up by distinct value and by ranges of values first, so no task sorts all values of a group.
    Rows without value or positive weight do not count; a group of none has no row.
    """
    found = ranks(df.filter(F.col(weight) > 0), keys, value, weight=weight)
    reach = lambda p: F.col("upto").cast("double") >= F.lit(p) * F.col("n").cast("double")
    return found.groupBy(*keys).agg(*[F.min(F.when(reach(p), F.col(value))).alias(n) for n, p in probabilities])


def ranks(df: DataFrame, by: list[str], value: str, parts: int = 64, weight: str | None = None) -> DataFrame:
    """by, value, upto (rows, or weights, of the group up to the value) and n (of the whole group), for every distinct value.

    Nulls do not count. Values fall into ranges between approximate quantiles, and running counts go over the ranges'
    sums first, so that no task sorts all values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("c__"))
    cuts = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("cuts__"))
    # one row
    placed = counts.crossJoin(F.broadcast(cuts)).withColumn("part__", F.size(F.filter("cuts__", lambda c: c < F.col(value)))).drop("cuts__")
    before = W.partitionBy(*by).orderBy("part__").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "part__").agg(F.sum("c__").alias("s__"))
    sums = sums.withColumn("low__", F.coalesce(F.sum("s__").over(before), F.lit(0))).withColumn("n", F.sum("s__").over(W.partitionBy(*by)))
    inside = W.partitionBy(*by, "part__").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("low__") + F.sum("c__").over(inside)
    return placed.join(sums.drop("s__"), [*by, "part__"]).select(*by, value, upto.alias("upto"), "n")


def at_rank(rank: Column, value: str) -> Column:
    """Aggregate: the value at a rank counted from 0."""
    return F.min(F.when(F.col("upto") > rank, F.col(value)))


def linear_quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """by, n and quantiles by linear interpolation over ranks; groups without a value have no row."""
    picks = []
    for name, p in probabilities.items():
        place = (F.col("n") - 1) * F.lit(p)
        low = F.floor(place)
        picks += [at_rank(low, value).alias(f"{name}_a"), at_rank(F.least(low + 1, F.col("n") - 1), value).alias(f"{name}_b")]
    found = ranks(df, by, value).groupBy(*by, "n").agg(*picks)

    def between(name: str, p: float) -> Column:
        place, a, b = (F.col("n") - 1) * F.lit(p), F.col(f"{name}_a").cast("double"), F.col(f"{name}_b").cast("double")
        return (a + (place - F.floor(place)) * (b - a)).alias(name)

    return found.select(*by, "n", *[between(name, p) for name, p in probabilities.items()])


def floor_index_breaks(df: DataFrame, value: str, fractions=(0.2, 0.4, 0.6, 0.8), by: list[str] | None = None) -> DataFrame:
    """Class breaks values[min(n - 1, floor(n f))] of the values without nulls, of all rows or by group; one row of nulls where there is no row."""
    picks = [at_rank(F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(f))), value).alias(f"break_{i + 1}") for i, f in enumerate(fractions)]
    return ranks(df, by or [], value).groupBy(*(by or [])).agg(*picks)


def tukey(df: DataFrame, cohort: str, value: str, k: float = 1.5, least: int = 4) -> DataFrame:
    """Fences of each cohort; cohorts below least keep their row, without quantiles and with nothing evaluated."""
    if not 0 < k < float("inf"):
        raise ValueError("k must be a positive number")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    enough = F.col("n") >= least
    q = linear_quantiles(df, [cohort], value, {"q1": 0.25, "q3": 0.75})
    q = df.select(cohort).distinct().join(q, cohort, "left").withColumn("n", n)
    q = q.withColumn("q1", F.when(enough, F.col("q1"))).withColumn("q3", F.when(enough, F.col("q3"))).withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.select(cohort, "n", F.when(enough, F.col("n")).otherwise(0).alias("evaluated"), "q1", "q3", "iqr", (F.col("q1") - k * F.col("iqr")).alias("lower"), (F.col("q3") + k * F.col("iqr")).alias("upper"))


def outliers(df: DataFrame, cohort: str, value: str, code: str, k: float = 1.5, least: int = 4) -> DataFrame:
    """Rows strictly beyond their cohort's fences: direction, distance and its multiple of the range (null when that is 0)."""
    rows = df.join(tukey(df, cohort, value, k, least), cohort)
    above, below = F.col(value) > F.col("upper"), F.col(value) < F.col("lower")
    distance = F.when(above, F.col(value) - F.col("upper")).otherwise(F.col("lower") - F.col(value))
    return rows.filter(above | below).select(code, cohort, value, F.when(above, "above").otherwise("below").alias("direction"), distance.alias("distance"), F.try_divide(distance, F.col("iqr")).alias("multiple"))
