"""Contracts: named conditions that one aggregate evaluates, as a report or as an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from civicframe.functions.scalars import SAFE_INTEGER
from civicframe.operators.joins import CheckFailed


@dataclass(frozen=True)
class Check:
    """A name and an aggregate condition."""

    name: str
    holds: Column


def report(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_name, ok) from a single aggregate; a condition that is null does not hold."""
    row = df.agg(*[F.coalesce(c.holds, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks)])
    pairs = [F.struct(F.lit(c.name).alias("check_name"), F.col(f"c{i}").alias("ok")) for i, c in enumerate(checks)]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.check_name", "x.ok")


def enforce(df: DataFrame, checks: list[Check]) -> DataFrame:
    failed = [r.check_name for r in report(df, checks).filter("NOT ok").collect()]
    if failed:
        raise CheckFailed(", ".join(failed))
    return df


def headers(df: DataFrame, expected: list[str], exact: bool = True) -> None:
    """Ordered equality of column names, or (not exact) that none is missing."""
    if len(set(df.columns)) != len(df.columns):
        raise CheckFailed("doubled columns")
    missing = [c for c in expected if c not in df.columns]
    if missing or exact and df.columns != list(expected):
        raise CheckFailed(f"columns: missing {missing}, found {df.columns}")


def header_state(line: Column, sep: str, expected: list[str]) -> Column:
    """Struct of what a file's first line has against the expected order: missing and unknown columns, doubled, exact. Case and outer spaces do not count."""
    cells = F.transform(F.split(line, f"[{sep}]"), lambda c: F.lower(F.trim(c)))
    want = F.array(*map(F.lit, expected))
    return F.struct(
        F.filter(want, lambda c: ~F.array_contains(cells, c)).alias("missing"), F.filter(cells, lambda c: ~F.array_contains(want, c)).alias("unknown"),
        (F.size(cells) > F.size(F.array_distinct(cells))).alias("doubled"), (cells == want).alias("exact"),
    )


def always(condition: Column) -> Column:
    """Holds for every row; null counts as failure."""
    return F.count_if(~F.coalesce(condition, F.lit(False))) == 0


def unique(*columns: str) -> Column:
    return F.count(F.lit(1)) == F.count_distinct(F.struct(*columns))


def determines(key: str, *dependent: str) -> Column:
    """Functional dependency, over distinct pairs."""
    return F.count_distinct(F.struct(key, *dependent)) == F.count_distinct(F.struct(key))


def constant(column: str, value) -> Column:
    return always(F.col(column) == value)


def counts(expected: int, column: str | None = None) -> Column:
    return (F.count(F.lit(1)) if column is None else F.count_distinct(column)) == expected


def covers(column: str, values: list) -> Column:
    """Exactly these values occur."""
    return F.array_sort(F.collect_set(column)) == F.array_sort(F.array(*map(F.lit, values)))


def within(value: Column, target: Column, tolerance) -> Column:
    return F.abs(value - target) <= tolerance


def safe_sum(column: str) -> Column:
    return F.abs(F.coalesce(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(0))) <= SAFE_INTEGER


def both_or_none(a: str, b: str) -> Column:
    return always(F.col(a).isNull() == F.col(b).isNull())


@dataclass(frozen=True)
class Rule:
    """A named condition in standard SQL: of every row, or (each=False) of a whole group; null does not hold."""

    name: str
    holds: str
    each: bool = True

    def sql(self) -> str:
        if self.each:
            return f"count(CASE WHEN coalesce({self.holds}, false) THEN NULL ELSE 1 END) = 0"
        return f"coalesce({self.holds}, false)"


def judged(df: DataFrame, by: str, rules: list[Rule]) -> DataFrame:
    """(by, check_name, ok) for every group and rule, from one aggregate."""
    row = df.groupBy(by).agg(*[F.expr(r.sql()).alias(f"c{i}") for i, r in enumerate(rules)])
    pairs = [F.struct(F.lit(r.name).alias("check_name"), F.col(f"c{i}").alias("ok")) for i, r in enumerate(rules)]
    return row.select(by, F.explode(F.array(*pairs)).alias("x")).select(by, "x.check_name", "x.ok")


def broken(df: DataFrame, variants: list[str], changes: dict[str, str], lost: str = "false") -> DataFrame:
    """A copy of a table for each variant, with columns changed by SQL expressions over column variant and rows lost."""
    named = df.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    kept = named.filter(f"NOT ({lost})")
    return kept.select("variant", *[F.expr(changes[c]).alias(c) if c in changes else F.col(c) for c in df.columns])
