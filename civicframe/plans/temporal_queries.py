"""Releases and versions in time."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from civicframe.operators import temporal as T
from civicframe.plans.queries import query
from civicframe.plans.roles import available_years, entities, movements, read, tasks

_INDEX = "(year * 12 + month - 1)"
#: Releases by segment: some months of each, with gaps above the look back; one segment publishes some months twice.
_RELEASES = f"""m AS (SELECT DISTINCT segment, {_INDEX} AS idx FROM mov JOIN ent USING (entity)),
    rel AS (SELECT segment, idx, CASE WHEN segment = 'BUILDING' AND idx % 23 = 3 THEN 2 ELSE 1 END AS copies FROM m WHERE (idx + length(segment)) % 23 IN (0, 3)
        OR segment = 'BUILDING' AND idx % 23 = 3)"""


def _releases(spark, sf_dir) -> DataFrame:
    """Titles of monthly releases, parsed to their period."""
    months = movements(spark, sf_dir).select("entity", "year", "month").join(entities(spark, sf_dir).select("entity", "segment"), "entity").select("segment", "year", "month").distinct()
    at = T.month_index(F.col("year"), F.col("month"))
    twice = (F.col("segment") == "BUILDING") & (at % 23 == 3)
    months = months.filter(((at + F.length("segment")) % 23).isin(0, 3) | twice).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))))
    return months.select("segment", "copy", at.alias("at"))


@query(
    "s10_r01_release_as_of",
    f"""+ {_RELEASES}, q AS (SELECT entity, segment, CAST(min{_INDEX} AS INT) AS asked FROM mov JOIN ent USING (entity) GROUP BY entity, segment),
        j AS (SELECT q.*, rel.idx, rel.copies FROM q ASOF LEFT JOIN rel ON q.segment = rel.segment AND q.asked >= rel.idx)
        SELECT entity, segment, asked, CASE WHEN asked - idx < 16 THEN CAST(idx AS INT) END AS released,
        CASE WHEN idx IS NULL OR asked - idx >= 16 THEN 'missing' WHEN copies > 1 THEN 'ambiguous' ELSE 'found' END AS state FROM j""",
)
def release_as_of(spark, sf_dir):
    """The release that each entity's first month of payments sees: the last of at most 16 months, ambiguous where a month has two."""
    first = movements(spark, sf_dir).groupBy("entity").agg(F.min(T.month_index(F.col("year"), F.col("month"))).alias("asked"))
    requests = first.join(entities(spark, sf_dir).select("entity", "segment"), "entity")
    return T.as_of(requests, _releases(spark, sf_dir), ["segment"], "asked", "at").select("entity", "segment", "asked", "released", "state")


_NOW = 2001 * 12 + 6


@query(
    "r01_release_requests",
    f"""+ m AS (SELECT DISTINCT segment, year, month, {_INDEX} AS idx FROM mov JOIN ent USING (entity)),
        fin AS (SELECT segment, year, CASE WHEN length(segment) = 9 AND year % 4 = 0 THEN 2 ELSE 1 END AS copies FROM m WHERE month = 12 AND year % 2 = 0),
        rel AS (SELECT segment, idx FROM m WHERE month % 4 = length(segment) % 4),
        q AS (SELECT entity, segment, CAST(CASE WHEN entity % 5 > 0 THEN 1998 + entity % 7 END AS INT) AS year,
            CAST(CASE WHEN entity % 3 > 0 AND entity % 10 > 0 THEN entity % 14 END AS INT) AS month FROM ent),
        k AS (SELECT *, CASE WHEN year IS NULL AND month IS NULL THEN 'latest' WHEN year IS NULL OR year < 2000 THEN 'invalid' WHEN month IS NULL THEN 'year'
            WHEN month BETWEEN 1 AND 12 THEN 'month' ELSE 'invalid' END AS asked FROM q),
        b AS (SELECT *, CASE asked WHEN 'latest' THEN {_NOW} WHEN 'month' THEN {_INDEX} WHEN 'year' THEN year * 12 + 11 END AS upto,
            CASE asked WHEN 'latest' THEN 16 WHEN 'month' THEN 1 ELSE 12 END AS back FROM k),
        j AS (SELECT b.entity, b.segment, b.year, b.month, asked, fin.copies, (SELECT max(idx) FROM rel WHERE rel.segment = b.segment AND idx <= upto AND idx > upto - back) AS idx
            FROM b LEFT JOIN fin ON asked = 'year' AND b.segment = fin.segment AND b.year = fin.year)
        SELECT entity, segment, year, month, asked, CASE WHEN asked = 'invalid' THEN NULL WHEN copies > 0 THEN 'consuntivo' WHEN idx > 0 THEN 'mensile' END AS kind,
        CASE WHEN copies IS NULL AND asked <> 'invalid' THEN CAST(idx AS INT) END AS released,
        CASE WHEN asked = 'invalid' THEN 'invalid' WHEN copies > 1 THEN 'ambiguous' WHEN copies = 1 OR idx > 0 THEN 'found' ELSE 'missing' END AS state FROM j""",
)
def release_requests(spark, sf_dir):
    """A request of every kind from each entity: latest, a year (its final account or else its latest month), a month, and those that are refused."""
    months = movements(spark, sf_dir).select("entity", "year", "month").join(entities(spark, sf_dir).select("entity", "segment"), "entity").select("segment", "year", "month").distinct()
    twice = (F.length("segment") == 9) & (F.col("year") % 4 == 0)
    finals = months.filter("month = 12 AND year % 2 = 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))))
    finals = finals.select("segment", F.lit("consuntivo").alias("kind"), "year", F.lit(None).cast("int").alias("month"))
    monthly = months.filter(F.col("month") % 4 == F.length("segment") % 4).select("segment", F.lit("mensile").alias("kind"), "year", "month")
    k = F.col("entity")
    year, month = F.when(k % 5 > 0, 1998 + k % 7).cast("int"), F.when((k % 3 > 0) & (k % 10 > 0), k % 14).cast("int")
    requests = entities(spark, sf_dir).select("entity", "segment", year.alias("year"), month.alias("month"))
    return T.resolved_releases(requests, finals.unionByName(monthly), ["segment"], _NOW)


#: Five versions of each customer: gaps, overlaps, one of a day, and the last one open.
VERSIONS_SQL = """ver AS (SELECT c_custkey AS entity, k AS version, DATE '1994-06-01' + CAST(c_custkey % 400 + k * (250 + c_custkey % 97) AS INT) AS valid_from,
    CASE WHEN k = 4 THEN DATE '2100-12-31' ELSE DATE '1994-06-01' + CAST(c_custkey % 400 + k * (250 + c_custkey % 97) + CASE c_custkey % 4 WHEN 0 THEN 200 WHEN 1 THEN 249 + c_custkey % 97
        WHEN 2 THEN 900 ELSE 0 END AS INT) END AS valid_to FROM customer, (VALUES (0), (1), (2), (3), (4)) AS v(k))"""


def versions(spark, sf_dir) -> DataFrame:
    """entity, version, valid_from and valid_to."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.explode(F.array(*map(F.lit, range(5)))).alias("version"))
    shift = F.col("entity") % 400 + F.col("version") * (250 + F.col("entity") % 97)
    held = F.when(F.col("entity") % 4 == 0, 200).when(F.col("entity") % 4 == 1, 249 + F.col("entity") % 97).when(F.col("entity") % 4 == 2, 900).otherwise(0)
    begin = F.lit("1994-06-01").cast("date")
    return rows.select("entity", "version", F.date_add(begin, shift.cast("int")).alias("valid_from"), F.when(F.col("version") == 4, F.lit("2100-12-31").cast("date")).otherwise(F.date_add(begin, (shift + held).cast("int"))).alias("valid_to"))


@query(
    "f12_j05_valid_versions",
    f"""+ {VERSIONS_SQL}, p AS (SELECT row_number() OVER () AS row, entity, day, cents FROM mov),
        j AS (SELECT p.*, version, row_number() OVER (PARTITION BY row ORDER BY valid_from DESC NULLS LAST, version) AS place FROM p
            LEFT JOIN ver ON p.entity = ver.entity AND day BETWEEN valid_from AND valid_to)
        SELECT entity, version, count(*) AS payments, CAST(sum(cents) AS BIGINT) AS cents, min(day) AS first_day, max(day) AS last_day FROM j WHERE place = 1 GROUP BY entity, version""",
)
def valid_versions(spark, sf_dir):
    """Every payment meets the version of its entity that is valid on its day, or none; sums by entity and version."""
    own = T.checked_intervals(versions(spark, sf_dir), "valid_from", "valid_to")
    years = available_years(spark, sf_dir)
    span = (datetime.date(min(years), 1, 1), datetime.date(max(years), 12, 31)) if years else None
    found = T.valid_at(movements(spark, sf_dir).select("entity", "day", "cents"), own, ["entity"], "day", "valid_from", "valid_to", "version", span=span, parts=tasks(spark, sf_dir))
    return found.groupBy("entity", F.col("valid.version").alias("version")).agg(F.count(F.lit(1)).alias("payments"), F.sum("cents").alias("cents"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    "f12_active_in_year",
    f"""+ {VERSIONS_SQL}, y(year) AS (VALUES (1995), (1998), (2001)),
        a AS (SELECT year, entity, version, row_number() OVER (PARTITION BY year, entity ORDER BY valid_from DESC, version) AS place FROM ver, y
            WHERE valid_from <= make_date(year, 12, 31) AND valid_to >= make_date(year, 1, 1))
        SELECT CAST(year AS INT) AS year, version, count(*) AS entities FROM a WHERE place = 1 GROUP BY year, version""",
)
def active_in_year(spark, sf_dir):
    """The version of each entity whose validity meets a year, the last to start, for three years; counted by version."""
    from civicframe.operators.joins import keep_latest

    years = F.explode(F.array(*map(F.lit, (1995, 1998, 2001))))
    rows = T.checked_intervals(versions(spark, sf_dir), "valid_from", "valid_to").withColumn("year", years)
    rows = rows.filter("valid_from <= make_date(year, 12, 31) AND valid_to >= make_date(year, 1, 1)")
    return keep_latest(rows, ["year", "entity"], "valid_from", "version").groupBy("year", "version").agg(F.count(F.lit(1)).alias("entities"))
