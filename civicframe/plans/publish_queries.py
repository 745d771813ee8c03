"""Publishing, refreshing and reading back, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from civicframe.functions.scalars import cents
from civicframe.operators.contracts import Rule
from civicframe.plans.queries import query
from civicframe.plans.roles import movements, read
from civicframe.sources.publish import publish, read_published, refresh
from civicframe.sources.shared import shared_folder


@query(
    "k01_k03_k04_s25_v24_published",
    "SELECT supplier, flag, status, count(*) AS lines, CAST(sum(cents) AS BIGINT) AS cents, min(day) AS first_day, max(day) AS last_day FROM mov GROUP BY supplier, flag, status",
)
def published(spark, sf_dir):
    """Sums by supplier, published with their rules, count and digest from the writing job, and read back against the manifest of their parts."""
    sums = movements(spark, sf_dir).groupBy("supplier", "flag", "status").agg(F.count(F.lit(1)).alias("lines"), F.sum("cents").alias("cents"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    rules = [Rule("lines", "lines > 0"), Rule("cents", "cents >= 0"), Rule("days", "first_day <= last_day"), Rule("flag", "flag IN ('A', 'N', 'R')")]
    where = shared_folder(spark, "published")
    publish(sums, where, rules, {"dataset": "supplier sums"})
    return read_published(spark, where)


#: The later state of orders: some totals change in the first quarters, a month is gone, another is new.
_LATER = """later AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 997 = 0 AND month(o_orderdate) <= 3 THEN 1 ELSE 0 END AS price,
    CAST(year(o_orderdate) + CASE WHEN o_orderkey % 777 = 0 AND year(o_orderdate) = 2001 THEN 1 ELSE 0 END AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month
    FROM orders WHERE NOT (year(o_orderdate) = 1996 AND month(o_orderdate) = 2))"""


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """orderkey, price, year and month of orders as they are, and of their later state."""
    own = read(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("price"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    later = own.filter("NOT (year = 1996 AND month = 2)")
    later = later.withColumn("price", F.col("price") + F.when((F.col("o_orderkey") % 997 == 0) & (F.col("month") <= 3), 100).otherwise(0))
    later = later.withColumn("year", F.col("year") + F.when((F.col("o_orderkey") % 777 == 0) & (F.col("year") == 2001), 1).otherwise(0))
    return own, later


def _files(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("year", "month").agg(F.array_sort(F.collect_set(F.col("_metadata.file_name"))).alias("files"), F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


@query(
    "k02_k06_refreshed_partitions",
    f"""WITH own AS (SELECT o_orderkey, o_totalprice AS price, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month FROM orders), {_LATER},
        d AS (SELECT DISTINCT year, month FROM ((SELECT * FROM own EXCEPT SELECT * FROM later) UNION ALL (SELECT * FROM later EXCEPT SELECT * FROM own))),
        a AS (SELECT year, month FROM own GROUP BY ALL), b AS (SELECT year, month, count(*) AS n,
            CAST(sum(CAST(round(CAST(price AS DECIMAL(18,2)) * 100, 0) AS BIGINT)) AS BIGINT) AS price FROM later GROUP BY ALL)
        SELECT year, month, CASE WHEN b.n IS NULL THEN 'removed' WHEN a.year IS NULL THEN 'added' WHEN d.year IS NULL THEN 'same' ELSE 'changed' END AS state,
        coalesce(n, 0) AS n, coalesce(price, 0) AS price, d.year IS NOT NULL AS rewritten
        FROM (SELECT * FROM a UNION SELECT year, month FROM b) LEFT JOIN (SELECT year, month, 1 AS one FROM a) a1 USING (year, month) LEFT JOIN a USING (year, month)
        LEFT JOIN b USING (year, month) LEFT JOIN d USING (year, month)""",
    roles=False,
)
def refreshed_partitions(spark, sf_dir):
    """Orders by month, brought to their later state: what differed by the digest tree, what the table then holds, and which partitions have other files."""
    own, later = _orders(spark, sf_dir)
    where = shared_folder(spark, "orders")
    refresh(own, where, ["year", "month"], "o_orderkey")
    files = shared_folder(spark, "files")
    _files(spark, f"{where}/data").write.parquet(files)
    before = spark.read.parquet(files).select("year", "month", F.col("files").alias("before"))
    changes = refresh(later, where, ["year", "month"], "o_orderkey")
    after = _files(spark, f"{where}/data").join(before, ["year", "month"], "full_outer").join(changes, ["year", "month"], "full_outer")
    return after.select(
        "year", "month", F.coalesce("state", F.lit("same")).alias("state"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("price", F.lit(0)).alias("price"),
        (~F.col("files").eqNullSafe(F.col("before"))).alias("rewritten"),
    )
