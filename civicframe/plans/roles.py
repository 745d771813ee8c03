"""The roles that the driver's tables play: movements, entities, regions, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from civicframe.functions.scalars import cents, title_digit
from civicframe.operators.cube import Cube, Level
from civicframe.operators.joins import dealt
from civicframe.sources.shared import shared_folder
from civicframe.sources.sinks import Folder


_schemas: dict[tuple[str, str], tuple[tuple, StructType]] = {}
_rows: dict[tuple[str, str], tuple[tuple, int]] = {}
#: Rows of a task, so that what it sorts and groups stays small whatever the tables' size; with at most FEW tasks the choice is left to Spark.
TASK_ROWS, FEW = 200_000, 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once for each state that they are in."""
    path = f"{sf_dir}/{name}.parquet"
    folder = Folder(spark, path)
    state = folder.state() if folder.exists() else None
    key = (spark.sparkContext.applicationId, path)
    if state is None or _schemas.get(key, (None,))[0] != state:
        table = spark.read.parquet(path)
        _schemas[key] = (state, table.schema)
        return table
    return spark.read.schema(_schemas[key][1]).parquet(path)


def tasks(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int | None:
    """Tasks for the rows of a table, which are counted once for each state of its files; None where they are few."""
    path = f"{sf_dir}/{name}.parquet"
    folder = Folder(spark, path)
    state = folder.state() if folder.exists() else None
    key = (spark.sparkContext.applicationId, path)
    if state is None or _rows.get(key, (None,))[0] != state:
        _rows[key] = (state, read(spark, sf_dir, name).count())
    n = -(-_rows[key][1] // TASK_ROWS)
    return n if n > FEW else None


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, supplier, part, number, line, year, month, day, cents of every payment; of large tables by number over tasks of bounded size."""
    n = tasks(spark, sf_dir)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.to_date("o_orderdate").alias("day"))
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"),
        cents(F.col("l_extendedprice")).alias("cents"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    return dealt(lines, n, "number").join(dealt(orders, n, "o_orderkey"), F.col("number") == F.col("o_orderkey")).drop("o_orderkey")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), title_digit(F.substring_index("p_brand", "#", -1)).alias("title"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, name, region, people (unknown for a balance of one or less), balance_cents."""
    customer = read(spark, sf_dir, "customer")
    return customer.select(
        F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") > 1, F.floor("c_acctbal").cast("bigint")).alias("people"), cents(F.col("c_acctbal")).alias("balance_cents"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, area = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(area, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("region_name"), F.col("r_name").alias("area"))


#: Stored levels of payments, the finest first.
LEVELS = (Level("payments", ("year", "month", "entity", "title"), "year"), Level("entity_title", ("entity", "title")), Level("entity_year", ("entity", "year")), Level("title_month", ("title", "year", "month")))
_cubes: dict[tuple[str, str], tuple[tuple, Cube]] = {}


def payments_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Sums and counts of payments at some levels, written once for an application and the state that the tables are in."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = tuple(Folder(spark, f"{sf_dir}/{t}.parquet").state() for t in ("lineitem", "orders", "part"))
    known = _cubes.get(key)
    if known is None or known[0] != state or not all(Folder(spark, f"{known[1].path}/{level.name}/_SUCCESS").exists() for level in LEVELS):
        rows = movements(spark, sf_dir).join(titles(spark, sf_dir), "part")
        cube = Cube.build(rows, shared_folder(spark, "payments"), list(LEVELS), {"cents": F.sum("cents"), "lines": F.count(F.lit(1))}, tasks(spark, sf_dir))
        known = _cubes[key] = (state, cube)
    return known[1]


def entity_totals(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """One row per entity with movements (of a year): total_cents, title_cents (title 1), joined with the entity."""
    title = F.coalesce(F.sum(F.when(F.col("title") == "1", F.col("cents"))), F.lit(0)).cast("bigint")
    where, needs = (None, ("title",)) if year is None else (F.col("year") == year, ("title", "year"))
    sums = payments_cube(spark, sf_dir).sums(["entity"], where, needs, {"title_cents": title})
    return sums.select("entity", F.col("cents").alias("total_cents"), "title_cents").join(entities(spark, sf_dir), "entity")


def available_years(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    """Years with payments, each with its last month."""
    months = payments_cube(spark, sf_dir).sums(["year", "month"], needs=("title",))
    return {r.year: r.month for r in months.groupBy("year").agg(F.max("month").alias("month")).collect()}


#: The same roles in SQL, as common table expressions.
SQL = """
mov AS (SELECT l_orderkey AS number, l_linenumber AS line, l_suppkey AS supplier, l_partkey AS part, l_returnflag AS flag,
        l_linestatus AS status,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS cents, o_custkey AS entity,
    CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(o_orderdate AS DATE) AS day
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tit AS (SELECT p_partkey AS part, coalesce(nullif(regexp_extract(p_brand, '#.*?(\\d)', 1), ''), '?') AS title FROM part),
ent AS (SELECT c_custkey AS entity, c_name AS name, c_nationkey AS region, c_mktsegment AS segment,
    CASE WHEN c_acctbal > 1 THEN CAST(floor(c_acctbal) AS BIGINT) END AS people, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * 100,
        0) AS BIGINT) AS balance_cents FROM customer),
reg AS (SELECT n_nationkey AS region, n_name AS region_name, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey),
tot AS (SELECT entity, CAST(sum(cents) AS BIGINT) AS total_cents, CAST(coalesce(sum(cents) FILTER (title = '1'),
        0) AS BIGINT) AS title_cents
    FROM mov JOIN tit USING (part) GROUP BY entity),
et AS (SELECT * FROM tot JOIN ent USING (entity))
"""
