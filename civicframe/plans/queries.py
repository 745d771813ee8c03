"""The registered queries of the engine, each with its SQL. A name begins with the identifiers it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from civicframe.functions import scalars as X
from civicframe.operators import aggregates as A, contracts as V, joins as J, series as S
from civicframe.plans.roles import SQL, entities, entity_totals, movements, payments_cube, read, regions, titles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, roles: bool = True):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = f"WITH {SQL}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if roles else sql
        return build

    return register


def percent8(n, d):
    return F.round(F.try_divide(n.cast("decimal(20,0)"), d.cast("decimal(18,0)")).cast("decimal(30,12)"), 8).cast("decimal(18,8)")


RATIO = "CAST(round(CAST(CAST({n} AS DECIMAL(20,0)) AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 8) AS DECIMAL(18,8))"


# --- movements, totals, coverage -------------------------------------------------------------------------------


@query(
    "j01_j02_a06_region_totals",
    """SELECT region_name, CAST(sum(total_cents) AS BIGINT) AS total_cents, CAST(coalesce(sum(total_cents) FILTER (people IS NOT NULL),
        0) AS BIGINT) AS cents_with_people,
        CAST(coalesce(sum(people), 0) AS BIGINT) AS people, count(*) AS entities, count(*) FILTER (people IS NULL) AS without_people,
        CAST(round(CAST(sum(total_cents) FILTER (people IS NOT NULL) AS DOUBLE) / (sum(people) * 100), 2) AS DECIMAL(20,2)) AS per_capita
        FROM et JOIN reg USING (region) GROUP BY region_name""",
)
def region_totals(spark, sf_dir):
    """Totals by region; a head's share counts only the payments of entities whose people are known."""
    known = F.col("people").isNotNull()
    rows = entity_totals(spark, sf_dir).join(regions(spark, sf_dir), "region")
    found = rows.groupBy("region_name").agg(
        F.sum("total_cents").alias("total_cents"), F.coalesce(F.sum(F.when(known, F.col("total_cents"))), F.lit(0)).alias("cents_with_people"),
        F.coalesce(F.sum("people"), F.lit(0)).alias("people"), F.count(F.lit(1)).alias("entities"), F.count_if(~known).alias("without_people"),
    )
    return found.withColumn("per_capita", X.per_capita(F.col("cents_with_people"), F.col("people")))


@query(
    "j02_left_join_unmatched",
    """SELECT coalesce(region_name, 'none') AS region_name, CAST(sum(total_cents) AS BIGINT) AS total_cents FROM et LEFT JOIN (SELECT * FROM reg
        WHERE area <> 'ASIA') r USING (region) GROUP BY 1""",
)
def left_join_unmatched(spark, sf_dir):
    """Entities of an unknown region stay in the total, apart."""
    known = regions(spark, sf_dir).filter("area <> 'ASIA'")
    return entity_totals(spark, sf_dir).join(known, "region", "left").groupBy(F.coalesce("region_name", F.lit("none")).alias("region_name")).agg(F.sum("total_cents").alias("total_cents"))


@query(
    "a05_grouping_sets",
    """SELECT CAST(grouping_id(entity, title, region, month) AS BIGINT) AS level, entity, title, region, month, CAST(sum(cents) AS BIGINT) AS cents
        FROM mov JOIN tit USING (part) JOIN ent USING (entity)
        GROUP BY GROUPING SETS ((entity), (entity, title), (region), (title), (month))""",
)
def grouping_sets(spark, sf_dir):
    """By entity, entity and title, region, title, month: each from the coarsest stored level that has its keys."""
    cube = payments_cube(spark, sf_dir)
    by_entity = cube.sums(["entity", "title"]).join(entities(spark, sf_dir).select("entity", "region"), "entity")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kinds = dict(by_entity.dtypes) | {"month": "int"}
    found = None
    for level, keys, rows in ((7, ["entity"], by_entity), (3, ["entity", "title"], by_entity), (13, ["region"], by_entity), (11, ["title"], cube.sums(["title"])), (14, ["month"], cube.sums(["month"]))):
        part = rows.groupBy(*keys).agg(F.sum("cents").alias("cents"))
        part = part.select(F.lit(level).cast("bigint").alias("level"), *[F.col(c) if c in keys else null(c, kinds[c]) for c in ("entity", "title", "region", "month")], "cents")
        found = part if found is None else found.unionByName(part)
    return found


@query(
    "a07_a10_coverage",
    """SELECT count(*) AS movements, count(*) FILTER (people IS NOT NULL) AS with_people,
        CAST(sum(total_cents) FILTER (people IS NULL) AS BIGINT) AS cents_without_people,
        count(*) FILTER (region % 5 <> 0) AS with_region, count(*) FILTER (people IS NOT NULL AND region % 5 <> 0) AS with_both,
        CAST(sum(people) FILTER (region % 5 <> 0) AS BIGINT) AS regional_people, CAST(sum(title_cents) AS BIGINT) AS title_cents FROM et""",
)
def coverage(spark, sf_dir):
    people, regional = F.col("people").isNotNull(), F.col("region") % 5 != 0
    return entity_totals(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("movements"), F.count_if(people).alias("with_people"), F.sum(F.when(~people, F.col("total_cents"))).alias("cents_without_people"),
        F.count_if(regional).alias("with_region"), F.count_if(people & regional).alias("with_both"), F.sum(F.when(regional, F.col("people"))).alias("regional_people"), F.sum("title_cents").alias("title_cents"),
    )


_BANDS = " ".join(f"WHEN people IS NOT NULL {f'AND people >= {low}' if low is not None else ''} {f'AND people < {high}' if high is not None else ''} THEN '{name}'" for name, low, high in A.POPULATION_BANDS)
_BAND_ROWS = ", ".join(f"({i}, '{b[0]}')" for i, b in enumerate(A.POPULATION_BANDS))


@query(
    "a08_a09_a11_distribution_bands",
    f"""+ bands(ord, band) AS (VALUES {_BAND_ROWS}), b AS (SELECT *, CASE {_BANDS} END AS band FROM et)
        SELECT CAST(ord AS INT) AS ord, bands.band, count(entity) AS n, CAST(coalesce(sum(people), 0) AS BIGINT) AS people,
        CAST(coalesce(sum(title_cents), 0) AS BIGINT) AS title_cents,
        CAST(coalesce(sum(total_cents), 0) AS BIGINT) AS total_cents,
        {RATIO.format(n="coalesce(sum(title_cents), 0)", d="sum(total_cents)")} AS share
        FROM bands LEFT JOIN b ON bands.band = b.band GROUP BY ord, bands.band""",
)
def distribution_bands(spark, sf_dir):
    """Eight fixed bands, empty ones too."""
    rows = entity_totals(spark, sf_dir).withColumn("band", A.banded(None, "people"))
    sums = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("people").alias("people"), F.sum("title_cents").alias("title_cents"), F.sum("total_cents").alias("total_cents"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "people", "title_cents", "total_cents")}
    return A.band_table(spark).join(sums, "band", "left").select("ord", "band", *zero.values()).withColumn("share", percent8(F.col("title_cents"), F.col("total_cents")))


def _weighted_sql(weight: str) -> str:
    picks = ", ".join(f"min(v) FILTER (cum >= CAST({p} AS DOUBLE) * total) AS {n}" for n, p in A.PROBABILITIES)
    return f"""+ q AS (SELECT region, title_cents AS v, {weight} AS w FROM et WHERE people > 0),
        r AS (SELECT region, v, CAST(sum(w) OVER (PARTITION BY region
        ORDER BY v RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS cum, CAST(sum(w) OVER (PARTITION BY region) AS DOUBLE) AS total FROM q)
        SELECT region, {picks} FROM r GROUP BY region"""


@query("a20_w07_weighted_quantiles", _weighted_sql("people"))
def weighted_quantiles(spark, sf_dir):
    """Weighted nearest rank, residents as weights."""
    return A.weighted_nearest_rank(entity_totals(spark, sf_dir).filter("people > 0"), ["region"], "title_cents", "people")


@query("a20_entity_quantiles", _weighted_sql("1"))
def entity_quantiles(spark, sf_dir):
    """The same with every entity weighing one."""
    return A.weighted_nearest_rank(entity_totals(spark, sf_dir).filter("people > 0").withColumn("one", F.lit(1)), ["region"], "title_cents", "one")


_FENCES = """+ q AS (SELECT region, count(balance_cents) AS n, CASE WHEN count(balance_cents) >= 4 THEN quantile_cont(CAST(balance_cents AS DOUBLE), 0.25) END AS q1,
        CASE WHEN count(balance_cents) >= 4 THEN quantile_cont(CAST(balance_cents AS DOUBLE), 0.75) END AS q3 FROM ent GROUP BY region)"""


@query("a21_a23_a24_fences", _FENCES + """ SELECT region, n, CASE WHEN n >= 4 THEN n ELSE 0 END AS evaluated, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower,
        q3 + 1.5 * (q3 - q1) AS upper FROM q""")
def fences(spark, sf_dir):
    return A.tukey(entities(spark, sf_dir), "region", "balance_cents")


_OUT = """, s AS (SELECT entity, name, people, ent.region, total_cents AS v FROM et AS ent),
        q2 AS (SELECT region, quantile_cont(CAST(v AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(v AS DOUBLE), 0.75) AS q3 FROM s GROUP BY region HAVING count(*) >= 4)
        SELECT entity, region, v AS total_cents, CASE WHEN v > q3 + 1.5 * (q3 - q1) THEN 'above' ELSE 'below' END AS direction,
        CASE WHEN v > q3 + 1.5 * (q3 - q1) THEN v - (q3 + 1.5 * (q3 - q1)) ELSE q1 - 1.5 * (q3 - q1) - v END AS distance,
        CASE WHEN v > q3 + 1.5 * (q3 - q1) THEN v - (q3 + 1.5 * (q3 - q1)) ELSE q1 - 1.5 * (q3 - q1) - v END / nullif(q3 - q1, 0) AS multiple
        FROM s JOIN q2 USING (region) WHERE v > q3 + 1.5 * (q3 - q1) OR v < q1 - 1.5 * (q3 - q1)"""


@query("a26_f15_o05_outliers", _FENCES + _OUT)
def outlier_screen(spark, sf_dir):
    rows = A.outliers(entity_totals(spark, sf_dir), "region", "total_cents", "entity")
    return rows.orderBy(F.col("multiple").desc_nulls_last(), F.col("distance").desc(), "entity")


@query(
    "a25_x30_band_sensitivity",
    """+ b AS (SELECT *, CASE WHEN people IS NULL THEN 'non-disponibile' WHEN people < 1000 THEN 'meno-di-1.000'
        WHEN people < 5000 THEN '1.000-4.999' WHEN people < 20000 THEN '5.000-19.999' ELSE '20.000-o-piu' END AS band FROM et),
        q AS (SELECT band, region, count(*) AS n, quantile_cont(CAST(total_cents AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(total_cents AS DOUBLE), 0.75) AS q3 FROM b GROUP BY band, region),
        f AS (SELECT b.band, count(*) FILTER (n >= 4) AS evaluated,
        count(*) FILTER (n >= 4 AND (total_cents > q3 + 1.5 * (q3 - q1) OR total_cents < q1 - 1.5 * (q3 - q1))) AS outliers FROM b
        JOIN q ON b.band = q.band AND b.region = q.region GROUP BY b.band),
        o(band) AS (VALUES ('meno-di-1.000'), ('1.000-4.999'), ('5.000-19.999'), ('20.000-o-piu'), ('non-disponibile'))
        SELECT o.band, coalesce(evaluated, 0) AS evaluated, coalesce(outliers, 0) AS outliers FROM o LEFT JOIN f ON o.band = f.band""",
)
def band_sensitivity(spark, sf_dir):
    """Outliers within population band and region; every band has a row."""
    rows = entity_totals(spark, sf_dir).withColumn("band", X.population_band(F.col("people"))).withColumn("cohort", F.concat_ws("|", "band", "region"))
    fenced = rows.join(A.tukey(rows, "cohort", "total_cents"), "cohort")
    beyond = (F.col("total_cents") > F.col("upper")) | (F.col("total_cents") < F.col("lower"))
    found = fenced.groupBy("band").agg(F.count_if(F.col("evaluated") > 0).alias("evaluated"), F.count_if(F.coalesce(beyond, F.lit(False))).alias("outliers"))
    bands = spark.createDataFrame([(b,) for b in ("meno-di-1.000", "1.000-4.999", "5.000-19.999", "20.000-o-piu", "non-disponibile")], "band string")
    return bands.join(found, "band", "left").select("band", F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("outliers", F.lit(0)).alias("outliers"))


# --- series ------------------------------------------------------------------------------------------------------


@query(
    "w01_f19_x34_month_flows",
    """+ m AS (SELECT year, month, CAST(sum(cents) AS BIGINT) AS flow FROM mov
        GROUP BY year, month), o AS (SELECT CAST(max(year) AS INT) AS y, max(day) AS observed FROM mov),
        l AS (SELECT year, max(month) AS latest FROM m GROUP BY year)
        SELECT year, month, flow, CAST(sum(flow) OVER (PARTITION BY year ORDER BY month) AS BIGINT) AS cumulative FROM m
        JOIN l USING (year), o WHERE NOT (year = year(observed) AND month = latest)""",
)
def month_flows(spark, sf_dir):
    """Flows and running totals of the months that are complete."""
    months = movements(spark, sf_dir).groupBy("year", "month").agg(F.sum("cents").alias("flow"), F.max("day").alias("seen"))
    by_year = W.partitionBy("year")
    run = S.running_total(months, ["year"], "month", "flow").withColumn("latest", F.max("month").over(by_year)).withColumn("observed", F.max("seen").over(by_year))
    latest_year = months.agg(F.max("seen").alias("now"))
    return run.crossJoin(F.broadcast(latest_year)).filter(X.completed_month(F.col("year"), F.col("month"), F.col("latest"), F.col("now"))).select("year", "month", "flow", "cumulative")


_GAP = """+ m AS (SELECT year, month, CAST(sum(sum(cents)) OVER (PARTITION BY year ORDER BY month) AS BIGINT) AS cumulative FROM mov
        GROUP BY year, month), g AS (SELECT * FROM m WHERE month <> 3)"""


@query("w02_gap_safe_flows", _GAP + """ SELECT year, month, cumulative, CASE WHEN month = 1 THEN cumulative
        WHEN lag(month) OVER w = month - 1 THEN cumulative - lag(cumulative) OVER w END AS flow FROM g WINDOW w AS (PARTITION BY year
        ORDER BY month)""")
def gap_safe_flows(spark, sf_dir):
    """Cumulative values, March lost, back to flows."""
    months = movements(spark, sf_dir).groupBy("year", "month").agg(F.sum("cents").alias("cents"))
    cumulative = S.running_total(months, ["year"], "month", "cents").filter("month <> 3").select("year", "month", "cumulative")
    return S.flows(cumulative, ["year"], "month", "cumulative")


@query("w03_missing_months", _GAP + """ SELECT year, CAST(e.month AS INT) AS month FROM (SELECT year, unnest(range(1, max(month) + 1)) AS month FROM g GROUP BY year) e
        WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.year = e.year AND g.month = e.month)""")
def lost_months(spark, sf_dir):
    months = movements(spark, sf_dir).select("year", "month").distinct().filter("month <> 3")
    return S.missing_months(months, ["year"], "month")


@query(
    "w04_x16_yearly_changes",
    """+ y AS (SELECT region, year, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity)
        GROUP BY region, year), c AS (SELECT *, lag(cents) OVER (PARTITION BY region ORDER BY year) AS before FROM y)
        SELECT region, year, cents, cents - before AS change, CASE WHEN before = 0 THEN 0.0
        WHEN before IS NOT NULL THEN floor(CAST(cents - before AS DOUBLE) / CAST(before AS DOUBLE) * 1000 + 0.5) / 10 END AS change_pct FROM c""",
)
def yearly_changes(spark, sf_dir):
    years = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region"), "entity").groupBy("region", "year").agg(F.sum("cents").alias("cents"))
    return S.changes(years, ["region"], "year", "cents")


@query("w05_a16_top_by_value", "SELECT entity, total_cents FROM et ORDER BY total_cents DESC, entity LIMIT 100")
def top_by_value(spark, sf_dir):
    return S.top(entity_totals(spark, sf_dir).select("entity", "total_cents"), [F.desc("total_cents"), F.asc("entity")], 100)


@query("w06_top_by_head", """SELECT entity, CAST(round(CAST(total_cents AS DOUBLE) / (people * 100), 2) AS DECIMAL(20,2)) AS per_capita, total_cents FROM et
        WHERE people IS NOT NULL ORDER BY per_capita DESC, total_cents DESC, entity LIMIT 100""")
def top_by_head(spark, sf_dir):
    """Ranked over all entities, not over the list by value."""
    rows = entity_totals(spark, sf_dir).filter("people IS NOT NULL").select("entity", X.per_capita(F.col("total_cents"), F.col("people")).alias("per_capita"), "total_cents")
    return S.top(rows, [F.desc("per_capita"), F.desc("total_cents"), F.asc("entity")], 100)


@query("w08_j05_keep_latest", """SELECT entity, number, day FROM (SELECT entity, number, day, row_number() OVER (PARTITION BY entity ORDER BY day DESC, number) AS k
        FROM (SELECT DISTINCT entity, number, day FROM mov)) WHERE k = 1""")
def latest_order(spark, sf_dir):
    orders = movements(spark, sf_dir).select("entity", "number", "day").distinct()
    return J.keep_latest(orders, ["entity"], "day", "number")


@query("w09_w10_increasing", """+ y AS (SELECT DISTINCT year FROM mov), l AS (SELECT year, lag(year) OVER (ORDER BY year) AS b FROM y)
        SELECT count(*) FILTER (b >= year) = 0 AS increasing, count(*) AS years FROM l""")
def increasing_years(spark, sf_dir):
    years = movements(spark, sf_dir).select("year").distinct().withColumn("series", F.lit("all"))
    return S.with_before(years, ["series"], "year", "year").agg(S.increasing(None, "year").alias("increasing"), F.count(F.lit(1)).alias("years"))


@query("w11_w12_shares", f"""+ s AS (SELECT region, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) GROUP BY region)
        SELECT region, cents, {RATIO.format(n='cents', d='(SELECT sum(cents) FROM s)')} AS share,
        {RATIO.format(n='cents', d='(SELECT max(cents) FROM s)')} AS bar FROM s""")
def shares(spark, sf_dir):
    """Share of the total and of the largest; the totals are one broadcast row."""
    sums = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region"), "entity").groupBy("region").agg(F.sum("cents").alias("cents"))
    whole = sums.agg(F.sum("cents").alias("whole"), F.max("cents").alias("most"))
    return sums.crossJoin(F.broadcast(whole)).select("region", "cents", percent8(F.col("cents"), F.col("whole")).alias("share"), percent8(F.col("cents"), F.col("most")).alias("bar"))


@query("w13_last_five", "+ y AS (SELECT year, CAST(sum(cents) AS BIGINT) AS cents FROM mov GROUP BY year) SELECT * FROM y ORDER BY year DESC LIMIT 5")
def last_five(spark, sf_dir):
    return S.top(movements(spark, sf_dir).groupBy("year").agg(F.sum("cents").alias("cents")), [F.desc("year")], 5)


@query("w14_share_intervals", """+ s AS (SELECT title, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN tit USING (part)
        GROUP BY title), c AS (SELECT *, sum(cents) OVER (ORDER BY title) AS up, sum(cents) OVER () AS t FROM s)
        SELECT title, cents, CAST(round(CAST(up - cents AS DOUBLE) / t, 8) AS DECIMAL(30,8)) AS from_share, CAST(round(CAST(up AS DOUBLE) / t,
        8) AS DECIMAL(30,8)) AS to_share FROM c""")
def slices(spark, sf_dir):
    sums = movements(spark, sf_dir).join(titles(spark, sf_dir), "part").groupBy("title").agg(F.sum("cents").alias("cents"))
    return S.share_intervals(sums, "title", "cents")


@query("a28_a38_peak_and_mean", """+ m AS (SELECT year, month, CAST(sum(cents) AS BIGINT) AS flow FROM mov GROUP BY year, month)
        SELECT year, arg_max(month, flow) AS peak_month, CAST(round(CAST(sum(flow) AS DOUBLE) / max(month), 0) AS BIGINT) AS mean_cents FROM m
        GROUP BY year""")
def peak_and_mean(spark, sf_dir):
    """First month of the largest flow; mean as the latest cumulative value over its month."""
    months = movements(spark, sf_dir).groupBy("year", "month").agg(F.sum("cents").alias("flow"))
    return months.groupBy("year").agg(F.max_by("month", F.struct("flow", -F.col("month"))).alias("peak_month"), F.round(F.sum("flow").cast("double") / F.max("month"), 0).cast("bigint").alias("mean_cents"))


@query("a29_a37_net_share", f"""+ y AS (SELECT year, CAST(sum(cents) AS BIGINT) AS total, CAST(coalesce(sum(cents) FILTER (title = '7'), 0) AS BIGINT) AS passed,
        CAST(coalesce(sum(cents) FILTER (title = '1'), 0) AS BIGINT) AS one FROM mov JOIN tit USING (part) GROUP BY year)
        SELECT year, total - passed AS net, {RATIO.format(n='one', d='(total - passed)')} AS share, year = (SELECT max(year)
        FROM y) AS is_partial FROM y""")
def net_share(spark, sf_dir):
    """Totals without title 7, the share of title 1, and whether the year is still filling."""
    rows = movements(spark, sf_dir).join(titles(spark, sf_dir), "part")
    part = lambda t: F.coalesce(F.sum(F.when(F.col("title") == t, F.col("cents"))), F.lit(0))
    years = rows.groupBy("year").agg((F.sum("cents") - part("7")).alias("net"), part("1").alias("one"))
    last = years.agg(F.max("year").alias("last"))
    return years.crossJoin(F.broadcast(last)).select("year", "net", percent8(F.col("one"), F.col("net")).alias("share"), (F.col("year") == F.col("last")).alias("is_partial"))


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("a01_t15_group_sum", "SELECT segment AS key, arg_min(name, entity) AS label, CAST(sum(balance_cents) AS BIGINT) AS value FROM ent GROUP BY segment")
def labelled_sums(spark, sf_dir):
    return A.group_sum(entities(spark, sf_dir), "segment", "name", "entity", "balance_cents").withColumnRenamed("segment", "key").orderBy(F.desc("value"), "key")


@query("a02_composite_groups", "SELECT flag, status, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n FROM mov GROUP BY flag, status")
def composite_groups(spark, sf_dir):
    return movements(spark, sf_dir).groupBy("flag", "status").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))


@query("a03_f18_unpivoted_sums", """SELECT method, cents FROM (SELECT CAST(sum(CASE WHEN flag = 'A' THEN cents END) AS BIGINT) AS a, CAST(sum(CASE
        WHEN flag = 'N' THEN cents END) AS BIGINT) AS n, CAST(sum(CASE WHEN flag = 'R' THEN cents END) AS BIGINT) AS r, CAST(0 AS BIGINT) AS z
        FROM mov) UNPIVOT (cents FOR method IN (a, n, r, z)) WHERE cents > 0""")
def unpivoted(spark, sf_dir):
    rows = movements(spark, sf_dir).select(*[F.when(F.col("flag") == c.upper(), F.col("cents")).otherwise(0).alias(c) for c in "anr"], F.lit(0).cast("bigint").alias("z"))
    return A.unpivoted_sums(rows, ["a", "n", "r", "z"], "method", "cents")


@query("a04_a33_totals", "SELECT CAST(sum(cents) AS BIGINT) AS cents, min(day) AS first_day, max(day) AS last_day FROM mov")
def totals(spark, sf_dir):
    return movements(spark, sf_dir).agg(F.sum("cents").alias("cents"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_SUPPRESSED = "CASE WHEN balance_cents >= 0 THEN people END AS f, CASE WHEN balance_cents >= 0 AND people IS NOT NULL THEN balance_cents END AS a"


@query(
    "a12_a13_u04_suppressed_rollup",
    f"""+ s AS (SELECT area, region, {_SUPPRESSED} FROM ent JOIN reg USING (region))
        SELECT CAST(grouping_id(area, region) AS BIGINT) AS level, area, region,
        CAST(coalesce(sum(f) FILTER (f IS NOT NULL AND a IS NOT NULL), 0) AS BIGINT) AS known_frequency,
        CAST(coalesce(sum(a) FILTER (f IS NOT NULL AND a IS NOT NULL), 0) AS BIGINT) AS known_amount_cents,
        count(*) FILTER (f IS NULL OR a IS NULL) AS suppressed_rows FROM s GROUP BY ROLLUP (area, region)""",
)
def suppressed_rollup(spark, sf_dir):
    """Entity to region to area to all, with withheld rows counted at every level."""
    shown = F.col("balance_cents") >= 0
    rows = entities(spark, sf_dir).join(regions(spark, sf_dir), "region").select("area", "region", F.when(shown, F.col("people")).alias("f"), F.when(shown & F.col("people").isNotNull(), F.col("balance_cents")).alias("a"))
    return rows.rollup("area", "region").agg(F.grouping_id("area", "region").cast("bigint").alias("level"), *A.suppressed(F.col("f"), F.col("a")))


@query("a14_a15_distincts", """SELECT count(DISTINCT supplier) AS suppliers, count(DISTINCT entity) AS entities, (SELECT count(*)
        FROM (SELECT DISTINCT nullif(flag, 'N') AS f, nullif(status, 'O') AS s FROM mov)) AS pairs FROM mov""")
def distincts(spark, sf_dir):
    """Exact; a struct keeps pairs with nulls."""
    pair = F.struct(F.nullif("flag", F.lit("N")), F.nullif("status", F.lit("O")))
    return movements(spark, sf_dir).agg(F.count_distinct("supplier").alias("suppliers"), F.count_distinct("entity").alias("entities"), F.count_distinct(pair).alias("pairs"))


@query("a16_top_partners", "SELECT entity, count(DISTINCT supplier) AS partners FROM mov GROUP BY entity ORDER BY partners DESC, entity LIMIT 20")
def top_partners(spark, sf_dir):
    return S.top(movements(spark, sf_dir).groupBy("entity").agg(F.count_distinct("supplier").alias("partners")), [F.desc("partners"), F.asc("entity")], 20)


_AUDIT = {
    "direct": ("l_returnflag = 'A'", lambda: F.col("l_returnflag") == "A"),
    "family": ("l_returnflag LIKE 'A%' OR l_returnflag LIKE 'R%'", lambda: F.col("l_returnflag").startswith("A") | F.col("l_returnflag").startswith("R")),
    "non_positive": ("l_extendedprice <= 0", lambda: F.col("l_extendedprice") <= 0),
    "below": ("l_extendedprice > 0 AND l_extendedprice < 40000", lambda: (F.col("l_extendedprice") > 0) & (F.col("l_extendedprice") < 40000)),
    "direct_below": ("l_returnflag = 'A' AND l_extendedprice > 0 AND l_extendedprice < 40000", lambda: (F.col("l_returnflag") == "A") & (F.col("l_extendedprice") > 0) & (F.col("l_extendedprice") < 40000)),
    "in_band": ("l_extendedprice >= 35000 AND l_extendedprice < 40000", lambda: (F.col("l_extendedprice") >= 35000) & (F.col("l_extendedprice") < 40000)),
    "band_direct": ("l_returnflag = 'A' AND l_extendedprice >= 35000 AND l_extendedprice < 40000", lambda: (F.col("l_returnflag") == "A") & (F.col("l_extendedprice") >= 35000) & (F.col("l_extendedprice") < 40000)),
    "in_scope": ("l_extendedprice > 5000 AND l_extendedprice < 90000", lambda: (F.col("l_extendedprice") > 5000) & (F.col("l_extendedprice") < 90000)),
    "scope_not_direct_above": ("l_extendedprice >= 40000 AND l_extendedprice < 90000 AND l_returnflag NOT LIKE 'A%' AND l_returnflag NOT LIKE 'R%'", lambda: (F.col("l_extendedprice") >= 40000) & (F.col("l_extendedprice") < 90000) & ~F.col("l_returnflag").startswith("A") & ~F.col("l_returnflag").startswith("R")),
    "inactive": ("l_linestatus <> 'O'", lambda: F.col("l_linestatus") != "O"),
}


@query("a17_a18_f11_f16_audit", f"""SELECT count(*) AS records, {', '.join(f'count(*) FILTER ({sql}) AS {n}' for n, (sql, _) in _AUDIT.items())},
        CAST(round(CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) * 100 / count(*), 6) AS DECIMAL(20,6)) AS direct_pct FROM lineitem""", roles=False)
def audit(spark, sf_dir):
    """All counters in one pass over four columns."""
    counters = [F.count_if(c()).alias(n) for n, (_, c) in _AUDIT.items()]
    found = read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("records"), *counters)
    return found.withColumn("direct_pct", X.percentage(F.col("direct"), F.col("records")))


@query("a19_frequencies", "SELECT coalesce(nullif(trim(replace(event_type, 'click', ' ')), ''), 'NON INDICATA') AS label, count(*) AS n FROM events GROUP BY 1", roles=False)
def frequencies(spark, sf_dir):
    """Blank labels count under a name of their own; most frequent first."""
    label = F.coalesce(F.nullif(F.trim(F.replace("event_type", F.lit("click"), F.lit(" "))), F.lit("")), F.lit("NON INDICATA"))
    return read(spark, sf_dir, "events").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@query("a22_class_breaks", "+ v AS (SELECT list_sort(list(total_cents)) AS l, count(*) AS n FROM et) SELECT " + ", ".join(f"l[least(n, CAST(floor(n * {f}) AS INT) + 1)] AS break_{i + 1}" for i, f in enumerate((0.2, 0.4, 0.6, 0.8))) + " FROM v")
def class_breaks(spark, sf_dir):
    return A.floor_index_breaks(entity_totals(spark, sf_dir), "total_cents")


@query(
    "a27_j14_areas",
    """SELECT area, CAST(sum(total_cents) AS BIGINT) AS cents, CAST(nullif(sum(people), 0) AS BIGINT) AS people,
        count(DISTINCT region) AS regions, CAST(round(CAST(sum(total_cents) AS DOUBLE) / (sum(people) * 100), 2) AS DECIMAL(20,2)) AS per_capita
        FROM et JOIN reg USING (region) GROUP BY area""",
)
def areas(spark, sf_dir):
    """Ratio of sums, not mean of ratios; every region must have an area."""
    rows = J.checked_lookup(entity_totals(spark, sf_dir), regions(spark, sf_dir), "region")
    found = rows.groupBy("area").agg(F.sum("total_cents").alias("cents"), F.nullif(F.sum("people"), F.lit(0)).alias("people"), F.count_distinct("region").alias("regions"))
    return found.withColumn("per_capita", X.per_capita(F.col("cents"), F.col("people")))


@query("a30_null_totals", """SELECT CAST(coalesce(sum(people), 0) AS BIGINT) AS people, CAST(coalesce(sum(CASE
        WHEN balance_cents > 10000000 THEN balance_cents END), 0) AS BIGINT) AS large FROM ent""")
def null_totals(spark, sf_dir):
    return entities(spark, sf_dir).agg(F.coalesce(F.sum("people"), F.lit(0)).alias("people"), F.coalesce(F.sum(F.when(F.col("balance_cents") > 10000000, F.col("balance_cents"))), F.lit(0)).alias("large"))


@query("a34_a35_a36_latest", """SELECT event_type, max(ts) AS latest, min(ts) AS oldest, quantile_disc(event_id, 0.95) AS p95, quantile_cont(CAST(event_id AS DOUBLE),
        0.5) AS middle FROM events GROUP BY event_type""", roles=False)
def latest(spark, sf_dir):
    """Times by type, and over the ordered identifiers the value that 95 percent reach and the middle; no task sorts a whole type."""
    rows = read(spark, sf_dir, "events")
    place = F.ceil(F.lit(0.95) * F.col("n")) - 1
    middle = [A.at_rank(F.floor((F.col("n") - 1) / 2), "event_id"), A.at_rank(F.ceil((F.col("n") - 1) / 2), "event_id")]
    ordered = A.ranks(rows, ["event_type"], "event_id").groupBy("event_type").agg(A.at_rank(place, "event_id").alias("p95"), ((middle[0] + middle[1]) / 2).alias("middle"))
    return rows.groupBy("event_type").agg(F.max("ts").alias("latest"), F.min("ts").alias("oldest")).join(ordered, "event_type")


@query("a32_differences", """+ y AS (SELECT year, CAST(sum(cents) FILTER (flag = 'A') AS BIGINT) AS v, CAST(nullif(sum(cents) FILTER (flag = 'R'), 0) AS BIGINT) AS r
        FROM mov GROUP BY year) SELECT year, CAST(round(CAST(v - r AS DOUBLE) * 100 / r, 6) AS DECIMAL(20,6)) AS difference_pct FROM y""")
def differences(spark, sf_dir):
    sums = movements(spark, sf_dir).groupBy("year").agg(F.sum(F.when(F.col("flag") == "A", F.col("cents"))).alias("v"), F.nullif(F.sum(F.when(F.col("flag") == "R", F.col("cents"))), F.lit(0)).alias("r"))
    return sums.select("year", X.percentage(F.col("v") - F.col("r"), F.col("r")).alias("difference_pct"))


# --- joins, sets -----------------------------------------------------------------------------------------------------


@query("j03_unambiguous", "SELECT number, min(flag) AS flag FROM mov GROUP BY number HAVING count(DISTINCT flag) = 1")
def unambiguous_flags(spark, sf_dir):
    return J.unambiguous(movements(spark, sf_dir).select("number", "flag"), "number", "flag")


@query("j04_j06_checked_lookup", "SELECT segment, region_name, count(*) AS n FROM ent JOIN reg USING (region) GROUP BY segment, region_name")
def checked(spark, sf_dir):
    return J.checked_lookup(entities(spark, sf_dir), regions(spark, sf_dir), "region").groupBy("segment", "region_name").agg(F.count(F.lit(1)).alias("n"))


@query("j07_u01_key_sets", """SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN a.entity IS NULL THEN 'right' ELSE 'left' END AS only_in
        FROM (SELECT DISTINCT entity FROM mov WHERE year = 1999) a FULL JOIN (SELECT DISTINCT entity FROM mov
        WHERE year = 2000) b ON a.entity = b.entity WHERE a.entity IS NULL OR b.entity IS NULL""")
def key_sets(spark, sf_dir):
    rows = movements(spark, sf_dir)
    return J.same_keys(rows.filter("year = 1999"), rows.filter("year = 2000"), ["entity"])


@query("j08_year_guarded", """SELECT year, region, CAST(sum(cents) AS BIGINT) AS cents, CASE WHEN year = 2000 THEN CAST(max(p) AS BIGINT) END AS people FROM mov
        JOIN ent USING (entity) JOIN (SELECT region AS r, sum(people) AS p FROM ent GROUP BY region) ON region = r GROUP BY year, region""")
def year_guarded(spark, sf_dir):
    """People join only the year that they were counted in."""
    people = entities(spark, sf_dir).groupBy("region").agg(F.sum("people").alias("people")).withColumn("year", F.lit(2000))
    sums = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region"), "entity").groupBy("year", "region").agg(F.sum("cents").alias("cents"))
    return sums.join(people, ["region", "year"], "left").select("year", "region", "cents", "people")


_TENDERS = """+ t AS (SELECT number AS cup, nullif(line, 1) AS cig, CASE WHEN supplier % 3 <> 0 THEN supplier END AS user FROM mov WHERE status = 'O'),
        w AS (SELECT number AS cup, nullif(line, 1) AS cig, CASE WHEN supplier % 3 <> 0 THEN supplier END AS user, part FROM mov WHERE flag = 'N')"""


def _tenders(spark, sf_dir):
    rows = movements(spark, sf_dir).select(F.col("number").alias("cup"), F.nullif("line", F.lit(1)).alias("cig"), F.when(F.col("supplier") % 3 != 0, F.col("supplier")).alias("user"), "part", "status", "flag")
    return rows.filter("status = 'O'").select("cup", "cig", "user"), rows.filter("flag = 'N'").select("cup", "cig", "user", "part")


_MATCH = "w.cup = t.cup AND w.cig IS NOT DISTINCT FROM t.cig AND w.user IS NOT DISTINCT FROM t.user AND coalesce(t.cig, t.user) IS NOT NULL"


@query("j10_null_safe_semi", f"{_TENDERS} SELECT cup, count(*) AS linked FROM w WHERE EXISTS (SELECT 1 FROM t WHERE {_MATCH}) GROUP BY cup")
def linked_awards(spark, sf_dir):
    tenders, awards = _tenders(spark, sf_dir)
    return J.null_safe(awards, tenders, ["cup"], ["cig", "user"], "left_semi").groupBy("cup").agg(F.count(F.lit(1)).alias("linked"))


@query("j10_j20_a31_null_safe_anti", f"{_TENDERS} SELECT cup, count(*) AS unlinked FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE {_MATCH}) GROUP BY cup")
def unlinked_awards(spark, sf_dir):
    tenders, awards = _tenders(spark, sf_dir)
    return J.null_safe(awards, tenders, ["cup"], ["cig", "user"], "left_anti").groupBy("cup").agg(F.count(F.lit(1)).alias("unlinked"))


@query("j11_j13_composite_lookup", """+ c AS (SELECT * FROM (VALUES (0, 'NATION_0', 'a'), (1, 'WRONG', 'b')) AS v(code, label, identity)) SELECT region, region_name, identity
        FROM reg LEFT JOIN c ON region = code AND trim(region_name) = label""")
def composite_lookup(spark, sf_dir):
    """Code and label must both match, else there is no identity."""
    curated = spark.createDataFrame([(0, "NATION_0", "a"), (1, "WRONG", "b")], "code int, label string, identity string")
    found = regions(spark, sf_dir)
    return found.join(curated, (F.col("region") == F.col("code")) & (F.trim("region_name") == F.col("label")), "left").select("region", "region_name", "identity")


@query("j17_v10_v11_reconcile", """+ r AS (SELECT region, CAST(sum(balance_cents) AS BIGINT) AS c FROM ent GROUP BY region), p AS (SELECT region, CAST(sum(balance_cents) +
        CASE WHEN region = 3 THEN 1 ELSE 0 END AS BIGINT) AS c FROM ent WHERE region <> 7 GROUP BY region)
        SELECT coalesce(r.region, p.region) AS region, r.c AS recomputed, p.c AS published, r.c IS NOT DISTINCT FROM p.c AS ok FROM r FULL
        JOIN p ON r.region = p.region""")
def reconcile(spark, sf_dir):
    """Detail against a published table with one wrong and one missing row."""
    detail = entities(spark, sf_dir).groupBy("region").agg(F.sum("balance_cents").alias("cents"))
    published = detail.filter("region <> 7").withColumn("cents", F.col("cents") + F.when(F.col("region") == 3, 1).otherwise(0))
    return J.reconciled(detail, published, ["region"], "cents")


@query("j19_u07_set_difference", "SELECT number, line FROM mov EXCEPT ALL SELECT DISTINCT number, line FROM mov")
def set_difference(spark, sf_dir):
    """Multiset difference: the doubled keys."""
    keys = movements(spark, sf_dir).select("number", "line")
    return keys.exceptAll(keys.dropDuplicates())


@query("u02_set_minus", "SELECT entity FROM ent EXCEPT SELECT entity FROM mov")
def set_minus(spark, sf_dir):
    return entities(spark, sf_dir).select("entity").subtract(movements(spark, sf_dir).select("entity"))


@query("u03_u05_u06_union", """SELECT source, count(DISTINCT year) AS years, count(*) AS n FROM (SELECT 'a' AS source, year FROM mov WHERE flag = 'A' UNION ALL
        SELECT 'r' AS source, year FROM mov WHERE flag = 'R') GROUP BY source""")
def union_all(spark, sf_dir):
    rows = movements(spark, sf_dir)
    parts = rows.filter("flag = 'A'").select(F.lit("a").alias("source"), "year").unionByName(rows.filter("flag = 'R'").select(F.lit("r").alias("source"), "year"))
    return parts.groupBy("source").agg(F.count_distinct("year").alias("years"), F.count(F.lit(1)).alias("n"))


@query("v04_f10_doubled_keys", "SELECT number, line, count(*) AS n FROM mov GROUP BY number, line HAVING count(*) > 1")
def doubled_keys(spark, sf_dir):
    return movements(spark, sf_dir).groupBy("number", "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "v05_v08_checks",
    """+ r AS (SELECT et.*, region_name, entity % 2 AS year FROM et JOIN reg USING (region))
        SELECT 'determines' AS check_name, count(DISTINCT (region, region_name)) = count(DISTINCT region) AS ok FROM r
        UNION ALL SELECT 'does_not_determine', count(DISTINCT (region, entity)) = count(DISTINCT region) FROM r
        UNION ALL SELECT 'entities', count(*) = count(DISTINCT entity) FROM r
        UNION ALL SELECT 'safe_sum', abs(sum(CAST(total_cents AS HUGEINT))) <= 9007199254740991 FROM r
        UNION ALL SELECT 'title_le_total', count(*) FILTER (title_cents > total_cents) = 0 FROM r
        UNION ALL SELECT 'unique', count(DISTINCT entity) = count(entity) FROM r
        UNION ALL SELECT 'not_unique', count(DISTINCT region) = count(region) FROM r
        UNION ALL SELECT 'year_constant', count(*) FILTER (year <> 0) = 0 FROM r""",
)
def checks(spark, sf_dir):
    """A bundle of contracts from one aggregate."""
    rows = entity_totals(spark, sf_dir).join(regions(spark, sf_dir), "region").withColumn("year", F.col("entity") % 2)
    return V.report(
        rows,
        [
            V.Check("determines", V.determines("region", "region_name")), V.Check("does_not_determine", V.determines("region", "entity")),
            V.Check("entities", F.count(F.lit(1)) == F.count_distinct("entity")), V.Check("safe_sum", V.safe_sum("total_cents")),
            V.Check("title_le_total", V.always(F.col("title_cents") <= F.col("total_cents"))), V.Check("unique", V.unique("entity")),
            V.Check("not_unique", V.unique("region")), V.Check("year_constant", V.constant("year", 0)),
        ],
    )


# --- shapes, search, scalars -----------------------------------------------------------------------------------------


@query("p09_p10_pivot", "SELECT supplier, " + ", ".join(f"""CAST(coalesce(sum(cents) FILTER (flag = '{f}'), 0) AS BIGINT) AS {f.lower()}, CAST(CASE
        WHEN count(*) FILTER (flag = '{f}') = 0 THEN 1 ELSE 0 END AS INT) AS {f.lower()}_missing""" for f in "ANR") + " FROM mov GROUP BY supplier")
def pivot(spark, sf_dir):
    """Long to wide over a fixed list, zero by default and with a flag for what was missing."""
    wide = movements(spark, sf_dir).groupBy("supplier").pivot("flag", list("ANR")).agg(F.sum("cents"))
    return wide.select("supplier", *[x for f in "ANR" for x in (F.coalesce(f, F.lit(0)).alias(f.lower()), F.col(f).isNull().cast("int").alias(f"{f.lower()}_missing"))])


@query("p02_j09_o06_d08_trace", """SELECT o_orderkey AS number, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, string_agg(supplier, ','
        ORDER BY CAST(supplier AS VARCHAR), CAST(line AS VARCHAR)) AS suppliers FROM orders JOIN mov ON o_orderkey = number GROUP BY o_orderkey""")
def trace(spark, sf_dir):
    """Parents with an ordered array of children, flattened again for comparison."""
    lines = movements(spark, sf_dir).select("number", "supplier", "line", "cents")
    parents = lines.select("number").distinct()
    tree = J.nested(parents, lines, "number", "lines", ["supplier", "line"])
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["cents"])
    return tree.select("number", F.size("lines").cast("bigint").alias("n"), total.alias("cents"), F.array_join(F.transform("lines", lambda x: x["supplier"].cast("string")), ",").alias("suppliers"))


@query("f06_f08_nested_filters", """SELECT number, count(*) FILTER (flag = 'R') AS kept FROM mov GROUP BY number
        HAVING count(*) FILTER (flag = 'R') > 0 AND bool_or(supplier % 7 = 0)""")
def nested_filters(spark, sf_dir):
    """Children are filtered, parents left empty go; another condition on any child."""
    lines = movements(spark, sf_dir).groupBy("number").agg(F.collect_list(F.struct("flag", "supplier")).alias("lines"))
    kept = lines.withColumn("kept", F.filter("lines", lambda x: x["flag"] == "R"))
    return kept.filter((F.size("kept") > 0) & F.exists("lines", lambda x: x["supplier"] % 7 == 0)).select("number", F.size("kept").cast("bigint").alias("kept"))


@query("p08_zip_series", "SELECT region, year, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) WHERE year IN (1999, 2000) GROUP BY region, year")
def zipped(spark, sf_dir):
    """Aligned arrays back to rows of the chosen years."""
    sums = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region"), "entity").groupBy("region", "year").agg(F.sum("cents").alias("cents"))
    arrays = sums.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("year", "cents"))).alias("s")).select("region", F.col("s.year").alias("years"), F.col("s.cents").alias("amounts"))
    return arrays.select("region", F.explode(F.arrays_zip("years", "amounts")).alias("z")).filter("z.years IN (1999, 2000)").select("region", F.col("z.years").alias("year"), F.col("z.amounts").alias("cents"))


@query("f01_f05_f07_equality", """SELECT entity FROM ent JOIN reg USING (region) WHERE lower(region_name) = lower('NATION_0') AND (CAST(entity AS VARCHAR) LIKE '1%' OR
        name = 'Customer#000000002')""")
def equality(spark, sf_dir):
    rows = entities(spark, sf_dir).join(regions(spark, sf_dir), "region")
    return rows.filter((F.lower("region_name") == F.lower(F.lit("NATION_0"))) & (F.col("entity").cast("string").startswith("1") | (F.col("name") == "Customer#000000002"))).select("entity")


@query("f02_f03_f04_x27_search", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'ecion') OR contains(lower(strip_accents(source)), 'src7')", roles=False)
def search(spark, sf_dir):
    """Accent- and case-insensitive search over two fields."""
    docs = read(spark, sf_dir, "documents")
    return docs.filter(X.contains_folded([F.col("text")], "ÉCION") | X.contains_folded([F.col("source")], "SRC7")).select("doc_id")


@query("f12_f13_intervals", """SELECT count(*) FILTER (day <= DATE '2000-12-31' AND day + 30 >= DATE '2000-01-01') AS active,
        count(*) FILTER (flag = 'N' AND status = 'F') AS residual FROM mov""")
def intervals(spark, sf_dir):
    """Validity intervals that overlap a year; rows of a residual identity."""
    active = (F.col("day") <= F.lit("2000-12-31").cast("date")) & (F.date_add("day", 30) >= F.lit("2000-01-01").cast("date"))
    return movements(spark, sf_dir).agg(F.count_if(active).alias("active"), F.count_if((F.col("flag") == "N") & (F.col("status") == "F")).alias("residual"))


@query("f09_f14_scan_filters", "SELECT supplier, CAST(sum(cents) AS BIGINT) AS cents FROM mov WHERE flag = 'R' AND supplier <> 5 GROUP BY supplier")
def scan_filters(spark, sf_dir):
    return movements(spark, sf_dir).filter("flag = 'R' AND supplier <> 5").groupBy("supplier").agg(F.sum("cents").alias("cents"))


@query("f17_s19_malformed", """SELECT count(*) AS records, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL) AS malformed,
        CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events""", roles=False)
def malformed(spark, sf_dir):
    """Unreadable rows are counted and skipped."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("records"), F.count_if(k.isNull()).alias("malformed"), F.sum(k).alias("k"))


@query("o01_o02_o09_o12_page", "SELECT entity, people FROM ent ORDER BY people DESC NULLS LAST, entity LIMIT 25 OFFSET 50")
def one_page(spark, sf_dir):
    return S.page(entities(spark, sf_dir).select("entity", "people"), S.ordered_by("people", True, "entity"), 50, 25)


@query("o03_o04_o07_o08_name_order", "SELECT entity, name FROM ent ORDER BY lower(strip_accents(name)), entity LIMIT 30")
def name_order(spark, sf_dir):
    return S.page(entities(spark, sf_dir).select("entity", "name"), [F.collate("name", "UNICODE_CI_AI").asc(), F.asc("entity")], 0, 30)


@query(
    "p04_p05_p06_derived",
    f"""+ s AS (SELECT region, CAST(sum(total_cents) AS BIGINT) AS cost, CAST(sum(title_cents) AS BIGINT) AS paid, count(*) AS n FROM et
        GROUP BY region) SELECT region, coalesce({RATIO.format(n='paid', d='cost')}, 0) AS ratio, cost - paid AS difference,
        CAST(floor(CAST(cost AS DOUBLE) / n + 0.5) AS BIGINT) AS mean_cents, coalesce({RATIO.format(n='cost', d='(SELECT sum(cost) FROM s)')},
        0) AS share FROM s""",
)
def derived(spark, sf_dir):
    """Shares and ratios are 0 on a zero base, means are null."""
    sums = entity_totals(spark, sf_dir).groupBy("region").agg(F.sum("total_cents").alias("cost"), F.sum("title_cents").alias("paid"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("cost").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select(
        "region", F.coalesce(percent8(F.col("paid"), F.col("cost")), F.lit(0)).alias("ratio"), (F.col("cost") - F.col("paid")).alias("difference"),
        X.round_half_up(F.try_divide(F.col("cost").cast("double"), F.col("n").cast("double"))).alias("mean_cents"), F.coalesce(percent8(F.col("cost"), F.col("whole")), F.lit(0)).alias("share"),
    )


@query("p01_p03_p07_projection", """SELECT entity, CASE WHEN people IS NULL THEN 'partial' ELSE 'complete' END AS state, CAST(len(list_distinct(list_filter([segment,
        nullif(name, 'Customer#000000001'), segment], lambda x: x IS NOT NULL))) AS INT) AS parts FROM ent""")
def projection(spark, sf_dir):
    """Repeated columns to an array without blanks and repetitions; complete or partial."""
    parts = F.array_distinct(F.array_compact(F.array(F.col("segment"), F.nullif("name", F.lit("Customer#000000001")), F.col("segment"))))
    return entities(spark, sf_dir).select("entity", F.when(F.col("people").isNull(), "partial").otherwise("complete").alias("state"), F.size(parts).alias("parts"))


@query("p11_buckets", """+ b AS (SELECT * FROM (VALUES ('1', 'current'), ('2', 'capital'), ('3', 'capital'), ('4', 'loans')) AS v(title, bucket))
        SELECT coalesce(bucket, 'other') AS bucket, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN tit USING (part) LEFT JOIN b USING (title)
        GROUP BY 1""")
def buckets(spark, sf_dir):
    names = spark.createDataFrame([("1", "current"), ("2", "capital"), ("3", "capital"), ("4", "loans")], "title string, bucket string")
    sums = movements(spark, sf_dir).join(titles(spark, sf_dir), "part").groupBy("title").agg(F.sum("cents").alias("cents"))
    return sums.join(F.broadcast(names), "title", "left").groupBy(F.coalesce("bucket", F.lit("other")).alias("bucket")).agg(F.sum("cents").alias("cents"))


#: Fixed values of the policy scenario: bases in billions; shares and rates of the three variants.
BASES = (("procurement", "59.7721"), ("tax", "108.6"), ("healthcare", "0.568"), ("debt", "0.250546"))
VARIANTS = (("prudent", "0.25", "0.02", "0.01", "0.05", "0.1"), ("central", "0.5", "0.025", "0.03", "0.1", "0.2"), ("ambitious", "1", "0.025", "0.05", "0.15", "0.3"))
_V = ", ".join(f"('{v[0]}', {v[1]}::DECIMAL(9,4) * {v[2]}::DECIMAL(9,4), {v[3]}::DECIMAL(9,4), {v[4]}::DECIMAL(9,4), {v[5]}::DECIMAL(9,4))" for v in VARIANTS)
_BASE = "CAST(CAST(coalesce(sum(cents) FILTER (title = '{0}'), 0) // 100 AS BIGINT) / 1000000.0 AS DECIMAL(12,6)) AS {1}"


@query("p12_scenario", f"""+ v(id, a, b, c, d) AS (VALUES {_V}), s AS (SELECT region, {", ".join(_BASE.format(i + 1, n) for i, (n, _) in enumerate(BASES))} FROM mov JOIN tit USING (part) JOIN ent USING (entity)
        GROUP BY region), x AS (SELECT region, id, round(procurement * a, 9) AS procurement, round(tax * b, 9) AS tax, round(healthcare * c, 9) AS healthcare, round(debt * d, 9) AS debt FROM v, s)
        SELECT region, id, CAST(procurement AS DECIMAL(20,9)) AS procurement, CAST(tax AS DECIMAL(20,9)) AS tax,
        CAST(healthcare AS DECIMAL(20,9)) AS healthcare, CAST(debt AS DECIMAL(20,9)) AS debt,
        CAST(procurement + tax + healthcare + debt AS DECIMAL(20,9)) AS annual FROM x""")
def scenario(spark, sf_dir):
    """Each region's payments of four titles, in millions, as bases crossed with three variants."""
    paid = movements(spark, sf_dir).join(titles(spark, sf_dir), "part").join(entities(spark, sf_dir).select("entity", "region"), "entity")
    millions = lambda t: (F.floor(F.coalesce(F.sum(F.when(F.col("title") == t, F.col("cents"))), F.lit(0)) / 100).cast("decimal(18,0)") / 1000000).cast("decimal(12,6)")
    bases = paid.groupBy("region").agg(*[millions(str(i + 1)).alias(n) for i, (n, _) in enumerate(BASES)])
    variants = spark.createDataFrame(list(VARIANTS), "id string, audited string, efficiency string, taxed string, health string, prevented string")
    number = lambda c: F.col(c).cast("decimal(12,6)")
    part = lambda n, *rates: F.round(_product(number(n), *map(number, rates)), 9).cast("decimal(20,9)").alias(n)
    # three variants
    found = bases.crossJoin(F.broadcast(variants)).select("region", "id", part("procurement", "audited", "efficiency"), part("tax", "taxed"), part("healthcare", "health"), part("debt", "prevented"))
    return found.withColumn("annual", (F.col("procurement") + F.col("tax") + F.col("healthcare") + F.col("debt")).cast("decimal(20,9)"))


def _product(*xs):
    out = xs[0]
    for x in xs[1:]:
        out = out * x
    return out


@query("x33_x36_freshness", """SELECT event_id, CASE WHEN ts IS NULL THEN 'unknown' WHEN date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') < -300 THEN 'unknown'
        WHEN date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') > 86400 THEN 'stale' ELSE 'fresh' END AS state,
        ['gennaio','febbraio','marzo','aprile','maggio','giugno','luglio','agosto','settembre','ottobre','novembre','dicembre'][month(ts)] AS
        month_name FROM events""", roles=False)
def fresh(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", X.freshness(F.col("ts").cast("timestamp_ntz"), now, F.lit(86400)).alias("state"), X.month_name(F.month("ts")).alias("month_name"))


@query("x14_x15_x38_basis_points", """+ y AS (SELECT region, CAST(sum(total_cents) AS BIGINT) AS v, CAST(sum(title_cents) AS BIGINT) AS b FROM et GROUP BY region)
        SELECT region, CAST(round(CAST(v AS DOUBLE) * 10000 / nullif(b, 0), 0) AS BIGINT) AS bp FROM y""")
def points(spark, sf_dir):
    return entity_totals(spark, sf_dir).groupBy("region").agg(F.sum("total_cents").alias("v"), F.sum("title_cents").alias("b")).select("region", X.basis_points(F.col("v"), F.col("b")).alias("bp"))


@query("r01_s10_release", """+ c AS (SELECT year, month, CASE WHEN month = 12 THEN 'consuntivo' ELSE 'mensile' END AS kind FROM mov GROUP BY year, month)
        SELECT year, month, kind FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY (kind = 'consuntivo') DESC, month DESC) AS k
        FROM c) WHERE k = 1""")
def releases(spark, sf_dir):
    """For each year the final account where there is one, else the latest month."""
    found = movements(spark, sf_dir).select("year", "month").distinct().withColumn("kind", F.when(F.col("month") == 12, "consuntivo").otherwise("mensile"))
    place = F.row_number().over(W.partitionBy("year").orderBy((F.col("kind") == "consuntivo").desc(), F.desc("month")))
    return found.withColumn("place", place).filter("place = 1").drop("place")
