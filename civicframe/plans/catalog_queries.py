"""Builders of the nineteen datasets over the roles of the driver's tables, and one registered query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from civicframe.functions import scalars as X
from civicframe.operators import aggregates as A, series as S
from civicframe.plans import queries as Q
from civicframe.plans.catalog import DatasetQuery, QueryError, level_of, validated
from civicframe.plans.roles import SQL, available_years, entities, entity_totals, movements, read, regions

BUILDERS: dict[str, Callable[[SparkSession, str, DatasetQuery], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, q: DatasetQuery) -> DataFrame:
    """A validated dataset query as an unexecuted DataFrame."""
    return BUILDERS[validated(q).dataset](spark, sf_dir, q)


def dataset(name: str, sql: str, **example):
    """Registers a builder, and its example as a query with SQL."""

    def register(build):
        BUILDERS[name] = build
        key = f"q{len(BUILDERS):02d}_{name}"
        QUERIES[key] = lambda spark, sf_dir: run(spark, sf_dir, DatasetQuery(name, **example))
        ORACLES[key] = f"WITH {SQL}{',' if sql.startswith('+') else ''} {sql.removeprefix('+')}"
        return build

    return register


def example(name: str, of: str, sql: str, **filters):
    """Registers one more query of a dataset."""
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, DatasetQuery(of, **filters))
    ORACLES[name] = f"WITH {SQL}{',' if sql.startswith('+') else ''} {sql.removeprefix('+')}"


def matches(totals: DataFrame, page: DataFrame, columns: dict) -> DataFrame:
    """A page with totals over all matches, not over the page."""
    return page.crossJoin(F.broadcast(totals.agg(*[c.alias(n) for n, c in columns.items()])))


def _region(rows: DataFrame, region: str | None) -> DataFrame:
    return rows if region is None else rows.filter(X.same_name(F.col("region_name"), F.lit(region)))


def _year(spark, sf_dir, q: DatasetQuery, latest: bool = False) -> int | None:
    """The year asked for, refused where there is none; without one the latest, or no year."""
    if q.year is None and not latest:
        return None
    years = available_years(spark, sf_dir)
    year = max(years, default=None) if q.year is None else q.year
    if year not in years:
        raise QueryError(f"{q.dataset} has no year {year}; it has {', '.join(map(str, sorted(years)))}")
    return year


def _period(spark, sf_dir, q: DatasetQuery) -> tuple[int, int | None]:
    """Year and month: as asked, or the latest month there is; a period without payments is refused."""
    years = available_years(spark, sf_dir)
    if q.year is None:
        year = max(years, default=None)
        return year, years.get(year)
    if q.year not in years:
        raise QueryError(f"{q.dataset} has no release for {q.year}")
    return q.year, q.month


#: Places of a ranking.
PLACES = 100
_BAND_CASE = " ".join(
    f"WHEN people IS NOT NULL {f'AND people >= {low}' if low is not None else ''} {f'AND people < {high}' if high is not None else ''} THEN '{name}'" for name, low, high in A.POPULATION_BANDS
)
_MUNICIPAL = f"""+ y AS (SELECT ent.entity, ent.people, region_name, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) JOIN reg USING (region) WHERE year = {{year}}
        GROUP BY ent.entity, ent.people, region_name),
    h AS (SELECT *, CASE WHEN people > 0 THEN CAST(round(CAST(cents AS DOUBLE) / (people * 100), 2) AS DECIMAL(20,2)) END AS head FROM y),
    p AS (SELECT *, row_number() OVER (ORDER BY cents DESC, entity) AS by_value, row_number() OVER (ORDER BY head DESC NULLS LAST, cents DESC, entity) AS by_head FROM h),
    b AS (SELECT *, CASE {_BAND_CASE} END AS band FROM y),
    c AS (SELECT region_name, sum(cents) FILTER (people IS NOT NULL) AS known, sum(people) AS people, sum(cents) AS cents, count(*) AS n FROM y GROUP BY region_name)
    SELECT 'region' AS section, region_name AS key, CAST(NULL AS INT) AS place, CAST(cents AS BIGINT) AS cents, n AS entities, CAST(people AS BIGINT) AS people,
        CASE WHEN people > 0 THEN CAST(round(CAST(known AS DOUBLE) / (people * 100), 2) AS DECIMAL(20,2)) END AS per_capita FROM c WHERE {{where}}
    UNION ALL SELECT 'by value', CAST(entity AS VARCHAR), CAST(by_value AS INT), cents, 1, people, head FROM p WHERE by_value <= {PLACES} AND {{where}}
    UNION ALL SELECT 'by head', CAST(entity AS VARCHAR), CAST(by_head AS INT), cents, 1, people, head FROM p WHERE by_head <= {PLACES} AND head IS NOT NULL AND {{where}}
    UNION ALL SELECT 'without people', 'all', NULL, CAST(coalesce(sum(cents) FILTER (people IS NULL), 0) AS BIGINT), count(*) FILTER (people IS NULL), NULL, NULL FROM y"""
_MUNICIPAL_BANDS = """ UNION ALL SELECT 'band', band, NULL, CAST(sum(cents) AS BIGINT), count(*), CAST(sum(people) AS BIGINT), NULL FROM b WHERE band IS NOT NULL GROUP BY band"""


@dataset("siope_comuni", _MUNICIPAL.format(year=2000, where="lower(region_name) = 'nation_3'"), year=2000, region="Nation_3")
def municipal_payments(spark, sf_dir, q):
    """A year's payments: sums by region, the first hundred of the nation by value and by a head's share, bands of population, and what has no population.

    With a region its sum and those of the hundreds that lie in it; bands are of the nation and left out. Without a year the latest.
    """
    rows = entity_totals(spark, sf_dir, _year(spark, sf_dir, q, latest=True)).join(regions(spark, sf_dir), "region")
    rows = rows.select(F.col("entity").cast("string").alias("key"), "entity", "region_name", F.col("total_cents").alias("cents"), "people", X.per_capita(F.col("total_cents"), F.col("people")).alias("per_capita"))
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    sums = (F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("entities"), F.sum("people").alias("people"))
    known = F.sum(F.when(F.col("people").isNotNull(), F.col("cents")))
    found = _region(rows, q.region).groupBy(F.col("region_name").alias("key")).agg(*sums, X.per_capita(known, F.sum("people")).alias("per_capita"))
    found = found.select(F.lit("region").alias("section"), "key", null("place", "int"), "cents", "entities", "people", "per_capita")
    by_value = S.numbered(S.top(rows, [F.desc("cents"), F.asc("entity")], PLACES), [F.desc("cents"), F.asc("entity")])
    by_head = [F.desc("per_capita"), F.desc("cents"), F.asc("entity")]
    headed = S.numbered(S.top(rows.filter("per_capita IS NOT NULL"), by_head, PLACES), by_head)
    for section, places in (("by value", by_value), ("by head", headed)):
        part = _region(places, q.region).select(F.lit(section).alias("section"), "key", F.col("place").cast("int").alias("place"), "cents", F.lit(1).cast("bigint").alias("entities"), "people", "per_capita")
        found = found.unionByName(part)
    unknown = rows.agg(F.coalesce(F.sum(F.when(F.col("people").isNull(), F.col("cents"))), F.lit(0)).alias("cents"), F.count_if(F.col("people").isNull()).alias("entities"))
    found = found.unionByName(unknown.select(F.lit("without people").alias("section"), F.lit("all").alias("key"), null("place", "int"), "cents", "entities", null("people", "bigint"), null("per_capita", "decimal(20,2)")))
    if q.region is None:
        bands = rows.filter("people IS NOT NULL").groupBy(A.banded(None, "people").alias("key")).agg(*sums)
        found = found.unionByName(bands.select(F.lit("band").alias("section"), "key", null("place", "int"), "cents", "entities", "people", null("per_capita", "decimal(20,2)")))
    return found


example("q01_siope_comuni_latest", "siope_comuni", _MUNICIPAL.format(year="(SELECT max(year) FROM mov)", where="true") + _MUNICIPAL_BANDS)
example("q01_siope_comuni_nation", "siope_comuni", _MUNICIPAL.format(year=1997, where="true") + _MUNICIPAL_BANDS, year=1997)


_GROUPINGS = {"mission": ("flag",), "title": ("status",), "administration": ("flag", "status")}
_STATE = """+ x AS (SELECT year, flag, status, cents FROM mov WHERE year IN ({year}, {year} - 1) AND month = {month}),
    u AS (SELECT 'mission' AS grouping, flag AS key, year, cents FROM x UNION ALL SELECT 'title', status, year, cents FROM x UNION ALL
        SELECT 'administration', flag || ':' || status, year, cents FROM x),
    c AS (SELECT grouping, key, CAST(sum(cents) FILTER (year = {year}) AS BIGINT) AS cents,
        CAST(sum(cents) FILTER (year = {year} - 1) AS BIGINT) AS before FROM u GROUP BY grouping, key)
    SELECT grouping, key, cents, before, CAST(round(CAST(cents - before AS DOUBLE) * 100 / before, 6) AS DECIMAL(20,6)) AS difference_pct,
    CASE WHEN (SELECT count(*) FROM x WHERE year = {year} - 1) = 0 THEN 'no companion release'
        WHEN before IS NULL THEN 'not in the companion release' END AS warning FROM c WHERE cents IS NOT NULL"""


@dataset("openbdap_spesa_stato", _STATE.format(year=1999, month=6), year=1999, month=6)
def state_spending(spark, sf_dir, q):
    """A period by mission, title and administration, each against the period a year before, with a warning where that lacks it. Without a year the latest month."""
    year, in_year = _period(spark, sf_dir, q)
    month = F.col("month") == in_year if in_year else F.lit(True)
    rows = movements(spark, sf_dir).filter(month & F.col("year").isin(year, year - 1))
    now, then = F.col("year") == year, F.col("year") == year - 1
    sums = rows.groupBy("flag", "status").agg(F.sum(F.when(now, F.col("cents"))).alias("cents"), F.sum(F.when(then, F.col("cents"))).alias("before"))
    # few rows from here on: one for each pair of keys
    found = None
    for name, keys in _GROUPINGS.items():
        part = sums.groupBy(F.concat_ws(":", *keys).alias("key")).agg(F.sum("cents").alias("cents"), F.sum("before").alias("before")).withColumn("grouping", F.lit(name))
        found = part if found is None else found.unionByName(part)
    companion = rows.agg(F.count_if(then).alias("earlier"))
    warning = F.when(F.col("earlier") == 0, "no companion release").when(F.col("before").isNull(), "not in the companion release")
    found = found.filter("cents IS NOT NULL").crossJoin(F.broadcast(companion))
    return found.select("grouping", "key", "cents", "before", X.percentage(F.col("cents") - F.col("before"), F.col("before")).alias("difference_pct"), warning.alias("warning"))


example("q02_openbdap_spesa_stato_first_year", "openbdap_spesa_stato", _STATE.format(year=1995, month=3), year=1995, month=3)
_LATEST_STATE = _STATE.replace("AND month = {month}", "{month}")
example(
    "q02_openbdap_spesa_stato_latest", "openbdap_spesa_stato",
    _LATEST_STATE.format(year="(SELECT max(year) FROM mov)", month="AND month = (SELECT month FROM mov ORDER BY year DESC, month DESC LIMIT 1)"),
)
example("q02_openbdap_spesa_stato_year", "openbdap_spesa_stato", _LATEST_STATE.format(year=1997, month=""), year=1997)


_OFFICE = """+ x AS (SELECT flag, status, cents FROM mov WHERE supplier = {code} AND year = {year} {month}),
    u AS (SELECT 'mission' AS grouping, flag AS key, cents FROM x UNION ALL SELECT 'category', status, cents FROM x UNION ALL SELECT 'detail', flag || ':' || status, cents FROM x
        UNION ALL SELECT 'total', {code}, cents FROM x)
    SELECT grouping, key, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS payments, CAST(round(CAST(sum(cents) AS DOUBLE) * 100 / (SELECT sum(cents) FROM x), 6) AS DECIMAL(20,6)) AS share_pct
    FROM u GROUP BY grouping, key"""


@dataset("openbdap_amministrazione", _OFFICE.format(code="'7'", year=2000, month=""), code="7", year=2000)
def administration(spark, sf_dir, q):
    """An administration's payments of a period by mission, by category and by both, with its total. A code without payments is refused."""
    year, month = _period(spark, sf_dir, q)
    code = q.code.strip()
    rows = movements(spark, sf_dir).filter((F.col("supplier").cast("string") == code) & (F.col("year") == year))
    rows = rows.filter(F.col("month") == month) if month else rows
    sums = rows.groupBy("flag", "status").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("payments"))
    found = None
    for name, key in (("mission", F.col("flag")), ("category", F.col("status")), ("detail", F.concat_ws(":", "flag", "status")), ("total", F.lit(code))):
        part = sums.groupBy(key.alias("key")).agg(F.sum("cents").alias("cents"), F.sum("payments").alias("payments")).withColumn("grouping", F.lit(name))
        found = part if found is None else found.unionByName(part)
    # one row; without payments it fails the job
    whole = rows.agg(F.sum("cents").alias("whole"), F.count(F.lit(1)).alias("n")).select("whole", F.when(F.col("n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"no administration {code} in this period")).cast("boolean")).alias("known"))
    found = whole.join(F.broadcast(found), F.lit(True), "left")
    return found.filter("known").select("grouping", "key", "cents", "payments", X.percentage(F.col("cents"), F.col("whole")).alias("share_pct"))


example("q03_openbdap_amministrazione_month", "openbdap_amministrazione", _OFFICE.format(code="'3'", year=1998, month="AND month = 5"), code=" 3 ", year=1998, month=5)

_WORK = """+ w AS (SELECT number, CAST(sum(cents) AS BIGINT) AS actual, CAST(coalesce(sum(cents) FILTER (flag <> 'R'), 0) AS BIGINT) AS planned,
        CAST(coalesce(sum(cents) FILTER (flag = 'A'), 0) AS BIGINT) AS secured,
        max(day) AS planned_end, CASE WHEN bool_and(status = 'F') THEN 'C' END AS status, count(*) FILTER (flag = 'N') AS open FROM mov
        WHERE number = {cup} GROUP BY number),
    s AS (SELECT *, CASE WHEN planned > 0 AND actual > 0 THEN CAST(round(CAST(actual - planned AS DOUBLE) * 10000 / planned,
        0) AS BIGINT) END AS change_bp, greatest(actual - secured, 0) AS to_find FROM w)
    SELECT number, actual, planned, secured, change_bp, open, array_to_string(list_filter([CASE WHEN open = 0 THEN 'data-quality' END,
        CASE WHEN coalesce(status, '') <> 'C' AND planned_end < DATE '2001-08-31' THEN 'schedule-check' END,
        CASE WHEN change_bp >= 1000 THEN 'cost-growth' END, CASE
        WHEN to_find > 0 THEN 'funding-gap' END], lambda x: x IS NOT NULL), ',') AS signals FROM s"""


@dataset("openbdap_opere_pubbliche", _WORK.format(cup=77), cup="77")
def public_work(spark, sf_dir, q):
    """One work by its code: cost, funding, the change of cost where both costs are positive, and its signals."""
    work = X.works(movements(spark, sf_dir).filter(F.col("number") == int(q.cup)))
    warnings = F.when(F.col("open") == 0, F.array(F.lit("no open line"))).otherwise(F.array().cast("array<string>"))
    observed = F.lit("2001-08-31").cast("date")
    signals = X.work_signals(warnings, F.col("status"), F.col("planned_end"), F.lit(None).cast("date"), observed, F.col("change_bp"), F.col("to_find"))
    return work.select("number", "actual", "planned", "secured", "change_bp", "open", F.array_join(signals, ",").alias("signals"))


example("q04_openbdap_opere_pubbliche_other", "openbdap_opere_pubbliche", _WORK.format(cup=32), cup="32")

_HEALTH = """+ e AS (SELECT et.*, region_name FROM et JOIN reg USING (region)), n AS (SELECT CAST(sum(title_cents) AS BIGINT) AS title_cents,
        CAST(sum(total_cents) AS BIGINT) AS total_cents, count(*) AS entities FROM e WHERE {where})
    {rows}"""
_HEALTH_PAGE = """SELECT 'entity' AS level, CAST(entity AS VARCHAR) AS code, title_cents, total_cents, CAST(1 AS BIGINT) AS entities, (SELECT entities
        FROM n) AS matched FROM e WHERE {where} ORDER BY entity LIMIT 20"""


@dataset(
    "openbdap_ssn_conto_economico",
    _HEALTH.format(where="lower(region_name) = 'nation_7'", rows="SELECT 'region' AS level, 'Nation_7' AS code, title_cents, total_cents, entities, entities AS matched FROM n UNION ALL ("
                   + _HEALTH_PAGE.format(where="lower(region_name) = 'nation_7'") + ")"),
    region="Nation_7", limit=20,
)
def health_accounts(spark, sf_dir, q):
    """The nation with its regions, a region with a page of its entities, or an entity by its code or name."""
    rows = _region(entity_totals(spark, sf_dir, _year(spark, sf_dir, q)).join(regions(spark, sf_dir), "region"), q.region)
    if q.code:
        rows = rows.filter((F.col("entity").cast("string") == q.code) | (F.col("name") == q.code))
    sums = (F.sum("title_cents").alias("title_cents"), F.sum("total_cents").alias("total_cents"), F.count(F.lit(1)).alias("entities"))
    columns = ("level", "code", "title_cents", "total_cents", "entities")
    if not q.region and not q.code:
        lower = rows.groupBy(F.col("region_name").alias("code")).agg(*sums).withColumn("level", F.lit("region")).select(*columns)
        top = rows.agg(*sums).select(F.lit("nation").alias("level"), F.lit("IT").alias("code"), "title_cents", "total_cents", "entities")
        return matches(rows, top.unionByName(lower), {"matched": F.count(F.lit(1))})
    page = S.page(rows.select("entity", "title_cents", "total_cents"), [F.asc("entity")], *q.page)
    page = page.select(F.lit("entity").alias("level"), F.col("entity").cast("string").alias("code"), "title_cents", "total_cents", F.lit(1).cast("bigint").alias("entities"))
    if q.region and not q.code:
        page = rows.agg(*sums).select(F.lit("region").alias("level"), F.lit(q.region).alias("code"), "title_cents", "total_cents", "entities").unionByName(page)
    return matches(rows, page, {"matched": F.count(F.lit(1))})


example(
    "q05_openbdap_ssn_conto_economico_nation", "openbdap_ssn_conto_economico",
    _HEALTH.format(where="true", rows="""SELECT 'nation' AS level, 'IT' AS code, title_cents, total_cents, entities, entities AS matched FROM n UNION ALL
        SELECT 'region', region_name, CAST(sum(title_cents) AS BIGINT), """
                   "CAST(sum(total_cents) AS BIGINT), count(*), (SELECT entities FROM n) FROM e GROUP BY region_name"),
)
example("q05_openbdap_ssn_conto_economico_entity", "openbdap_ssn_conto_economico", _HEALTH.format(where="entity = 10", rows=_HEALTH_PAGE.format(where="entity = 10")), code="10")

#: Totals of a year in place of those of all years.
_OF_YEAR = """+ tot AS (SELECT entity, CAST(sum(cents) AS BIGINT) AS total_cents, CAST(coalesce(sum(cents) FILTER (title = '1'), 0) AS BIGINT) AS title_cents
    FROM mov JOIN tit USING (part) WHERE year = {year} GROUP BY entity), et AS (SELECT * FROM tot JOIN ent USING (entity)){more}"""


def _of_year(year: int, sql: str) -> str:
    """The SQL of all years, over those totals: a later table of the same name hides the earlier in a nested query."""
    return f"SELECT * FROM (WITH {_OF_YEAR.format(year=year, more='').removeprefix('+ ')}{',' + sql.removeprefix('+') if sql.startswith('+') else ' ' + sql})"


example(
    "q05_openbdap_ssn_conto_economico_year", "openbdap_ssn_conto_economico",
    _of_year(1999, _HEALTH.format(where="lower(region_name) = 'nation_7'", rows="SELECT 'region' AS level, 'Nation_7' AS code, title_cents, total_cents, entities, entities AS matched FROM n UNION ALL ("
             + _HEALTH_PAGE.format(where="lower(region_name) = 'nation_7'").replace("LIMIT 20", "LIMIT 5 OFFSET 3") + ")")), year=1999, region="Nation_7", limit=5, offset=3,
)

_NEEDS = """SELECT entity, total_cents - title_cents AS difference, CAST(round(CAST(total_cents AS DOUBLE) / (people * 100), 2) AS DECIMAL(20,2)) AS per_capita
    FROM et JOIN reg USING (region) WHERE lower(region_name) = 'nation_11' ORDER BY {order} NULLS LAST, entity LIMIT 30 OFFSET {offset}"""


@dataset("opencivitas_fabbisogni", _NEEDS.format(order="difference DESC", offset=5), region="Nation_11", limit=30, offset=5)
def needs(spark, sf_dir, q, sort: str = "difference", descending: bool = True):
    """Entities by difference, by a head's share or by code, unknown ones last."""
    if sort not in ("difference", "per_capita", "entity"):
        raise QueryError(f"no order by {sort}")
    rows = _region(entity_totals(spark, sf_dir, _year(spark, sf_dir, q)).join(regions(spark, sf_dir), "region"), q.region)
    rows = rows.filter(F.col("entity").cast("string") == q.code.strip()) if q.code else rows
    rows = rows.select("entity", (F.col("total_cents") - F.col("title_cents")).alias("difference"), X.per_capita(F.col("total_cents"), F.col("people")).alias("per_capita"))
    return S.page(rows, S.ordered_by(sort, descending, "entity"), *q.page)


QUERIES["q06_opencivitas_fabbisogni_per_head"] = lambda spark, sf_dir: needs(spark, sf_dir, DatasetQuery("opencivitas_fabbisogni", region="Nation_11", limit=30), "per_capita", False)
ORACLES["q06_opencivitas_fabbisogni_per_head"] = f"WITH {SQL} {_NEEDS.format(order='per_capita ASC', offset=0)}"
example("q06_opencivitas_fabbisogni_year", "opencivitas_fabbisogni", _of_year(1996, _NEEDS.format(order="difference DESC", offset=0)), year=1996, region="nation_11", limit=30)
example("q06_opencivitas_fabbisogni_code", "opencivitas_fabbisogni", _NEEDS.replace("lower(region_name) = 'nation_11'", "entity = 12").format(order="difference DESC", offset=0), code="12")


_COHESION = """+ e AS (SELECT et.*, area FROM et JOIN reg USING (region)), u AS (SELECT 'region' AS dimension, CAST(region AS VARCHAR) AS key,
        title_cents, total_cents FROM e
    UNION ALL SELECT 'area', area, title_cents, total_cents FROM e UNION ALL SELECT 'theme', segment, title_cents, total_cents FROM e)
    SELECT dimension, key, count(*) AS projects, CAST(sum(total_cents) AS BIGINT) AS cost, CAST(sum(title_cents) AS BIGINT) AS paid,
        CAST(sum(total_cents) - sum(title_cents) AS BIGINT) AS difference FROM u GROUP BY dimension, key"""


@dataset("opencoesione_progetti", _COHESION)
def cohesion(spark, sf_dir, q):
    """Projects, cost and payments by region, by area and by theme, in one pass."""
    rows = entity_totals(spark, sf_dir).join(regions(spark, sf_dir), "region").withColumn("region", F.col("region").cast("string"))
    sums = (F.count(F.lit(1)).alias("projects"), F.sum("total_cents").alias("cost"), F.sum("title_cents").alias("paid"))
    sets = rows.groupingSets([["region"], ["area"], ["segment"]], "region", "area", "segment").agg(F.grouping_id("region", "area", "segment").alias("which"), *sums)
    dimension = F.when(F.col("which") == 3, "region").when(F.col("which") == 5, "area").otherwise("theme")
    return sets.select(dimension.alias("dimension"), F.coalesce("region", "area", "segment").alias("key"), "projects", "cost", "paid", (F.col("cost") - F.col("paid")).alias("difference"))


@dataset(
    "pnrr_asili",
    """+ p AS (SELECT number, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) JOIN reg USING (region)
        WHERE lower(region_name) = 'nation_2' GROUP BY number) SELECT *, (SELECT count(*) FROM p) AS total FROM p ORDER BY number LIMIT 20""",
    region="Nation_2", limit=20,
)
def projects(spark, sf_dir, q):
    rows = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region", "segment"), "entity").join(regions(spark, sf_dir), "region")
    rows = _region(rows, q.region)
    rows = rows.filter(F.col("number").cast("string") == q.cup) if q.cup else rows
    rows = rows.filter(X.contains_folded([F.col("segment")], q.query)) if q.query else rows
    rows = rows.filter(X.same_name(F.col("area"), F.lit(q.province))) if q.province else rows
    found = rows.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return matches(found, S.page(found, [F.asc("number")], *q.page), {"total": F.count(F.lit(1))})


_PROJECTS = """+ p AS (SELECT number, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) JOIN reg USING (region)
        WHERE {where} GROUP BY number) SELECT *, (SELECT count(*) FROM p) AS total FROM p ORDER BY number LIMIT {limit} OFFSET {offset}"""
example("q08_pnrr_asili_cup", "pnrr_asili", _PROJECTS.format(where="number = 32", limit=50, offset=0), cup="32")
example("q08_pnrr_asili_query", "pnrr_asili", _PROJECTS.format(where="contains(lower(segment), 'mach')", limit=10, offset=4), query="MÀCH", limit=10, offset=4)
example("q08_pnrr_asili_province", "pnrr_asili", _PROJECTS.format(where="lower(area) = 'europe' AND lower(region_name) = 'nation_8'", limit=50, offset=0), province="Europe", region="NATION_8")


@dataset("anac_cig_snapshot", """SELECT flag AS choice, count(*) AS n, CAST(round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM mov
        WHERE year = 2000), 6) AS DECIMAL(20,6)) AS pct FROM mov WHERE year = 2000 GROUP BY flag""", year=2000)
def contracts(spark, sf_dir, q):
    """Kinds of contract of a year, the latest without one, with their share."""
    rows = movements(spark, sf_dir).filter(F.col("year") == _year(spark, sf_dir, q, latest=True))
    whole = rows.agg(F.count(F.lit(1)).alias("whole"))
    return rows.groupBy(F.col("flag").alias("choice")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole)).select("choice", "n", X.percentage(F.col("n"), F.col("whole")).alias("pct"))


example("q09_anac_cig_snapshot_latest", "anac_cig_snapshot", """SELECT flag AS choice, count(*) AS n, CAST(round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM mov
        WHERE year = (SELECT max(year) FROM mov)), 6) AS DECIMAL(20,6)) AS pct FROM mov WHERE year = (SELECT max(year) FROM mov) GROUP BY flag""")


@dataset("inps_invalidita_civile", """+ y AS (SELECT region_name, year, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) JOIN reg USING (region)
        GROUP BY region_name, year), c AS (SELECT *, cents - lag(cents) OVER (PARTITION BY region_name ORDER BY year) AS change FROM y) SELECT *
        FROM c WHERE year = 1998 AND lower(region_name) = 'nation_5'""", year=1998, region="Nation_5")
def invalidity(spark, sf_dir, q):
    rows = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region"), "entity").join(regions(spark, sf_dir), "region")
    years = _region(rows, q.region).groupBy("region_name", "year").agg(F.sum("cents").alias("cents"))
    found = S.changes(years, ["region_name"], "year", "cents").drop("change_pct")
    return found.filter(F.col("year") == q.year) if q.year else found


@dataset("cpt_finanza_regionale", """SELECT region_name, year, CAST(coalesce(sum(cents) FILTER (flag = 'N'), 0) AS BIGINT) AS revenue,
        CAST(coalesce(sum(cents) FILTER (flag <> 'N'), 0) AS BIGINT) AS expenditure, CAST(coalesce(sum(cents) FILTER (flag = 'N'),
        0) - coalesce(sum(cents) FILTER (flag <> 'N'), 0) AS BIGINT) AS balance FROM mov JOIN ent USING (entity) JOIN reg USING (region)
        WHERE year = 1997 GROUP BY region_name, year""", year=1997)
def regional_finance(spark, sf_dir, q):
    rows = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region"), "entity").join(regions(spark, sf_dir), "region")
    rows = _region(rows.filter(F.col("year") == _year(spark, sf_dir, q, latest=True)), q.region)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0))
    return rows.groupBy("region_name", "year").agg(part(F.col("flag") == "N").alias("revenue"), part(F.col("flag") != "N").alias("expenditure")).withColumn("balance", F.col("revenue") - F.col("expenditure"))


_FINANCE = ORACLES["q11_cpt_finanza_regionale"].removeprefix(f"WITH {SQL} ").removeprefix(f"WITH {SQL}")
example("q11_cpt_finanza_regionale_latest", "cpt_finanza_regionale", _FINANCE.replace("year = 1997", "year = (SELECT max(year) FROM mov)"))
example("q11_cpt_finanza_regionale_region", "cpt_finanza_regionale", _FINANCE.replace("year = 1997", "year = 1998 AND lower(region_name) = 'nation_4'"), year=1998, region="nation_4")

#: The year that the income data are of; they have no other.
TAX_YEAR = 2024
_TAX = """+ s AS (SELECT region_name, entity, name, CASE WHEN balance_cents >= 0 THEN people END AS f, CASE
        WHEN balance_cents >= 0 AND people IS NOT NULL THEN balance_cents END AS a FROM ent JOIN reg USING (region)
        WHERE contains(lower(name), '11')) SELECT entity, name, f AS frequency, a AS amount_cents, (SELECT count(*)
        FROM s) AS matched, (SELECT CAST(coalesce(sum(a) FILTER (f IS NOT NULL), 0) AS BIGINT)
        FROM s) AS matched_cents, (SELECT count(*) FILTER (f IS NULL OR a IS NULL) FROM s) AS suppressed FROM s
        ORDER BY lower(name), entity LIMIT 20"""


@dataset("mef_irpef_comunale", _TAX, level="municipality", query="11", limit=20)
def income_tax(spark, sf_dir, q):
    """Totals are over all matches; withheld pairs stay null. Another year than that of the data, or an unknown region or province, is refused."""
    if q.year is not None and q.year != TAX_YEAR:
        raise QueryError(f"mef_irpef_comunale is of {TAX_YEAR}")
    places = regions(spark, sf_dir)
    for asked, column in ((q.region, "region_name"), (q.province, "area")):
        if asked is not None and not places.filter(X.same_name(F.col(column), F.lit(asked))).limit(1).count():
            raise QueryError(f"no place {asked}")
    shown = F.col("balance_cents") >= 0
    rows = _region(entities(spark, sf_dir).join(places, "region"), q.region)
    rows = rows.filter(X.same_name(F.col("area"), F.lit(q.province))) if q.province is not None else rows
    rows = rows.filter(X.contains_folded([F.col("name")], q.query)) if q.query else rows
    level = level_of(q)
    if q.code:
        own = {"region": F.lpad(F.col("region").cast("string"), 2, "0"), "province": F.concat(F.lit("9"), F.lpad(F.col("region").cast("string"), 2, "0"))}
        rows = rows.filter(own.get(level, F.col("entity").cast("string")) == q.code)
    rows = rows.select("region_name", "area", "entity", "name", F.when(shown, F.col("people")).alias("frequency"), F.when(shown & F.col("people").isNotNull(), F.col("balance_cents")).alias("amount_cents"))
    if level != "municipality":
        return rows.groupBy("area" if level == "province" else "region_name").agg(*A.suppressed(F.col("frequency"), F.col("amount_cents")))
    known = F.col("frequency").isNotNull() & F.col("amount_cents").isNotNull()
    page = S.page(rows.select("entity", "name", "frequency", "amount_cents"), [F.collate("name", "UNICODE_CI_AI").asc(), F.asc("entity")], *q.page)
    return matches(rows, page, {"matched": F.count(F.lit(1)), "matched_cents": F.coalesce(F.sum(F.when(known, F.col("amount_cents"))), F.lit(0)), "suppressed": F.count_if(~known)})


_TAX_PLACES = _TAX.replace("contains(lower(name), '11')", "{where}")
_TAX_SUMS = """SELECT {key}, CAST(coalesce(sum(people) FILTER (balance_cents >= 0 AND people IS NOT NULL), 0) AS BIGINT) AS known_frequency,
    CAST(coalesce(sum(balance_cents) FILTER (balance_cents >= 0 AND people IS NOT NULL), 0) AS BIGINT) AS known_amount_cents,
    count(*) FILTER (balance_cents < 0 OR people IS NULL) AS suppressed_rows FROM ent JOIN reg USING (region) WHERE {where} GROUP BY {key}"""
example("q12_mef_irpef_comunale_province", "mef_irpef_comunale", _TAX_PLACES.format(where="lower(area) = 'asia'"), province="ASIA", year=TAX_YEAR, limit=20)
example("q12_mef_irpef_comunale_region", "mef_irpef_comunale", _TAX_PLACES.format(where="lower(region_name) = 'nation_6'").replace("LIMIT 20", "LIMIT 20 OFFSET 7"), level="municipality", region="Nation_6", limit=20, offset=7)
example("q12_mef_irpef_comunale_code", "mef_irpef_comunale", _TAX_PLACES.format(where="entity = 100"), level="municipality", code="100")
example("q12_mef_irpef_comunale_regions", "mef_irpef_comunale", _TAX_SUMS.format(key="region_name", where="true"))
example("q12_mef_irpef_comunale_region_code", "mef_irpef_comunale", _TAX_SUMS.format(key="region_name", where="region = 7"), code="07")
example("q12_mef_irpef_comunale_provinces", "mef_irpef_comunale", _TAX_SUMS.format(key="area", where="lower(region_name) = 'nation_6'"), level="province", region="NATION_6")


@dataset("ipa_enti", "SELECT entity, name FROM ent WHERE contains(lower(name), '#00000014') ORDER BY entity LIMIT 10", query="#00000014", limit=10)
def bodies(spark, sf_dir, q):
    rows = entities(spark, sf_dir).select("entity", "name")
    if q.code:
        return rows.filter(F.col("entity").cast("string") == q.code.strip()).limit(1)
    return S.page(rows.filter(F.lower("name").contains(q.query.lower())) if q.query else rows, [F.asc("entity")], *q.page)


example("q13_ipa_enti_code", "ipa_enti", "SELECT entity, name FROM ent WHERE entity = 14", code=" 14 ")
example("q13_ipa_enti_page", "ipa_enti", "SELECT entity, name FROM ent WHERE contains(lower(name), '1') ORDER BY entity LIMIT 7 OFFSET 9", query="1", limit=7, offset=9)

_STRUCTURE = """+ u AS (SELECT DISTINCT supplier, part % 10 AS unit FROM mov WHERE supplier = 3), o AS (SELECT DISTINCT supplier, part % 7 AS unit
        FROM mov WHERE supplier = 3)
    (SELECT 'units' AS list, unit, CAST(supplier AS BIGINT) AS parent, (SELECT count(*) FROM u) AS total, CASE WHEN (SELECT count(*)
        FROM u) > 4 THEN CAST(4 AS BIGINT) END AS next_offset FROM u ORDER BY unit LIMIT 4)
    UNION ALL (SELECT 'offices', unit, CAST(supplier AS BIGINT), (SELECT count(*) FROM o), CASE WHEN (SELECT count(*)
        FROM o) > 4 THEN CAST(4 AS BIGINT) END FROM o ORDER BY unit LIMIT 4)"""


@dataset("ipa_struttura", _STRUCTURE, code="3", limit=4)
def structure(spark, sf_dir, q):
    """Two lists of a body, its units and its offices, each a page with its total and where the next begins."""
    own = movements(spark, sf_dir).filter(F.col("supplier") == int(q.code))
    offset, limit = q.page
    found = None
    for name, size in (("units", 10), ("offices", 7)):
        rows = own.select((F.col("part") % size).alias("unit"), F.col("supplier").alias("parent")).distinct()
        facts = S.envelope(rows, offset, limit).select("total", "next_offset")
        # one row
        part = S.page(rows, [F.asc("unit")], offset, limit).crossJoin(F.broadcast(facts)).withColumn("list", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


example(
    "q14_ipa_struttura_offset", "ipa_struttura",
    _STRUCTURE.replace("supplier = 3", "supplier = 5").replace("FROM u) > 4 THEN CAST(4", "FROM u) > 7 THEN CAST(7").replace("FROM o) > 4 THEN CAST(4", "FROM o) > 7 THEN CAST(7").replace("LIMIT 4", "LIMIT 5 OFFSET 2"), code="5", limit=5, offset=2,
)


@dataset("mef_partecipazioni", """SELECT count(*) AS records, count(DISTINCT supplier) AS companies, count(DISTINCT entity) AS administrations,
        count(*) FILTER (flag = 'A' OR status = 'F') AS any_flag FROM mov""")
def participations(spark, sf_dir, q):
    anyone = F.exists(F.array(F.col("flag") == "A", F.col("status") == "F"), lambda x: x)
    return movements(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("supplier").alias("companies"), F.count_distinct("entity").alias("administrations"), F.count_if(anyone).alias("any_flag"))


@dataset("consulenti_incarichi", """SELECT 'external' AS series, year, count(*) AS n FROM mov WHERE flag = 'A' AND year = 1999 GROUP BY year UNION ALL
        SELECT 'employee', year, count(*) FROM mov WHERE flag = 'R' AND year = 1999 GROUP BY year""", year=1999)
def appointments(spark, sf_dir, q):
    rows = movements(spark, sf_dir).filter("flag IN ('A', 'R')").select(F.when(F.col("flag") == "A", "external").otherwise("employee").alias("series"), "year")
    return (rows.filter(F.col("year") == q.year) if q.year else rows).groupBy("series", "year").agg(F.count(F.lit(1)).alias("n"))


@dataset("parlamento_bilanci", """SELECT status AS chamber, count(*) AS statements FROM (SELECT DISTINCT status, year, month FROM mov WHERE status = 'F' AND year = 2000)
        GROUP BY status""", chamber="F", year=2000)
def chambers(spark, sf_dir, q):
    """Statements are filtered within their chamber; chambers left without any go."""
    nested = movements(spark, sf_dir).select("status", "year", "month").distinct().groupBy(F.col("status").alias("chamber")).agg(F.collect_list(F.struct("year", "month")).alias("s"))
    nested = nested.filter(F.col("chamber") == q.chamber) if q.chamber else nested
    kept = nested.withColumn("s", F.filter("s", lambda x: x["year"] == q.year)) if q.year else nested
    return kept.filter(F.size("s") > 0).select("chamber", F.size("s").cast("bigint").alias("statements"))


_OUT = Q.ORACLES["a26_f15_o05_outliers"][len("WITH ") + len(SQL) :]


@dataset("controlli_segnali", f"""+ x AS (WITH {SQL}{_OUT}) SELECT entity, region, total_cents, direction FROM x
        ORDER BY multiple DESC NULLS LAST, distance DESC, entity LIMIT 20""", area="spesa-comuni", limit=20)
def signals(spark, sf_dir, q):
    if q.area and q.area.lower() != "spesa-comuni":
        raise QueryError(f"no screening for {q.area}")
    rows = A.outliers(_region(entity_totals(spark, sf_dir, _year(spark, sf_dir, q)).join(regions(spark, sf_dir), "region"), q.region), "region", "total_cents", "entity")
    order = [F.col("multiple").desc_nulls_last(), F.col("distance").desc(), F.col("entity").asc()]
    return S.page(rows, order, *q.page).select("entity", "region", "total_cents", "direction")


_SCREEN = f"""+ x AS (SELECT * FROM (WITH z AS (SELECT 1){_OUT.replace("+ ", ", ", 1) if _OUT.lstrip().startswith("+") else _OUT})) SELECT entity, x.region, total_cents, direction FROM x {{join}}
        ORDER BY multiple DESC NULLS LAST, distance DESC, entity LIMIT 20 OFFSET {{offset}}"""
example("q18_controlli_segnali_region", "controlli_segnali", _SCREEN.format(join="JOIN reg USING (region) WHERE lower(region_name) = 'nation_20'", offset=0).replace("x.region,", "region,"), area="spesa-comuni", region="Nation_20", limit=20)
example("q18_controlli_segnali_year", "controlli_segnali", _of_year(1999, _SCREEN.format(join="", offset=2)), year=1999, limit=20, offset=2)


@dataset("registro_fonti", """SELECT supplier, name FROM (SELECT s_suppkey AS supplier, s_name AS name FROM supplier)
        WHERE contains(lower(name), '9') OR contains(lower(CAST(supplier AS VARCHAR)), '9')""", query="9")
def sources(spark, sf_dir, q):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("name"))
    return rows.filter(X.contains_folded([F.col("name"), F.col("supplier").cast("string")], q.query)) if q.query else rows
