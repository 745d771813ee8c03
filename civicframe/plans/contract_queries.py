"""Contracts over tables that are made wrong on purpose: each query gives, for every variant and rule, whether it holds.

Variant `sound` has the table as it is; every other variant breaks the rules that it is named after.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from civicframe.functions import scalars as X
from civicframe.operators import aggregates as A, joins as J
from civicframe.operators.contracts import Rule, broken, judged
from civicframe.plans.queries import ORACLES, QUERIES
from civicframe.plans.roles import SQL, entities, entity_totals, movements, regions, titles


@dataclass(frozen=True)
class Contract:
    """A table (with its SQL), what each variant changes or loses, and the rules."""

    name: str
    columns: tuple[str, ...]
    sql: str
    rules: tuple[Rule, ...]
    changes: dict[str, str] = field(default_factory=dict)
    lost: str = "false"
    variants: tuple[str, ...] = ()
    #: Columns whose sums pass 64 bits in a variant; Spark sums them up as decimals, as SQL does by itself.
    wide: tuple[str, ...] = ()

    def oracle(self) -> str:
        names = ", ".join(f"('{v}')" for v in ("sound", *self.variants))
        columns = ", ".join(f"{self.changes[c]} AS {c}" if c in self.changes else c for c in self.columns)
        checks = " UNION ALL ".join(f"SELECT variant, '{r.name}' AS check_name, {r.sql()} AS ok FROM t GROUP BY variant" for r in self.rules)
        table = f"t AS (SELECT variant, {columns} FROM base CROSS JOIN (VALUES {names}) AS v(variant) WHERE NOT ({self.lost}))"
        return f"WITH {SQL}, {self.sql}, {table} {checks}"

    def judge(self, rows: DataFrame) -> DataFrame:
        """Whether each rule holds for every variant of the rows."""
        copies = broken(rows.select(*self.columns), ["sound", *self.variants], self.changes, self.lost)
        return judged(copies.withColumns({c: F.col(c).cast("decimal(38,0)") for c in self.wide}), "variant", list(self.rules))


CONTRACTS: dict[str, Contract] = {}


def contract(*args, **options):
    spec = Contract(*args, **options)

    def register(build):
        CONTRACTS[spec.name] = spec
        QUERIES[spec.name] = lambda spark, sf_dir: spec.judge(build(spark, sf_dir))
        ORACLES[spec.name] = spec.oracle()
        return build

    return register


def _add(column: str, variant: str, where: str, amount: str = "1") -> str:
    return f"{column} + CASE WHEN variant = '{variant}' AND {where} THEN {amount} ELSE 0 END"


def _flag_sum(flag: str):
    return F.coalesce(F.sum(F.when(F.col("flag") == flag, F.col("cents"))), F.lit(0)).alias(flag.lower())


_FLAGS = ", ".join(f"CAST(coalesce(sum(cents) FILTER (flag = '{f}'), 0) AS BIGINT) AS {f.lower()}" for f in "ANR")


@contract(
    "v07_v08_v09_months_and_parts",
    ("year", "months", "first", "last", "paid", "a", "n", "r", "unit"),
    f"""base AS (SELECT year, count(DISTINCT month) AS months, min(month) AS first, max(month) AS last, CAST(sum(cents) AS BIGINT) AS paid,
        {_FLAGS}, 'cents' AS unit FROM mov GROUP BY year)""",
    (
        Rule("months_without_gap", "first = 1 AND months = last"),
        Rule("one_open_year", "count(CASE WHEN last < 12 THEN 1 END) <= 1", each=False),
        Rule("parts_are_the_whole", "a + n + r = paid"),
        Rule("one_unit", "unit = 'cents'"),
        Rule("years_once", "count(DISTINCT year) = count(*)", each=False),
    ),
    {
        "months": _add("months", "gap", "year = 1998", "-1"), "n": _add("n", "part", "year = 1999"), "last": _add("last", "open", "year IN (1996, 1997)", "-1"),
        "unit": "CASE WHEN variant = 'unit' AND year = 2000 THEN 'euro' ELSE unit END", "year": _add("year", "twice", "year = 1996"),
    },
    variants=("gap", "part", "open", "unit", "twice"),
)
def months_and_parts(spark, sf_dir):
    seen = (F.count_distinct("month").alias("months"), F.min("month").alias("first"), F.max("month").alias("last"), F.sum("cents").alias("paid"))
    return movements(spark, sf_dir).groupBy("year").agg(*seen, *map(_flag_sum, "ANR")).withColumn("unit", F.lit("cents"))


@contract(
    "v06_v13_national_and_regional",
    ("region", "metric", "regional_cents", "aggregate_cents", "national_cents"),
    """m AS (SELECT region, flag AS metric, CAST(sum(cents) AS BIGINT) AS regional_cents FROM mov JOIN ent USING (entity) GROUP BY region, flag),
        e AS (SELECT entity, flag AS metric, CAST(sum(cents) AS BIGINT) AS cents FROM mov GROUP BY entity, flag),
        g AS (SELECT region, metric, CAST(sum(cents) AS BIGINT) AS aggregate_cents FROM e JOIN ent USING (entity) GROUP BY region, metric),
        n AS (SELECT flag AS metric, CAST(sum(cents) AS BIGINT) AS national_cents FROM mov GROUP BY flag),
        base AS (SELECT * FROM m FULL JOIN g USING (region, metric) JOIN n USING (metric))""",
    (
        Rule("regions", "count(DISTINCT region) = 25", each=False),
        Rule("metrics_of_every_region", "count(*) = count(DISTINCT region) * count(DISTINCT metric)", each=False),
        Rule("aggregate_rows_are_regional", "aggregate_cents = regional_cents"),
        *[
            Rule(f"national_{f.lower()}", f"sum(CASE WHEN metric = '{f}' THEN regional_cents END) = max(CASE WHEN metric = '{f}' THEN national_cents END)", each=False)
            for f in "ANR"
        ],
    ),
    {"aggregate_cents": _add("aggregate_cents", "aggregate", "region = 3 AND metric = 'A'"), "national_cents": _add("national_cents", "national", "metric = 'R'", "-1")},
    "variant = 'lost_region' AND region = 4 OR variant = 'lost_metric' AND region = 5 AND metric = 'N'",
    ("aggregate", "national", "lost_region", "lost_metric"),
)
def national_and_regional(spark, sf_dir):
    rows = movements(spark, sf_dir).withColumnRenamed("flag", "metric")
    of = entities(spark, sf_dir).select("entity", "region")
    regional = rows.join(of, "entity").groupBy("region", "metric").agg(F.sum("cents").alias("regional_cents"))
    detail = rows.groupBy("entity", "metric").agg(F.sum("cents").alias("cents"))
    aggregate = detail.join(of, "entity").groupBy("region", "metric").agg(F.sum("cents").alias("aggregate_cents"))
    national = rows.groupBy("metric").agg(F.sum("cents").alias("national_cents"))
    return regional.join(aggregate, ["region", "metric"], "full_outer").join(national, "metric")


@contract(
    "v14_v15_people_and_levels",
    ("entity", "historic", "historic_head", "standard", "standard_head", "level"),
    """base AS (SELECT entity, CAST(total_cents AS DOUBLE) AS historic, CAST(total_cents AS DOUBLE) / people AS historic_head, CAST(title_cents AS DOUBLE) AS standard,
        CAST(title_cents AS DOUBLE) / people AS standard_head, CAST(entity % 11 AS DOUBLE) AS level FROM et WHERE people > 0 AND title_cents > 0)""",
    (
        Rule("same_people", "abs(historic / historic_head - standard / standard_head) / (standard / standard_head) <= 0.000001"),
        Rule("whole_levels", "level = floor(level)"),
        Rule("levels_in_range", "level >= 0 AND level <= 10"),
    ),
    {
        "standard_head": "standard_head * CASE WHEN variant = 'people' AND entity % 50 = 1 THEN 1.0001 ELSE 1.0 END",
        "level": "level + CASE WHEN variant = 'half' AND level = 3 THEN 0.5 WHEN variant = 'range' AND level = 10 THEN 1.0 ELSE 0.0 END",
    },
    variants=("people", "half", "range"),
)
def people_and_levels(spark, sf_dir):
    rows = entity_totals(spark, sf_dir).filter("people > 0 AND title_cents > 0")
    historic, standard = F.col("total_cents").cast("double"), F.col("title_cents").cast("double")
    return rows.select(
        "entity", historic.alias("historic"), (historic / F.col("people")).alias("historic_head"), standard.alias("standard"),
        (standard / F.col("people")).alias("standard_head"), (F.col("entity") % 11).cast("double").alias("level"),
    )


@contract(
    "v16_appointments",
    ("series", "year", "assignments", "completed", "managers", "others"),
    """base AS (SELECT CASE WHEN supplier % 2 = 0 THEN 'external' ELSE 'employee' END AS series, year, count(*) AS assignments,
        count(*) FILTER (status = 'F') AS completed,
        count(*) FILTER (flag = 'A') AS managers, count(*) FILTER (flag <> 'A') AS others FROM mov GROUP BY 1, 2)""",
    (
        Rule("completed_at_most_all", "completed <= assignments"),
        Rule("parts_are_the_whole", "managers + others = assignments"),
        Rule("years_once", "count(*) = count(DISTINCT concat(series, CAST(year AS VARCHAR(4))))", each=False),
        Rule(
            "same_years",
            "count(DISTINCT CASE WHEN series = 'external' THEN year END) = count(DISTINCT year) AND count(DISTINCT CASE WHEN series = 'employee' THEN year END) = count(DISTINCT year)",
            each=False,
        ),
    ),
    {
        "completed": "CASE WHEN variant = 'completed' AND year = 1997 THEN assignments + 1 ELSE completed END", "managers": _add("managers", "parts", "year = 1999 AND series = 'employee'"),
        "year": _add("year", "twice", "year = 1998 AND series = 'external'"),
    },
    "variant = 'years' AND series = 'external' AND year = 2000",
    ("completed", "parts", "twice", "years"),
)
def appointments(spark, sf_dir):
    series = F.when(F.col("supplier") % 2 == 0, "external").otherwise("employee").alias("series")
    counters = (F.count_if(F.col("status") == "F").alias("completed"), F.count_if(F.col("flag") == "A").alias("managers"), F.count_if(F.col("flag") != "A").alias("others"))
    return movements(spark, sf_dir).groupBy(series, "year").agg(F.count(F.lit(1)).alias("assignments"), *counters)


@contract(
    "v17_stock_and_change",
    ("year", "national", "regional", "stock", "allowances", "pensions", "previous", "change_cents"),
    """y AS (SELECT year, CAST(sum(cents) AS BIGINT) AS national, count(*) AS stock, count(*) FILTER (flag = 'A') AS allowances,
        count(*) FILTER (flag <> 'A') AS pensions FROM mov GROUP BY year),
        g AS (SELECT region, year, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) GROUP BY region, year),
        s AS (SELECT year, CAST(sum(cents) AS BIGINT) AS regional FROM g GROUP BY year),
        base AS (SELECT *, lag(national) OVER (ORDER BY year) AS previous, national - lag(national) OVER (ORDER BY year) AS change_cents
        FROM y JOIN s USING (year))""",
    (
        Rule("regions_are_the_nation", "regional = national"),
        Rule("parts_are_the_stock", "allowances + pensions = stock"),
        Rule("change_of_the_series", "previous IS NULL AND change_cents IS NULL OR change_cents = national - previous"),
        Rule("one_begin", "count(CASE WHEN previous IS NULL THEN 1 END) = 1", each=False),
    ),
    {
        "regional": _add("regional", "regions", "year = 1996"), "pensions": _add("pensions", "stock", "year = 1997", "-1"), "change_cents": _add("change_cents", "change", "year = 1998"),
        "previous": "CASE WHEN variant = 'begin' AND year = 2000 THEN NULL ELSE previous END",
    },
    variants=("regions", "stock", "change", "begin"),
)
def stock_and_change(spark, sf_dir):
    from civicframe.operators import series as S

    rows = movements(spark, sf_dir)
    parts = (F.count_if(F.col("flag") == "A").alias("allowances"), F.count_if(F.col("flag") != "A").alias("pensions"))
    years = rows.groupBy("year").agg(F.sum("cents").alias("national"), F.count(F.lit(1)).alias("stock"), *parts)
    by_region = rows.join(entities(spark, sf_dir).select("entity", "region"), "entity").groupBy("region", "year").agg(F.sum("cents").alias("cents"))
    both = years.join(by_region.groupBy("year").agg(F.sum("cents").alias("regional")), "year").withColumn("series", F.lit("all"))
    moved = S.changes(both, ["series"], "year", "national").withColumnRenamed("change", "change_cents")
    return moved.withColumn("previous", F.col("national") - F.col("change_cents"))


@contract(
    "v18_balances",
    ("region", "year", "revenue", "expenditure", "balance", "people", "head"),
    """p AS (SELECT region, sum(people) AS people FROM ent GROUP BY region),
        s AS (SELECT region, year, CAST(coalesce(sum(cents) FILTER (flag = 'N'), 0) AS BIGINT) AS revenue,
        CAST(coalesce(sum(cents) FILTER (flag <> 'N'), 0) AS BIGINT) AS expenditure
            FROM mov JOIN ent USING (entity) GROUP BY region, year),
        base AS (SELECT region, year, revenue, expenditure, revenue - expenditure AS balance, CASE
        WHEN year <> 1996 THEN CAST(people AS BIGINT) END AS people,
            CASE WHEN year <> 1996 THEN CAST(sign(revenue - expenditure) * ((2 * abs(revenue - expenditure) + people) // (2 * people)) AS
        BIGINT) END AS head FROM s JOIN p USING (region))""",
    (
        Rule("balance", "balance = revenue - expenditure"),
        Rule("no_head_without_people", "people IS NOT NULL OR head IS NULL"),
        Rule("head_rounds_half_away", "people IS NULL OR 2 * abs(head * people - balance) < people OR 2 * abs(head * people - balance) = people AND abs(head * people) > abs(balance)"),
        Rule("positive_people", "people IS NULL OR people > 0"),
        Rule("territories_of_every_year", "count(*) = count(DISTINCT region) * count(DISTINCT year)", each=False),
        Rule("rows_once", "count(*) = count(DISTINCT region * 10000 + year)", each=False),
    ),
    {
        "balance": _add("balance", "balance", "region = 2 AND year = 1999"), "head": _add("head", "head", "region = 3 AND year = 1998"),
        "people": "CASE WHEN variant = 'unknown' AND region = 4 AND year = 1997 THEN NULL WHEN variant = 'nobody' AND region = 5 AND year = 1997 THEN 0 ELSE people END",
        "year": _add("year", "twice", "region = 6 AND year = 1996"),
    },
    "variant = 'lost' AND region = 7 AND year = 1998",
    ("balance", "head", "unknown", "nobody", "twice", "lost"),
)
def balances(spark, sf_dir):
    """Revenue, expenditure, their balance and its share of a head; people are unknown for one year."""
    of = entities(spark, sf_dir)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0))
    sums = movements(spark, sf_dir).join(of.select("entity", "region"), "entity").groupBy("region", "year")
    sums = sums.agg(part(F.col("flag") == "N").alias("revenue"), part(F.col("flag") != "N").alias("expenditure"))
    people = of.groupBy("region").agg(F.sum("people").alias("people"))
    rows = sums.join(people, "region").withColumn("people", F.when(F.col("year") != 1996, F.col("people"))).withColumn("balance", F.col("revenue") - F.col("expenditure"))
    return rows.withColumn("head", X.round_half_away(F.col("balance"), F.col("people")))


@contract(
    "v19_category_tree",
    ("year", "payments", "category", "label", "paid", "parts", "part_sum", "caveat"),
    """c AS (SELECT year, title AS category, CAST(sum(cents) AS BIGINT) AS paid, count(DISTINCT flag) AS parts FROM mov JOIN tit USING (part)
        GROUP BY year, title),
        y AS (SELECT year, CAST(sum(cents) AS BIGINT) AS payments FROM mov GROUP BY year),
        base AS (SELECT year, payments, category, concat('Titolo ', category) AS label, paid, parts, paid AS part_sum,
        'only parts' AS caveat FROM c JOIN y USING (year))""",
    (
        Rule("components_are_the_category", "abs(part_sum - paid) <= 0"),
        Rule("decomposed_with_caveat", "parts = 0 OR caveat IS NOT NULL"),
        Rule("mandatory_categories", "count(CASE WHEN category = '1' THEN 1 END) = count(DISTINCT year) AND count(CASE WHEN category = '2' THEN 1 END) = count(DISTINCT year)", each=False),
        Rule("labels", "label = concat('Titolo ', category)"),
        Rule("categories_are_the_payments", "abs(sum(paid) - sum(DISTINCT payments)) <= 100", each=False),
        Rule("plausible_years", "year >= 1948 AND year <= 2200"),
    ),
    {
        "part_sum": _add("part_sum", "component", "year = 1999 AND category = '2'"), "caveat": "CASE WHEN variant = 'caveat' AND category = '3' THEN NULL ELSE caveat END",
        "label": "CASE WHEN variant = 'label' AND category = '3' THEN 'Vitalizi' ELSE label END", "paid": _add("paid", "payments", "year = 2000 AND category = '1'", "1000"),
        "year": _add("year", "year", "year = 1995", "-100"),
    },
    "variant = 'mandatory' AND category = '1' AND year = 1998",
    ("component", "caveat", "label", "payments", "year", "mandatory"),
)
def category_tree(spark, sf_dir):
    """Statements as trees (year, categories, components), taken apart again for the rules."""
    rows = movements(spark, sf_dir).join(titles(spark, sf_dir), "part")
    parts = rows.groupBy("year", F.col("title").alias("category"), "flag").agg(F.sum("cents").alias("paid"))
    categories = parts.groupBy("year", "category").agg(F.sum("paid").alias("paid"), F.collect_list(F.struct("flag", "paid")).alias("components"))
    tree = categories.groupBy("year").agg(F.collect_list(F.struct("category", "paid", "components")).alias("categories"))
    tree = tree.join(rows.groupBy("year").agg(F.sum("cents").alias("payments")), "year")
    part_sum = F.aggregate("c.components", F.lit(0).cast("bigint"), lambda a, x: a + x["paid"])
    return tree.select("year", "payments", F.explode("categories").alias("c")).select(
        "year", "payments", "c.category", F.concat(F.lit("Titolo "), "c.category").alias("label"), "c.paid",
        F.size("c.components").cast("bigint").alias("parts"), part_sum.alias("part_sum"), F.lit("only parts").alias("caveat"),
    )


@contract(
    "v20_v21_v23_rows",
    ("entity", "region", "region_name", "total_cents", "title_cents", "frequency", "amount"),
    """base AS (SELECT entity, region, region_name, total_cents, title_cents, CASE WHEN balance_cents >= 0 THEN people END AS frequency,
        CASE WHEN balance_cents >= 0 AND people IS NOT NULL THEN balance_cents END AS amount FROM et JOIN reg USING (region))""",
    (
        Rule("both_or_none", "(frequency IS NULL) = (amount IS NULL)"),
        Rule("title_within_total", "title_cents <= total_cents"),
        Rule("title_within_total_of_all", "sum(title_cents) <= sum(total_cents)", each=False),
        Rule("safe_sum", "abs(sum(CAST(total_cents AS DECIMAL(38,0)))) <= 9007199254740991", each=False),
        Rule("entities_once", "count(DISTINCT entity) = count(*)", each=False),
        Rule("region_determines_name", "count(DISTINCT concat(CAST(region AS VARCHAR(9)), region_name)) = count(DISTINCT region)", each=False),
    ),
    {
        "amount": "CASE WHEN variant = 'half' AND entity % 7 = 0 THEN NULL ELSE amount END", "title_cents": "CASE WHEN variant = 'title' AND entity % 9 = 1 THEN total_cents + 1 ELSE title_cents END",
        "total_cents": _add("total_cents", "huge", "entity % 2 = 1", "9007199254740991"), "entity": "CASE WHEN variant = 'twice' AND entity % 10 = 1 THEN 1 ELSE entity END",
        "region_name": "CASE WHEN variant = 'name' AND entity % 5 = 1 THEN 'other' ELSE region_name END",
    },
    variants=("half", "title", "huge", "twice", "name"),
    wide=("total_cents", "title_cents"),
)
def checked_rows(spark, sf_dir):
    shown = F.col("balance_cents") >= 0
    rows = J.checked_lookup(entity_totals(spark, sf_dir), regions(spark, sf_dir), "region")
    amount = F.when(shown & F.col("people").isNotNull(), F.col("balance_cents"))
    return rows.select("entity", "region", "region_name", "total_cents", "title_cents", F.when(shown, F.col("people")).alias("frequency"), amount.alias("amount"))


# --- the distribution of payments per head: groups by band and region, coverage, and how they must agree -----------------

_COVERAGE = (
    "movements", "with_people", "without_people", "with_region", "without_region", "with_both", "people", "regional_people", "paid", "paid_with_people", "paid_without_people",
    "paid_without_region", "paid_people_no_region", "title", "title_without_people", "title_without_region", "title_people_no_region", "share_all", "share_covered", "active", "matched",
)
_MEASURES = ("kind", "id", "n", "group_people", "group_title", "group_total", "group_share", *[f"m_{p}" for p, _ in A.PROBABILITIES], *[f"r_{p}" for p, _ in A.PROBABILITIES])
_KNOWN, _REGIONAL = "people IS NOT NULL", "region % 5 <> 0"


def _sum(kind: str, column: str) -> str:
    return f"sum(CASE WHEN kind = '{kind}' THEN {column} ELSE 0 END)"


def _present(prefix: str) -> str:
    names = [f"{prefix}_{p}" for p, _ in A.PROBABILITIES]
    return f"(n > 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in names)} OR n = 0 AND {' AND '.join(f'{c} IS NULL' for c in names)})"


def _monotone(prefix: str) -> str:
    names = [f"{prefix}_{p}" for p, _ in A.PROBABILITIES]
    return f"(n = 0 OR {' AND '.join(f'{a} <= {b}' for a, b in zip(names, names[1:]))})"


_RULES = (
    Rule("matched_are_active", "matched <= active"),
    Rule("regions_of_movements", "with_region + without_region = movements"),
    Rule("people_of_movements", "with_people + without_people = movements"),
    Rule("regional_are_matched", "with_region <= matched AND without_region <= active - matched"),
    Rule("both_within_people", "with_both <= with_people"),
    Rule("people_without_region", "with_people - with_both <= without_region"),
    Rule("regional_people", "regional_people <= people"),
    Rule("payments_by_people", "abs(paid_with_people + paid_without_people - paid) <= 25"),
    Rule("payments_without_region", "paid_people_no_region <= paid_without_region"),
    Rule("title_without_region", "title_without_region <= paid_without_region AND title_people_no_region <= title_without_region AND title_people_no_region <= paid_people_no_region"),
    Rule("shares_at_most_one", "share_all <= 1 AND share_covered <= 1"),
    Rule("share_all", "abs(share_all - CAST(title AS DOUBLE) / paid) <= 0.00000002"),
    Rule("share_covered", f"abs(max(share_covered) - CAST({_sum('band', 'group_title')} AS DOUBLE) / {_sum('band', 'group_total')}) <= 0.00000002", each=False),
    Rule("eight_bands", "count(CASE WHEN kind = 'band' THEN 1 END) = 8 AND count(DISTINCT CASE WHEN kind = 'band' THEN id END) = 8", each=False),
    Rule("twenty_regions", "count(CASE WHEN kind = 'region' THEN 1 END) = 20 AND count(DISTINCT CASE WHEN kind = 'region' THEN id END) = 20", each=False),
    Rule("bands_hold_all_with_people", f"{_sum('band', 'n')} = max(with_people)", each=False),
    Rule("regions_hold_all_with_both", f"{_sum('region', 'n')} = max(with_both)", each=False),
    Rule("bands_hold_all_people", f"{_sum('band', 'group_people')} = max(people)", each=False),
    Rule("regions_hold_regional_people", f"{_sum('region', 'group_people')} = max(regional_people)", each=False),
    Rule("bands_hold_covered_payments", f"abs({_sum('band', 'group_total')} - max(paid_with_people)) <= 25", each=False),
    Rule("regions_and_rest_hold_covered_payments", f"abs({_sum('region', 'group_total')} + max(paid_people_no_region) - {_sum('band', 'group_total')}) <= 25", each=False),
    Rule("regions_and_rest_hold_covered_title", f"abs({_sum('region', 'group_title')} + max(title_people_no_region) - {_sum('band', 'group_title')}) <= 25", each=False),
    Rule("bands_and_rest_hold_title", f"abs({_sum('band', 'group_title')} + max(title_without_people) - max(title)) <= 25", each=False),
    Rule("group_title_within_total", "group_title <= group_total + 1"),
    Rule("group_share_within_one", "group_share IS NULL OR group_share <= 1"),
    Rule("group_share_with_base", "(group_total = 0) = (group_share IS NULL)"),
    Rule("group_share", "group_share IS NULL OR abs(group_share - CAST(group_title AS DOUBLE) / group_total) <= 0.00000002"),
    Rule("nobody_nowhere", "(n = 0) = (group_people = 0)"),
    Rule("quantiles_present", f"{_present('m')} AND {_present('r')}"),
    Rule("quantiles_monotone", f"{_monotone('m')} AND {_monotone('r')}"),
)
#: What each variant changes: column, where, by how much.
_BREAKS = {
    "matched": ("matched", "true", "active"), "with_region": ("with_region", "true", "1"), "without_people": ("without_people", "true", "1"), "few_matched": ("matched", "true", "-matched"),
    "with_both": ("with_both", "true", "with_people"), "no_both": ("with_both", "true", "-with_both"), "regional_people": ("regional_people", "true", "people"), "paid": ("paid_with_people", "true", "26"),
    "no_region": ("paid_people_no_region", "true", "paid_without_region"), "title_no_region": ("title_people_no_region", "true", "title_without_region + 1"), "share": ("share_all", "true", "1.0"),
    "share_all": ("share_all", "true", "0.0000001"), "share_covered": ("share_covered", "true", "0.0000001"), "band_n": ("n", "kind = 'band' AND id = '1000-4999'", "1"),
    "region_n": ("n", "kind = 'region' AND id = '3'", "1"), "band_people": ("group_people", "kind = 'band' AND id = '1000-4999'", "1"), "region_people": ("group_people", "kind = 'region' AND id = '3'", "1"),
    "band_total": ("group_total", "kind = 'band' AND id = '1000-4999'", "26"), "region_total": ("group_total", "kind = 'region' AND id = '3'", "26"),
    "region_title": ("group_title", "kind = 'region' AND id = '3'", "26"), "band_title": ("group_title", "kind = 'band' AND id = '1000-4999'", "26"),
    "title_over_total": ("group_title", "kind = 'region' AND id = '6'", "group_total + 2"), "group_share": ("group_share", "kind = 'region' AND id = '7'", "0.0000001"),
    "share_over_one": ("group_share", "kind = 'region' AND id = '8'", "1.0"), "nobody": ("group_people", "kind = 'region' AND id = '9'", "-group_people"),
    "monotone": ("m_p90", "kind = 'region' AND id = '11'", "-m_p90 - 1"),
}
_NULLS = {"no_share": ("group_share", "kind = 'region' AND id = '12'"), "no_quantile": ("r_p50", "kind = 'band' AND id = '1000-4999'")}
_LOST = "variant = 'lost_band' AND kind = 'band' AND id = '500000-plus' OR variant = 'lost_region' AND kind = 'region' AND id = '13'"


def _changes() -> dict[str, str]:
    out = {}
    for column in dict.fromkeys([c for c, *_ in _BREAKS.values()] + [c for c, _ in _NULLS.values()]):
        steps = " ".join(f"WHEN variant = '{v}' AND {where} THEN {column} + {by}" for v, (c, where, by) in _BREAKS.items() if c == column)
        steps += " ".join(f" WHEN variant = '{v}' AND {where} THEN NULL" for v, (c, where) in _NULLS.items() if c == column)
        out[column] = f"CASE {steps} ELSE {column} END"
    return out


def _quantiles_sql(by: str, weight: str, prefix: str) -> str:
    picks = ", ".join(f"min(v) FILTER (cum >= CAST({p} AS DOUBLE) * total) AS {prefix}_{n}" for n, p in A.PROBABILITIES)
    return f"""(SELECT id, {picks} FROM (SELECT id, v, CAST(sum(w) OVER (PARTITION BY id ORDER BY v RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS cum,
        CAST(sum(w) OVER (PARTITION BY id) AS DOUBLE) AS total FROM (SELECT {by} AS id, title_cents // people AS v, {weight} AS w FROM b
        WHERE {by} IS NOT NULL)) GROUP BY id)"""


def _groups_sql(kind: str, by: str, ids: str) -> str:
    return f"""SELECT '{kind}' AS kind, ids.id, count(entity) AS n, CAST(coalesce(sum(people), 0) AS BIGINT) AS group_people,
        CAST(coalesce(sum(title_cents), 0) AS BIGINT) AS group_title,
        CAST(coalesce(sum(total_cents), 0) AS BIGINT) AS group_total, CAST(sum(title_cents) AS DOUBLE) / nullif(sum(total_cents),
        0) AS group_share,
        {", ".join(f"any_value({p}_{q}) AS {p}_{q}" for p in "mr" for q, _ in A.PROBABILITIES)}
        FROM ({ids}) ids LEFT JOIN b ON b.{by} = ids.id LEFT JOIN {_quantiles_sql(by, "1", "m")} qm ON qm.id = ids.id LEFT
        JOIN {_quantiles_sql(by, "people", "r")} qr ON qr.id = ids.id GROUP BY ids.id"""


_BAND = " ".join(f"WHEN {f'people >= {low}' if low is not None else 'true'} {f'AND people < {high}' if high is not None else ''} THEN '{name}'" for name, low, high in A.POPULATION_BANDS)
_DISTRIBUTION = f"""b AS (SELECT *, CASE {_BAND} END AS band, CASE WHEN {_REGIONAL} THEN CAST(region AS VARCHAR) END AS place FROM et WHERE {_KNOWN}),
    g AS ({_groups_sql("band", "band", "SELECT unnest([" + ", ".join(f"'{b[0]}'" for b in A.POPULATION_BANDS) + "]) AS id")}
        UNION ALL {_groups_sql("region", "place", "SELECT CAST(region AS VARCHAR) AS id FROM reg WHERE " + _REGIONAL)}),
    c AS (SELECT count(*) AS movements, count(people) AS with_people, count(*) - count(people) AS without_people,
        count(*) FILTER ({_REGIONAL}) AS with_region,
        count(*) FILTER (NOT {_REGIONAL}) AS without_region, count(*) FILTER ({_KNOWN} AND {_REGIONAL}) AS with_both,
        CAST(sum(people) AS BIGINT) AS people,
        CAST(sum(people) FILTER ({_REGIONAL}) AS BIGINT) AS regional_people, CAST(sum(total_cents) AS BIGINT) AS paid,
        CAST(coalesce(sum(total_cents) FILTER ({_KNOWN}), 0) AS BIGINT) AS paid_with_people,
        CAST(coalesce(sum(total_cents) FILTER (NOT {_KNOWN}), 0) AS BIGINT) AS paid_without_people,
        CAST(coalesce(sum(total_cents) FILTER (NOT {_REGIONAL}), 0) AS BIGINT) AS paid_without_region,
        CAST(coalesce(sum(total_cents) FILTER ({_KNOWN} AND NOT {_REGIONAL}), 0) AS BIGINT) AS paid_people_no_region,
        CAST(sum(title_cents) AS BIGINT) AS title,
        CAST(coalesce(sum(title_cents) FILTER (NOT {_KNOWN}), 0) AS BIGINT) AS title_without_people,
        CAST(coalesce(sum(title_cents) FILTER (NOT {_REGIONAL}), 0) AS BIGINT) AS title_without_region,
        CAST(coalesce(sum(title_cents) FILTER ({_KNOWN} AND NOT {_REGIONAL}), 0) AS BIGINT) AS title_people_no_region,
        CAST(sum(title_cents) AS DOUBLE) / sum(total_cents) AS share_all,
        CAST(sum(title_cents) FILTER ({_KNOWN}) AS DOUBLE) / sum(total_cents) FILTER ({_KNOWN}) AS share_covered FROM et),
    k AS (SELECT count(*) AS active, count(*) FILTER ({_REGIONAL}) AS matched FROM ent),
    base AS (SELECT * FROM g, c, k)"""


def _groups(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts, sums, share and both kinds of quantiles (every entity as one, every resident as one) for each kind and id, empty ones too; in one pass over the entities' groups."""
    both = F.array(F.struct(F.lit("band").alias("kind"), F.col("band").alias("id")), F.struct(F.lit("region").alias("kind"), F.col("place").alias("id")))
    of = rows.select("people", "title_cents", "total_cents", "head", F.explode(both).alias("g")).select("g.*", "people", "title_cents", "total_cents", "head").filter("id IS NOT NULL")
    sums = of.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("people").alias("group_people"), F.sum("title_cents").alias("group_title"), F.sum("total_cents").alias("group_total"))
    weights = F.array(F.struct(F.lit("m").alias("by"), F.lit(1).cast("bigint").alias("weight")), F.struct(F.lit("r").alias("by"), F.col("people").alias("weight")))
    ranked = A.weighted_nearest_rank(of.select("kind", "id", "head", F.explode(weights).alias("w")).select("kind", "id", "head", "w.*"), ["kind", "id", "by"], "head", "weight")
    picks = [F.max(F.when(F.col("by") == p, F.col(n))).alias(f"{p}_{n}") for p in "mr" for n, _ in A.PROBABILITIES]
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "group_people", "group_title", "group_total")]
    found = ids.join(sums, ["kind", "id"], "left").select("kind", "id", *zero)
    found = found.withColumn("group_share", F.try_divide(F.col("group_title").cast("double"), F.col("group_total").cast("double")))
    return found.join(ranked.groupBy("kind", "id").agg(*picks), ["kind", "id"], "left")


@contract("v12_v22_w10_distribution", (*_MEASURES, *_COVERAGE), _DISTRIBUTION, _RULES, _changes(), _LOST, (*_BREAKS, *_NULLS, "lost_band", "lost_region"))
def distribution(spark, sf_dir):
    """Groups by band and region next to the one row of coverage."""
    known, regional = F.col("people").isNotNull(), F.col("region") % 5 != 0
    rows = entity_totals(spark, sf_dir)
    own = rows.filter(known).withColumn("band", A.banded(None, "people")).withColumn("place", F.when(regional, F.col("region").cast("string")))
    own = own.withColumn("head", F.floor(F.col("title_cents") / F.col("people")).cast("bigint"))
    places = regions(spark, sf_dir).filter(regional).select(F.lit("region").alias("kind"), F.col("region").cast("string").alias("id"))
    groups = _groups(own, A.band_table(spark).select(F.lit("band").alias("kind"), F.col("band").alias("id")).unionByName(places))

    def total(column: str, where=None):
        return F.coalesce(F.sum(F.col(column) if where is None else F.when(where, F.col(column))), F.lit(0))

    coverage = rows.agg(
        F.count(F.lit(1)).alias("movements"), F.count_if(known).alias("with_people"), F.count_if(~known).alias("without_people"), F.count_if(regional).alias("with_region"),
        F.count_if(~regional).alias("without_region"), F.count_if(known & regional).alias("with_both"), total("people").alias("people"), total("people", regional).alias("regional_people"),
        total("total_cents").alias("paid"), total("total_cents", known).alias("paid_with_people"), total("total_cents", ~known).alias("paid_without_people"),
        total("total_cents", ~regional).alias("paid_without_region"), total("total_cents", known & ~regional).alias("paid_people_no_region"), total("title_cents").alias("title"),
        total("title_cents", ~known).alias("title_without_people"), total("title_cents", ~regional).alias("title_without_region"),
        total("title_cents", known & ~regional).alias("title_people_no_region"),
        F.try_divide(total("title_cents").cast("double"), total("total_cents").cast("double")).alias("share_all"),
        F.try_divide(total("title_cents", known).cast("double"), total("total_cents", known).cast("double")).alias("share_covered"),
    )
    registered = entities(spark, sf_dir).agg(F.count(F.lit(1)).alias("active"), F.count_if(regional).alias("matched"))
    # both sides have one row
    return groups.crossJoin(F.broadcast(coverage.crossJoin(F.broadcast(registered))))
