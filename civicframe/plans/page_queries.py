"""Pages, sort keys, lookups and change detection, each id with a row of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from civicframe.functions import scalars as X
from civicframe.operators import aggregates as A, joins as J, series as S
from civicframe.operators.paging import StoredOrder
from civicframe.plans.queries import query
from civicframe.plans.roles import entities, entity_totals, movements, read, regions

_DIFFERENCE = "total_cents - title_cents"
_HEAD = "CAST(round(CAST(total_cents AS DOUBLE) / (people * 100), 2) AS DECIMAL(20,2))"
#: Sort keys of a list of entities and what they are in SQL.
KEYS = {"code": "entity", "difference": _DIFFERENCE, "per_capita": _HEAD, "percent": f"CASE WHEN title_cents > 0 THEN CAST(round(CAST({_DIFFERENCE} AS DOUBLE) * 100 / title_cents, 6) AS DECIMAL(20,6)) END"}


def _sorted_sql(key: str, descending: bool) -> str:
    order = f"{KEYS[key]} {'DESC' if descending else 'ASC'} NULLS LAST, entity"
    return f"""SELECT '{key}' AS sort_key, {str(descending).lower()} AS descending, entity, place
        FROM (SELECT entity, row_number() OVER (ORDER BY {order}) AS place FROM et) WHERE place <= 15"""


@query("o01_o02_sort_keys", " UNION ALL ".join(f"({_sorted_sql(k, d)})" for k in KEYS for d in (False, True)))
def sort_keys(spark, sf_dir):
    """The first places by every key in both directions: nulls last, ties by code."""
    rows = entity_totals(spark, sf_dir)
    difference = F.col("total_cents") - F.col("title_cents")
    keys = {
        "code": F.col("entity"), "difference": difference, "per_capita": X.per_capita(F.col("total_cents"), F.col("people")),
        "percent": F.when(F.col("title_cents") > 0, X.percentage(difference, F.col("title_cents"))),
    }
    from pyspark.sql import Window as W

    # both directions of every key as rows of their own: nulls last, descending keys turned
    sides = [F.struct(F.lit(n).alias("sort_key"), F.lit(d).alias("descending"), (-k if d else k).cast("decimal(30,6)").alias("k")) for n, k in keys.items() for d in (False, True)]
    spread = rows.select("entity", F.explode(F.array(*sides)).alias("x")).select("x.*", "entity")
    place = F.row_number().over(W.partitionBy("sort_key", "descending").orderBy(F.col("k").asc_nulls_last(), "entity"))
    return spread.withColumn("place", place).filter("place <= 15").select("sort_key", "descending", "entity", F.col("place").cast("bigint").alias("place"))


@query(
    "o03_o04_o08_region_ranking",
    """+ s AS (SELECT region_name, area, CAST(sum(total_cents) AS BIGINT) AS cents, CAST(sum(CASE
        WHEN region % 4 <> 0 THEN people END) AS BIGINT) AS people FROM et JOIN reg USING (region) GROUP BY region_name, area, region),
        h AS (SELECT *, CAST(round(CAST(cents AS DOUBLE) / (people * 100), 0) AS BIGINT) // 20 AS head FROM s)
        SELECT region_name, head, row_number() OVER (ORDER BY head DESC NULLS LAST, lower(strip_accents(region_name))) AS place,
        row_number() OVER (ORDER BY lower(region_name)) AS by_name FROM h""",
)
def region_ranking(spark, sf_dir):
    """By a head's share, unknown ones last, then by name without case and accents."""
    sums = entity_totals(spark, sf_dir).join(regions(spark, sf_dir), "region").groupBy("region", "region_name")
    sums = sums.agg(F.sum("total_cents").alias("cents"), F.sum(F.when(F.col("region") % 4 != 0, F.col("people"))).alias("people"))
    head = F.floor(F.round(F.try_divide(F.col("cents").cast("double"), F.col("people") * 100), 0) / 20).cast("bigint")
    rows = sums.select("region_name", head.alias("head"))
    ranked = S.numbered(rows, [F.col("head").desc_nulls_last(), F.collate("region_name", "UNICODE_CI_AI").asc()])
    return S.numbered(ranked, [F.lower("region_name").asc()], "by_name")


@query("o07_composite_order", "SELECT region, segment, entity, row_number() OVER (ORDER BY region, segment, entity) AS place FROM ent ORDER BY place LIMIT 40")
def composite_order(spark, sf_dir):
    order = [F.asc("region"), F.asc("segment"), F.asc("entity")]
    return S.numbered(S.top(entities(spark, sf_dir).select("region", "segment", "entity"), order, 40), order)


#: Requests of pages: (asked page, asked size, offset, limit).
REQUESTS = ((1, 10, 0, 10), (3, 10, 20, 10), (9999, 50, -5, 900), (0, 7, 7, 0), (2, 1, 100000000, 3))


def _page_sql(i: int, page: int, size: int) -> str:
    return f"""SELECT {i} AS request, p.page, (SELECT n FROM k) AS total, least({size}, (SELECT n
        FROM k) - (p.page - 1) * {size}) AS returned, (SELECT n FROM k) > p.page * {size} AS has_more,
        (SELECT min(entity) FROM o WHERE place > (p.page - 1) * {size} AND place <= p.page * {size}) AS least
        FROM (SELECT least(greatest(1, {page}), greatest(1, CAST(ceil((SELECT n FROM k) / {size}.0) AS BIGINT))) AS page) p"""


@query("o09_o12_page_numbers", """+ k AS (SELECT count(*) AS n FROM ent), o AS (SELECT entity, row_number() OVER (ORDER BY people DESC NULLS LAST, entity) AS place
        FROM ent) """ + " UNION ALL ".join(f"({_page_sql(i, p, s)})" for i, (p, s, _, _) in enumerate(REQUESTS)))
def page_numbers(spark, sf_dir):
    """Pages by number, moved to the last there is, with total, returned and whether there is more: all from one stored order, whose ranges know the total."""
    stored = StoredOrder.build(entities(spark, sf_dir).select("entity", "people"), S.ordered_by("people", True, "entity"))
    total, asked, facts = stored.total, [], []
    for i, (page, size, _, _) in enumerate(REQUESTS):
        at = S.last_page(page, total, size)
        asked.append(((at - 1) * size, size))
        facts.append((i, at, total, max(0, min(size, total - (at - 1) * size)), total > at * size))
    least = stored.pages(asked).groupBy("request").agg(F.min("entity").alias("least"))
    known = spark.createDataFrame(facts, "request int, page bigint, total bigint, returned bigint, has_more boolean")
    return known.join(least, "request", "left")


_CLAMPED = ", ".join(f"({i}, least(greatest({o}, 0), 100000), least(greatest({n}, 1), 100))" for i, (_, _, o, n) in enumerate(REQUESTS))


@query(
    "o10_o11_o14_offsets",
    f"""+ k AS (SELECT count(*) AS n FROM ent), r(request, first, size) AS (VALUES {_CLAMPED})
        SELECT request, CAST(first AS BIGINT) AS first, CAST(greatest(least(size, n - first), 0) AS BIGINT) AS returned, n AS total,
        CAST(CASE WHEN first + size < n THEN first + size END AS BIGINT) AS next_offset,
        request IN (0, 1) AS within_bounds FROM r, k""",
)
def offsets(spark, sf_dir):
    """Offsets and limits moved into their range, the next offset while there is one, and whether the strict policy takes the request."""
    rows = entities(spark, sf_dir).select("entity")
    found = None
    for i, (_, _, offset, limit) in enumerate(REQUESTS):
        at, size = S.clamped(offset, 0, 0, 100_000), S.clamped(limit, 50, 1, 100)
        try:
            S.bounded(offset, 0, 0, 100_000), S.bounded(limit, 50, 1, 100)
            taken = True
        except ValueError:
            taken = False
        env = S.envelope(rows, at, size).select(F.lit(i).alias("request"), F.col("first"), "returned", "total", "next_offset", F.lit(taken).alias("within_bounds"))
        found = env if found is None else found.unionByName(env)
    return found


# --- lookups over a registry ----------------------------------------------------------------------------------------


@query("s12_registry_search", """SELECT p_partkey AS code, p_name AS name FROM part WHERE contains(lower(p_name), 'red') AND p_brand = 'Brand#11'
        ORDER BY p_name, p_partkey LIMIT 20 OFFSET 3""", roles=False)
def registry_search(spark, sf_dir):
    """Full text and exact filters, in order, from an offset."""
    rows = read(spark, sf_dir, "part").filter(X.contains_folded([F.col("p_name")], "RED") & (F.col("p_brand") == "Brand#11"))
    return S.page(rows.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name")), [F.asc("name"), F.asc("code")], 3, 20)


@query("s13_point_lookup", "SELECT c_custkey AS code, c_name AS name FROM customer WHERE c_custkey = 42", roles=False)
def point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(F.col("c_custkey") == 42).limit(1).select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))


@query("s14_count_only", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'", roles=False)
def count_only(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").agg(F.count(F.lit(1)).alias("n"))


@query("s15_remote_groups", "SELECT p_type AS kind, count(*) AS n FROM part WHERE p_size >= 10 GROUP BY p_type ORDER BY n DESC, kind LIMIT 15", roles=False)
def remote_groups(spark, sf_dir):
    """Group, count, the first fifteen."""
    rows = read(spark, sf_dir, "part").filter(F.col("p_size") >= 10)
    return S.top(rows.groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("kind")], 15)


@query("s16_equals_top", "SELECT number, line, cents, supplier = 7 AS own FROM mov WHERE supplier = 7 ORDER BY number, line, cents LIMIT 20")
def equals_top(spark, sf_dir):
    """An equality and the first twenty; every row is checked to have the key that was asked for."""
    rows = movements(spark, sf_dir).filter("supplier = 7").select("number", "line", "cents", (F.col("supplier") == 7).alias("own"))
    return S.top(rows, [F.asc("number"), F.asc("line"), F.asc("cents")], 20)


@query(
    "s17_declared_columns",
    """SELECT 'n_name' AS name, 'string' AS type, max(typeof(n_name)) = 'VARCHAR' AS present FROM nation UNION ALL SELECT 'n_nationkey', 'int', max(typeof(CAST(n_nationkey AS INT))) = 'INTEGER' FROM nation
        UNION ALL SELECT 'n_regionkey', 'string', max(typeof(n_regionkey)) = 'VARCHAR' FROM nation UNION ALL SELECT 'n_missing', 'string', count(*) > 0 FROM duckdb_columns() WHERE column_name = 'n_missing'""",
    roles=False,
)
def declared_columns(spark, sf_dir):
    """Declared columns against those of a table; one of them is of another type, one is not there."""
    nation = read(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_regionkey")
    return S.declared(nation, {"n_name": "string", "n_nationkey": "int", "n_regionkey": "string", "n_missing": "string"})


_LAYOUT = ("code", "year", "amount", "note")
_FOUND = """CASE i % 7 WHEN 0 THEN 'code;year;amount;note' WHEN 1 THEN 'code;amount;year;note' WHEN 2 THEN 'code;year;amount' WHEN 3 THEN 'code;year;amount;note;x' || CAST(i AS STRING)
    WHEN 4 THEN 'code;year;amount;note;year' WHEN 5 THEN ' Code ;YEAR;amount;note' ELSE 'x' || CAST(i AS STRING) || ';year;amount;note' END"""


@query(
    "v01_header_states",
    f"""WITH t AS (SELECT i, list_transform(string_split({_FOUND}, ';'), lambda c: lower(trim(c))) AS cells FROM (SELECT s_suppkey AS i FROM supplier)), e AS (SELECT {list(_LAYOUT)} AS want)
        SELECT i, array_to_string(list_filter(want, lambda c: NOT list_contains(cells, c)), ',') AS missing,
        array_to_string(list_filter(cells, lambda c: NOT list_contains(want, c)), ',') AS unknown, length(cells) > list_unique(cells) AS doubled, cells = want AS exact FROM t, e""",
    roles=False,
)
def header_states(spark, sf_dir):
    """A header for each supplier against the declared order of columns: what is missing, unknown or doubled, and whether it is exactly that."""
    from civicframe.operators.contracts import header_state

    found = header_state(F.expr(_FOUND), ";", list(_LAYOUT))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i")).select("i", found.alias("h")).select("i", F.array_join("h.missing", ",").alias("missing"), F.array_join("h.unknown", ",").alias("unknown"), "h.doubled", "h.exact")


# --- changes --------------------------------------------------------------------------------------------------------


_DIFFERS = "EXISTS ((SELECT * FROM {0} EXCEPT ALL SELECT * FROM own) UNION ALL (SELECT * FROM own EXCEPT ALL SELECT * FROM {0}))"


@query(
    "k02_change_digest",
    f"""WITH own AS (SELECT n_nationkey, n_name FROM nation), sorted AS (SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC),
        altered AS (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'other' ELSE n_name END AS n_name FROM nation), fewer AS (SELECT * FROM own WHERE n_nationkey <> 3)
        SELECT 'same' AS variant, {_DIFFERS.format('own')} AS changed UNION ALL SELECT 'order', {_DIFFERS.format('sorted')} UNION ALL SELECT 'ignored', {_DIFFERS.format('own')}
        UNION ALL SELECT 'value', {_DIFFERS.format('altered')} UNION ALL SELECT 'row', {_DIFFERS.format('fewer')}""",
    roles=False,
)
def change_digest(spark, sf_dir):
    """Whether a content digest differs from that of the table: not by order or ignored columns, but by any value or row."""
    from civicframe.sources.sinks import content_digest

    table = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").withColumn("observed", F.lit(1))
    variants = {
        "same": table, "order": table.orderBy(F.desc("n_name")).select("n_name", "observed", "n_nationkey"), "ignored": table.withColumn("observed", F.lit(2)),
        "value": table.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "other").otherwise(F.col("n_name"))), "row": table.filter("n_nationkey <> 3"),
    }
    digests = None
    for name, df in variants.items():
        part = content_digest(df, ("observed",)).withColumn("variant", F.lit(name))
        digests = part if digests is None else digests.unionByName(part)
    first = content_digest(table, ("observed",)).select(F.struct("n", "sum", "xor").alias("own"))
    # one row
    return digests.crossJoin(F.broadcast(first)).select("variant", (F.struct("n", "sum", "xor") != F.col("own")).alias("changed"))


@query(
    "k06_refresh_skip",
    """WITH m AS (SELECT s_suppkey AS source, CAST(s_suppkey % 5 AS VARCHAR) AS modified, CASE WHEN s_suppkey % 3 = 0 THEN 'e' END AS etag
        FROM supplier),
        o AS (SELECT s_suppkey AS source, CAST(CASE WHEN s_suppkey % 10 = 1 THEN 9 ELSE s_suppkey % 5 END AS VARCHAR) AS modified, CASE
        WHEN s_suppkey % 4 = 0 THEN 'f' END AS etag FROM supplier WHERE s_suppkey % 20 <> 7)
        SELECT o.source, m.modified = o.modified AND (o.etag IS NULL OR coalesce(o.etag = m.etag, false)) AS unchanged FROM o
        JOIN m USING (source)""",
    roles=False,
)
def refresh_skip(spark, sf_dir):
    """Sources whose last change and, where given, tag are those of the manifest."""
    from civicframe.sources.sinks import unchanged_sources

    key = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier")
    manifest = rows.select(key.alias("source"), (key % 5).cast("string").alias("last_modified"), F.when(key % 3 == 0, "e").alias("etag"))
    observed = rows.filter(key % 20 != 7).select(key.alias("source"), F.when(key % 10 == 1, F.lit(9)).otherwise(key % 5).cast("string").alias("last_modified"), F.when(key % 4 == 0, "f").alias("etag"))
    return unchanged_sources(manifest, observed).select("source", "unchanged")


# --- filters, sets, series ------------------------------------------------------------------------------------------


@query(
    "f10_prevalent_keys",
    """SELECT number, count(*) AS n FROM mov WHERE flag = 'A' GROUP BY number, line HAVING count(*) > 1 UNION ALL
        SELECT CAST(-1 AS BIGINT), count(DISTINCT number) FROM mov WHERE flag = 'A'""",
)
def prevalent_keys(spark, sf_dir):
    """Keys are checked among the rows whose flag prevails; last, how many those have."""
    rows = movements(spark, sf_dir).filter("flag = 'A'")
    doubled = rows.groupBy("number", "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("number").cast("bigint").alias("number"), "n")
    return doubled.unionByName(rows.agg(F.lit(-1).cast("bigint").alias("number"), F.count_distinct("number").alias("n")))


_IDENTITY = ("flag", "status", "month_even", "line_one", "title", "segment", "area")


@query(
    "f13_residual_rows",
    """+ r AS (SELECT mov.*, title, segment, area, month % 2 = 0 AS month_even, line = 1 AS line_one FROM mov JOIN tit USING (part)
        JOIN ent USING (entity) JOIN reg USING (region))
        SELECT CASE WHEN flag = 'N' AND status = 'O' AND month_even AND line_one AND title = '1' AND segment = 'BUILDING' AND area =
        'ASIA' THEN 'residual' ELSE 'assigned' END AS kind,
        count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY 1""",
)
def residual_rows(spark, sf_dir):
    """Rows of exactly one identity of seven cells, and all others."""
    from civicframe.plans.roles import titles

    rows = movements(spark, sf_dir).join(titles(spark, sf_dir), "part").join(entities(spark, sf_dir).select("entity", "region", "segment"), "entity").join(regions(spark, sf_dir), "region")
    rows = rows.withColumn("month_even", F.col("month") % 2 == 0).withColumn("line_one", F.col("line") == 1)
    identity = dict(zip(_IDENTITY, ("N", "O", True, True, "1", "BUILDING", "ASIA")))
    kind = F.when(X.all_of(*[F.col(c).eqNullSafe(F.lit(v)) for c, v in identity.items()]), "residual").otherwise("assigned")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(
    "u03_files_without_repeats",
    """SELECT number, line, count(*) AS files FROM (SELECT DISTINCT number, line, 'a' AS f FROM mov WHERE flag <> 'R' UNION ALL
        SELECT DISTINCT number, line, 'b' FROM mov WHERE status = 'F') GROUP BY number, line HAVING count(*) > 1""",
)
def repeated_in_files(spark, sf_dir):
    """Keys that more than one file of a union has."""
    rows = movements(spark, sf_dir)
    files = [rows.filter("flag <> 'R'").withColumn("file", F.lit("a")), rows.filter("status = 'F'").withColumn("file", F.lit("b"))]
    return J.repeated_across(files, ["number", "line"], "file")


@query(
    "a31_project_totals",
    """+ t AS (SELECT number, CAST(sum(cents) FILTER (status = 'O') AS BIGINT) AS tenders,
        CAST(sum(cents) FILTER (flag = 'N') AS BIGINT) AS awards,
            CAST(sum(cents) FILTER (flag = 'N' AND (number, line, supplier, part) IN (SELECT (number, line, supplier, part) FROM mov
        WHERE status = 'O')) AS BIGINT) AS linked
            FROM mov GROUP BY number)
        SELECT number, coalesce(tenders, 0) AS tenders, coalesce(awards, 0) AS awards, coalesce(linked, 0) AS linked, coalesce(awards,
        0) - coalesce(linked, 0) AS unlinked FROM t""",
)
def project_totals(spark, sf_dir):
    """Tenders and awards of every project, and of the awards those that a tender of the project has."""
    rows = movements(spark, sf_dir).select("number", "line", "supplier", "part", "cents", "status", "flag")
    key = ["number", "line", "supplier", "part"]
    # lines of one key are summed up with whether a tender has it, then those of a project: one scan
    tender, award = F.col("status") == "O", F.col("flag") == "N"
    part = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0)).alias(n)
    by_key = rows.groupBy(*key).agg(part(tender, "tenders"), part(award, "awards"), F.bool_or(tender & F.coalesce("line", "supplier", "part").isNotNull()).alias("known"))
    linked = F.coalesce(F.sum(F.when(F.col("known"), F.col("awards"))), F.lit(0))
    found = by_key.groupBy("number").agg(F.sum("tenders").alias("tenders"), F.sum("awards").alias("awards"), linked.alias("linked"))
    return found.select("number", "tenders", "awards", "linked", (F.col("awards") - F.col("linked")).alias("unlinked"))


@query("a35_oldest_valid", """SELECT event_type, min(CASE WHEN year(ts) = 2024 AND event_id % 5 <> 0 THEN ts END) AS oldest,
        count(*) FILTER (event_id % 5 = 0) AS dropped FROM events GROUP BY event_type""", roles=False)
def oldest_valid(spark, sf_dir):
    """The oldest of the times that can be read; the others are counted."""
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    at = text.try_cast("timestamp_ntz")
    rows = read(spark, sf_dir, "events").select("event_type", at.alias("at"))
    return rows.groupBy("event_type").agg(F.min(F.when(F.year("at") == 2024, F.col("at"))).alias("oldest"), F.count_if(F.col("at").isNull()).alias("dropped"))


@query(
    "w09_increasing_series",
    """+ y AS (SELECT region, year, CAST(sum(cents) AS BIGINT) AS cents FROM mov JOIN ent USING (entity) WHERE year < 2001
        GROUP BY region, year), l AS (SELECT *, lag(cents) OVER (PARTITION BY region ORDER BY year) AS b FROM y)
        SELECT region, count(*) FILTER (b >= cents) = 0 AS increasing FROM l GROUP BY region""",
)
def increasing_series(spark, sf_dir):
    """Whether the amounts of complete years rise without a break, by region."""
    rows = movements(spark, sf_dir).filter("year < 2001").join(entities(spark, sf_dir).select("entity", "region"), "entity")
    years = rows.groupBy("region", "year").agg(F.sum("cents").alias("cents"))
    return S.with_before(years, ["region"], "year", "cents").groupBy("region").agg(S.increasing(None, "cents").alias("increasing"))


@query(
    "a22_breaks_by_group",
    "+ v AS (SELECT region, list_sort(list(total_cents)) AS l, count(*) AS n FROM et GROUP BY region) SELECT region, " + ", ".join(f"l[least(n, CAST(floor(n * {f}) AS INT) + 1)] AS break_{i + 1}" for i, f in enumerate((0.2, 0.4, 0.6, 0.8))) + " FROM v",
)
def breaks_by_group(spark, sf_dir):
    return A.floor_index_breaks(entity_totals(spark, sf_dir), "total_cents", by=["region"])
