"""Questions answered from what is stored once: bitmaps, trigram lists, ordered copies, levels of the cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicframe.functions.scalars import cents
from civicframe.operators import bitmaps as B
from civicframe.operators.joins import dealt
from civicframe.operators.paging import StoredOrder
from civicframe.operators.series import clamped
from civicframe.operators.trigrams import TrigramIndex
from civicframe.plans.queries import query
from civicframe.plans.roles import entities, movements, payments_cube, read, regions, tasks
from civicframe.sources.shared import shared_folder
from civicframe.plans.value_queries import FOLD_SQL


@query(
    "a14_a15_a16_bitmap_distincts",
    """+ r AS (SELECT supplier, entity, region_name, area FROM mov JOIN ent USING (entity) JOIN reg USING (region)),
        e AS (SELECT entity, count(DISTINCT supplier) AS suppliers FROM r GROUP BY entity)
        SELECT 'entity' AS level, CAST(entity AS VARCHAR) AS key, suppliers, row_number() OVER (ORDER BY suppliers DESC, entity) <= 10 AS among_top FROM e
        UNION ALL SELECT 'region', region_name, count(DISTINCT supplier), false FROM r GROUP BY region_name
        UNION ALL SELECT 'area', area, count(DISTINCT supplier), false FROM r GROUP BY area UNION ALL SELECT 'all', 'all', count(DISTINCT supplier), false FROM r""",
)
def bitmap_distincts(spark, sf_dir):
    """Distinct suppliers by entity, region, area and in all, from one table of bitmaps; the ten entities with the most."""
    where = shared_folder(spark, "suppliers")
    parts = tasks(spark, sf_dir)
    B.bitmaps(movements(spark, sf_dir).select("entity", "supplier"), ["entity"], "supplier", parts).write.parquet(where)
    places = entities(spark, sf_dir).select("entity", "region").join(regions(spark, sf_dir), "region").select("entity", "region_name", "area")
    # bitmaps take 4096 bytes each in memory and far fewer in files, so files are no measure of a task
    stored = dealt(spark.read.parquet(where), parts, "entity")
    by_region = B.merged(stored.join(places, "entity"), ["region_name", "area"])
    by_entity = B.distinct_counts(stored, ["entity"], "suppliers")
    first = by_entity.orderBy(F.desc("suppliers"), "entity").limit(10).select("entity", F.lit(True).alias("first"))
    # ten rows
    found = by_entity.join(F.broadcast(first), "entity", "left").select(F.lit("entity").alias("level"), F.col("entity").cast("string").alias("key"), "suppliers", F.coalesce("first", F.lit(False)).alias("among_top"))
    for level, key in (("region", F.col("region_name")), ("area", F.col("area")), ("all", F.lit("all"))):
        counts = B.distinct_counts(by_region.withColumn("key", key), ["key"], "suppliers")
        found = found.unionByName(counts.select(F.lit(level).alias("level"), "key", "suppliers", F.lit(False).alias("among_top")))
    return found


@query(
    "a14_bitmaps_of_months",
    """+ r AS (SELECT region, year, month, entity FROM mov JOIN ent USING (entity))
        SELECT region, year, CASE WHEN g = 0 THEN quarter END AS quarter, count(DISTINCT entity) AS active
        FROM (SELECT *, CAST((month + 2) // 3 AS INT) AS quarter FROM r), (VALUES (0), (1)) AS v(g) GROUP BY region, year, g, CASE WHEN g = 0 THEN quarter END""",
)
def bitmaps_of_months(spark, sf_dir):
    """Active entities by region and quarter, and by year: the months' bitmaps or-ed, as no sum of months would do."""
    where = shared_folder(spark, "active")
    rows = movements(spark, sf_dir).select("entity", "year", "month").join(entities(spark, sf_dir).select("entity", "region"), "entity")
    B.bitmaps(rows, ["region", "year", "month"], "entity").write.parquet(where)
    stored = spark.read.parquet(where).withColumn("quarter", F.floor((F.col("month") + 2) / 3).cast("int"))
    quarters = B.merged(stored, ["region", "year", "quarter"])
    years = B.distinct_counts(quarters, ["region", "year"], "active").withColumn("quarter", F.lit(None).cast("int"))
    return B.distinct_counts(quarters, ["region", "year", "quarter"], "active").unionByName(years)


def _search_sql(rows: str, terms: str) -> str:
    """Hits of each term, and how many texts have all of its three rarest trigrams."""
    return f"""WITH x AS (SELECT id, {FOLD_SQL.format('s')} AS key FROM ({rows}) WHERE s IS NOT NULL),
        t AS (SELECT term, {FOLD_SQL.format('term')} AS folded FROM (SELECT DISTINCT term FROM ({terms}))),
        g AS (SELECT DISTINCT term, folded, substr(folded, i, 3) AS gram FROM t, (SELECT unnest(range(1, 200)) AS i) WHERE i <= length(folded) - 2),
        n AS (SELECT gram, count(x.id) AS n FROM (SELECT DISTINCT gram FROM g) d LEFT JOIN x ON contains(x.key, d.gram) GROUP BY gram),
        c AS (SELECT term, gram, row_number() OVER (PARTITION BY term ORDER BY n, gram) AS place FROM g JOIN n USING (gram)),
        m AS (SELECT term, x.id FROM c JOIN x ON contains(x.key, c.gram) WHERE place <= 3 GROUP BY term, x.id HAVING count(*) = (SELECT count(*) FROM c c2 WHERE c2.term = c.term AND place <= 3)),
        v AS (SELECT term, count(*) AS verified FROM m GROUP BY term)
        SELECT term, id, verified FROM t JOIN x ON contains(x.key, t.folded) JOIN v USING (term)"""


@query(
    "f03_f04_x27_indexed_documents",
    _search_sql("SELECT doc_id AS id, text AS s FROM documents", "SELECT upper(split_part(text, ' ', 2)) || ' ' || split_part(text, ' ', 3) AS term FROM benchmark ORDER BY item_id LIMIT 10"),
    roles=False,
)
def indexed_documents(spark, sf_dir):
    """Ten terms of two words from benchmark passages, looked for in all documents through an index of trigrams."""
    words = F.split("text", " ")
    terms = read(spark, sf_dir, "benchmark").orderBy("item_id").limit(10).select(F.concat_ws(" ", F.upper(words[1]), words[2]).alias("term"))
    index = TrigramIndex.build(read(spark, sf_dir, "documents"), "doc_id", "text")
    return index.search([r.term for r in terms.collect()])


_PART_TERMS = ("red", "RÉD", "part 1", "Part  99", "77", "ar", "nowhere", "t 10", "PART 123", "blue")


@query(
    "f03_f04_x27_indexed_names",
    _search_sql("SELECT p_partkey AS id, p_name AS s FROM part", "SELECT unnest(['" + "', '".join(t for t in _PART_TERMS if len(t) > 2) + "']) AS term")
    + f" UNION ALL SELECT short, id, (SELECT count(*) FROM x) FROM x, (VALUES {', '.join(f'({t!r})' for t in _PART_TERMS if len(t) < 3)}) AS s(short) WHERE contains(key, short)",
    roles=False,
)
def indexed_names(spark, sf_dir):
    """Ten terms in the names of parts, with other case, accents and spaces, two of them too short for the index."""
    return TrigramIndex.build(read(spark, sf_dir, "part"), "p_partkey", "p_name").search(list(_PART_TERMS))


#: Pages asked for: (offset, limit), moved into their range.
PAGES = tuple((o, n) for o, n in (
    (0, 10), (10, 10), (990, 20), (1000, 1), (-5, 3), (12_345, 50), (14_990, 100), (14_999, 1), (15_000, 10), (99_999, 5),
    (100_000, 7), (250_000, 30), (7_000, 0), (7_001, 900), (3_333, 33), (2_048, 64), (5_000, 25), (640, 12), (149_995, 9), (11, 2),
))
_ASKED = ", ".join(f"({i}, {clamped(o, 0, 0, 100_000)}, {clamped(n, 50, 1, 100)})" for i, (o, n) in enumerate(PAGES))


@query(
    "o09_o14_stored_order_pages",
    f"""WITH o AS (SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS price FROM orders),
        n AS (SELECT *, row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) - 1 AS place FROM o), r(request, first, size) AS (VALUES {_ASKED})
        SELECT CAST(request AS INT) AS request, place, o_orderkey, price FROM n JOIN r ON place >= first AND place < first + size""",
    roles=False,
)
def stored_order_pages(spark, sf_dir):
    """Twenty pages of orders by falling price, in one job over the ranges that hold them."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("price"))
    stored = StoredOrder.build(rows, [F.col("price").desc_nulls_last(), F.col("o_orderkey").asc()], range_rows=2000)
    return stored.pages([(clamped(o, 0, 0, 100_000), clamped(n, 50, 1, 100)) for o, n in PAGES])


@query(
    "a05_stored_levels",
    """+ p AS (SELECT year, month, entity, title, cents FROM mov JOIN tit USING (part))
        SELECT 'entity of a year' AS question, CAST(entity AS VARCHAR) AS key, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS lines FROM p WHERE year = 1998 GROUP BY entity
        UNION ALL SELECT 'title', title, CAST(sum(cents) AS BIGINT), count(*) FROM p GROUP BY title
        UNION ALL SELECT 'month of title 1', CAST(month AS VARCHAR), CAST(sum(cents) AS BIGINT), count(*) FROM p WHERE title = '1' GROUP BY month
        UNION ALL SELECT 'entity of a month', CAST(entity AS VARCHAR), CAST(sum(cents) AS BIGINT), count(*) FROM p WHERE year = 1999 AND month = 4 AND title = '2' GROUP BY entity
        UNION ALL SELECT 'all', 'all', CAST(sum(cents) AS BIGINT), count(*) FROM p""",
)
def stored_levels(spark, sf_dir):
    """Five questions, each read from the coarsest stored level that has its keys; a year reads its own part."""
    cube, found = payments_cube(spark, sf_dir), None
    year, month, title = F.col("year"), F.col("month"), F.col("title")
    asked = (
        ("entity of a year", ["entity"], year == 1998, ("year",)), ("title", ["title"], None, ()), ("month of title 1", ["month"], title == "1", ("title",)),
        ("entity of a month", ["entity"], (year == 1999) & (month == 4) & (title == "2"), ("year", "month", "title")), ("all", [], None, ()),
    )
    for name, by, where, needs in asked:
        part = cube.sums(by, where, needs)
        part = part.select(F.lit(name).alias("question"), (F.col(by[0]).cast("string") if by else F.lit("all")).alias("key"), "cents", "lines")
        found = part if found is None else found.unionByName(part)
    return found
