"""What is stored once answers as a scan would: bitmaps, trigram lists, ordered copies, levels of a cube."""

import random

import pytest
from pyspark.sql import functions as F

from civicframe.operators import bitmaps as B
from civicframe.operators.cube import Cube, Level
from civicframe.operators.paging import StoredOrder
from civicframe.operators.trigrams import TrigramIndex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_count_as_distinct_does(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(3), rng.choice([None, 1, 32768, 32769, -5, 0, 10**12, rng.randrange(10**6)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, m int, v long")
    bits = B.bitmaps(df, ["k", "m"], "v")
    for keys in (["k", "m"], ["k"], ["m"], []):
        want = df.groupBy(*keys).agg(F.count_distinct("v").alias("n"))
        assert sorted(B.distinct_counts(bits, keys, "n").collect()) == sorted(want.collect())
    # two tables of bitmaps merge by their union
    halves = B.bitmaps(df.filter("m = 0"), ["k"], "v").unionByName(B.bitmaps(df.filter("m > 0"), ["k"], "v"))
    assert sorted(B.distinct_counts(halves, ["k"], "n").collect()) == sorted(df.groupBy("k").agg(F.count_distinct("v")).collect())
    assert B.distinct_counts(B.bitmaps(df.limit(0), ["k"], "v"), ["k"], "n").count() == 0


@pytest.mark.parametrize("bucket", [3, 50_000])
def test_index_finds_what_a_scan_finds(spark, bucket):
    rng = random.Random(bucket)
    letters = "abcàÉ ' –x"
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(40)))) for i in range(300)] + [(300, None), (None, "abc abc"), (301, ""), (302, "ÀBC" * 4000), (302, "other abca")]
    df = spark.createDataFrame(texts, "n long, s string")
    terms = ["abc", "ÀB", "x", "", "bca", "a'b", "é - x", "nowhere", "cab", "ABCABC", "abc"]
    index = TrigramIndex.build(df, "n", "s", bucket)
    got = sorted((r.term, r.id) for r in index.search(terms).collect())
    from civicframe.functions.scalars import search_key

    folded = {t: k for t, k in spark.createDataFrame([(t,) for t in set(terms)], "t string").select("t", search_key(F.col("t"))).collect()}
    keys = [(r.n, r.k) for r in df.filter("n IS NOT NULL AND s IS NOT NULL").select("n", search_key(F.col("s")).alias("k")).collect()]
    assert got == sorted((t, i) for t in set(terms) if folded[t] for i, k in keys if folded[t] in k)
    verified = {r.term: r.verified for r in index.search(["abc", "x"]).collect()}
    assert verified["x"] == len(keys) and verified["abc"] < len(keys)
    assert index.search([""]).count() == 0 and TrigramIndex.build(df.limit(0), "n", "s").search(["abc"]).count() == 0


def test_pages_of_a_stored_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, rng.randrange(100)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    stored = StoredOrder.build(df, [F.col("v").desc_nulls_last(), F.col("id").asc()], range_rows=60)
    want = [i for i, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    requests = [(0, 10), (995, 10), (500, 1), (123, 200), (1000, 5), (7, 0), (0, 10)]
    got = stored.pages(requests).collect()
    assert stored.total == 1000
    for n, (offset, limit) in enumerate(requests):
        page = sorted((r.place, r.id) for r in got if r.request == n)
        assert page == list(enumerate(want))[offset : offset + limit]
    one = stored.pages([(500, 5)])
    held = stored.ranges_of(500, 5)
    assert len(held) <= 2 and "PartitionFilters: [isnotnull" in plan(one)
    empty = StoredOrder.build(df.limit(0), [F.col("id").asc()])
    assert empty.total == 0 and empty.pages([(0, 5)]).count() == 0


def test_the_coarsest_level_answers(spark, tmp_path):
    rows = [(i % 50, i % 3, i % 4 + 1990, i) for i in range(5000)] + [(None, 1, 1990, 7)]
    df = spark.createDataFrame(rows, "e int, t int, y int, v long")
    levels = [Level("all", ("e", "t", "y"), "y"), Level("et", ("e", "t")), Level("t", ("t",))]
    cube = Cube.build(df, str(tmp_path / "c"), levels, {"v": F.sum("v"), "n": F.count(F.lit(1))})
    assert [cube.level_for(k).name for k in ({"e", "y"}, {"e"}, {"t"}, set(), {"t", "y"})] == ["all", "et", "t", "t", "all"]
    for by, where, needs in ((["e"], None, ()), (["t"], None, ()), (["e"], F.col("y") == 1991, ("y",)), ([], None, ()), (["e", "t"], None, ())):
        source = df if where is None else df.filter(where)
        want = source.groupBy(*by).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
        got = cube.sums(by, where, needs)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "PartitionFilters: [isnotnull(y" in plan(cube.sums(["e"], F.col("y") == 1991, ("y",)))
    with pytest.raises(KeyError, match="no stored level has z"):
        cube.sums(["z"])
    empty = Cube.build(df.limit(0), str(tmp_path / "e"), levels, {"v": F.sum("v"), "n": F.count(F.lit(1))})
    assert empty.sums(["e"]).count() == 0


def test_payments_are_scanned_once(spark, tmp_path):
    """Queries over entities' totals read the stored level; other tables in the same place are noticed."""
    import shutil

    import civicframe.plans.contract_queries  # noqa: F401
    from civicframe.plans.queries import QUERIES
    from civicframe.plans.roles import entity_totals

    data = tmp_path / "d"
    shutil.copytree("/root/testdata/sf0.001", data)
    data.chmod(0o755)
    before = entity_totals(spark, str(data)).agg(F.sum("total_cents")).first()[0]
    for name in ("a26_f15_o05_outliers", "a25_x30_band_sensitivity", "v12_v22_w10_distribution", "a05_grouping_sets"):
        files = QUERIES[name](spark, str(data)).inputFiles()
        assert any("/entity_title/" in f for f in files) and not any("lineitem" in f for f in files)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").limit(100)
    lines.write.parquet(f"{data}/fresh")
    (data / "lineitem.parquet").unlink()
    (data / "fresh").rename(data / "lineitem.parquet")
    assert entity_totals(spark, str(data)).agg(F.sum("total_cents")).first()[0] < before
