"""Artifacts that are bound to their bytes, and refreshes that write what changed."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from civicframe.operators.contracts import Rule
from civicframe.operators.joins import CheckFailed
from civicframe.sources import publish as P

RULES = [Rule("positive", "v > 0"), Rule("named", "k IS NOT NULL")]


@pytest.fixture
def rows(spark):
    return spark.range(1, 1001).select(F.col("id").alias("v"), (F.col("id") % 7).cast("string").alias("k")).repartition(3)


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "a")
    bound = P.publish(rows, path, RULES, {"dataset": "x"}, part_rows=100)
    assert bound["rows"] == 1000 and bound["parts"] >= 10
    back = P.read_published(spark, path)
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    meta = json.loads(Path(path, "meta.json").read_text())
    assert meta == bound and list(meta) == sorted(meta)
    P.publish(rows.filter("v < 10"), path, RULES)
    assert P.read_published(spark, path).count() == 9 and [p.name for p in tmp_path.iterdir()] == ["a"]


def test_one_job_writes_counts_and_checks(spark, rows, tmp_path):
    plain = jobs(spark, "plain", lambda: rows.write.parquet(str(tmp_path / "plain")))
    observed = jobs(spark, "observed", lambda: P._observed(rows, [F.count(F.lit(1)).alias("c")], lambda d: d.write.parquet(str(tmp_path / "observed"))))
    assert observed == plain


def test_rows_that_break_a_rule_leave_what_was_there(spark, rows, tmp_path):
    path = str(tmp_path / "a")
    P.publish(rows, path, RULES)
    with pytest.raises(CheckFailed, match=r"positive \(1 rows\), named \(2 rows\)"):
        P.publish(rows.union(spark.createDataFrame([(0, None), (5, None)], "v long, k string")), path, RULES)
    assert P.read_published(spark, path).count() == 1000 and [p.name for p in tmp_path.iterdir()] == ["a"]
    with pytest.raises(ValueError, match="not of every row"):
        P.publish(rows, path, [Rule("n", "count(*) > 0", each=False)])


@pytest.mark.parametrize("kind", ["byte", "lost", "extra", "manifest", "meta"])
def test_a_flipped_byte_is_refused(spark, rows, tmp_path, kind):
    path = tmp_path / "a"
    P.publish(rows, str(path), RULES, part_rows=100)
    for crc in path.rglob("*.crc"):
        crc.unlink()
    part = next((path / "data").glob("*.parquet"))
    if kind == "byte":
        data = bytearray(part.read_bytes())
        data[len(data) // 2] ^= 1
        part.write_bytes(data)
    elif kind == "lost":
        part.unlink()
    elif kind == "extra":
        (path / "data" / "part-x.parquet").write_bytes(part.read_bytes())
    elif kind == "manifest":
        listed = next(p for p in (path / "manifest").glob("*.json") if p.stat().st_size)
        listed.write_text(listed.read_text().replace('"bytes":', '"bytes":1', 1))
    else:
        meta = path / "meta.json"
        meta.write_text(meta.read_text().replace('"rows":1000', '"rows":1001'))
    with pytest.raises(CheckFailed):
        P.read_published(spark, str(path))


def test_an_empty_table_and_nulls(spark, rows, tmp_path):
    P.publish(rows.limit(0), str(tmp_path / "e"), RULES)
    assert P.read_published(spark, str(tmp_path / "e")).dtypes == rows.dtypes and P.read_published(spark, str(tmp_path / "e")).count() == 0


def listing(path):
    return {str(p.relative_to(path)) for p in Path(path, "data").rglob("*.parquet")}


def test_refresh_writes_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    own = spark.createDataFrame([(i, i % 4 or None, "x", i) for i in range(200)], "id int, year int, v string, seen int")
    state = lambda df: {(r.year, r.state) for r in df.collect()}
    everything = lambda: {tuple(r) for r in spark.read.parquet(f"{path}/data").select("id", "year", "v").collect()}
    assert state(P.refresh(own, path, ["year"], "id", ignore=("seen",))) == {(y, "added") for y in (1, 2, 3, None)}
    first = listing(path)
    assert state(P.refresh(own.withColumn("seen", F.lit(9)).orderBy(F.desc("id")), path, ["year"], "id", ignore=("seen",))) == set() and listing(path) == first
    later = own.filter("coalesce(year, 0) <> 2").withColumn("v", F.when(F.col("id") == 4, "y").otherwise(F.col("v"))).union(spark.createDataFrame([(900, 9, "n", 0)], own.schema))
    assert state(P.refresh(later, path, ["year"], "id", ignore=("seen",))) == {(None, "changed"), (2, "removed"), (9, "added")}
    kept = {f for f in first if "year=1" in f or "year=3" in f}
    assert kept <= listing(path) and listing(path) & first == kept
    assert everything() == {tuple(r) for r in later.select("id", "year", "v").collect()}
    # cut off before the tree was in place: done again
    P.Folder(spark, f"{path}/tree").delete()
    assert len(state(P.refresh(later, path, ["year"], "id", ignore=("seen",)))) == 4
    assert everything() == {tuple(r) for r in later.select("id", "year", "v").collect()}
    assert state(P.refresh(later.limit(0), path, ["year"], "id")) == {(y, "removed") for y in (1, 3, 9, None)}


def test_trees_are_compared_from_the_root(spark):
    a = spark.createDataFrame([(i, i % 5, i % 3) for i in range(300)], "id int, y int, m int")
    b = a.withColumn("m", F.when(F.col("id") == 7, 2).otherwise(F.col("m")))
    old, new = P.digest_tree(a, ["y", "m"], "id", 4), P.digest_tree(b, ["y", "m"], "id", 4)
    assert old.filter("depth = 0").collect() == [r for r in old.collect() if r.path == []] and old.filter("depth = 0").first().n == 300
    found = {(tuple(r.path), r.state) for r in P.changed_nodes(old, new, 2).collect()}
    assert found == {(("2", "1"), "changed"), (("2", "2"), "changed")}
    assert P.changed_nodes(old, old, 3).count() == 0 and P.changed_nodes(old.limit(0), new, 0).first().state == "added"
