"""What holds on large tables: sums beyond 64 bits, joins that no guess of a size broadcasts, tasks of bounded rows."""

import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from civicframe.functions import scalars as X
from civicframe.operators import bitmaps as B, temporal as T, trigrams
from civicframe.operators.cube import Cube, Level
from civicframe.plans import contract_queries, roles, source_queries
from civicframe.sources import readers as R
from civicframe.streaming import files

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_beyond_64_bits(spark):
    """2500 entities of a variant are above 2^63 in all."""
    rows = spark.range(5000).selectExpr("id AS entity", "1 AS region", "'a' AS region_name", "id + 5 AS total_cents", "id AS title_cents", "id AS frequency", "id AS amount")
    found = {(r.variant, r.check_name): r.ok for r in contract_queries.CONTRACTS["v20_v21_v23_rows"].judge(rows).collect()}
    assert found["huge", "title_within_total_of_all"] and not found["huge", "safe_sum"] and found["sound", "safe_sum"]
    assert [k for k, ok in found.items() if k[0] == "sound" and not ok] == []


def test_versions_in_buckets_are_not_broadcast(spark):
    """Versions are exploded, so the size of their table says nothing."""
    day = lambda m: datetime.date(2024, m, 1)
    facts = spark.createDataFrame([(1, day(3)), (1, day(9)), (2, day(3))], "entity long, day date")
    versions = spark.createDataFrame([(1, 0, day(1), day(6)), (1, 1, day(2), day(4))], "entity long, version int, valid_from date, valid_to date")
    for parts in (None, 3):
        found = T.valid_at(facts, versions, ["entity"], "day", "valid_from", "valid_to", "version", parts=parts)
        assert "BroadcastHashJoin" not in plan(found)
        assert sorted((r.entity, r.day.month, r.valid and r.valid.version) for r in found.collect()) == [(1, 3, 1), (1, 9, None), (2, 3, None)]


def test_ages_count_seconds_of_the_clock(spark):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    state = lambda t: spark.range(1).select(X.freshness(F.lit(t).cast("timestamp_ntz"), now, F.lit(86400))).first()[0]
    assert [state(t) for t in ("2024-01-18 23:59:59.5", "2024-01-19 00:00:00.5", "2024-01-20 00:05:00.9", "2024-01-20 00:05:01")] == ["stale", "fresh", "fresh", "unknown"]


def test_payments_are_dealt_over_tasks_of_bounded_rows(spark, monkeypatch):
    """F5, F6, F8, F10 to F18: what groups payments by their number stands on the join's tasks."""
    whole = sorted(map(tuple, roles.movements(spark, SF).collect()))
    monkeypatch.setattr(roles, "TASK_ROWS", 100)
    n = roles.tasks(spark, SF)
    assert n == -(-len(whole) // 100) and n > roles.FEW
    rows = roles.movements(spark, SF)
    assert rows.rdd.getNumPartitions() == n and sorted(map(tuple, rows.collect())) == whole
    of_groups = rows.groupBy("number", "line").count()
    assert plan(of_groups).count(" Exchange hashpartitioning") == 2 and of_groups.rdd.getNumPartitions() == n


def test_bitmaps_of_small_groups_are_made_behind_the_shuffle(spark):
    rows = spark.range(3000).selectExpr("id % 700 AS k", "id % 41 AS v")
    dealt = B.bitmaps(rows, ["k"], "v", 5)
    lines = plan(dealt).splitlines()
    assert next(i for i, x in enumerate(lines) if "Exchange" in x) > max(i for i, x in enumerate(lines) if "Aggregate" in x)
    count = lambda b: sorted(map(tuple, B.distinct_counts(b, ["k"], "n").collect()))
    assert count(dealt) == count(B.bitmaps(rows, ["k"], "v"))


def test_workbooks_are_read_one_at_a_time(spark, monkeypatch):
    """Frames of one workbook each, however many come in a batch."""
    books = spark.range(40).repartition(1).select(F.concat(F.col("id").cast("string"), F.lit(".xlsx")).alias("path"), source_queries._workbook(F.lit("x\ny")).alias("content"))
    seen = {}
    monkeypatch.setattr(type(books), "mapInPandas", lambda self, run, schema: seen.update(run=run))
    R.workbook_rows(books, "Data")
    frame = pd.DataFrame([tuple(r) for r in books.collect()], columns=["path", "content"])
    assert [len(f) for f in seen["run"](iter([frame]))] == [2] * 40


def rows_of(spark, where, file, keys, day):
    rows = [(n, 1, "1", datetime.datetime(2024, 1, day), file) for n in keys]
    spark.createDataFrame(rows, files.SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")


def test_first_rows_and_repeats_without_state_in_memory(spark, tmp_path):
    """As the state's test, with a stop between the runs; a batch looks at the first rows before it."""
    where = str(tmp_path)

    def run():
        files.first_and_repeats(files.union_of(spark, f"{where}/in", 1), ["number", "line"], "file", "at", f"{where}/out", f"{where}/state")
        out = spark.read.schema("number bigint, line int, file string, first_file string").option("recursiveFileLookup", "true").parquet(f"{where}/out").collect()
        return sorted((r.number, r.file) for r in out if r.first_file is None), {(r.number, r.first_file, r.file) for r in out if r.first_file}

    rows_of(spark, where, "a", [1, 2, 2, 3], 1)
    rows_of(spark, where, "b", [3, 4], 2)
    assert run() == ([(1, "a"), (2, "a"), (3, "a"), (4, "b")], {(3, "a", "b")})
    rows_of(spark, where, "c", [1, 5], 3)
    rows_of(spark, where, "d", [5, 6, 6], 4)
    found = run()
    assert found == ([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c"), (6, "d")], {(3, "a", "b"), (1, "a", "c"), (5, "c", "d")})
    assert run() == found


def test_lists_of_trigrams_are_gathered_before_the_shuffle(spark, monkeypatch):
    """Every text once in each of its lists, whatever the border between lots; no row for each trigram of each text."""
    keys = ["abcabc", "", "ab", "bcé😀a", "abcd", "xabc"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 16)), pa.array(keys), pa.array([0, 0, 1, 1, 0, 1])], names=["id", "key", "bucket"])
    expected = {(k[i : i + 3], b, n) for n, k, b in zip(range(10, 16), keys, [0, 0, 1, 1, 0, 1]) for i in range(len(k) - 2)}
    for lot, most in ((1, 6), (100, 1)):
        monkeypatch.setattr(trigrams, "GATHERED", lot)
        lots = [b.to_pylist() for b in trigrams.gathered(iter([batch, batch.slice(0, 0)]))]
        rows = [(r["gram"], r["bucket"], i) for x in lots for r in x for i in r["ids"]]
        assert len(lots) <= most and len(rows) == len(set(rows)) and set(rows) == expected
    monkeypatch.setattr(trigrams, "GATHERED", 4)
    df = spark.createDataFrame([(1, "one two"), (1, "two one"), (2, "ONE"), (3, None), (None, "one")], "n long, s string")
    index = trigrams.TrigramIndex.build(df, "n", "s")
    assert {r.gram: list(r.ids) for r in index.postings.filter("gram IN ('one', 'two', 'e t')").collect()} == {"one": [1, 2], "two": [1], "e t": [1]}


def test_first_level_needs_one_shuffle_for_sums_and_files(spark, monkeypatch, tmp_path):
    """Slices of a year change no sum; a year's files are as many as tasks have a slice of it, at most."""
    rows = spark.range(2000).selectExpr("id % 7 + 1992 AS year", "id % 90 AS entity", "id AS cents")
    level = Level("l", ("year", "entity"), "year")
    found = {}
    for parts in (None, 24):
        cube = Cube.build(rows, f"{tmp_path}/{parts}", [level, Level("y", ("year",))], {"cents": F.sum("cents")}, parts)
        found[parts] = sorted(map(tuple, cube.sums(["year", "entity"]).collect())), sorted(map(tuple, cube.sums(["year"]).collect()))
    assert found[None] == found[24] and len(found[24][0]) == 630
    assert all(len(list(y.glob("*.parquet"))) <= 3 for y in (tmp_path / "24" / "l").glob("year=*"))
