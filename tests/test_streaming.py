"""Streams that stop and go on: late and lost months, keys that several files have."""

import datetime

from pyspark.sql import functions as F

from civicframe.streaming import files, flows

SCHEMA = "k string, month int, cumulative long, at timestamp"


def month(k, m, value):
    return (k, m, value, datetime.datetime(2024, m, 1))


def test_late_and_lost_months(spark, tmp_path):
    """Every lot is a run of its own from the checkpoint."""
    where, late = str(tmp_path), "70 days"
    seen = []

    def lot(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{where}/in")
        flows.run_to_the_end(spark, flows.streamed_flows(stream, ["k"], late), f"{where}/out", f"{where}/state")
        now = sorted((r.k, r.month, r.flow) for r in spark.read.schema("k string, month int, flow long").parquet(f"{where}/out").collect())
        fresh = [r for r in now if r not in seen]
        assert len(now) == len(seen) + len(fresh)
        seen[:] = now
        return fresh

    assert lot(month("a", 1, 10), month("a", 3, 45), month("b", 2, 7)) == [("a", 1, 10)]
    # late, but within the watermark: closes the gap behind and before it; a repeat changes nothing
    assert lot(month("a", 2, 25), month("a", 1, 99)) == [("a", 2, 15), ("a", 3, 20)]
    assert lot(month("a", 5, 80), month("b", 1, 3)) == [("b", 1, 3), ("b", 2, 4)]
    # far ahead: the watermark passes May, whose April is lost
    lost = lot(month("a", 12, 300)) + lot(month("c", 12, 1))
    assert ("a", 5, None) in lost
    # too late now
    assert lot(month("a", 4, 60)) == []
    assert [r for r in seen if r[0] == "a"] == [("a", 1, 10), ("a", 2, 15), ("a", 3, 20), ("a", 5, None)]


def rows_of(spark, where, file, keys, day):
    rows = [(n, 1, "1", datetime.datetime(2024, 1, day), file) for n in keys]
    spark.createDataFrame(rows, files.SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")


def test_repeats_across_files_and_restarts(spark, tmp_path):
    where = str(tmp_path)

    def run():
        files.ended(files.first_rows(files.union_of(spark, f"{where}/in", 1), ["number", "line"], "at", "30 days").select("number", "line", "file"), f"{where}/first", f"{where}/s1")
        twice = files.repeats(files.union_of(spark, f"{where}/in", 1), files.union_of(spark, f"{where}/in", 1), ["number", "line"], "file", "at", "30 days")
        files.ended(twice, f"{where}/twice", f"{where}/s2")
        first = sorted(r.number for r in spark.read.schema("number bigint, line int, file string").parquet(f"{where}/first").collect())
        again = {(r.number, r.first_file, r.file) for r in spark.read.schema("number bigint, line int, first_file string, file string").parquet(f"{where}/twice").collect()}
        return first, again

    rows_of(spark, where, "a", [1, 2, 2, 3], 1)
    rows_of(spark, where, "b", [3, 4], 2)
    first, again = run()
    assert first == [1, 2, 3, 4] and again == {(3, "a", "b")}
    # stopped here; the next run goes on from the checkpoint
    rows_of(spark, where, "c", [1, 5], 3)
    rows_of(spark, where, "d", [5, 6], 4)
    first, again = run()
    assert first == [1, 2, 3, 4, 5, 6] and again == {(3, "a", "b"), (1, "a", "c"), (5, "c", "d")}
    assert run() == (first, again)
    batch = spark.read.parquet(f"{where}/in").groupBy("number").agg(F.count_distinct("file").alias("n")).filter("n > 1")
    assert {r.number for r in batch.collect()} == {n for n, _, _ in again}
