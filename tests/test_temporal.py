"""As-of and interval joins against every pair, with ties, gaps, nulls, hot keys and empty sides."""

import datetime
import random

import pytest

from civicframe.operators import temporal as T

DAY = datetime.date(2000, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_against_every_pair(spark):
    rng = random.Random(5)
    releases = [(rng.choice("ab"), rng.randrange(100)) for _ in range(25)] + [(None, 5)]
    requests = [(i, rng.choice("abc"), rng.randrange(-5, 130), rng.choice([-3, 1, 4, 16, 90])) for i in range(300)] + [(300, None, 9, 16), (301, "a", None, 16)]
    left = spark.createDataFrame(requests, "id int, k string, asked int, back int")
    right = spark.createDataFrame(releases, "k string, at int")
    from pyspark.sql import functions as F

    df = T.as_of(left, right, ["k"], "asked", "at", F.col("back"))
    got = {r.id: (r.released, r.copies, r.state) for r in df.collect()}
    for i, k, asked, back in requests:
        width = min(36, max(1, back))
        near = [a for key, a in releases if key is not None and key == k and asked is not None and asked - width < a <= asked]
        want = (max(near), near.count(max(near)), "ambiguous" if near.count(max(near)) > 1 else "found") if near else (None, None, "missing")
        assert got[i] == want
    assert "BroadcastNestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df)
    assert {r.state for r in T.as_of(left, right.limit(0), ["k"], "asked", "at").collect()} == {"missing"}
    assert T.as_of(left.limit(0), right, ["k"], "asked", "at").count() == 0


def test_versions_against_every_pair(spark):
    rng = random.Random(8)
    days = lambda n: DAY + datetime.timedelta(n)
    versions = []
    for i in range(400):
        k, start = rng.choice(["hot"] * 6 + ["b", "c"]), rng.randrange(600)
        versions.append((k, i, days(start), days(start + rng.choice([0, 3, 40, 64, 700]))))
    versions += [("b", 1000, days(50), days(90)), ("b", 999, days(50), days(90))]
    facts = [(i, rng.choice(["hot", "b", "c", "d"]), days(rng.randrange(-10, 1400))) for i in range(800)] + [(800, None, days(3)), (801, "b", None)]
    left = spark.createDataFrame(facts, "id int, k string, day date")
    right = spark.createDataFrame(versions, "k string, version int, low date, high date")
    for width in (1, 64, 1000):
        df = T.valid_at(left, right, ["k"], "day", "low", "high", "version", width)
        got = {r.id: r.valid and r.valid.version for r in df.collect()}
        assert len(got) == len(facts) == df.count()
        for i, k, day in facts:
            held = [(a, -v) for key, v, a, b in versions if key == k and day is not None and a <= day <= b]
            assert got[i] == (-max(held)[1] if held else None)
    assert "BroadcastNestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df)
    within = T.valid_at(left, right, ["k"], "day", "low", "high", "version", span=(days(-10), days(1400)))
    assert {r.id: r.valid and r.valid.version for r in within.collect()} == got
    assert T.valid_at(left, right, ["k"], "day", "low", "high", "version", how="inner").count() == sum(v is not None for v in got.values())
    assert T.valid_at(left, right.limit(0), ["k"], "day", "low", "high", "version").filter("valid IS NOT NULL").count() == 0


def test_a_turned_interval_is_refused(spark):
    rows = spark.createDataFrame([(1, DAY, DAY), (2, DAY, DAY - datetime.timedelta(1))], "v int, low date, high date")
    with pytest.raises(Exception, match="low is after high"):
        T.checked_intervals(rows, "low", "high").count()
    assert T.checked_intervals(rows.filter("v = 1"), "low", "high").count() == 1


def test_every_state_occurs(spark):
    from civicframe.plans.queries import QUERIES
    import civicframe.plans.temporal_queries  # noqa: F401

    data = "/root/testdata/sf0.001"
    states = lambda name: {r.state for r in QUERIES[name](spark, data).select("state").distinct().collect()}
    assert states("s10_r01_release_as_of") == {"found", "ambiguous", "missing"}
    assert states("r01_release_requests") == {"found", "ambiguous", "missing", "invalid"}
