"""Small cases that pin the rules, and one broken input for each contract."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from civicframe.functions import scalars as X
from civicframe.operators import aggregates as A, contracts as V, joins as J, series as S


def one(df, col):
    return df.select(col.alias("x")).first().x


def lits(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def test_rankings_do_not_follow_each_other(spark):
    rows = spark.createDataFrame([("grande", 1_000_000, 1_000_000), ("piccolo", 10, 1_000), ("none", None, 2_000_000)], "name string, people long, cents long")
    assert [r.name for r in S.top(rows, [F.desc("cents"), F.asc("name")], 3).collect()] == ["none", "grande", "piccolo"]
    head = rows.filter("people is not null").withColumn("h", X.per_capita(F.col("cents"), F.col("people")))
    assert [r.name for r in S.top(head, [F.desc("h"), F.asc("name")], 3).collect()] == ["piccolo", "grande"]


def test_population_sentinel(spark):
    got = lits(spark, "00000001", "00000125", "1.234,5", "x").select(X.population(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == [None, 125, 1234, None]


ROWS = [("n", 100, 200000, 100000), ("n", 300, 1200000, 600000), ("s", 600, 3600000, 1800000), ("s", 1000, 8000000, 4000000), ("s", None, 2000000, 1000000), (None, 500, 1000000, 500000)]


def test_weighted_nearest_rank(spark):
    df = spark.createDataFrame(ROWS, "region string, people long, total long, title long").filter("people is not null")
    head = df.withColumn("v", F.col("title") / F.col("people") / 100).withColumn("one", F.lit(1)).withColumn("g", F.lit(1))
    assert tuple(A.weighted_nearest_rank(head, ["g"], "v", "one").first())[1:] == (10, 10, 20, 30, 40)
    assert tuple(A.weighted_nearest_rank(head, ["g"], "v", "people").first())[1:] == (10, 20, 30, 40, 40)


def test_weighted_nearest_rank_is_no_interpolation(spark):
    df = spark.createDataFrame([(1000, 100), (2000, 300), (3000, 600), (4000, 1000)], "v long, w long").withColumn("g", F.lit(1))
    assert A.weighted_nearest_rank(df, ["g"], "v", "w").first().p50 == 3000


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_against_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), rng.randint(0, 40), rng.randint(1, 9)) for _ in range(120)]
    df = spark.createDataFrame(rows, "g int, v long, w long")
    got = {r.g: r for r in A.weighted_nearest_rank(df, ["g"], "v", "w").collect()}
    linear = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", 0.25).alias("q")).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((v, w) for x, v, w in rows if x == g)
        total = sum(w for _, w in own)
        for name, p in A.PROBABILITIES:
            cum = 0
            for v, w in own:
                cum += w
                if cum >= p * total:
                    break
            assert got[g][name] == v
        at = 0.25 * (len(own) - 1)
        low, high = own[int(at)][0], own[min(int(at) + 1, len(own) - 1)][0]
        assert abs(linear[g] - (low + (high - low) * (at - int(at)))) < 1e-9


def test_outliers(spark):
    same = spark.createDataFrame([(i, "r", v) for i, v in enumerate([0, 0, 0, 0, 100])], "code int, region string, v long")
    (row,) = A.outliers(same, "region", "v", "code").collect()
    assert (row.direction, row.distance, row.multiple) == ("above", 100.0, None)
    small = A.tukey(same.limit(3), "region", "v").first()
    assert small.evaluated == 0 and small.q1 is None and small.n == 3
    with pytest.raises(ValueError):
        A.tukey(same, "region", "v", k=0)


def test_implied_population(spark):
    df = spark.createDataFrame([(2000000, 100, 1800000, 90)], "a long, b long, c long, d long")
    assert one(df, X.implied_population([(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))])) == 20000
    assert one(df, X.implied_population([(F.col("a"), F.lit(0))])) is None


def test_flows_and_gaps(spark):
    df = spark.createDataFrame([("x", 4, 45), ("x", 1, 10), ("x", 2, 25)], "s string, month int, c long")
    assert [r.flow for r in S.flows(df, ["s"], "month", "c").orderBy("month").collect()] == [10, 15, None]
    assert [r.month for r in S.missing_months(df, ["s"], "month").collect()] == [3]


def test_suppressed_pairs(spark):
    df = spark.createDataFrame([(5, 100), (None, None), (0, 0)], "f long, a long")
    assert tuple(df.agg(*A.suppressed(F.col("f"), F.col("a"))).first()) == (5, 100, 1)
    assert not V.report(spark.createDataFrame([(5, None)], "f long, a long"), [V.Check("pair", V.both_or_none("f", "a"))]).first().ok


def test_bands_keep_empty_ones(spark):
    df = spark.createDataFrame([(100,), (300,), (600,), (1000,)], "people long").withColumn("band", A.banded(None, "people"))
    n = {r.band: r.n for r in A.band_table(spark).join(df.groupBy("band").agg(F.count("*").alias("n")), "band", "left").collect()}
    assert n["under-1000"] == 3 and n["1000-4999"] == 1 and n["500000-plus"] is None and len(n) == 8


def test_null_safe_keys(spark):
    a = spark.createDataFrame([("p", "c", None), ("p", None, None), ("q", "c", None)], "cup string, cig string, user string")
    b = spark.createDataFrame([("p", "c", None), ("p", None, None)], "cup string, cig string, user string")
    assert [tuple(r) for r in J.null_safe(a, b, ["cup"], ["cig", "user"], "left_semi").collect()] == [("p", "c", None)]
    assert J.null_safe(a, b, ["cup"], ["cig", "user"], "left_anti").count() == 2


def test_lookups_fail_closed(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="missing"):
        J.checked_lookup(facts, spark.createDataFrame([(1, "a")], "k int, v string"), "k").count()
    with pytest.raises(Exception, match="doubled"):
        J.checked_lookup(facts, spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string"), "k").count()
    double = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert [tuple(r) for r in J.unambiguous(double, "k", "v").collect()] == [(2, "c")]


@pytest.mark.parametrize(
    "broken,check",
    [
        ([(1, "a", 5), (1, "a", 5)], lambda: V.unique("k")), ([(1, "a", 5), (1, "b", 5)], lambda: V.determines("k", "s")), ([(1, "a", 5), (2, "a", 6)], lambda: V.constant("v", 5)),
        ([(1, "a", 5)], lambda: V.counts(2)), ([(1, "a", 5)], lambda: V.covers("k", [1, 2])), ([(1, "a", 9007199254740992)], lambda: V.safe_sum("v")), ([(1, "a", -5)], lambda: V.always(F.col("v") >= 0)),
        ([(1, "a", None)], lambda: V.always(F.col("v") >= 0)), ([(1, "a", 5)], lambda: V.within(F.sum("v"), F.lit(6), 0.5)),
    ],
)
def test_checks_catch(spark, broken, check):
    df = spark.createDataFrame(broken, "k int, s string, v long")
    with pytest.raises(J.CheckFailed):
        V.enforce(df, [V.Check("c", check())])


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    V.headers(df, ["a"], exact=False)
    for expected, exact in ((["a", "b"], True), (["a", "c"], False)):
        with pytest.raises(J.CheckFailed):
            V.headers(df, expected, exact)


def test_number_grammars(spark):
    c = F.col("s")
    cases = {"1000,50": 100050, "1.234.567,8": 123456780, "€ 800,00": 80000, "12.5": 1250, "1.500": 150000, "1.23.4": None, "": None}
    assert {r.s: r.x for r in lits(spark, *cases).select("s", X.grouped_cents(c).alias("x")).collect()} == cases
    millions = {"12,34567": 1234567000, "-1": None, "": None, "12.34567": None, "1.234,5": None}
    assert {r.s: r.x for r in lits(spark, *millions).select("s", X.millions_to_cents(c).alias("x")).collect()} == millions
    assert one(spark.range(1), X.round_half_up(F.lit(-2.5))) == -2
    assert one(spark.range(1), F.round(F.lit(-2.5).cast("decimal(5,1)"), 0)) == -3
    assert [r.x for r in lits(spark, "10,25", "bad").select(X.lenient_number(c).alias("x")).collect()] == [10.25, 0]


def test_text_dates_flags(spark):
    c = F.col("s")
    assert [r.x for r in lits(spark, "00/01/1900", "31/12/2020", "2020-02-30", "##").select(X.flexible_date(c).alias("x")).collect()] == [None, dt.date(2020, 12, 31), None, None]
    assert [r.x for r in lits(spark, "S", "n", "?").select(X.yes_no(c).alias("x")).collect()] == [True, False, None]
    assert [r.x for r in lits(spark, "example.it/a", "http://b.it", "ftp://c.it", "x").select(X.external_url(c).alias("x")).collect()] == ["https://example.it/a", "http://b.it", None, None]
    assert [r.x for r in lits(spark, "COMUNE DI REGGIO NELL'EMILIA", "L'AQUILA", "CORIGLIANO-ROSSANO").select(X.municipality_name(c).alias("x")).collect()] == ["Reggio Nell'Emilia", "L'Aquila", "Corigliano-Rossano"]
    assert one(spark.range(1), X.same_name(F.lit("Forlì  Cesena"), F.lit("FORLI CESENA")))


def test_freshness_and_signals(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    assert [one(spark.range(1), X.freshness(at(s), now, F.lit(3600))) for s in ("2024-01-01 23:30:00", "2024-01-01 00:00:00", "2024-01-02 00:10:00")] == ["fresh", "stale", "unknown"]
    day = lambda s: F.lit(s).cast("date")
    got = one(spark.range(1), X.work_signals(F.array(F.lit("w")), F.lit("A"), day("2022-12-31"), F.lit(None).cast("date"), day("2024-01-01"), F.lit(2273), F.lit(200000)))
    assert got == ["data-quality", "schedule-check", "cost-growth", "funding-gap"]


def test_paging_policies():
    assert S.clamped(500, 50, 1, 100) == 100 and S.clamped(None, 50, 1, 100) == 50 and S.last_page(9, 25, 10) == 3
    with pytest.raises(ValueError):
        S.bounded(500, 50, 1, 100)


def test_polygon_area(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))])
    assert one(spark.range(1), X.polygon_area(ring)) == 6
