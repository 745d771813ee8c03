from pyspark.sql import functions as F

from civicframe.llm import mixing as M


def docs(spark, spec):
    rows, i = [], 0
    for source, lang, n, words in spec:
        for _ in range(n):
            rows.append((i, " ".join(["w"] * words), lang, source, 1))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")


def test_shortage_stays_with_siblings(spark):
    leaves = spark.createDataFrame([("domain0", "en", "a", 10), ("domain0", "en", "b", 1000), ("domain1", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: int(r.budget) for r in M.budgets(leaves, {"domain": {}, "lang": {}, "source": {}}, 500, 1).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}  # half each; what a lacks goes to b, not to c
    got = {r.source: int(r.budget) for r in M.budgets(leaves, {"domain": {"domain0": 9}, "lang": {}, "source": {}}, 900, 1).collect()}
    assert got == {"a": 10, "b": 1000, "c": 799}  # domain0 cannot use its part, so domain1 gets it


def test_prefixes_and_epochs(spark):
    frame = docs(spark, [("s0", "en", 200, 10), ("s4", "en", 5, 10)])
    out = M.mixture(frame, permille=500, max_epochs=2).cache()
    by = {r.source: (r.n, r.t) for r in out.groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert by == {"s4": (10, 100), "s0": (92, 920)}  # 1025 tokens, of which s4 can use 100 in two epochs; whole documents only
    assert sorted(out.collect()) == sorted(M.mixture(frame.repartition(7), permille=500, max_epochs=2).collect())
    taken = M.mixed(frame, permille=500, max_epochs=2)
    assert taken.columns == frame.columns and taken.count() == 102


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "x", 0), (3, "a b", "en", "s1", 0), (3, "a b", "en", "s1", 0), (None, "c", "en", "s1", 0)], "doc_id long, text string, lang string, source string, cap int")
    out = M.mixture(odd)
    assert out.count() == 5 and {r.domain for r in out.collect()} == {"unknown", "domain1"}
    assert M.mixture(odd.limit(0)).count() == 0 and M.mixed(odd.limit(0)).count() == 0
