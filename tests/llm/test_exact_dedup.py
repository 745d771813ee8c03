import hashlib

from pyspark.sql import functions as F

from civicframe.llm.exact_dedup import distinct_texts, exact_dedup, placed_in_ranges

SCHEMA = "doc_id long, text string, run string, Norm int"


def docs(spark):
    rows = [(5, "a  b"), (2, "a b"), (9, "a\tb"), (3, None), (4, ""), (7, "x" * 200_000), (6, "x" * 200_000), (8, "A b"), (2, "a b"), (None, "n"), (10, " ")]
    return spark.createDataFrame([(i, t, "r", 1) for i, t in rows], SCHEMA)


def test_groups(spark):
    got = exact_dedup(docs(spark).repartition(3)).collect()
    assert len(got) == 11
    groups = {(r.keep_id, r.group_size) for r in got}
    assert groups == {(2, 4), (3, 2), (6, 2), (8, 1), (None, 1), (10, 1)}
    assert sorted((r.doc_id or -1) for r in got if r.kept) == [-1, 2, 3, 6, 8, 10]
    assert all(len(r.text_sha256) == 64 for r in got)


def test_large_group_crosses_partitions(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same text', concat('text ', id)) AS text")
    got = exact_dedup(many).filter("doc_id % 3 = 0")
    assert got.select("keep_id", "group_size").distinct().collect() == [(0, 1667)]
    assert [r.doc_id for r in got.filter("kept").collect()] == [0]


def test_ranges_are_those_of_the_order(spark):
    """Whatever the cuts: groups, equal texts across borders and the one that stays are those of a plain grouping."""
    rows = [(i if i % 11 else None, ("same  text", f"text {i % 7}", "", "é" * (i % 5), None)[i % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        want.setdefault(" ".join((t or "").split(" ")).replace("  ", " "), []).append(i)
    got = exact_dedup(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert sorted(map(len, by.values())) == sorted(map(len, want.values())) and len(got) == 400
    sums = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for sha, rs in by.items():
        ids = [i for i in sums[sha] if i is not None]
        assert {r.keep_id for r in rs} == {min(ids, default=None)} and {r.group_size for r in rs} == {len(rs)} and sum(r.kept for r in rs) == 1
    assert distinct_texts(df).count() == len(want)


def test_range_numbers(spark):
    cuts = [("b", "x", 3), ("b", "x", 5), ("c", "", 0), ("d", "y", 1), ("d", "y", 2)]
    df = spark.createDataFrame([("a", "z", 9), ("b", "x", None), ("b", "x", 3), ("b", "x", 4), ("c", "a", 0), ("d", "y", 2), ("e", "", 0)], "a string, b string, c long")
    kind = "struct<a: string, b: string, c: bigint>"
    for k in range(len(cuts) + 1):
        got = [r.n for r in placed_in_ranges(df, F.struct("a", "b", "c").cast(kind), cuts[:k], kind, "n").collect()]
        assert got == [min(k, n) for n in (0, 0, 1, 1, 3, 5, 5)]


def test_what_stays_is_what_is_named(spark):
    """kept and keep_id agree for null identifiers, also where borders of ranges cut the group."""
    few = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    many = spark.range(3000).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "IF(id % 3 = 0, 'same', concat('t', id % 50)) AS text")
    for df in (few, many.repartition(7)):
        got = exact_dedup(df).collect()
        by = {}
        for r in got:
            by.setdefault(r.text_sha256, []).append(r)
        for rows in by.values():
            (stays,) = [r for r in rows if r.kept]
            least = min((r.doc_id for r in rows if r.doc_id is not None), default=None)
            assert {r.keep_id for r in rows} == {least} == {stays.doc_id}
        kept = distinct_texts(df).collect()
        assert sorted(map(str, (r.doc_id for r in kept))) == sorted(str(r.doc_id) for r in got if r.kept) and len(kept) == len(by)


def test_splitters_are_not_in_the_plan(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    from civicframe.llm.exact_dedup import content_runs

    plan = content_runs(df)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 20_000


def test_stage_keeps_columns(spark):
    kept = distinct_texts(docs(spark))
    assert kept.columns == ["doc_id", "text", "run", "Norm"] and kept.count() == 6
    assert kept.filter("doc_id = 2").count() == 1


def test_empty(spark):
    assert exact_dedup(docs(spark).limit(0)).count() == 0 and distinct_texts(docs(spark).limit(0)).count() == 0
