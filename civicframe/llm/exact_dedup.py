"""Exact dedup by content sort, in DataFrame operations only.

Splitters sampled from the rows cut the order of the normalised bytes into ranges; each row goes to its
range in one shuffle, each range is sorted externally, and each row is compared in full with the one
before it. The sort key is (first KEY characters, SHA-256, identifier), so that a splitter stays small
however long the texts are. As the identifier is part of the key, splitters may fall inside a group of
copies, so no group has to fit into one task. Splitters go out once, as a row that is broadcast. A run of equals that a border of ranges cuts is joined
again from the first and last row of each range, compared in full: two rows for each range, however
large the group.

Nulls count as empty text. Rows with the same identifier and text are copies of each other; one of
them stays. A null identifier is the largest: it stays only where all of its group's are null.
An empty table gives an empty table. Columns that clash with working columns are kept untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from civicframe.llm.common import WS, free_name, shuffle_partitions, table, written

#: Characters of the text in a splitter; ranges for each shuffle partition, and at most; sampled rows for each range.
KEY, RANGES, MOST_RANGES, SAMPLED = 24, 4, 16_384, 20
_RUN = "struct<part: int, n: bigint, head: boolean, first: boolean, last: boolean, sha: string>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def splitters(rows: DataFrame, key: list[str], id_col: str, ranges: int) -> list:
    """Sorted keys between ranges, from at most SAMPLED rows for each: those with the smallest hashes of their identifiers."""
    n, most, top = rows.count(), SAMPLED * ranges, 1 << 62
    order = F.pmod(F.xxhash64(id_col), F.lit(top))
    some = rows.filter(order < F.lit(int(top * 1.5 * most / n))) if n > 2 * most else rows
    found = some.select(*key).orderBy(F.pmod(F.xxhash64(id_col), F.lit(top)), *key).limit(most).orderBy(*key).collect()
    step = max(1, math.ceil(len(found) / ranges))
    return [tuple(r) for r in found[step::step]]


def placed_in_ranges(rows: DataFrame, key: Column, cuts: list, kind: str, part: str) -> DataFrame:
    """rows with part, how many of the sorted cuts are not above the key: first among every so many of them, then among those between."""
    if not cuts:
        return rows.withColumn(part, F.lit(0))
    step = max(1, math.isqrt(len(cuts)))
    outer, inner = free_name(rows, "outer", "inner")
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    # one row of at most MOST_RANGES splitters
    table_ = rows.sparkSession.createDataFrame([([g[0] for g in groups], groups)], f"{outer} array<{kind}>, {inner} array<array<{kind}>>")
    at = F.size(F.filter(F.col(outer), lambda c: c <= key))
    within = F.filter(F.element_at(F.col(inner), at), lambda c: c <= key)
    place = F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + F.size(within))
    return rows.crossJoin(F.broadcast(table_)).select(*[F.col(f"`{c}`") for c in rows.columns], place.alias(part))


def content_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """Each row with its run: equal rows next to each other in one range of the sorted order.

    Adds run (struct): part (the range), n (which run of it), head (first of its run), first and last (of its range), sha
    (of the normalised text). With carry the other columns stay, else the identifier and, of first and last rows, the
    normalised text as border.
    """
    run, norm, start, sha, none, part, head, n, first, last = free_name(df, "run", "norm", "start", "sha", "none", "part", "head", "n", "first", "last")
    key = [start, sha, none, id_col]
    own = [F.col(f"`{c}`") for c in df.columns] if carry else [F.col(id_col)]
    rows = df.select(*own, normalised(F.col(text_col)).alias(norm)).withColumn(start, F.substring(norm, 1, KEY)).withColumn(sha, F.sha2(norm, 256)).withColumn(none, F.col(f"`{id_col}`").isNull())
    cuts = splitters(rows, key, id_col, min(MOST_RANGES, RANGES * shuffle_partitions(df.sparkSession)))
    kind = f"struct<a: string, b: string, c: boolean, d: {df.schema[id_col].dataType.simpleString()}>"
    placed = placed_in_ranges(rows, F.struct(*key).cast(kind), cuts, kind, part).repartition(F.col(part))
    order = W.partitionBy(part).orderBy(*key)
    before = F.lag(norm).over(order)
    runs = (
        placed.withColumn(last, F.lead(sha).over(order).isNull())
        .withColumn(head, F.coalesce(before != F.col(norm), F.lit(True)))
        .withColumn(first, F.row_number().over(order) == 1)
        .withColumn(n, F.sum(F.col(head).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    )
    of = F.struct(F.col(part).alias("part"), F.col(n).alias("n"), F.col(head).alias("head"), F.col(first).alias("first"), F.col(last).alias("last"), F.col(sha).alias("sha"))
    border = [] if carry else [F.when(F.col(first) | F.col(last), F.col(norm)).alias("border")]
    return runs.select(*own, of.cast(_RUN).alias(run), *border)


def cut_runs(borders: DataFrame) -> DataFrame:
    """borders (part, n, sha, text: first and last rows of ranges) -> (part, n, lead_part, lead_n): runs of equal texts under the first of them."""
    runs = borders.select("part", "n", "sha", "text").distinct()
    lead = runs.groupBy("sha", "text").agg(F.min(F.struct("part", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return runs.join(lead, ["sha", "text"]).select("part", "n", F.col("lead.part").alias("lead_part"), F.col("lead.n").alias("lead_n"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256."""
    runs = written(content_runs(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", carry=False).select("id", "run.*", "border"), "runs")
    cut = written(cut_runs(runs.filter("border IS NOT NULL").withColumnRenamed("border", "text")), "cut-runs")
    named = runs.groupBy("part", "n").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("rows"))
    joined = cut.join(named, ["part", "n"]).groupBy("lead_part", "lead_n").agg(F.min("keep").alias("all_keep"), F.sum("rows").alias("all_rows"))
    joined = written(cut.join(joined, ["lead_part", "lead_n"]), "joined-runs")
    # at most two rows for each of MOST_RANGES ranges
    whole = named.join(F.broadcast(joined), ["part", "n"], "left")
    whole = whole.select(
        "part", "n", F.coalesce("all_keep", "keep").alias("keep_id"), F.coalesce("all_rows", "rows").alias("group_size"),
        F.coalesce((F.col("part") == F.col("lead_part")) & (F.col("n") == F.col("lead_n")), F.lit(True)).alias("leads"),
    )
    return runs.join(whole, ["part", "n"]).select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("head") & F.col("leads")).alias("kept"), F.col("sha").alias("text_sha256"))


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the copies: of equal texts, the row with the smallest identifier, with all its columns."""
    own = [f"own_{i}" for i in range(len(df.columns))]
    (run,) = free_name(df, "run")
    runs = content_runs(df, id_col, text_col).filter(f"{run}.head OR {run}.last")
    runs = written(runs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(df.columns, own)], f"{run}.*"), "heads")
    text = normalised(F.col(own[df.columns.index(text_col)])).alias("text")
    cut = cut_runs(runs.filter("first OR last").select("part", "n", "sha", text)).filter("part <> lead_part OR n <> lead_n").select("part", "n")
    # at most two rows for each of MOST_RANGES ranges
    kept = runs.filter("head").join(F.broadcast(cut), ["part", "n"], "left_anti")
    return kept.select(*[F.col(o).alias(c) for o, c in zip(own, df.columns)])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)"""
}
