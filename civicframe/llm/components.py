"""Distributed connected components by alternating large and small stars.

Every round is a few joins and partial aggregations on edges; nothing of a component is gathered in
one place. A node with many edges meets them by broadcast: of E rows at most E / limit nodes have more
than limit, and the limit grows with E so that these never exceed BROADCAST_ROWS; the rows of all
others are dealt by node. Node identifiers may have any ordered type; a component's name is its
smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from civicframe.llm.common import BROADCAST_ROWS, cut, written

#: Edges of a node that meet in one task at least, however few edges there are.
FEW = 64


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n); n counts edges and sums to total at most."""
    limit = max(FEW, -(-total // BROADCAST_ROWS))
    many = F.broadcast(least.filter(F.col("n") > limit).select("u", F.col("m").alias("far")))
    marked = rows.join(many, "u", "left")
    dealt = marked.filter("far IS NULL").select("u", "v").join(least.filter(F.col("n") <= limit).select("u", "m"), "u")
    return marked.filter("far IS NOT NULL").select("u", "v", F.col("far").alias("m")).union(dealt.select("u", "v", "m"))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter("v > u"), least, 2 * count).select(F.col("v").alias("u"), "m").distinct().select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    # every edge points from the larger to the smaller node
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, count).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) in any direction -> (node, component) for every node that some edge has.

    Null ends and self-loops are ignored; no edges give an empty table.
    """
    kind = edges.schema["u"].dataType
    now = cut(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct())
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # of count edges the large star has count at most, one for each
        now = cut(_small_star(written(_large_star(now, seen[0]), "large-star"), seen[0]))
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the stars did not settle")
    names = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return names.union(roots).select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
