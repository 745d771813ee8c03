"""Publishing by one writing job, reading back what was bound, and refreshing only the partitions that changed.

The job that writes the parts also counts rows, digests them and counts rows that break a rule, by an observation. A
manifest of the parts with their SHA-256 is a table beside them, and one small file binds both with a hash of itself.

A digest tree has the rows and digest of a table, of each of its partitions and of buckets in them. Two trees are compared
from the top down, so that only children of what differs are looked at, and a refresh writes only partitions that differ.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from civicframe.operators.contracts import Rule
from civicframe.operators.joins import CheckFailed
from civicframe.sources.sinks import Folder, canonical, replace_atomically

#: Rows of a part at most, so that a part can be hashed whole; buckets of a partition in a digest tree.
PART_ROWS, BUCKETS = 2_000_000, 16
_TREE = "depth int, path array<string>, n bigint, sum decimal(38,0), xor bigint"


def _digest(columns: list[str]) -> list[Column]:
    h = F.xxhash64(*sorted(columns))
    return [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("xor")]


def _self_hash(meta: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in meta.items() if k != "self"}).encode()).hexdigest()


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """part, bytes and sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _observed(df: DataFrame, more: list[Column], write) -> dict:
    """What the job that writes df has counted."""
    seen = Observation()
    write(df.observe(seen, *_digest(df.columns), *more))
    return seen.get


def publish(df: DataFrame, path: str, rules: list[Rule], meta: dict | None = None, part_rows: int = PART_ROWS) -> dict:
    """Writes df under path with its manifest, all or nothing; nothing where a row breaks a rule. Gives what binds it.

    Rules are checked, rows counted and digested by the job that writes the parts.
    """
    if bad := [r.name for r in rules if not r.each]:
        raise ValueError(f"not of every row: {', '.join(bad)}")
    spark, bound = df.sparkSession, {}

    def write(where: str) -> None:
        broken = [F.expr(f"count(CASE WHEN coalesce({r.holds}, false) THEN NULL ELSE 1 END)").alias(f"rule{i}") for i, r in enumerate(rules)]
        found = _observed(df, broken, lambda d: d.write.option("maxRecordsPerFile", part_rows).parquet(f"{where}/data"))
        if failed := [f"{r.name} ({found[f'rule{i}']} rows)" for i, r in enumerate(rules) if found[f"rule{i}"]]:
            raise CheckFailed(", ".join(failed))
        parts = _observed(_parts(spark, f"{where}/data"), [], lambda d: d.write.json(f"{where}/manifest"))
        bound.update(meta or {})
        bound.update({"columns": df.schema.json(), "rows": found["n"], "sum": str(found["sum"]), "xor": str(found["xor"]), "parts": parts["n"], "parts_sum": str(parts["sum"]), "parts_xor": str(parts["xor"])})
        bound["self"] = _self_hash(bound)
        Folder(spark, where).write_text("meta.json", canonical(bound))

    replace_atomically(spark, write, path)
    return bound


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published rows; refused where the binding file, the manifest or any part is not the one that was written."""
    from pyspark.sql.types import StructType

    meta = json.loads(spark.read.text(f"{path}/meta.json", wholetext=True).first().value)
    if meta.get("self") != _self_hash(meta):
        raise CheckFailed(f"{path}: meta.json is not what was written")
    listed = spark.read.schema("part string, bytes bigint, sha256 string").json(f"{path}/manifest")
    row = listed.agg(*_digest(listed.columns)).first()
    if (row.n, str(row["sum"]), str(row.xor)) != (meta["parts"], meta["parts_sum"], meta["parts_xor"]):
        raise CheckFailed(f"{path}: the manifest is not what was written")
    found = _parts(spark, f"{path}/data").select("part", F.struct("bytes", "sha256").alias("found"))
    both = listed.select("part", F.struct("bytes", "sha256").alias("listed")).join(found, "part", "full_outer")
    if odd := both.filter(~F.col("listed").eqNullSafe(F.col("found"))).select("part").limit(5).collect():
        raise CheckFailed(f"{path}: {', '.join(r.part for r in odd)} differ from the manifest")
    return spark.read.schema(StructType.fromJson(json.loads(meta["columns"]))).parquet(f"{path}/data")


def digest_tree(df: DataFrame, levels: list[str], key: str, buckets: int = BUCKETS, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(depth, path, n, sum, xor): the whole at depth 0, then by each level, then by buckets of the key; columns in ignore do not count."""
    columns = [c for c in df.columns if c not in ignore]
    steps = [F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) for c in levels] + [F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")]
    leaves = df.groupBy(F.array(*steps).alias("path")).agg(*_digest(columns))
    up = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(len(steps))))).withColumn("path", F.slice("path", F.lit(1), F.col("depth")))
    nodes = up.groupBy("depth", "path").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"))
    return nodes.select("depth", "path", "n", F.col("sum").cast("decimal(38,0)").alias("sum"), "xor")


def changed_nodes(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """path and state (added, removed, changed) of the nodes of a depth that differ, by comparing trees from their roots down."""
    found = None
    for d in range(depth + 1):
        a, b = (t.filter(F.col("depth") == d).select("path", F.struct("n", "sum", "xor").alias(name)) for t, name in ((old, "before"), (new, "after")))
        if found is not None:
            above = found.select(F.col("path").alias("above"))
            a, b = (t.join(above, F.slice("path", 1, d - 1) == F.col("above"), "left_semi") for t in (a, b))
        both = a.join(b, "path", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
        state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
        found = both.select("path", state.alias("state"))
    return found


def refresh(df: DataFrame, path: str, levels: list[str], key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Brings a table partitioned by levels up to df: changed and added partitions are written, removed ones deleted, others left as they are.

    Gives the levels and state of what differed. The tree goes in place last: a refresh that was cut off is done again by the next.
    """
    spark = df.sparkSession
    data, tree, fresh = f"{path}/data", f"{path}/tree", f"{path}/tree.{uuid.uuid4().hex}"
    digest_tree(df, levels, key, ignore=ignore).write.parquet(fresh)
    new = spark.read.schema(_TREE).parquet(fresh)
    old = spark.read.schema(_TREE).parquet(tree) if Folder(spark, tree).exists() else new.limit(0)
    log = f"{path}/changes/{uuid.uuid4().hex}"
    named = [F.nullif(F.get("path", F.lit(i)), F.lit("__HIVE_DEFAULT_PARTITION__")).cast(df.schema[c].dataType).alias(c) for i, c in enumerate(levels)]
    changed_nodes(old, new, len(levels)).select(*named, "state").write.parquet(log)
    changes = spark.read.parquet(log)
    todo = changes.filter("state <> 'removed'")
    if todo.limit(1).count():
        on = [df[c].eqNullSafe(todo[c]) for c in levels]
        rows = df.join(todo, on, "left_semi").repartition(*levels, F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*levels).parquet(data)
    # one row for each partition that is gone
    for gone in changes.filter("state = 'removed'").toLocalIterator():
        Folder(spark, "/".join([data, *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if gone[c] is None else gone[c]}" for c in levels)])).delete()
    replace_atomically(spark, lambda where: new.write.parquet(where), tree)
    Folder(spark, fresh).delete()
    return changes
