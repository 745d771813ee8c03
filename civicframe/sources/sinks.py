"""Sinks that write only what changed, and both files of a pair or neither."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from civicframe.operators.contracts import Check, enforce
from civicframe.operators.joins import CheckFailed


def content_digest(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Row count and order-free digest of all columns but those ignored; one row."""
    columns = sorted(c for c in df.columns if c not in ignore)
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.bit_xor(h).alias("xor"))


class Folder:
    """A path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.at.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.system.exists(self.at)

    def state(self) -> tuple[int, int, int]:
        """Bytes, files and the last change of a file or a folder of files."""
        inside = self.system.getContentSummary(self.at)
        times = [f.getModificationTime() for f in self.system.listStatus(self.at)]
        return inside.getLength(), inside.getFileCount(), max(times, default=0)

    def rename(self, to: str) -> None:
        if not self.system.rename(self.at, self.spark._jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{self.path} cannot become {to}")

    def delete(self) -> None:
        self.system.delete(self.at, True)

    def write_text(self, name: str, text: str) -> None:
        out = self.system.create(self.spark._jvm.org.apache.hadoop.fs.Path(self.at, name), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()


def write_if_changed(df: DataFrame, path: str, ignore: tuple[str, ...] = ()) -> bool:
    """Writes Parquet unless the content, without the columns ignored, is there already."""
    spark = df.sparkSession
    if Folder(spark, path).exists() and tuple(content_digest(spark.read.parquet(path), ignore).first()) == tuple(content_digest(df, ignore).first()):
        return False
    replace_atomically(spark, lambda where: df.write.parquet(where), path)
    return True


def replace_atomically(spark: SparkSession, write, path: str) -> None:
    """Writes beside the target and renames, on the target's own file system; a failure leaves the target as it was."""
    fresh, old = (Folder(spark, f"{path}.{uuid.uuid4().hex}.{end}") for end in ("part", "old"))
    try:
        write(fresh.path)
        if Folder(spark, path).exists():
            Folder(spark, path).rename(old.path)
        fresh.rename(path)
    except BaseException:
        if old.exists() and not Folder(spark, path).exists():
            old.rename(path)
        raise
    finally:
        fresh.delete(), old.delete()


def write_pair(data: DataFrame, meta: dict, path: str) -> None:
    """Data and metadata under one folder, in one rename."""
    spark = data.sparkSession

    def write(where: str) -> None:
        data.write.parquet(f"{where}/data")
        Folder(spark, where).write_text("meta.json", canonical(meta))

    replace_atomically(spark, write, path)


def write_artifact(data: DataFrame, path: str, checks: list[Check], meta: dict | None = None) -> dict:
    """Data that hold all checks, with the metadata that bind them: columns, rows and digest. Nothing is written where a check fails."""
    enforce(data, checks)
    n, total, xor = content_digest(data).first()
    bound = {**(meta or {}), "columns": data.schema.simpleString(), "rows": n, "sum": str(total), "xor": str(xor)}
    write_pair(data, bound, path)
    return bound


def read_artifact(spark: SparkSession, path: str, checks: list[Check]) -> DataFrame:
    """The data of an artifact, refused where columns, rows, digest or a check are not those that were written."""
    meta = json.loads(spark.read.text(f"{path}/meta.json", wholetext=True).first().value)
    data = spark.read.parquet(f"{path}/data")
    n, total, xor = content_digest(data).first()
    found = {"columns": data.schema.simpleString(), "rows": n, "sum": str(total), "xor": str(xor)}
    if bad := [k for k, v in found.items() if meta.get(k) != v]:
        raise CheckFailed(f"{path}: {', '.join(bad)} differ")
    return enforce(data, checks)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def unchanged_sources(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with unchanged: whether last_modified and, where given, etag are those of the manifest."""
    known = manifest.select("source", F.col("last_modified").alias("modified__"), F.col("etag").alias("etag__"), F.lit(True).alias("known__"))
    tag = F.col("etag").isNull() | F.coalesce(F.col("etag") == F.col("etag__"), F.lit(False))
    same = F.coalesce("known__", F.lit(False)) & F.col("last_modified").eqNullSafe(F.col("modified__")) & tag
    return sources.join(known, "source", "left").withColumn("unchanged", same).drop("modified__", "etag__", "known__")


def unchanged(manifest: DataFrame, sources: DataFrame) -> bool:
    """Whether no source has changed."""
    return unchanged_sources(manifest, sources).filter("NOT unchanged").limit(1).count() == 0
