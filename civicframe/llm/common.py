"""What the training-data operators share: tables, the shared folder, counts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the contracts: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only while the bound on its rows is below this.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch.
BATCH = 1000
#: Environment of lean_workers: blocks above 4 MB are mapped, so freed ones go back at once, and so does what is free above 8 MB at the heap's end.
LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when the session began elsewhere than in the repository.

    Arrow batches get BATCH rows where the session has Spark's default, as rows here are whole texts.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = f"{env.get('PYTHONPATH', '')}:{os.environ.get('PYTHONPATH', '')}".split(":")
    if root not in known:
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


def lean_workers(spark: SparkSession) -> None:
    """Lets Python workers give freed memory back to the system, from the next query of this session on.

    Workers wait idle between the stages of a pipeline, and what they keep counts for their executor.
    """
    spark.sparkContext.environment.update(LEAN)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and has no other machines.

    What is written there stays until the folder's owner clears it, so that a lost executor can be made up for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="civicframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: a Parquet table in the shared folder, read again. It survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Working column names that clash with none of the frame's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(col: str = "doc_id"):
    """crc32 of the identifier as text, modulo 5; 0 is held out."""
    return F.crc32(F.encode(F.col(col).cast("string"), "UTF-8")) % 5


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The (at most) rows rows whose identifiers have the smallest hashes. A threshold on the hash goes first, so
    that what the last sort gets does not grow with the input."""
    n, top = df.count(), 1 << 62
    order = F.xxhash64(id_col)
    if n > 2 * rows:
        df = df.filter(F.pmod(order, F.lit(top)) < F.lit(int(top * 1.5 * rows / n)))
    return df.orderBy(F.pmod(order, F.lit(top)), id_col).limit(rows)
