"""Structured Streaming over events: windows with a watermark, and idempotent upserts of refreshed files.

The batch side has only periods that still fill; these are extensions of the same idea.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from civicframe.sources.shared import shared_folder


def window_totals(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and values by window and type; windows close when the watermark has passed."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100, 0).cast("bigint")).alias("cents"))
        .select(F.col("w.start").alias("day"), "event_type", "n", "cents")
    )


#: Buckets of keys that an upserted table is parted into.
BUCKETS = 64


def upsert(target: str, keys: list[str], buckets: int = BUCKETS):
    """A foreachBatch function: rows of a batch replace those of equal keys; a repeated batch changes nothing.

    The table is parted by buckets of its keys, and only the buckets that a batch hits are read and written. Of rows of a batch
    with equal keys the largest counts, by the other columns in their order.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        from civicframe.sources.sinks import Folder

        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in keys]
        fresh = batch.groupBy(*keys).agg(F.max(F.struct(*others)).alias("row__")).select(*keys, "row__.*").select(*batch.columns)
        rows = fresh = fresh.withColumn("bucket__", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        if Folder(spark, target).exists():
            # at most as many rows as there are buckets
            hit = F.broadcast(fresh.select("bucket__").distinct())
            old = spark.read.schema(fresh.schema).parquet(target).join(hit, "bucket__", "left_semi").join(fresh.select(*keys), keys, "left_anti")
            rows = old.select(*fresh.columns).unionByName(fresh)
        rows.repartition("bucket__").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket__").parquet(target)

    return apply


def upserted(spark: SparkSession, target: str) -> DataFrame:
    """The rows of an upserted table."""
    return spark.read.parquet(target).drop("bucket__")


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream to its end: every trigger writes the windows that it has changed, the last of each counts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    where = shared_folder(spark, "days")
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{where}/out/epoch_part={epoch}")

    windows = window_totals(stream).writeStream.outputMode("update").foreachBatch(keep)
    windows.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(f"{where}/out")
    return written.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "cents"), "epoch").alias("last")).select("day", "event_type", "last.n", "last.cents")


QUERIES = {"stream_days": streamed_days}
ORACLES = {
    "stream_days": """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100,
        0) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"""
}
