"""Many files as one stream, with the keys that several files have found while it runs.

The first row of a key goes on, later ones do not; a row of a key that another file had first is a repeat. first_rows and
repeats keep what they know as state behind a watermark: right for a stream of which only the last days matter. Where
every key counts, first_and_repeats keeps first rows as files, which each batch reads once, as a state of all keys would have
to stay in executors' memory. All go on from their checkpoints after a stop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from civicframe.operators.joins import dealt
from civicframe.plans.roles import read, tasks
from civicframe.sources.shared import shared_folder
from civicframe.sources.sinks import Folder

def first_rows(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def repeats(stream: DataFrame, again: DataFrame, keys: list[str], file: str, at: str, late: str) -> DataFrame:
    """keys, first_file and file of rows whose key another file had first; again is the same stream, read once more."""
    first = first_rows(again, keys, at, late).select(*[F.col(k).alias(f"{k}__") for k in keys], F.col(file).alias("first_file"), F.col(at).alias("at__"))
    near = (F.col(at) >= F.col("at__") - F.expr(f"INTERVAL {late}")) & (F.col(at) <= F.col("at__") + F.expr(f"INTERVAL {late}"))
    same = [F.col(k) == F.col(f"{k}__") for k in keys] + [F.col(file) != F.col("first_file"), near]
    return stream.withWatermark(at, late).join(first, reduce(lambda a, b: a & b, same)).select(*keys, "first_file", file)


def first_and_repeats(stream: DataFrame, keys: list[str], file: str, at: str, out: str, checkpoint: str, parts: int | None = None) -> None:
    """Writes keys, file, at and first_file by batch: the first row of each key, by batch, at and file (first_file is null), and every row whose key another file had first.

    A batch that runs again after a stop replaces what it wrote and looks only at those before it. parts: tasks of a batch.
    """
    schema = stream.select(*keys, file, at).schema.add("first_file", stream.schema[file].dataType).add("batch", "long")
    place = W.partitionBy(*keys).orderBy("new", at, file)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, file, at, F.lit(True).alias("new"))
        if Folder(spark, out).exists():
            before = spark.read.schema(schema).parquet(out).filter((F.col("batch") < number) & F.col("first_file").isNull())
            rows = rows.unionByName(before.select(*keys, file, at, F.lit(False).alias("new")))
        # the first row of a key is what went on before, if there is any
        rows = dealt(rows, parts, *keys).withColumn("place", F.row_number().over(place)).withColumn("own", F.first(F.struct(file)).over(place)[file])
        found = rows.filter(F.col("new") & ((F.col("place") == 1) | (F.col("own") != F.col(file))))
        found = found.select(*keys, file, at, F.when(F.col("place") > 1, F.col("own")).alias("first_file"))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ended(frame: DataFrame, out: str, checkpoint: str) -> None:
    frame.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Half years of the given tables, about.
HALVES = 14
SCHEMA = "number bigint, line int, cents_text string, at timestamp, file string"


def union_of(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(folder)


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in files by the half year of their shipment, as one stream: how often each key went on, and whether another file repeats it."""
    where = shared_folder(spark, "files")
    half = F.concat_ws("-", F.year("l_shipdate").cast("string"), F.when(F.month("l_shipdate") < 7, "1").otherwise("2"))
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("number"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_extendedprice").cast("string").alias("cents_text"),
        F.col("l_shipdate").cast("timestamp").alias("at"), half.alias("file"), half.alias("part"),
    )
    parts, files = tasks(spark, sf_dir), f"{where}/in"
    # a half year of a large table is several files, each written by a task of bounded rows; a batch takes six half years
    each = 1 if parts is None else -(-parts // HALVES)
    rows = rows.repartition("part") if parts is None else rows.repartition(parts, "part", F.pmod("number", F.lit(each)))
    rows.write.partitionBy("part").parquet(files)
    first_and_repeats(union_of(spark, files, 6 * each), ["number", "line"], "file", "at", f"{where}/out", f"{where}/state", parts)
    found = spark.read.schema("number bigint, line int, first_file string").option("recursiveFileLookup", "true").parquet(f"{where}/out")
    return dealt(found, parts, "number", "line").groupBy("number", "line").agg(
        F.count_if(F.col("first_file").isNull()).alias("went_on"), F.bool_or(F.col("first_file").isNotNull()).alias("repeated"),
    )


QUERIES = {"stream_u03_repeats": repeated_lines}
ORACLES = {
    "stream_u03_repeats": """SELECT l_orderkey AS number, CAST(l_linenumber AS INT) AS line, CAST(1 AS BIGINT) AS went_on,
        count(DISTINCT year(l_shipdate) * 2 + CASE WHEN month(l_shipdate) < 7 THEN 0 ELSE 1 END) > 1 AS repeated FROM lineitem GROUP BY l_orderkey, l_linenumber"""
}
