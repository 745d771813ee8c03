"""Cumulative values as a stream: a month's flow is known once the month before is, whichever comes first.

State by series: the months within the watermark, each with its cumulative value and whether its flow went out. A month that
stands behind a gap waits; a late month that comes within the watermark closes the gap, and when the watermark passes
a month whose predecessor is lost, that month goes out without flow. Only the last month stays for good.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from civicframe.operators import series as S
from civicframe.plans.roles import SQL, entities, movements
from civicframe.sources.shared import shared_folder

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FlowProcessor(StatefulProcessor):
    """Emits (keys, month, flow) once for each month of a series; of repeated months the first value counts."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "month int", "cumulative bigint, at bigint, sent boolean")

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(*key, *row) for row in out], columns=[*self.keys, "month", "flow"])
        return frame.astype({"month": "int32", "flow": "Int64"})

    def _known(self, month: int) -> tuple | None:
        return self.months.getValue((month,)) if self.months.containsKey((month,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = {}
        for frame in rows:
            for month, cumulative, at in zip(frame["month"], frame["cumulative"], frame["at"]):
                fresh.setdefault(int(month), (int(cumulative), int(pd.Timestamp(at).timestamp() * 1000)))
        for month, (cumulative, at) in fresh.items():
            if self._known(month) is None:
                self.months.updateValue((month,), (cumulative, at, False))
                self.handle.registerTimer(at)
        out = []
        for month in sorted({m for f in fresh for m in (f, f + 1)}):
            own, before = self._known(month), self._known(month - 1)
            if own and not own[2] and (month == 1 or before):
                out.append((month, own[0] - (before[0] if month > 1 else 0)))
                self.months.updateValue((month,), (own[0], own[1], True))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No earlier month can come any more: months up to here are final, and those before the last of them go."""
        passed, out = expiredTimerInfo.getExpiryTimeInMs(), []
        final = sorted((m[0], v) for m, v in self.months.iterator() if v[1] <= passed)
        for month, (cumulative, at, sent) in final:
            if not sent:
                out.append((month, None))
                self.months.updateValue((month,), (cumulative, at, True))
        for month, _ in final[:-1]:
            self.months.removeKey((month,))
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def streamed_flows(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """stream (keys, month, cumulative, at) -> (keys, month, flow)."""
    kinds = dict(stream.dtypes)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "month int", "flow bigint"])
    rows = stream.select(*keys, F.col("month").cast("int").alias("month"), F.col("cumulative").cast("bigint").alias("cumulative"), F.col("at").cast("timestamp").alias("at"))
    return rows.withWatermark("at", late).groupBy(*keys).transformWithStateInPandas(FlowProcessor(keys), out, "Append", "EventTime")


def run_to_the_end(spark: SparkSession, frame: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over what is there, with the state store that such state needs, and appends to a table of files."""
    key, value = _PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        frame.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


#: A replay of all years needs a watermark behind all of them.
REPLAY = "4000 days"


def flows_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative payments by region and year arrive in four lots, some months late, some never; the flows that the stream knows beside the months."""
    rows = movements(spark, sf_dir).join(entities(spark, sf_dir).select("entity", "region"), "entity").groupBy("region", "year", "month").agg(F.sum("cents").alias("cents"))
    months = S.running_total(rows, ["region", "year"], "month", "cents").filter("(region + month) % 7 <> 3")
    months = months.select("region", "year", "month", "cumulative", F.make_date("year", "month", F.lit(1)).cast("timestamp").alias("at"))
    where = shared_folder(spark, "flows")
    months.withColumn("lot", (F.col("month") * 5 + F.col("region")) % 4).write.partitionBy("lot").parquet(f"{where}/months")
    for lot in range(4):
        spark.read.parquet(f"{where}/months").filter(F.col("lot") == lot).drop("lot").repartition(2, "region").write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(months.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    run_to_the_end(spark, streamed_flows(stream, ["region", "year"], REPLAY), f"{where}/out", f"{where}/state")
    flows = spark.read.schema("region int, year int, month int, flow bigint").parquet(f"{where}/out")
    return spark.read.parquet(f"{where}/months").drop("lot", "at").join(flows, ["region", "year", "month"], "left")


QUERIES = {"stream_w02_flows": flows_of_regions}
ORACLES = {
    "stream_w02_flows": f"""WITH {SQL}, m AS (SELECT region, year, month, CAST(sum(sum(cents)) OVER (PARTITION BY region, year ORDER BY month) AS BIGINT) AS cumulative
        FROM mov JOIN ent USING (entity) GROUP BY region, year, month), g AS (SELECT * FROM m WHERE (region + month) % 7 <> 3)
        SELECT region, year, month, cumulative, CASE WHEN month = 1 THEN cumulative WHEN lag(month) OVER w = month - 1 THEN cumulative - lag(cumulative) OVER w END AS flow
        FROM g WINDOW w AS (PARTITION BY region, year ORDER BY month)"""
}
