"""Pages by position in a stored order: a sorted copy in ranges, and a zone map of how many rows stand before each.

A page reads the one or two ranges that it lies in, at any offset; many pages are one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from civicframe.sources.shared import shared_folder

#: Rows of a range, about; ranges at most, as the zone map has a row for each.
RANGE_ROWS, MOST_RANGES = 100_000, 20_000
#: Places asked for at once that are broadcast.
BROADCAST_PLACES = 200_000


@dataclass
class StoredOrder:
    rows: DataFrame
    zones: list[tuple[int, int, int]]  # range, rows before it, rows in it

    @property
    def total(self) -> int:
        return self.zones[-1][1] + self.zones[-1][2] if self.zones else 0

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], range_rows: int = RANGE_ROWS) -> StoredOrder:
        """Stores df in a total order. Rows that the order leaves equal have no place of their own."""
        spark = df.sparkSession
        path = shared_folder(spark, "ordered")
        ranges = min(MOST_RANGES, max(1, -(-df.count() // range_rows)))
        place = F.monotonically_increasing_id()
        parted = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place__", place)
        parted = parted.withColumn("range__", F.shiftright("place__", 33).cast("int")).withColumn("place__", F.col("place__").bitwiseAND(F.lit((1 << 33) - 1)))
        parted.write.partitionBy("range__").parquet(path)
        rows = spark.read.schema(parted.schema).parquet(path)
        before, zones = 0, []
        for r in rows.groupBy("range__").count().orderBy("range__").collect():
            zones.append((r.range__, before, r["count"]))
            before += r["count"]
        return cls(rows, zones)

    def pages(self, requests: list[tuple[int, int]]) -> DataFrame:
        """request (its number), place (from 0) and the columns of the rows on each page (offset, limit), from the ranges that hold them only."""
        spark, own = self.rows.sparkSession, [c for c in self.rows.columns if c not in ("range__", "place__")]
        wanted = []
        for n, (offset, limit) in enumerate(requests):
            for name, before, count in self.zones:
                low, high = max(offset, before), min(offset + limit, before + count)
                if low < high:
                    wanted.append((n, name, before, low - before, high - before))
        asked = spark.createDataFrame(wanted, "request int, range__ int, before__ bigint, low__ bigint, high__ bigint")
        asked = asked.select("request", "range__", "before__", F.explode(F.sequence("low__", F.col("high__") - 1)).alias("place__"))
        held = self.rows.filter(F.col("range__").isin(sorted({w[1] for w in wanted})))
        # one row for each place asked for
        few = sum(high - low for *_, low, high in wanted) <= BROADCAST_PLACES
        found = held.join(F.broadcast(asked) if few else asked, ["range__", "place__"])
        return found.select("request", (F.col("before__") + F.col("place__")).alias("place"), *own)

    def ranges_of(self, offset: int, limit: int) -> list[int]:
        return [name for name, before, count in self.zones if before < offset + limit and offset < before + count]
