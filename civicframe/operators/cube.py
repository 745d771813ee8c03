"""A cube of additive sums that is stored at a few levels; questions are answered from the coarsest level that has their keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Parts of a level, about: slices of a part are as many as make one for each task.
PARTS = 8


@dataclass(frozen=True)
class Level:
    """A stored level: its keys, and the one by which its files are parted."""

    name: str
    keys: tuple[str, ...]
    parted_by: str | None = None


@dataclass
class Cube:
    spark: SparkSession
    path: str
    measures: tuple[str, ...]
    schemas: dict[Level, object] = field(default_factory=dict)
    rows: dict[Level, int] = field(default_factory=dict)

    @classmethod
    def build(cls, df: DataFrame, path: str, levels: list[Level], measures: dict[str, Column], parts: int | None = None) -> Cube:
        """Stores all levels: the first from df, by aggregates that may be summed up again, each other from the smallest level stored that has its keys.

        parts: tasks over which the rows of the first level are dealt by its part and slices of it, so that one shuffle serves sums and files.
        """
        cube = cls(df.sparkSession, path, tuple(measures))
        for i, level in enumerate(levels):
            if i:
                sums = cube.sums(list(level.keys))
            else:
                rows, slices = df, []
                if parts and level.parted_by:
                    slices = ["slice__"]
                    rows = df.withColumn("slice__", F.pmod(F.xxhash64(*[k for k in level.keys if k != level.parted_by]), F.lit(-(-parts // PARTS))))
                    rows = rows.repartition(parts, level.parted_by, "slice__")
                sums = rows.groupBy(*level.keys, *slices).agg(*[c.alias(n) for n, c in measures.items()]).drop(*slices)
            counted = Observation()
            sums = sums.observe(counted, F.count(F.lit(1)).alias("n"))
            if level.parted_by and not i and parts:
                sums.write.partitionBy(level.parted_by).parquet(f"{path}/{level.name}")
            elif level.parted_by:
                # files of even size within each part
                sums.hint("rebalance", level.parted_by).write.partitionBy(level.parted_by).parquet(f"{path}/{level.name}")
            else:
                sums.write.parquet(f"{path}/{level.name}")
            cube.schemas[level], cube.rows[level] = sums.schema, counted.get["n"]
        return cube

    def level_for(self, keys: set[str]) -> Level:
        """The stored level with the fewest rows among those that have all keys."""
        fit = [level for level in self.rows if keys <= set(level.keys)]
        if not fit:
            raise KeyError(f"no stored level has {', '.join(sorted(keys))}")
        return min(fit, key=lambda level: (self.rows[level], len(level.keys)))

    def read(self, level: Level) -> DataFrame:
        return self.spark.read.schema(self.schemas[level]).parquet(f"{self.path}/{level.name}")

    def sums(self, by: list[str], where: Column | None = None, needs: tuple[str, ...] = (), also: dict[str, Column] | None = None) -> DataFrame:
        """Measures by keys, of the rows that a condition on keys (by and needs) takes; also: more aggregates over keys and measures. All keys null: one row for all."""
        level = self.level_for({*by, *needs})
        rows = self.read(level)
        rows = rows if where is None else rows.filter(where)
        if not also and where is None and set(by) == set(level.keys):
            return rows.select(*by, *self.measures)
        return rows.groupBy(*by).agg(*[F.sum(m).cast("bigint").alias(m) for m in self.measures], *[c.alias(n) for n, c in (also or {}).items()])
