"""Rows in one global order of time, numbered without sorting them in one task, and read again from any position."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW_BITS = 33  # of the numbers that Spark gives to the rows of a partition


@dataclass(frozen=True)
class TemporalSampler:
    """A table written in ranges of the order; ``offsets``: rows before each range, and of all ranges at the end."""

    spark: SparkSession
    path: str
    schema: T.StructType
    offsets: tuple[int, ...]

    @classmethod
    def write(cls, df: DataFrame, path: str, order: Sequence[str], ranges: int) -> TemporalSampler:
        """Writes ``df`` in ``ranges`` ranges of ``order``, which must be total: time first, then what tells rows apart.

        One shuffle by sampled ranges; a range is sorted in its own task and its rows are counted as they are read back.
        Columns named __range and __place are not allowed.
        """
        if ranges < 1:
            raise ValueError("ranges must be 1 or more")
        if {"__range", "__place"} & set(df.columns):
            raise ValueError("__range and __place are the sampler's own columns")
        number = F.monotonically_increasing_id()
        rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__place", number)
        parts = rows.withColumns({"__range": F.shiftright("__place", _ROW_BITS).cast("int"), "__place": F.col("__place").bitwiseAND(F.lit(2**_ROW_BITS - 1))})
        parts.write.partitionBy("__range").parquet(path)
        return cls.open(df.sparkSession, path, df.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: T.StructType) -> TemporalSampler:
        """A table of these columns that was written before, in this session or another one."""
        own = T.StructType([*schema.fields, T.StructField("__place", T.LongType()), T.StructField("__range", T.IntegerType())])
        counts = {r["__range"]: r["count"] for r in spark.read.schema(own).parquet(path).groupBy("__range").count().collect()}  # a row for each range
        offsets = [0]
        for i in range(max(counts, default=-1) + 1):
            offsets.append(offsets[-1] + counts.get(i, 0))
        return cls(spark, path, own, tuple(offsets))

    def __len__(self) -> int:
        return self.offsets[-1]

    def read(self, start: int = 0, stop: int | None = None) -> DataFrame:
        """Rows at positions start to stop (without), with their ``position``; only the ranges that hold them are read."""
        stop = len(self) if stop is None else min(stop, len(self))
        if not 0 <= start:
            raise ValueError("start must be 0 or more")
        table = self.spark.read.schema(self.schema).parquet(self.path)
        if len(self.offsets) == 1:
            return table.withColumn("position", F.lit(0).cast("bigint")).limit(0)
        held = [i for i, (low, high) in enumerate(zip(self.offsets, self.offsets[1:], strict=False)) if low < stop and high > start]
        before = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in self.offsets]), F.col("__range") + 1)
        placed = table.where(F.col("__range").isin(held)).withColumn("position", before + F.col("__place"))
        return placed.where((F.col("position") >= start) & (F.col("position") < stop)).drop("__range", "__place")

    def batches(self, size: int, start: int = 0) -> DataFrame:
        """Rows from ``start`` on with ``batch``, from 0: runs of ``size`` positions, so that a stopped epoch goes on."""
        if size < 1:
            raise ValueError("size must be 1 or more")
        return self.read(start).withColumn("batch", F.floor((F.col("position") - start) / F.lit(size)))
