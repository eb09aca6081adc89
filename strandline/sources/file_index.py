"""An index of a folder's Parquet files: rows and the range of some columns for each file, to read and count by."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """file, rows, and least_{c}, greatest_{c} and nulls_{c} of each column: one pass over these columns alone."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), *[F.col(f"`{c}`").alias(c) for c in columns])
    ranges = [x for c in columns for x in (F.min(f"`{c}`").alias(f"least_{c}"), F.max(f"`{c}`").alias(f"greatest_{c}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}"))]
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *ranges)


@dataclass(frozen=True)
class FileIndex:
    """A folder with its index, stored beside it as a small table; files that came later are not in it."""

    path: str
    index_path: str

    @classmethod
    def write(cls, spark: SparkSession, path: str, columns: Sequence[str], index_path: str) -> FileIndex:
        build(spark, path, columns).write.mode("overwrite").parquet(index_path)
        return cls(path, index_path)

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.index_path)

    def files(self, spark: SparkSession, column: str, low: Any, high: Any) -> list[str]:
        """Files that may hold values from low to high, both included; None is an open end."""
        return [r[0] for r in self.entries(spark).where(_reaches(column, low, high)).select("file").orderBy("file").collect()]

    def read(self, spark: SparkSession, column: str, low: Any, high: Any) -> DataFrame:
        """Rows with values in the range, from the listed files alone."""
        found = self.files(spark, column, low, high)
        if not found:
            return spark.read.parquet(self.path).limit(0)
        return spark.read.option("basePath", self.path).parquet(*found).where(_between(F.col(f"`{column}`"), low, high))

    def count(self, spark: SparkSession, column: str, low: Any = None, high: Any = None) -> int:
        """Rows with values in the range; rows are read only from files that lie across an end of it."""
        inside = _between(F.col(f"least_{column}"), low, high) & _between(F.col(f"greatest_{column}"), low, high)
        found = self.entries(spark).where(_reaches(column, low, high)).withColumn("whole", inside)
        whole = found.where("whole").agg(F.sum(F.col("rows") - F.col(f"nulls_{column}"))).first()[0] or 0
        across = [r[0] for r in found.where("NOT whole").select("file").collect()]
        return whole + (spark.read.option("basePath", self.path).parquet(*across).where(_between(F.col(f"`{column}`"), low, high)).count() if across else 0)

    def total(self, spark: SparkSession) -> int:
        """All rows, without reading any."""
        return self.entries(spark).agg(F.sum("rows")).first()[0] or 0


def _between(c: Column, low: Any, high: Any) -> Column:
    out = c.isNotNull()
    if low is not None:
        out = out & (c >= F.lit(low))
    return out & (c <= F.lit(high)) if high is not None else out


def _reaches(column: str, low: Any, high: Any) -> Column:
    """Whether a file's range meets the one asked for."""
    out = F.col(f"least_{column}").isNotNull()
    if low is not None:
        out = out & (F.col(f"greatest_{column}") >= F.lit(low))
    return out & (F.col(f"least_{column}") <= F.lit(high)) if high is not None else out
