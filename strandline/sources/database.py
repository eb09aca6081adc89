"""Tables in a database over JDBC: filters pushed down, parallel reads by ranges, counted writes, DML with a row count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Database:
    """A JDBC url and its driver; options go to every read and write.

    text_type: type of text columns in tables that a write makes, where the database's own choice can't be compared.
    """

    url: str
    driver: str
    text_type: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def derby(cls, path: str, create: bool = True) -> Database:
        """An embedded database in a folder; its driver comes with Spark. One process may have it open: tasks of a local master."""
        return cls(f"jdbc:derby:{path}{';create=true' if create else ''}", "org.apache.derby.iapi.jdbc.AutoloadedDriver", "VARCHAR(32672)")

    def _base(self) -> dict[str, str]:
        return {"url": self.url, "driver": self.driver, **self.options}

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """A table or a query in parentheses, in one partition; Spark sends filters and columns to the database."""
        return spark.read.format("jdbc").options(**self._base(), dbtable=table).load()

    def read_ranges(self, spark: SparkSession, table: str, column: str, partitions: int) -> DataFrame:
        """The table in ranges of a number or time column, each read by a task of its own.

        The bounds are asked of the database. Rows outside of ranges that have no bounds don't exist: the first range
        takes nulls, the first and the last are open.
        """
        if partitions < 1:
            raise ValueError("partitions must be 1 or more")
        low, high = self.read(spark, table).agg(F.min(f"`{column}`"), F.max(f"`{column}`")).first()
        if low is None or low == high:
            return self.read(spark, table)
        ranges = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
        return spark.read.format("jdbc").options(**self._base(), dbtable=table, **ranges).load()

    def write(self, df: DataFrame, table: str, *, mode: str = "append", partitions: int | None = None) -> int:
        """Writes the rows, at most ``partitions`` connections at a time, and returns how many passed."""
        seen = Observation()
        rows = df.coalesce(partitions) if partitions else df
        texts = ", ".join(f"`{f.name}` {self.text_type}" for f in df.schema if isinstance(f.dataType, T.StringType)) if self.text_type else ""
        kinds = {"createTableColumnTypes": texts} if texts else {}
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("jdbc").options(**self._base(), dbtable=table, **kinds).mode(mode).save()
        return seen.get["rows"]

    def execute(self, spark: SparkSession, sql: str, args: Sequence[Any] = ()) -> int:
        """A statement with ``?`` parameters, run by the driver; returns the number of rows it changed."""
        jvm = spark._jvm
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.driver)
        properties = jvm.java.util.Properties()
        for name, value in self.options.items():
            properties.setProperty(name, value)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            statement = connection.prepareStatement(sql)
            for i, value in enumerate(args, 1):
                statement.setObject(i, value)
            return statement.executeUpdate()
        finally:
            connection.close()


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that the plan's JDBC scans send to the database."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PushedFilters: [", 1)[1].split("], ReadSchema")[0] for line in plan.split("\n") if "PushedFilters: [" in line]
