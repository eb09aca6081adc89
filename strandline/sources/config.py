"""Database settings from a file or the environment, and reading tables and queries over JDBC."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings that must be there.
REQUIRED = ("DB_HOST", "DB_PORT", "DB_NAME", "DB_USER", "DB_PASSWORD")


def parse_env(text: str) -> dict[str, str]:
    """NAME=value lines; blank lines and lines from ``#`` on don't count; only the first ``=`` splits."""
    pairs = (line.split("=", 1) for raw in text.splitlines() if (line := raw.strip()) and not line.startswith("#") and "=" in line)
    return {name.strip(): value.strip().strip("\"'") for name, value in pairs}


@dataclass(frozen=True)
class DatabaseConfig:
    host: str
    port: int
    name: str
    user: str
    password: str

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> DatabaseConfig:
        if missing := [k for k in REQUIRED if not values.get(k)]:
            raise ValueError(f"settings lack {', '.join(missing)}")
        return cls(values["DB_HOST"], int(values["DB_PORT"]), values["DB_NAME"], values["DB_USER"], values["DB_PASSWORD"])

    @classmethod
    def from_env_file(cls, path: str) -> DatabaseConfig:
        if not Path(path).exists():
            raise FileNotFoundError(path)
        return cls.from_mapping(parse_env(Path(path).read_text()))

    @classmethod
    def from_environment(cls) -> DatabaseConfig:
        return cls.from_mapping(os.environ)

    def jdbc_options(self) -> dict[str, str]:
        return {"url": f"jdbc:postgresql://{self.host}:{self.port}/{self.name}", "user": self.user, "password": self.password, "driver": "org.postgresql.Driver"}


def read_jdbc(spark: SparkSession, cfg: DatabaseConfig, table_or_query: str, *, partition_column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 1) -> DataFrame:
    """A table or a query in parentheses; split by ranges of a column where given (the driver must be on the class path)."""
    reader = spark.read.format("jdbc").options(**cfg.jdbc_options(), dbtable=table_or_query)
    if partition_column:
        if bounds is None or partitions < 1:
            raise ValueError("a partition column needs bounds and a number of partitions")
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def write_jdbc(df: DataFrame, cfg: DatabaseConfig, name: str, mode: str = "append") -> int:
    """Writes the rows and returns how many were sent, counted as they pass."""
    observed = Observation()
    df.observe(observed, F.count(F.lit(1)).alias("rows")).write.format("jdbc").options(**cfg.jdbc_options(), dbtable=name).mode(mode).save()
    return observed.get["rows"]


def query(spark: SparkSession, sql: str, args: Mapping[str, Any] | list[Any] | None = None) -> DataFrame:
    """SQL with named (``:name``) or positional (``?``) parameters."""
    return spark.sql(sql, args=dict(args) if isinstance(args, Mapping) else args or None)


def query_rows(spark: SparkSession, sql: str, args: Mapping[str, Any] | list[Any] | None = None) -> list[dict[str, Any]]:
    """All rows as dicts, for small results."""
    return [r.asDict(recursive=True) for r in query(spark, sql, args).collect()]


def query_one(spark: SparkSession, sql: str, args: Mapping[str, Any] | list[Any] | None = None) -> dict[str, Any] | None:
    row = query(spark, sql, args).limit(1).first()
    return row.asDict(recursive=True) if row else None
