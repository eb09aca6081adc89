"""Writing a stream batch by batch, so that a batch that runs again replaces what it left."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

_NAME = re.compile(r"[A-Za-z0-9_-]+")


def write_batches(stream: DataFrame, path: str, name: str, *, change: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer whose batches go to ``path``/query=name/batch=id, each as one Parquet folder that it overwrites.

    Spark runs a batch again with the same number after a failure or a restart from the checkpoint; it then replaces its
    own folder, and no other's. ``name`` must stay the same over restarts and differ between queries on one path. change:
    applied to each batch before it is written, for example a model's scores.
    """
    if not _NAME.fullmatch(name):
        raise ValueError("a name is letters, digits, _ and -")

    def put(batch: DataFrame, number: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/query={name}/batch={number}")

    return stream.writeStream.foreachBatch(put)


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All rows written so far, with ``query`` and ``batch``."""
    columns = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*columns.fields, T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])).parquet(path)


def newest(records: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
