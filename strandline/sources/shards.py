"""A table in embedded databases: one DuckDB file a shard in a shared folder, each opened by one task at a time.

An embedded database belongs to one process, so a table that many executors write, change and read is dealt over many.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of a shard, and of a batch that a task reads of it; memory of a task's database.
SHARD_ROWS, BATCH_ROWS, MEMORY = 1_000_000, 10_000, "256MB"


def _open(path: str, *, read_only: bool = False) -> duckdb.DuckDBPyConnection:
    spill = f"{path}-{uuid.uuid4().hex}.tmp"
    return duckdb.connect(path, read_only=read_only, config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill})


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class ShardedTable:
    """The table ``rows`` of the files ``shards``; files never change, a statement makes new ones.

    A task that runs again, or twice at once, writes a file of its own, and only the files of tasks that ended well count.
    The folder must be mounted under one path by the driver and all executors.
    """

    folder: str
    shards: tuple[str, ...]
    schema: T.StructType

    @classmethod
    def write(cls, df: DataFrame, folder: str, key: str, shards: int | None = None) -> tuple[ShardedTable, int]:
        """The rows in shards by ranges of ``key`` (one for each SHARD_ROWS unless given), and how many rows passed."""
        if shards is not None and shards < 1:
            raise ValueError("shards must be 1 or more")
        folder = folder.removeprefix("file:")
        shards = shards or max(1, -(-df.count() // SHARD_ROWS))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path, count, con = f"{folder}/{uuid.uuid4().hex}.duckdb", 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                news = pa.table(batch)
                if con is None:
                    os.makedirs(folder, exist_ok=True)
                    con = _open(path)
                    con.register("news", news)
                    con.execute("CREATE TABLE rows AS SELECT * FROM news LIMIT 0")
                else:
                    con.register("news", news)
                con.execute("INSERT INTO rows SELECT * FROM news")
                con.unregister("news")
                count += batch.num_rows
            if con is not None:
                con.close()
                yield pa.RecordBatch.from_pydict({"path": [path], "n": [count]})

        done = df.repartitionByRange(shards, f"`{key}`").mapInArrow(put, "path string, n long").collect()
        return cls(folder, tuple(sorted(r["path"] for r in done)), df.schema), sum(r["n"] for r in done)

    def _each(self, spark: SparkSession) -> DataFrame:
        """A row and a task for each shard."""
        return spark.createDataFrame(spark.sparkContext.parallelize([(s,) for s in self.shards], max(1, len(self.shards))), "path string")

    def execute(self, spark: SparkSession, sql: str, args: Sequence[Any] = ()) -> tuple[ShardedTable, int]:
        """A statement on ``rows`` with ``?`` parameters, run on a copy of each shard by a task of its own.

        Returns the changed table and the number of rows changed; this table stays as it was.
        """
        folder, args = self.folder, list(args)

        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    new = f"{folder}/{uuid.uuid4().hex}.duckdb"
                    shutil.copyfile(path, new)
                    con = _open(new)
                    count = con.execute(sql, args).fetchall()[0][0]
                    con.close()
                    yield pa.RecordBatch.from_pydict({"path": [new], "n": [count]})

        done = self._each(spark).mapInArrow(change, "path string, n long").collect()
        return ShardedTable(self.folder, tuple(sorted(r["path"] for r in done)), self.schema), sum(r["n"] for r in done)

    def read(self, spark: SparkSession, columns: Sequence[str] | None = None, where: str = "true", args: Sequence[Any] = ()) -> DataFrame:
        """Columns of the rows that meet ``where`` (with ``?`` parameters), which the databases work out; a task a shard."""
        names, args = list(columns or self.schema.names), list(args)
        query = f"SELECT {', '.join(map(_quoted, names))} FROM rows WHERE {where}"

        def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    con = _open(path, read_only=True)
                    yield from con.execute(query, args).to_arrow_reader(BATCH_ROWS)
                    con.close()

        return self._each(spark).mapInArrow(get, T.StructType([self.schema[n] for n in names]))
