"""Reading and writing: ticks and chains as Parquet by date, vectors and histories as JSON, file streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no_nan(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.ArrayType) and _leaves(kind) & {T.DoubleType, T.FloatType}:
        return F.transform(c, lambda x: _no_nan(x, kind.elementType))
    if isinstance(kind, T.StructType) and _leaves(kind) & {T.DoubleType, T.FloatType}:
        return F.when(c.isNotNull(), F.struct(*[_no_nan(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def _null_nan(df: DataFrame) -> DataFrame:
    """NaN as null, in lists and structs too."""
    return df.select(*[_no_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_table(df: DataFrame, path: str, *, time: str = "time", sort_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet partitioned by date, sorted inside, so that time and symbol filters skip files and row groups."""
    dated = df.withColumn("date", F.to_date(time))
    rows = dated.repartition("date").sortWithinPartitions("date", *sort_by, time)
    rows.write.mode(mode).partitionBy("date").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with NaN as null."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return _null_nan(reader.parquet(path))


def _leaves(kind: T.DataType) -> set[type]:
    if isinstance(kind, T.ArrayType):
        return _leaves(kind.elementType)
    if isinstance(kind, T.StructType):
        return {x for f in kind for x in _leaves(f.dataType)}
    return {type(kind)}


def _as_text(kind: T.DataType) -> T.DataType:
    """The type with text in place of fractional numbers."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType), f.nullable) for f in kind])
    return T.StringType() if isinstance(kind, (T.DoubleType, T.FloatType)) else kind


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; NaN becomes null, infinities the texts "inf" and "-inf".

    Columns that hold fractional numbers alone, in lists or structs too, are written so; a struct that mixes them with
    text must have no infinities (they would be "Infinity" there).
    """
    clean = _null_nan(df)
    numbers = [f.name for f in clean.schema if _leaves(f.dataType) <= {T.DoubleType, T.FloatType}]
    rest = [c for c in clean.columns if c not in numbers]
    inner = lambda names: F.expr("substring(__json, 2, length(__json) - 2)") if names else F.lit(None).cast("string")
    text = clean
    for target, names in (("__numbers", numbers), ("__rest", rest)):
        made = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}) if names else F.lit(None).cast("string")
        text = text.withColumn("__json", made).withColumn(target, inner(names))
    # the only texts of the first part are field names and infinities
    infinite = F.regexp_replace("__numbers", r'"(-?)Infinity"(?!\s*:)', '"$1inf"')
    text.select(F.concat(F.lit("{"), F.concat_ws(",", F.col("__rest"), infinite), F.lit("}")).alias("value")).write.mode(mode).text(path)


def read_vectors(spark: SparkSession, path: str, schema: T.StructType | str, *, multi_line: bool = False) -> DataFrame:
    """JSON lines (or one document a file) of this schema; "inf" and "-inf" are infinities, NaN reads as null."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(_as_text(kind)).option("multiLine", multi_line).option("allowNonNumericNumbers", True).json(path)
    return _null_nan(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind]))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all tasks run in this process."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_table(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder as a stream of its files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
