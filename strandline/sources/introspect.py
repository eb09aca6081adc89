"""Schemas, counts and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_schema(df: DataFrame) -> DataFrame:
    """column_name, data_type, is_nullable and ordinal_position, from metadata alone."""
    rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO", i) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, is_nullable string, ordinal_position int")


def row_count(df: DataFrame) -> int:
    """Exact; Parquet answers it from its footers."""
    return df.count()


def profile(df: DataFrame, time: str, symbol: str, most_symbols: int = 100) -> DataFrame:
    """One row: rows, first_time, last_time, symbols (the first ``most_symbols`` in order) and a sample row as JSON."""
    totals = df.agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.first(F.to_json(F.struct("*")), ignorenulls=True).alias("sample"))
    names = df.select(symbol).distinct().orderBy(symbol).limit(most_symbols).agg(F.array_sort(F.collect_list(symbol)).alias("symbols"))
    return totals.withColumn("__one", F.lit(1)).join(names.withColumn("__one", F.lit(1)), "__one").drop("__one")


def format_profile(name: str, df: DataFrame, time: str, symbol: str) -> str:
    """Readable text of a table's profile."""
    p = profile(df, time, symbol).first()
    lines = [f"{name}: {p['rows']} rows, {p['first_time']} to {p['last_time']}", f"symbols ({len(p['symbols'])}): {', '.join(map(str, p['symbols'][:10]))}", f"sample: {p['sample']}"]
    return "\n".join(lines + [f"  {r['column_name']}: {r['data_type']}" for r in table_schema(df).collect()])
