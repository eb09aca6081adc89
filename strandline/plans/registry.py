"""All registered queries of the market library and the SQL that they can be checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import catalog, market, online, sequential, storage, training

PARTS = (catalog, market, online, sequential, storage, training)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in PARTS for name, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
