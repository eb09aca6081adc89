"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.llm.sharding import unit_hash

#: A larger mean is split into equal parts of at most this mean, whose independent draws add up.
PART_MEAN = 16.0
#: Terms of the inverted distribution for a part: P(X > 96) < 1e-40 at mean 16.
TERMS = 96
#: Up to so many sources (checked) their rates are broadcast, a few MB; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000


def poisson_draw(rate: Column, key: Column, seed: str) -> Column:
    """Number of copies: the Poisson distribution with mean ``rate`` inverted at hash-seeded numbers of ``key``.

    ``rate`` must be a column of the frame (it is read in a lambda), never null. Rate 0 gives 0.
    """
    parts = F.greatest(F.ceil(rate / F.lit(PART_MEAN)), F.lit(1)).cast("int")

    def one(j: Column) -> Column:
        mean, u = rate / parts, unit_hash(F.lit(seed), j.cast("string"), key)
        first = F.exp(-mean)
        start = F.struct(first.alias("p"), first.alias("cdf"), F.when(u < first, 0).otherwise(1).alias("k"), u.alias("u"))

        def step(s: Column, i: Column) -> Column:
            p = s["p"] * mean / i
            cdf = s["cdf"] + p
            return F.struct(p.alias("p"), cdf.alias("cdf"), (s["k"] + F.when(s["u"] < cdf, 0).otherwise(1)).alias("k"), s["u"].alias("u"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda total, j: total + one(j))


def mix(df: DataFrame, targets: Mapping[str, float] | None = None, *, power: float = 0.5, total: float | None = None, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix") -> DataFrame:
    """Copies of the rows so that sources have the target shares in expectation, in a global random order.

    targets: weight by source; a source that isn't named gets none (its rows go). None: weights are the sources' row
    counts to the ``power``. total: expected rows (default: as many as now). Adds ``replica`` (from 0) and
    ``shuffle_key`` (of seed, replica, key and text), in place of columns of these names; the frame is range-partitioned by
    that key and sorted in it. A row's count depends on its key, its source's rate and the seed alone, so rerun tasks give
    the same rows. Rows with equal keys get equal counts. A null key or text counts as empty text; rows of a null source
    are a source of their own. An empty table gives no rows.
    """
    columns = [F.col("row")[c].alias(c) for c in df.columns if c not in ("replica", "shuffle_key")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(source).cast("string"), F.lit("\u0000null")).alias("own"))
    counts = rows.groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        if not targets or any(not w >= 0 for w in targets.values()) or not sum(targets.values()) > 0:
            raise ValueError("targets must be weights >= 0 with a positive sum")
        named = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets.items()], "own string, w double")
        weighed = counts.join(named, "own")
    sum_w, sources = weighed.agg(F.sum("w"), F.count(F.lit(1))).first()
    expected = float(total) if total is not None else float(rows.count())
    rates = weighed.select("own", F.round(F.col("w") / F.lit(sum_w or 1.0) * F.lit(expected) / F.col("n"), 9).alias("rate"))
    if sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    name = F.coalesce(F.col("row")[key].cast("string"), F.lit(""))
    body = F.coalesce(F.col("row")[text].cast("string"), F.lit("")) if text in df.columns else F.lit("")
    copies = (
        rows.join(rates, "own")
        .withColumn("copies", poisson_draw(F.col("rate"), name, seed))
        .where(F.col("copies") > 0)
        .select("row", F.md5(body.cast("binary")).alias("digest"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("replica"))
        .select(*columns, "replica", F.md5(F.concat_ws("|", F.lit(seed), F.col("replica").cast("string"), name, "digest").cast("binary")).alias("shuffle_key"))
    )
    return copies.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key", "replica")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that sources weigh as the square root of their row counts."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "replica", "shuffle_key", "text")


def mix_sql(source: str, columns: str, seed: str = "mix") -> str:
    """DuckDB SQL of :func:`mix` with its defaults over ``source``; rates here are assumed to be at most PART_MEAN."""
    return f"""
WITH RECURSIVE named AS (SELECT *, coalesce(source, chr(0) || 'null') AS own, coalesce(doc_id::VARCHAR, '') AS mix_name FROM {source}),
counts AS (SELECT own, count(*) AS n FROM named GROUP BY own),
rates AS (SELECT own, round(pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n, 9) AS rate FROM counts),
terms AS (
  SELECT own, rate, 0 AS i, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
  UNION ALL SELECT own, rate, i + 1, p * rate / (i + 1), cdf + p * rate / (i + 1) FROM terms WHERE i < {TERMS}
),
tables AS (SELECT own, list(cdf ORDER BY i) AS cdfs FROM terms GROUP BY own),
drawn AS (
  SELECT n.*, len(list_filter(cdfs, lambda c: c <= (('0x' || substr(md5('{seed}|0|' || mix_name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS k
  FROM named n JOIN tables USING (own)
)
SELECT {columns} FROM (SELECT *, unnest(range(k)) AS rep FROM drawn WHERE k > 0)"""


ORACLE_SQL = mix_sql("documents", "doc_id, source, rep::INTEGER AS replica, md5('mix|' || rep || '|' || mix_name || '|' || md5(coalesce(text, ''))) AS shuffle_key, text")
