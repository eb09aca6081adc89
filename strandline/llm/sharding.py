"""Rendezvous sharding: each record goes to the shard that draws the best weighted hash score for its key.

Only DataFrame functions are used. Adding a shard moves records into the new shard alone, because the scores of the
other shards for a key don't depend on how many shards there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import staged, table

#: Records of one shard that are numbered together in one task.
ROWS_PER_RANGE = 20_000


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 over the parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0, first: int = 0) -> Column:
    """Struct (score, shard) of the winning shard; the lowest ``-ln(u) / weight`` wins, ties go to the lower shard."""
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("weights must be positive and finite, at least one")
    scores = [
        F.struct((-F.log(unit_hash(F.lit(str(seed)), F.lit(str(j)), key)) / F.lit(float(w))).alias("score"), F.lit(j).alias("shard"))
        for j, w in enumerate(weights, first)
    ]
    return F.array_min(F.array(*scores))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], *, text: str = "text", seed: int = 0, grown_by: float | None = None, keep: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """Shard, gapless slot and digest columns for each record; returns key, size, text_crc32, law, shard, slot, grown_shard.

    A null key counts as the empty string; a null text as empty (size 1, checksum 0). Equal keys share a shard. Slots
    follow a digest of key, checksum and size, so rows equal in these get consecutive slots; with ``spread`` such rows are
    numbered and their numbers enter the digest, so copies of a row lie anywhere in the shard. keep: columns of ``df``
    returned as well; names of the columns above aren't allowed there. Other columns, whatever their names, are not read.
    An empty table gives no rows. A shard is numbered in ranges of the digest: counts by range give each range's first
    slot, and no task numbers a whole shard.
    """
    clash = {key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"} & set(keep)
    if clash:
        raise ValueError(f"columns that can't be kept: {sorted(clash)}")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    ranges = max(1, math.ceil(df.count() / (len(weights) * ROWS_PER_RANGE)))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    rows = df.select(F.col(key).alias("k"), name.alias("name"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("crc"), kept.alias("kept"))
    what = ["name", F.col("crc").cast("string"), F.col("size").cast("string")]
    if spread:
        copies = Window.partitionBy("name", "crc", "size").orderBy("k")
        rows = rows.withColumn("copy", F.row_number().over(copies))
        what.append(F.col("copy").cast("string"))
    rows = (
        rows.withColumn("digest", F.md5(F.concat_ws("|", *what).cast("binary")))
        .withColumn("best", rendezvous(F.col("name"), weights, seed))
        .withColumn("part", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") * F.lit(ranges) / F.lit(2**32)).cast("int"))
    )
    grown = F.lit(None).cast("int")
    if grown_by is not None:
        new = F.col("newcomer")
        rows = rows.withColumn("newcomer", rendezvous(F.col("name"), [grown_by], seed, first=len(weights)))
        grown = F.when(new["score"] < F.col("best")["score"], new["shard"]).otherwise(F.col("best")["shard"])
    # written once: the scores would be worked out again for the counts
    rows = staged(rows.select("k", "size", "crc", "kept", "digest", "part", F.col("best")["shard"].alias("shard"), grown.alias("grown_shard")), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("digest", "k", "crc", "size")
    return rows.join(starts, ["shard", "part"]).select(
        F.col("k").alias(key), *[F.col("kept")[c].alias(c) for c in keep], "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("start") + F.row_number().over(within) - 1).cast("bigint").alias("slot"), "grown_shard",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 equal shards by doc_id, with the shard that each would have among 17."""
    return assign_shards(table(spark, sf_dir, "documents"), "doc_id", [1.0] * 16, grown_by=1.0)


def shard_sql(source: str, shards: int = 16) -> str:
    """DuckDB SQL of :func:`query` over the relation ``source``."""
    return f"""
WITH crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::BIGINT,0,0,0,0,0,0,0,0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))
), base AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS name, coalesce(text, '') AS body FROM {source}
), scored AS (
  SELECT name, j, -ln((('0x' || substr(md5('0|' || j || '|' || name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM (SELECT DISTINCT name FROM base), range({shards} + 1) s(j)
), picked AS (
  SELECT name, arg_min(j, score) FILTER (WHERE j < {shards}) AS shard, arg_min(j, score) AS grown_shard FROM scored GROUP BY name
), measured AS (
  SELECT doc_id, b.name AS name, p.shard, p.grown_shard, strlen(body)::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM base b JOIN picked p USING (name), crc_table
)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(name || '|' || text_crc32 || '|' || size), doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM measured"""
