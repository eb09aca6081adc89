"""Line deduplication with a once-seen and a twice-seen Bloom filter.

One scan fills, in each task, a filter of line hashes seen and a filter of those seen again. Two tasks' filters merge bit
by bit: once = once | once', twice = twice | twice' | (once & once'), so every line in two documents is in the merged
twice-seen filter. A second scan sends on only lines that the twice-seen filter knows; an exact count by 128-bit hash
settles them. The filters have a fixed largest size; a fuller filter lets more lines through to the exact count and
changes no result. A full one lets all through: 32 bytes a line, so what is moved stays in proportion to the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import power_of_two, table

WHITE = b" \t\n\x0b\x0c\r"
#: Largest filter: 2**28 bits, 32 MB to broadcast.
MOST_BITS = 2**28
#: Bits of a filter that merge together, as one row.
SLICE_BITS = 2**15


def line_key(line: bytes, least: int) -> bytes | None:
    """The line's key: stripped, A-Z lower-cased; None if it has fewer than ``least`` code points."""
    key = line.strip(WHITE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _digests(body: bytes, least: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for x in body.split(b"\n") if (k := line_key(x, least)) is not None}


def _positions(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each digest, given as rows of two 64-bit numbers."""
    return digests[:, 0] & np.uint64(bits - 1), digests[:, 1] & np.uint64(bits - 1)


def _has(flags: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    one, two = ((flags[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in places)
    return (one & two).astype(bool)


def _put(flags: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(flags, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _as_rows(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def twice_seen(docs: DataFrame, least: int) -> tuple[bytes, int]:
    """The merged twice-seen filter of the column ``body`` and its number of bits."""
    lines = docs.agg(F.sum(F.size(F.split(F.col("body").cast("string"), "\n")))).first()[0] or 0
    bits = power_of_two(8 * lines, 2**17, MOST_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            found = [d for body in batch.column(0).to_pylist() for d in _digests(body, least)]
            if found:
                rows, counts = np.unique(_as_rows(found), axis=0, return_counts=True)
                places = _positions(rows, bits)
                again = (counts > 1) | _has(once, places)
                _put(twice, tuple(p[again] for p in places))
                _put(once, places)
        step = SLICE_BITS // 8
        full = [i for i in range(bits // SLICE_BITS) if once[i * step : (i + 1) * step].any()]
        for at in range(0, len(full), 256):
            part = full[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array([f[i * step : (i + 1) * step].tobytes() for i in part], pa.binary()) for f in (once, twice))], names=["slice", "once", "twice"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SLICE_BITS // 8, np.uint8), np.zeros(SLICE_BITS // 8, np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pd.DataFrame({"slice": [key[0]], "twice": [twice.tobytes()]}) if twice.any() else pd.DataFrame({"slice": [], "twice": []})

    # A filter a task: fewer, longer tasks where the filter is at its largest, so that filters stay small beside the lines.
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(8 * lines / bits))
    merged = docs.select("body").coalesce(tasks).mapInArrow(fill, "slice int, once binary, twice binary").groupBy("slice").applyInPandas(merge, "slice int, twice binary")
    flags = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["slice"] * SLICE_BITS // 8
        flags[at : at + SLICE_BITS // 8] = np.frombuffer(bytes(row["twice"]), np.uint8)
    return flags.tobytes(), bits


def drop_repeated_lines(df: DataFrame, *, least_chars: int = 20, least_docs: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep a line that ``least_docs`` documents share in the largest key alone; returns key, n_lines, n_dropped, text.

    A line's key is the line stripped of white space with A-Z lower-cased; keys of fewer than ``least_chars`` code points
    stay everywhere. All lines with the key stay in the largest document that has it. Null or empty text is one empty
    line. Rows that share a document key count as one document and keep or lose a line together; a null document key is
    less than any other and is one document. Very long texts are handled line by line in their row. An empty table gives
    no rows; other columns are not read.
    """
    if least_docs < 2 or least_chars < 1:
        raise ValueError("least_docs must be 2 or more, least_chars 1 or more")
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).withColumn("mark", F.xxhash64("body"))
    flags, bits = twice_seen(docs, least_chars)
    seen = spark.sparkContext.broadcast(flags)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(seen.value, np.uint8)
        for batch in batches:
            rows, found = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                mine = _digests(body, least_chars)
                rows += [i] * len(mine)
                found += mine
            if found:
                hit = np.flatnonzero(_has(known, _positions(_as_rows(found), bits)))
                at = pa.array([rows[j] for j in hit], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([found[j] for j in hit], pa.binary())], names=["k", "mark", "line"])

    key_type = docs.schema["k"].dataType.simpleString()
    # lines go back to a document by key and text, so the lines of a key with very many rows don't meet in one place
    repeats = docs.mapInArrow(suspects, f"k {key_type}, mark long, line binary").distinct()
    holders = repeats.select("line", "k").distinct()
    owners = holders.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("owner")).where(F.col("n") >= least_docs).drop("n")
    losses = (
        repeats.join(owners, "line")
        .where(F.col("k").isNull() | (F.col("k") < F.col("owner")))
        .groupBy(F.col("k").alias("loser"), F.col("mark").alias("loser_mark"))
        .agg(F.collect_list("line").alias("lost"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for body, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = body.split(b"\n")
                n_lines.append(len(lines))
                if lost:
                    gone = set(lost)
                    lines = [x for x in lines if (k := line_key(x, least_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], names=[key, "n_lines", "n_dropped", "body"])

    out = docs.join(losses, F.col("k").eqNullSafe(F.col("loser")) & (F.col("mark") == F.col("loser_mark")), "left").select("k", "body", "lost").mapInArrow(cut, f"`{key}` {key_type}, n_lines long, n_dropped long, body binary")
    return out.select(key, "n_lines", "n_dropped", F.col("body").cast("string").alias(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_az AS key FROM (
    SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))
), owners AS (
  SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.*, o.owner IS NOT NULL AND l.doc_id < o.owner AS gone FROM lines l LEFT JOIN owners o USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
