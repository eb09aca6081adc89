"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the last return the
columns of documents. Empty tables stay empty at every stage; other columns of documents go along with their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, mixing, near_dedup, quality, sharding
from strandline.llm.common import scratch, staged, table

#: A list of doc_ids up to so many rows (checked) is broadcast; beyond, the join shuffles.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids``."""
    ids = staged(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "removed")
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").select(*_columns(docs))


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and that no learned rule rejects.

    Each row is judged by its own text, repeated rows and rows of one doc_id too. Null and empty texts have no words and
    go. A null doc_id never meets a label, but is judged. Without labels only the base check speaks.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of near duplicates (5 words, similarity 0.8).

    Rows that share a doc_id stay or go together. Rows with a null doc_id and texts without words stay.
    """
    return _without(docs, near_dedup.near_duplicates(docs).where("not kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question, whatever its numbers, names or units.

    All rows of a doc_id go if one of them is contaminated; rows with a null doc_id stay. Null texts stay.
    """
    return _without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square root of their counts, in a global random order.

    Rows of one doc_id are repeated equally often; a null doc_id counts as the empty key, a null source is one of its own.
    """
    return mixing.mix(docs).select(*_columns(docs))


def rendezvous_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with a shard of 16 by doc_id, and a slot in it for each row.

    Slots are in a random order in which each replica has its own place, so the shuffle holds inside each shard. A null
    doc_id is the empty key. Columns named as the ones that sharding adds give way to them.
    """
    new = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    return sharding.assign_shards(docs, "doc_id", [1.0] * 16, grown_by=1.0, keep=[c for c in docs.columns if c not in new], spread=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("rendezvous_sharding", rendezvous_sharding),
]

#: Learned rules and near-duplicate groups aren't SQL; tests compare each stage with a plain version on whole documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input.

    What a stage stages inside is removed once its result is written; the last stage's is not, as its result is lazy.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-2]:
            docs = _written(spark, name, stage, docs, sf_dir)
        docs = _written(spark, *STAGES[-2], docs, sf_dir, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


def _written(spark: SparkSession, name: str, stage: Callable, docs: DataFrame, sf_dir: str, keep: bool = False) -> DataFrame:
    with scratch(spark):
        out = stage(spark, docs, sf_dir)
        return staged(out, name, outer=2 if keep else 1)
