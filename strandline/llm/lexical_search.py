"""Ranked lexical search: an inverted index in shards, searched document at a time.

Index: each task turns the documents it reads into shards of a bounded size, without a shuffle. In a shard documents are
numbered in the order of their keys; a term's postings are the gaps between these numbers and its occurrences, as
variable-length bytes. N, L and df are sums over all shards.

Search: a task reads shards; for each item it merges its terms' postings with a heap of cursors, in the order of documents,
into a heap of the k best (higher score, then smaller key). A document can be passed over only where the terms that it may
hold cannot lift it into that heap: terms whose greatest contributions together stay below the least score wanted drop out
of the merge and are only looked up. The shards' lists, k rows an item and shard at most, meet in one global ranking.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import staged, table

#: Lower-cases A-Z, keeps digits, letters and all bytes of characters beyond ASCII, and turns the others into spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 2**14, 2**21
#: Distinct terms of the items that are searched together; more items are searched in blocks of about so many.
BLOCK_TERMS = 2**20


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on as bytes of 7 bits, low ones first, the last one below 128; and where each number ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        more = size > k
        low = (v[more] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - size)[more] + k] = low | np.where(size[more] > k + 1, 128, 0).astype(np.uint64)
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128) + 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    place = np.arange(len(b)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


class _Shard:
    """Documents and postings in the order in which they are read."""

    def __init__(self) -> None:
        self.keys: list[pa.Scalar] = []
        self.sizes: list[int] = []
        self.number: dict[bytes, int] = {}
        self.docs: list[int] = []
        self.terms: list[int] = []
        self.times: list[int] = []

    def add(self, key: pa.Scalar, size: int, counts: dict[bytes, int]) -> None:
        number = self.number
        self.docs += [len(self.keys)] * len(counts)
        self.terms += [number.setdefault(t, len(number)) for t in counts]
        self.times += counts.values()
        self.keys.append(key)
        self.sizes.append(size)

    def columns(self, keys: pa.DataType) -> tuple:
        """Keys in order, sizes, terms, documents a term, postings; one list each."""
        key = pa.array([k.as_py() for k in self.keys], keys)
        order = pc.sort_indices(key, null_placement="at_end").to_numpy().astype(np.int64)
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        docs, terms, times = new[np.array(self.docs, np.int64)], np.array(self.terms, np.int64), np.array(self.times, np.int64)
        by = np.lexsort((docs, terms))
        docs, terms, times = docs[by], terms[by], times[by]
        df = np.bincount(terms, minlength=len(self.number))
        first = np.cumsum(df) - df
        gaps = np.diff(docs, prepend=0)
        gaps[first] = docs[first]
        data, ends = pack(np.stack((gaps, times), axis=1).ravel())
        stops = np.concatenate(([0], ends[2 * np.cumsum(df) - 1])) if len(df) else np.zeros(1, np.int64)
        postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(stops.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return one(key.take(pa.array(order))), one(pa.array(np.array(self.sizes, np.int64)[order])), one(pa.array(list(self.number), pa.binary())), one(pa.array(df)), one(postings.cast(pa.binary()))


def build_index(df: DataFrame, *, key: str = "doc_id", text: str = "text", terms: Sequence[bytes] | None = None) -> DataFrame:
    """shard, keys (sorted), sizes (terms a document), terms, df and postings: a row for each shard.

    terms: those that get postings (they are broadcast); without it all do. Documents without terms, null texts too, are
    in no shard. Repeated rows are documents of their own; a null key comes after all others. An empty table has no
    shards; other columns aren't read. A document is in one shard whole, however long.
    """
    docs = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))
    shared = df.sparkSession.sparkContext.broadcast(None if terms is None else frozenset(terms))
    names = ["shard", "keys", "sizes", "terms", "df", "postings"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, shard, serial = shared.value, _Shard(), TaskContext.get().partitionId() << 32

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([serial]), *shard.columns(kind)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for k, body in zip(batch.column(0), batch.column(1), strict=True):
                words = terms_of(body.as_py())
                if not words:
                    continue
                counts = Counter(words)
                shard.add(k, len(words), counts if asked is None else {t: counts[t] for t in asked & counts.keys()})
                if len(shard.keys) >= SHARD_DOCS or len(shard.docs) >= SHARD_POSTINGS:
                    yield flushed()
                    shard, serial = _Shard(), serial + 1
        if shard.keys:
            yield flushed()

    return docs.mapInArrow(work, f"shard long, keys array<{docs.schema['k'].dataType.simpleString()}>, sizes array<long>, terms array<binary>, df array<long>, postings array<binary>")


class Postings:
    """A term's documents in a shard and what it adds to their scores."""

    def __init__(self, data: bytes, weight: int, m: np.ndarray, k: int) -> None:
        both = unpack(data).reshape(-1, 2)
        docs, tf = np.cumsum(both[:, 0]), both[:, 1]
        adds = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
        self.docs, self.adds = docs.tolist(), adds.tolist()
        self.most = int(adds.max())
        self.kth = int(np.partition(adds, len(adds) - k)[len(adds) - k]) if len(adds) >= k else 0


def best(lists: list[tuple[Postings, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of a shard: highest score first, then the least document; scores above 0 only.

    lists: postings of an item's terms and how often the item holds each.
    """
    lists = sorted((x for x in lists if x[0].most), key=lambda x: x[0].most * x[1])
    bound = [0]  # what the first i terms can add at most
    for p, times in lists:
        bound.append(bound[-1] + p.most * times)
    need = max([1, *(p.kth * times for p, times in lists)])  # k documents reach this for sure
    first = 0  # terms from here on are merged; the ones before cannot reach what is needed by themselves
    while first < len(lists) and bound[first + 1] < need:
        first += 1
    docs, adds = [p.docs for p, _ in lists], [p.adds for p, _ in lists]
    times, at = [t for _, t in lists], [0] * len(lists)
    cursors = [(docs[j][0], j) for j in range(first, len(lists))]
    heapq.heapify(cursors)
    found: list[tuple[int, int]] = []  # a heap of score and the negative document: the worst one first
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            j = cursors[0][1]
            i = at[j]
            score += adds[j][i] * times[j]
            at[j] = i = i + 1
            if j >= first and i < len(docs[j]):
                heapq.heapreplace(cursors, (docs[j][i], j))
            else:
                heapq.heappop(cursors)
        for j in range(first - 1, -1, -1):
            if score + bound[j + 1] < need:
                break
            at[j] = i = bisect_left(docs[j], doc, at[j])
            if i < len(docs[j]) and docs[j][i] == doc:
                score += adds[j][i] * times[j]
        if score < need:
            continue
        if len(found) < k:
            heapq.heappush(found, (score, -doc))
        else:
            heapq.heapreplace(found, (score, -doc))
        if len(found) == k and found[0][0] >= need:
            need = found[0][0] + 1  # later documents lose ties
            while first < len(lists) and bound[first + 1] < need:
                first += 1
    return [(score, -doc) for score, doc in sorted(found, key=lambda x: (-x[0], -x[1]))]


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """item (a number for each row), k, terms and times: the distinct terms of each item."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(x.as_py())) for x in batch.column(2)]
            columns = pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["item", "k", "terms", "times"])

    return rows.mapInArrow(work, f"item long, k {rows.schema['k'].dataType.simpleString()}, terms array<binary>, times array<long>")


def search(index: DataFrame, items: DataFrame, *, k: int = 20, key: str = "item_id", text: str = "text", doc_key: str = "doc_id") -> DataFrame:
    """key, rank (from 1), doc_key and score of each item's k best documents with a score above 0 in a built index.

    index: staged rows of :func:`build_index`; it is read once for each block of items and once for the counts. Each row
    of ``items`` is searched by itself, with its repeats; null and empty items, and items with unknown terms only, have
    no results. Equal scores rank by the smaller document key, a null one last; documents with the same key are in no
    certain order. A null item key is returned as it is. Other columns aren't read. No items or documents: no rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = index.sparkSession
    asked = staged(_item_terms(items, key, text), "items")
    n_docs, length = index.select(F.size("keys").cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n_docs, length = n_docs or 0, length or 0
    df = staged(index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.df").alias("df")), "df")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    doc_type = index.schema["keys"].dataType.elementType
    out: DataFrame | None = None
    for block in range(blocks):
        mine = asked.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("item"), F.lit(blocks)) == block))
        # bounded: about BLOCK_TERMS terms
        queries = [(x["item"], dict(zip(map(bytes, x["terms"]), x["times"], strict=True))) for x in mine.select("item", "terms", "times").toLocalIterator()]
        held = mine.select(F.explode("terms").alias("term")).distinct().join(df, "term").toArrow()
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in zip(held["term"].to_pylist(), held["df"].to_pylist(), strict=True)}
        part = _searched(index, queries, weights, n_docs, length, k, doc_type.simpleString())
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "k"), "item").select(F.col("k").alias(key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_key), "score")


def _searched(index: DataFrame, queries: list, weights: dict[bytes, int], n_docs: int, length: int, k: int, doc_type: str) -> DataFrame:
    """item, doc and score: the k best of each shard for each of the queries."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                keys, sizes, terms, postings = (batch.column(i)[row].values for i in range(4))
                m = 75 + (25 * sizes.to_numpy() * n_docs) // length
                held = {t: Postings(p.as_py(), weights[t], m, k) for t, p in zip(terms.to_pylist(), postings, strict=True) if t in weights}
                items, docs, scores = [], [], []
                for item, times in queries:
                    for score, doc in best([(held[t], n) for t, n in times.items() if t in held], k):
                        items.append(item)
                        docs.append(doc)
                        scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), keys.take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], names=["item", "doc", "score"])

    return index.select("keys", "sizes", "terms", "postings").mapInArrow(work, f"item long, doc {doc_type}, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item; only the items' terms get postings, unless they are very many."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    words = _item_terms(items, "item_id", "text").select(F.explode("terms").alias("t")).distinct().limit(BLOCK_TERMS + 1).toArrow()["t"].to_pylist()
    return search(staged(build_index(docs, terms=words if len(words) <= BLOCK_TERMS else None), "index"), items)


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT r, doc_id, w AS held, len(w) AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM docs),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(held) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
asked AS (
  SELECT q, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY q, item_id, term),
scores AS (
  SELECT q, item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * whole.docs) // whole.length))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (r), whole
  GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
