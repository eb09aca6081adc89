"""Prediction by partial matching: code length of documents under a byte-context trie learned from the corpus.

A text is its words, lower-cased (A-Z) and joined by one space, then one newline as its end. The trie counts which byte
follows each context of up to ``order`` bytes in the training texts. A byte is coded in the longest context seen; a byte
new to that context costs an escape (method C: as many escapes as distinct bytes) and is coded one byte shorter, without
the bytes that the longer context would have offered (exclusion); bytes never seen share what is left evenly.

Counts are gathered by hash aggregation over all training texts, and no count is dropped. The trie is partitioned by the
last bytes of a context, two or as many more as a part's size asks for: all contexts that a byte can fall back to down to
that length are in one part, and the shorter levels above it go with each part. The cost of the most frequent grams is broadcast; other grams of
a text, seen or not, are looked up once each in their part of the trie and join the texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import lists_of, power_of_two, slices, staged, table, text_bytes_of, word_hashes

WORD, GRAM, TEXTS = 0, 1, 2
END = b"\n"
#: Words whose counts are broadcast (the most frequent, a few MB); all others are joined.
MOST_WORDS = 2**19
#: Bytes of texts whose grams are worked out together, and grams of a part of the trie.
CHUNK, PART_GRAMS = 2**20, 200_000
#: Crowded contexts that are broadcast (8 bytes each; there is one in PART_GRAMS grams at most); beyond, the join shuffles.
MOST_CROWDED = 1_000_000


def text_bytes(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def context_grams(body: np.ndarray, order: int) -> np.ndarray:
    """For each byte from place ``order`` on, itself and the ``order`` bytes before it, as one number."""
    n = len(body) - order
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(order + 1):
        out <<= np.uint64(8)
        out |= body[j : j + n]
    return out


class _Tally:
    """Sums of counts by key, compacted as they come in."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > 3_000_000:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, c = np.concatenate(self.keys), np.concatenate(self.counts)
        if not len(k):
            return k, c
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        self.keys, self.counts = [k[at]], [np.add.reduceat(c, at)]
        self.size = len(at)
        return self.keys[0], self.counts[0]


@dataclass
class _Level:
    """Contexts of one length. seen: its grams and their log10 counts; contexts, and what their fallback costs."""

    grams: np.ndarray
    log_counts: np.ndarray
    contexts: np.ndarray
    log_total: np.ndarray  # of T + D, entered first
    escape: np.ndarray  # entered first
    log_below: np.ndarray  # of T + D in the context one shorter, without this context's bytes
    escape_below: np.ndarray  # from the context one shorter, entered from here


class Trie:
    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tables: by context length from 0, sorted grams of one byte more and their counts."""
        self.order, self.levels = len(tables) - 1, []
        lower: tuple | None = None
        for k, (g, c) in enumerate(tables):
            ctx = g >> np.uint64(8)
            at = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(g) else np.zeros(0, np.int64)
            contexts, distinct = ctx[at], np.diff(np.append(at, len(g))).astype(float)
            total = np.add.reduceat(c, at) if len(g) else np.zeros(0)
            if lower is None:
                below_t, below_d = np.zeros(len(at)), np.full(len(at), 256.0) - distinct
            else:
                g1, c1, contexts1, total1, distinct1 = lower
                excluded = np.add.reduceat(c1[np.searchsorted(g1, g & np.uint64(2 ** (8 * k) - 1))], at) if len(g) else np.zeros(0)
                up = np.searchsorted(contexts1, contexts & np.uint64(2 ** (8 * (k - 1)) - 1))
                below_t, below_d = total1[up] - excluded, distinct1[up] - distinct
            with np.errstate(divide="ignore"):
                log_below = np.log10(below_t + below_d)
                escape_below = np.where(below_t + below_d > 0, np.log10(np.maximum(below_d, 1e-300)) - log_below, 0.0)
            log_total = np.log10(total + distinct)
            self.levels.append(_Level(g, np.log10(c), contexts, log_total, np.log10(distinct) - log_total, log_below, escape_below))
            lower = (g, c, contexts, total, distinct)
        self.top = self.levels[-1].log_counts - self.levels[-1].log_total[np.searchsorted(self.levels[-1].contexts, self.levels[-1].grams >> np.uint64(8))] if len(tables[-1][0]) else np.zeros(0)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each byte, given as grams of this order; equal grams are looked up once, in key order."""
        left, back = np.unique(grams, return_inverse=True)
        out = np.zeros(len(left))
        at, seen = self._find(self.levels[-1].grams, left)
        out[seen] = self.top[at[seen]]
        rows, left = np.flatnonzero(~seen), left[~seen]
        # origin: the context one byte longer that was escaped from, -1 while no context has been seen
        origin = np.full(len(left), -1, np.int64)
        for k in range(self.order, -1, -1):
            if not len(left):
                return out[back]
            level, above = self.levels[k], self.levels[k + 1] if k < self.order else None
            low = left if k == self.order else left & np.uint64(2 ** (8 * (k + 1)) - 1)
            where, known = self._find(level.contexts, low >> np.uint64(8))
            entered = origin >= 0
            at, seen = self._find(level.grams, low)
            fresh = ~entered & known
            if above is not None and entered.any():
                hit, miss = entered & seen, entered & ~seen
                out[rows[hit]] += level.log_counts[at[hit]] - above.log_below[origin[hit]]
                out[rows[miss]] += above.escape_below[origin[miss]]
            hit, miss = fresh & seen, fresh & ~seen
            out[rows[hit]] += level.log_counts[at[hit]] - level.log_total[where[hit]]
            out[rows[miss]] += level.escape[where[miss]]
            rows, left, origin = rows[~seen], left[~seen], np.where(known, where, -1)[~seen]
        if len(left):
            root = self.levels[0]
            out[rows] -= math.log10(256.0 - len(root.grams) if len(root.grams) else 256.0)
        return out[back]

    def cost(self, grams: np.ndarray) -> float:
        return float(self.costs(grams).sum())


def _train(part: Column) -> Column:
    return F.crc32(F.coalesce(part.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def _normal(bodies: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The texts as they are scored, and where each starts among all their bytes (and the last one ends)."""
    texts = [text_bytes(x.lower().split()) for x in bodies.to_pylist()]
    return texts, np.cumsum([0, *map(len, texts)])


def _text_grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of all bytes of the texts and the text of each, up to CHUNK at a time; before its start a text has ends."""
    pad, held, whose, size = END * order, [], [], 0

    def grams() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in held])
        out = context_grams(np.frombuffer(b"".join(held), np.uint8), order)
        own = np.ones(len(out), bool)
        for j in range(order):  # places between two pieces
            own[np.cumsum(sizes)[:-1] - order + j] = False
        return out[own], np.repeat(whose, sizes - order)

    for i, text in enumerate(texts):
        padded = pad + text
        for at in range(0, len(text), CHUNK):
            held.append(padded[at : at + CHUNK + order])
            whose.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                yield grams()
                held, whose, size = [], [], 0
    if held:
        yield grams()


def gather_counts(docs: DataFrame, order: int) -> DataFrame:
    """kind, key and n: words by hash, grams, and texts, of the column ``body``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, texts = _Tally(), _Tally(), 0
        for batch in batches:
            texts += batch.num_rows
            edges = text_bytes_of(batch.column(0))[1]
            for low, high in slices(edges, 4 * CHUNK):
                mine, at = _normal(batch.column(0).slice(low, high - low))
                words.add(word_hashes(np.frombuffer(b"".join(mine), np.uint8), at)[0])
                for found, _ in _text_grams(mine, order):
                    grams.add(found)
        for kind, (keys, counts) in ((WORD, words.compact()), (GRAM, grams.compact()), (TEXTS, (np.zeros(1, np.uint64), np.array([texts])))):
            for a in range(0, len(keys), 200_000):
                k = keys[a : a + 200_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[a : a + 200_000].astype(np.int64))], names=["kind", "key", "n"])

    return docs.mapInArrow(work, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _columns(bounded: DataFrame) -> list[np.ndarray]:
    """Keys (sorted) and numbers of a frame with a bounded number of rows, as Arrow (Python objects take ten times as much)."""
    found = bounded.toArrow()
    keys, *rest = (c.to_numpy().astype(np.int64) for c in found.columns)
    at = np.argsort(keys.view(np.uint64))
    return [keys.view(np.uint64)[at], *(x[at].astype(float) for x in rest)]


def _frequent(counts: DataFrame, most: int) -> tuple[Column, int, int]:
    """Condition for the most frequent of ``counts`` (key, n), at most ``most``; how many rows there are, and their sum."""
    by_size = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    low, room = 62, most
    for x in sorted(by_size, key=lambda x: -x["b"]):
        room -= x["rows"]
        if room < 0:
            break
        low = x["b"]
    return F.col("n") >= F.lit(2**low), sum(x["rows"] for x in by_size), sum(x["n"] for x in by_size)


def _summed(grams: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``size`` bytes of grams, sorted and distinct, and their counts."""
    low = grams & np.uint64(2 ** (8 * size) - 1)
    order = np.argsort(low, kind="stable")
    low, counts = low[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
    return low[at], np.add.reduceat(counts, at) if len(at) else counts


def _context(size: int) -> Column:
    """The last ``size`` bytes of a gram's context."""
    return F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(2 ** (8 * size) - 1))


def _crowded(grams: DataFrame, short: int, order: int) -> dict[int, DataFrame]:
    """By length, from ``short`` on, the contexts under which more than PART_GRAMS grams lie: one in PART_GRAMS grams at most."""
    out: dict[int, DataFrame] = {}
    rest = grams
    for size in range(short, order):
        counts = rest.groupBy(_context(size).alias("context")).count().where(F.col("count") > PART_GRAMS).select("context")
        found = staged(counts, "crowded")
        n = found.count()
        if not n:
            break
        out[size] = F.broadcast(found) if n <= MOST_CROWDED else found
        rest = rest.join(out[size], _context(size) == F.col("context"), "left_semi")
    return out


def _placed(rows: DataFrame, crowded: dict[int, DataFrame], short: int, parts: int) -> DataFrame:
    """Adds size, the least number of context bytes (from ``short`` on) that aren't crowded, and the part of these bytes."""
    length = F.lit(short)
    for size, contexts in crowded.items():
        mark = f"in_{size}"
        rows = rows.join(contexts.select(F.col("context").alias(mark)), _context(size) == F.col(mark), "left")
        length = length + F.col(mark).isNotNull().cast("int")
    rows = rows.withColumn("size", length).drop(*[f"in_{size}" for size in crowded])
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.expr("shiftleft(1L, size * 8) - 1"))
    return rows.withColumn("part", F.pmod(F.xxhash64("size", context), F.lit(parts)).cast("int"))


def gram_costs(wanted: DataFrame, grams: DataFrame, order: int, n_grams: int) -> DataFrame:
    """key and cost of the distinct grams ``wanted``, by the trie of all ``grams`` (key, n), part by part.

    A part has the grams under a context of two bytes, or of as many more as it takes to have PART_GRAMS grams at most
    (one context of full length can't be cut). What lies above a longer one, 256 grams a level, is copied to its part.
    """
    short = min(2, order)
    mask = lambda size: F.lit(2 ** (8 * size) - 1)
    low = [tuple(_columns(grams.groupBy(F.col("key").bitwiseAND(mask(j + 1)).alias("g")).agg(F.sum("n").alias("n")))) for j in range(short)]
    shared = grams.sparkSession.sparkContext.broadcast(low)
    parts = power_of_two(n_grams / PART_GRAMS, 16, 2**16)
    crowded = _crowded(grams, short, order)
    asked, own = (_placed(x, crowded, short, parts) for x in (wanted.select("key"), grams.select("key", "n")))
    held = own.select("key", "n", "size", "part", F.lit(-1).alias("level"))
    for size, contexts in crowded.items():
        under = grams.join(contexts, _context(size) == F.col("context"))
        level = under.groupBy("context", F.col("key").bitwiseAND(mask(size + 1)).alias("key")).agg(F.sum("n").alias("n"))
        below = asked.select("key", "size", "part").unionByName(own.select("key", "size", "part")).where(F.col("size") > size).select(_context(size).alias("context"), "part").distinct()
        held = held.unionByName(level.join(below, "context").select("key", "n", F.lit(0).alias("size"), "part", F.lit(size).alias("level")))

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        want, g = (t.column("key").to_numpy().astype(np.int64).view(np.uint64) for t in (asked, held))
        if not len(want):
            return pa.table({"key": pa.array([], pa.int64()), "cost": pa.array([], pa.float64())})
        counts = held.column("n").to_numpy().astype(float)
        size, level = (held.column(c).to_numpy() for c in ("size", "level"))
        tables = list(shared.value)
        for k in range(short, order + 1):
            mine = (level == k) | (level == -1) & (size <= k)
            tables.append(_summed(g[mine], counts[mine], k + 1))
        while tables and not len(tables[-1][0]):
            tables.pop()
        costs = Trie(tables).costs(want & np.uint64(2 ** (8 * len(tables)) - 1)) if tables else np.full(len(want), -math.log10(256))
        return pa.table({"key": pa.array(want.view(np.int64)), "cost": pa.array(costs)})

    return asked.select("key", "part").groupBy("part").cogroup(held.groupBy("part")).applyInArrow(look_up, "key long, cost double")


def score(df: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = 5, most_frequent: int = 2**21) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Rows whose crc32 of the key as text is divisible by 10 are held out; the others train. Null and empty texts are one
    end token. A null key is the empty text as key, so held out. Repeated rows train and score each. Without training
    rows each byte has 1/256 and each token 1. An empty table gives no rows; other columns are not read. The scores are
    log10 probabilities: base of the words by their training counts, score by the trie.
    most_frequent: grams whose cost is broadcast (16 bytes each); others are joined, with the same results.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("k"), _train(F.col(key)).alias("train"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    counts = staged(gather_counts(docs.where("train").select("body"), order), "counts")
    words, grams = (counts.where(F.col("kind") == kind).select("key", "n") for kind in (WORD, GRAM))
    texts = counts.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    common, distinct, n_train = _frequent(words, MOST_WORDS)
    n_train, distinct = n_train + texts, distinct + (texts > 0)
    norm = n_train + 0.1 * (distinct + 1)
    usual, n_grams, _ = _frequent(grams, most_frequent)
    siblings = Window.partitionBy(F.shiftrightunsigned("key", 8))
    of_context = grams.withColumn("t", F.sum("n").over(siblings) + F.count(F.lit(1)).over(siblings))
    gram_keys, gram_n, gram_t = _columns(of_context.where(usual).select("key", "n", "t"))
    model = spark.sparkContext.broadcast((gram_keys, np.log10(gram_n) - np.log10(gram_t), *_columns(words.where(common))))
    key_type = docs.schema["k"].dataType.simpleString()

    def rare_lists(whose: np.ndarray, keys: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
        """Distinct keys of each row and how often each comes, as two columns of lists."""
        order = np.lexsort((keys, whose))
        whose, keys = whose[order], keys[order]
        new = np.flatnonzero(np.concatenate(([True], (whose[1:] != whose[:-1]) | (keys[1:] != keys[:-1])))) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(keys)))
        return lists_of(whose[new], pa.array(keys[new].view(np.int64)), rows), lists_of(whose[new], pa.array(times), rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_costs, word_keys, tally = model.value
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            edges = text_bytes_of(batch.column(2))[1]
            for low, high in slices(edges, 4 * CHUNK):
                rows = high - low
                mine, at = _normal(batch.column(2).slice(low, rows))
                h, own = word_hashes(np.frombuffer(b"".join(mine), np.uint8), at)
                who = np.repeat(np.arange(rows), np.diff(own))
                where, known = Trie._find(word_keys, h)
                base = np.bincount(who[known], np.log10((tally[where[known]] + 0.1) / norm), rows) + math.log10((texts + 0.1) / norm)
                n_known = np.bincount(who[known], minlength=rows) + int(texts > 0)
                total, missed, whose = np.zeros(rows), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for found, of in _text_grams(mine, order):
                    different, back = np.unique(found, return_inverse=True)
                    where, seen = Trie._find(gram_keys, different)
                    cost = np.zeros(len(different))
                    cost[seen] = gram_costs[where[seen]]
                    total += np.bincount(of, cost[back], rows)
                    rest = np.flatnonzero(~seen[back])
                    missed.append(found[rest])
                    whose.append(of[rest])
                columns = [*rare_lists(who[~known], h[~known], rows), *rare_lists(np.concatenate(whose), np.concatenate(missed), rows)]
                ids = pa.array(np.arange(serial, serial + rows))
                serial += rows
                firsts = [ids, batch.column(0).slice(low, rows), batch.column(1).slice(low, rows), *map(pa.array, (np.diff(own) + 1, n_known, base, total))]
                yield pa.RecordBatch.from_arrays([*firsts, *columns], names=["id", "k", "train", "n_tokens", "n_known", "base", "score", "words", "word_n", "grams", "gram_n"])

    lists = "words array<long>, word_n array<long>, grams array<long>, gram_n array<long>"
    scored = staged(docs.mapInArrow(work, f"id long, k {key_type}, train boolean, n_tokens long, n_known long, base double, score double, {lists}"), "scored")

    def rare(keys: str, times: str) -> DataFrame:
        pairs = scored.where(F.size(keys) > 0).select("id", F.explode(F.arrays_zip(keys, times)).alias("r"))
        return pairs.select("id", F.col(f"r.{keys}").alias("key"), F.col(f"r.{times}").alias("tf"))

    n = F.coalesce(F.col("n"), F.lit(0))
    more_words = (
        rare("words", "word_n").join(words, "key", "left")
        .groupBy("id")
        .agg(F.sum(F.col("tf") * F.log10((n + F.lit(0.1)) / F.lit(float(norm)))).alias("more"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("known"))
    )
    rare_grams = rare("grams", "gram_n")
    more_grams = rare_grams.join(gram_costs(rare_grams.select("key").distinct(), grams, order, n_grams), "key").groupBy("id").agg(F.sum(F.col("tf") * F.col("cost")).alias("rest"))
    return scored.drop("words", "word_n", "grams", "gram_n").join(more_words, "id", "left").join(more_grams, "id", "left").select(
        F.col("k").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
