"""Near-duplicate groups by SetSketch registers.

A document's set of shingles gives REGISTERS registers: for each register a hash of every shingle is read as an
exponential variate, and the register keeps the least one, truncated to a power of BASE. Registers of a union are the
element-wise maxima, and equal registers are the more likely the more alike two sets are.

* Equal sets meet first, by a fingerprint of the set; one document stands for all of them.
* Bands of registers put representatives into buckets, and representatives that share buckets into clusters. Registers
  and full sets travel once to each block of a cluster, not once a pair: clusters are cut into blocks of bounded size,
  and a task holds two of them.
* In a few rounds a bucket's pivot meets the members of other components, links are verified, and components grow by
  connected components. What is still apart after the rounds is compared block by block, so that no colliding pair of
  different components stays untested; only verified links leave a task.
* A pair is tested in two steps: the Jaccard similarity of greatest likelihood, given both set sizes and how many
  registers are greater, less and equal, must not be far below the bound; then full sets are intersected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import WordHasher, mixed, staged, table

#: Registers, and how many of them are cut into bands.
REGISTERS, BANDED = 560, 140
#: Base of the register scale and its largest value: 1.02**-1200 of the range of 32-bit hashes.
BASE, TOP = 1.02, 1200
PIVOT_ROUNDS = 1
#: Eight-byte items (shingles and registers) of a block of a cluster, a task holds two blocks; tasks for the small clusters.
BLOCK_ITEMS, LEAST_BINS = 100_000, 64
SEEDS = (mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
SHINGLE_FACTOR = 0xC2B2AE3D27D4EB4F


def band_rows(percent: int) -> int:
    """Registers of a band: the most at which a link shares no band with probability under 1e-6."""
    return max(r for r in (1, 2, 4, 5, 7) if r == 1 or (1 - (percent / 100) ** r) ** (BANDED // r) < 1e-6)


def least_estimate(percent: int) -> float:
    """Estimates of pairs at the bound are under this with probability under 1e-5 (4.5 standard errors)."""
    return percent / 100 - 4.5 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole sequence if it is shorter; empty without words."""
    n = max(1, len(words) - size + 1) if len(words) else 0
    run, h = min(size, len(words)), np.full(n, len(words) if len(words) < size else 0, np.uint64)
    for j in range(run):
        h *= np.uint64(SHINGLE_FACTOR)
        h += words[j : j + n]
    return np.unique(mixed(h))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS registers (uint16) for each non-empty set."""
    edges = np.cumsum([0] + [len(s) for s in sets])[:-1]
    every = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(sets)), np.uint32)
    h, low = np.empty_like(every), np.empty_like(every)
    for i, seed in enumerate(SEEDS):
        np.bitwise_xor(every, seed, out=h)
        h *= np.uint32(0x85EBCA6B)
        np.right_shift(h, np.uint32(15), out=low)
        h ^= low
        h *= np.uint32(0xC2B2AE35)
        np.right_shift(h, np.uint32(16), out=low)
        h ^= low
        least[i] = np.minimum.reduceat(h, edges)
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype(np.uint16)


def likeliest_similarity(n_a: np.ndarray, n_b: np.ndarray, greater: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood on a grid, from set sizes and counts of registers a > b and a < b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal, best, top = REGISTERS - greater - less, np.zeros(len(u)), np.full(len(u), -np.inf)
    p = lambda x: -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / math.log(BASE)
    for j in np.linspace(0, 1, 101):
        possible = j <= np.minimum(u / v, v / u)
        more, fewer = p(u - v * j), p(v - u * j)
        logs = greater * np.log(np.maximum(more, 1e-9)) + less * np.log(np.maximum(fewer, 1e-9)) + equal * np.log(np.maximum(1 - more - fewer, 1e-9))
        better = possible & (logs > top)
        best[better], top[better] = j, logs[better]
    return best


def band_hashes(found: np.ndarray, rows: int) -> np.ndarray:
    """One hash (int64) for each band of ``rows`` registers, a row for each row of registers."""
    bands = BANDED // rows
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(found), 1))
    cut = found[:, : bands * rows].reshape(len(found), bands, rows).astype(np.uint64)
    for j in range(rows):
        h = mixed(h * np.uint64(SHINGLE_FACTOR) + cut[:, :, j])
    return h.view(np.int64)


def sketch(docs: DataFrame, shingle: int, rows: int, full: bool = False) -> DataFrame:
    """k, n (set size), mark (16 bytes that name the set) and bands of each row of k, body; no bands if empty.

    full: k, registers and items (the set's sorted hashes) instead.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            bodies = batch.column(1)
            at = 0
            while at < len(bodies):
                sets, first, size = [], at, 0
                while at < len(bodies) and size < 60_000:
                    sets.append(shingle_set(hasher.array(bodies[at].as_py().lower().split()), shingle))
                    size += len(sets[-1])
                    at += 1
                held = [s for s in sets if len(s)]
                found = registers(held) if held else np.zeros((0, REGISTERS), np.uint16)
                keys = batch.column(0).slice(first, at - first)
                each = iter(found if full else band_hashes(found, rows).tolist())
                mine = [next(each) if len(s) else None for s in sets]
                if full:
                    columns = [keys, pa.array([None if x is None else x.tobytes() for x in mine], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "registers", "items"])
                else:
                    marks = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), marks, pa.array(mine, pa.list_(pa.int64()))], names=["k", "n", "mark", "bands"])

    return docs.mapInArrow(work, "k long, registers binary, items binary" if full else "k long, n long, mark binary, bands array<long>")


def connected(edges: DataFrame, least: str = "a", other: str = "b") -> DataFrame:
    """node, component (least node reachable) of undirected edges, by rounds of least neighbour and pointer jumping.

    First each node's lesser neighbours are tied to the least of them instead of to the node: many nodes share those, so
    few distinct edges are left for the rounds.
    """
    pairs = edges.select(F.least(least, other).alias("a"), F.greatest(least, other).alias("b")).distinct()
    stars = pairs.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    pairs = stars.select(F.col("m").alias("x"), F.col("b").alias("y")).unionByName(stars.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))).distinct()
    links = staged(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))), "links")
    state = links.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("c"))
    state, before = staged(state, "components"), None
    while True:
        total = state.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return state.select(F.col("x").alias("node"), F.col("c").alias("component"))
        before = total
        lower = links.join(state.select(F.col("x").alias("y"), F.col("c")), "y").groupBy("x").agg(F.min("c").alias("m"))
        hop = state.join(lower, "x").select("x", F.least("c", "m").alias("c"))
        jump = hop.alias("h").join(state.select(F.col("x").alias("c"), F.col("c").alias("cc")), "c", "left")
        state = staged(jump.select("x", F.least("c", F.coalesce("cc", "c")).alias("c")), "components")


def _compare(t: pa.Table, percent: int) -> pa.Table:
    """Links among rows of the same g: of a row with its partners, or where these are null with all of other components.

    Of links that would close a circle with those found here before, or inside a component, none is needed: each task
    returns a forest, so links don't grow with the square of a group.
    """
    t = t.sort_by([("g", "ascending"), ("k", "ascending")])
    g, k, c, block, apart = (t.column(x).to_numpy() for x in ("g", "k", "c", "block", "apart"))
    partners = t.column("partners").to_pylist()
    found = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
    n, least = np.array([len(x) for x in sets], float), math.floor(least_estimate(percent) * REGISTERS)
    edges, tested = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))), []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        keys = k[low:high]
        for i in range(low, high):
            if partners[i] is None:
                j = np.arange(i + 1, high)
                j = j[(c[j] != c[i]) & ((block[j] != block[i]) | ~apart[i])]
            else:
                sides = (np.searchsorted(keys, partners[i], side) for side in ("left", "right"))
                j = np.array([x for a, b in zip(*sides, strict=True) for x in range(low + a, low + b)], np.int64)
            j = j[np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent]
            if len(j):
                equal = (found[j] == found[i]).sum(1)
                j, equal = j[equal >= least], equal[equal >= least]
                greater = (found[i] > found[j]).sum(1)
                tested += [(i, *x) for x in zip(j.tolist(), greater.tolist(), (REGISTERS - equal - greater).tolist(), strict=True)]
    if not tested:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    i, j, greater, less = (np.array(x) for x in zip(*tested, strict=True))
    likely = likeliest_similarity(n[i], n[j], greater, less) >= least_estimate(percent)
    links, above = set(), {}
    node = [int(k[x]) if partners[x] is not None else int(c[x]) for x in range(len(k))]

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = x = above.get(above[x], above[x])
        return x

    for x, y in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
        one, two = top(node[x]), top(node[y])
        if one == two:
            continue
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            links.add((int(min(k[x], k[y])), int(max(k[x], k[y]))))
            above[one] = two
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _linked(ends: DataFrame, known: DataFrame, bins: int, percent: int) -> DataFrame:
    """The links (a, b) among ``ends`` (g, alone, k, c, block, apart, partners); small clusters share tasks."""
    rows = ends.join(known, "k").withColumn("bin", F.when(F.col("alone"), F.pmod("g", F.lit(bins))).otherwise(F.col("g"))).drop("alone")
    return staged(rows.groupBy("bin").applyInArrow(lambda t: _compare(t, percent), "a long, b long").distinct(), "verified")


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.col("blocks"))


def _of_pairs(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """The ends of distinct pairs (a, b) of one cluster: a row for each document and pair of blocks, a's row names b."""
    placed = pairs.join(places.withColumnRenamed("k", "a"), "a").withColumn("x", _block(F.col("a"))).withColumn("y", _block(F.col("b")))
    group = F.xxhash64("cluster", F.least("x", "y"), F.greatest("x", "y")).alias("g")
    shared = [group, (F.col("blocks") == 1).alias("alone")]
    ends = placed.select(*shared, F.col("a").alias("k"), F.col("b").alias("other")).unionByName(placed.select(*shared, F.col("b").alias("k"), F.lit(None).cast("bigint").alias("other")))
    none = F.lit(0).cast("bigint")
    return ends.groupBy("g", "alone", "k").agg(F.collect_set("other").alias("partners")).select("g", "alone", "k", none.alias("c"), none.alias("block"), F.lit(False).alias("apart"), "partners")


def _of_rest(named: DataFrame, places: DataFrame) -> DataFrame:
    """Members (k, bucket, c) of buckets that hold more than one component, in each pair of blocks where they meet others."""
    sizes = named.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("m"))
    # the largest component of a bucket meets the others' blocks only; two of its own members need not meet
    open_ = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("m", "c")).alias("big"), F.count(F.lit(1)).alias("cs")).where("cs > 1").select("bucket", "big")
    rows = named.join(open_, "bucket").join(places, "k").withColumn("block", _block(F.col("k")))
    small = F.col("c") != F.col("big")
    held = rows.groupBy("bucket").agg(F.collect_set("block").alias("every"), F.collect_set(F.when(small, F.col("block"))).alias("some"))
    meets = rows.join(held, "bucket").groupBy("k", "c", "cluster", "blocks", "block").agg(F.array_distinct(F.flatten(F.collect_set(F.when(small, F.col("every")).otherwise(F.col("some"))))).alias("met"))
    group = F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other"))
    return meets.withColumn("other", F.explode("met")).select(
        group.alias("g"), (F.col("blocks") == 1).alias("alone"), "k", "c", "block", (F.col("block") != F.col("other")).alias("apart"), F.lit(None).cast("array<bigint>").alias("partners")
    )


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id (least key reachable over links) and kept for each row.

    Texts are lower-cased (A-Z) and cut into words at space and 0x09-0x0D; a text of fewer than ``shingle`` words is one
    shingle; null texts and texts without words have none and link with nothing. Two rows link if 100 * intersection >=
    ``percent`` * union. The key is an integer; rows with a null key are returned with themselves as (null) component
    and kept; rows with equal keys count as one document if their sets are equal, else their sets' links are joined.
    An empty table gives no rows; other columns are not read.
    """
    docs = df.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    rows = band_rows(percent)
    sketches = staged(sketch(docs, shingle, rows), "sketches")
    usable = sketches.where(F.col("k").isNotNull() & F.col("mark").isNotNull())
    leaders = staged(usable.groupBy("mark").agg(F.min("k").alias("k"), F.max("n").alias("n"), F.max("bands").alias("bands")), "leaders")
    buckets = leaders.select("k", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("k").alias("pivot")).where(F.col("size") > 1)
    members = staged(buckets.join(shared, "bucket").select("k", "bucket", "pivot").distinct(), "members")
    first = staged(members.where("k <> pivot").select(F.col("pivot").alias("a"), F.col("k").alias("b")).distinct(), "pairs")

    weight = F.col("n") + F.lit(REGISTERS * 2 // 8)
    clusters = connected(first).select(F.col("node").alias("k"), F.col("component").alias("cluster"))
    weighed = clusters.join(leaders.select("k", "n"), "k").groupBy("cluster").agg(F.sum(weight).alias("items"))
    blocks = F.ceil(F.col("items") / F.lit(BLOCK_ITEMS)).cast("bigint").alias("blocks")
    places = staged(clusters.join(weighed, "cluster").select("k", "cluster", "items", blocks), "places")
    bins = max(LEAST_BINS, math.ceil((places.join(leaders.select("k", "n"), "k").agg(F.sum(weight)).first()[0] or 0) / BLOCK_ITEMS))
    places = places.drop("items")
    known = staged(sketch(docs.join(places.select("k"), "k", "left_semi").distinct(), shingle, rows, full=True).where(F.col("registers").isNotNull()), "known")

    links = _linked(_of_pairs(first, places), known, bins, percent)
    for turn in range(PIVOT_ROUNDS + 1):
        parts = connected(links)
        named = members.join(parts.withColumnRenamed("node", "k"), "k", "left").select("k", "bucket", F.coalesce("component", "k").alias("c"))
        if turn == PIVOT_ROUNDS:
            ends = _of_rest(named, places)
        else:
            draw = F.xxhash64("k", F.lit(turn))
            open_ = named.groupBy("bucket").agg(F.min_by(F.struct("k", "c"), draw).alias("p"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket", F.col("p.k").alias("pivot"), F.col("p.c").alias("pc"))
            ends = _of_pairs(named.join(open_, "bucket").where("c <> pc").select(F.least("k", "pivot").alias("a"), F.greatest("k", "pivot").alias("b")).distinct(), places)
        links = links.unionByName(_linked(ends, known, bins, percent))
    parts = connected(links)

    final = leaders.select("mark", F.col("k").alias("leader")).join(parts.withColumnRenamed("node", "leader"), "leader", "left").select("mark", F.coalesce("component", "leader").alias("component_id"))
    plain = sketches.select("k", "n", "mark")
    # marks of a group of copies repeat in the left side only; AQE splits such partitions
    placed = plain.where(F.col("mark").isNotNull() & F.col("k").isNotNull()).join(final, "mark").select("k", "n", "component_id")
    rest = plain.where(F.col("mark").isNull() | F.col("k").isNull()).select("k", "n", F.col("k").alias("component_id"))
    return placed.unionByName(rest).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS s FROM docs)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component AS component_id, d.doc_id = r.component AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component FROM reach GROUP BY a) r ON r.a = d.doc_id"""
