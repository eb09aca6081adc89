"""Substring deduplication over prefix-partitioned suffix trees of words.

Every word position that starts a window of ``min_words`` words starts a suffix. Suffixes are split by prefixes of
variable length into groups that fit in memory; a group's subtree is its sorted suffixes with the lengths of common
prefixes between neighbours, and its internal nodes ``min_words`` words deep or deeper are the repeats. Subtrees are cut
at ``min_words`` words: a deeper node covers only words that nodes of that depth, of later suffixes, cover as well. Steps:

1. One scan finds anchors and counts prefixes. The anchor of a window is its 5-word gram of least hash. Equal windows have
   equal anchors, so only suffixes whose anchor occurs in two documents can be repeats. Anchors meet by hash range; those
   that repeat fill that range's part of a Bloom filter of bounded size. If that gets too full, blocks ask the ranges for
   their own anchors instead, so what is moved stays in proportion; results are the same. Counts of suffixes by prefix of
   1, 2, 4, ... words add up in sketches of bounded size, which may count too many, never too few.
2. Documents are dealt into blocks by their text, so copies meet in one block (a text whose copies would fill a block is
   spread by key). A suffix's prefix is lengthened until few enough suffixes share it; prefixes are packed into groups
   by hash. A block sends each distinct suffix once, with the least document that has it there, to its prefix's group. So
   a passage that a third of all documents share reaches its group once a block. The group builds its subtree and
   answers each block with one bit a suffix: whether its node holds a smaller document.
3. The block sorts its suffixes the same way, reads the bits and marks the words under repeats.

A suffix travels as ``min_words`` symbols (24 bits of each word's hash) and a 64-bit hash of the same words, which parts
suffixes whose symbols agree by chance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import mixed, power_of_two, slices, staged, table, text_bytes_of, window_hashes, word_hashes

GRAM = 5
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Text bytes of a block, suffixes of a group, anchors of a hash range: what one task holds at a time.
BLOCK_BYTES, GROUP_SUFFIXES, RANGE_ANCHORS = 4 * 2**20, 10**6, 2 * 10**6
#: A prefix that more than so many suffixes share is lengthened.
PREFIX_SUFFIXES = 50_000
#: Counters of a sketch of prefixes, at least and at most (4 bytes each, one sketch a prefix length).
LEAST_COUNTERS, MOST_COUNTERS = 2**14, 2**21
#: Texts with more bytes in all copies than this are spread over blocks by key.
HOT_TEXT_BYTES = 2**20
#: Up to so many such texts (checked) are broadcast; beyond, the join shuffles.
BROADCAST_TEXTS = 200_000
SYMBOL_BYTES, COUNTER_SLICE = 3, 2**12
#: Largest Bloom filter: 2**28 bits, 32 MB to broadcast; the share of set bits above which it isn't used.
MOST_BITS, FULL = 2**28, 0.4
NO_ID = np.iinfo(np.int64).max


def anchors(words: np.ndarray, min_words: int) -> np.ndarray:
    """Hash of the anchor of each window of ``min_words`` words, whatever texts they are of."""
    grams = window_hashes(words, GRAM, FACTORS[0])
    n = len(words) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, min_words - GRAM + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least


def _starts(own: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that start a window inside their text, and the text of each, from each text's first word."""
    sizes = np.maximum(np.diff(own) - min_words + 1, 0)
    who = np.repeat(np.arange(len(sizes)), sizes)
    ahead = np.cumsum(sizes) - sizes
    return np.arange(len(who)) + (own[:-1] - ahead)[who], who


def _bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits in the part of a filter of ``bits`` bits, from the low half of a hash whose top bits chose the part."""
    return h & np.uint64(bits - 1), (h >> np.uint64(20)) & np.uint64(bits - 1)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range 0..ranges-1 (a power of two) by the top bits."""
    return (h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)


def prefix_lengths(min_words: int) -> list[int]:
    """Lengths in words that a prefix may have: powers of two below ``min_words``, and ``min_words``."""
    return [2**i for i in range(min_words.bit_length()) if 2**i < min_words] + [min_words]


def scan(docs: DataFrame, min_words: int, text_bytes: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Anchors in two documents or more (range and hashes), their Bloom filter (a row a range), and sketches of prefix counts."""
    likely = text_bytes / 6 * 2 / (min_words - GRAM + 2)
    ranges = power_of_two(likely / RANGE_ANCHORS, 16, 2**16)
    part_bits = power_of_two(4 * likely / ranges, 2**12, max(2**12, MOST_BITS // ranges))
    lengths = prefix_lengths(min_words)
    counters = power_of_two(text_bytes / 6 / PREFIX_SUFFIXES * 16, LEAST_COUNTERS, MOST_COUNTERS)
    step = min(counters, COUNTER_SLICE)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        counts = np.zeros((len(lengths), counters), np.int64)

        def row(places: list[int], one: list[bytes], two: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["range", "hashes", "again"])

        def flush() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1, dtype=np.uint64))
            full = np.flatnonzero(edges[:-1] < edges[1:]).tolist()
            parts = [slice(edges[i], edges[i + 1]) for i in full]
            return row(full, [hashes[p].tobytes() for p in parts], [np.packbits(n[p] > 1).tobytes() for p in parts])

        for batch in batches:
            data, edges = text_bytes_of(batch.column(0))
            for low, high in slices(edges, BLOCK_BYTES):
                words, own = word_hashes(data[edges[low] : edges[high]], edges[low : high + 1] - edges[low])
                at, who = _starts(own, min_words)
                if not len(at):
                    continue
                for i, length in enumerate(lengths):
                    names = window_hashes(words, length, FACTORS[1])[at] & np.uint64(counters - 1)
                    counts[i] += np.bincount(names.astype(np.int64), minlength=counters)
                least = anchors(words, min_words)[at]
                turn = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (who[1:] != who[:-1]))))
                least, who = least[turn], who[turn]
                order = np.lexsort((who, least))
                least, who = least[order], who[order]
                held.append(least[np.concatenate(([True], (least[1:] != least[:-1]) | (who[1:] != who[:-1])))])
                size += len(held[-1])
                if size > 2 * 10**6:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        # sketches follow as negative ranges, one row for each part that isn't empty
        flat = counts.reshape(-1, step)
        full = np.flatnonzero(flat.any(1)).tolist()
        if full:
            yield row([-1 - i for i in full], [flat[i].tobytes() for i in full], [b""] * len(full))

    def meet(t: pa.Table) -> pa.Table:
        place, lists = t.column("range")[0].as_py(), t.column("hashes").to_pylist()
        if place < 0:
            total = np.sum([np.frombuffer(x, np.int64) for x in lists], axis=0)
            filled, h = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), b""
        else:
            lists = [np.frombuffer(x, np.uint64) for x in lists]
            again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(t.column("again").to_pylist(), lists, strict=True)]
            h = np.sort(np.concatenate([*lists, *(x[a] for x, a in zip(lists, again, strict=True))]))
            h = np.unique(h[1:][h[1:] == h[:-1]])
            flags = np.zeros(part_bits, bool)
            for p in _bit_places(h, part_bits):
                flags[p.astype(np.int64)] = True
            filled, h = np.packbits(flags, bitorder="little").tobytes(), h.tobytes()
        return pa.table({"range": pa.array([place], pa.int32()), "filled": pa.array([filled], pa.binary()), "hashes": pa.array([h], pa.binary())})

    found = staged(docs.select("body").mapInArrow(gather, "range int, hashes binary, again binary").groupBy("range").applyInArrow(meet, "range int, filled binary, hashes binary"), "anchors")
    parts, sketches = np.zeros((ranges, part_bits // 8), np.uint8), np.zeros((len(lengths) * counters // step, step), np.uint32)
    for r in found.select("range", "filled").toLocalIterator():  # MOST_BITS and a sketch a length at most
        if r["range"] < 0:
            sketches[-1 - r["range"]] = np.frombuffer(bytes(r["filled"]), np.uint32)
        else:
            parts[r["range"]] = np.frombuffer(bytes(r["filled"]), np.uint8)
    return found.where("range >= 0").select("range", "hashes"), parts, sketches.reshape(len(lengths), counters)


def _set_share(parts: np.ndarray) -> float:
    """Share of set bits."""
    return float(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)[parts].mean()) / 8


def _may_repeat(least: np.ndarray, parts: np.ndarray) -> np.ndarray:
    part_bits = parts.shape[1] * 8
    base = _range_of(least, len(parts)) * np.uint64(part_bits // 8)
    flat, ok = parts.reshape(-1), np.ones(len(least), bool)
    for p in _bit_places(least, part_bits):
        ok &= (flat[(base + (p >> np.uint64(3))).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _sorted_suffixes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffix keys (rows of bytes), and for each in order how many bytes it shares with the one before (0 first)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").reshape(-1)
    order = np.argsort(wide, kind="stable")
    ordered = keys[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(1), differs.argmax(1), keys.shape[1])
    return order, np.concatenate(([0], common))


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """Start of each node at ``depth``: a run of sorted suffixes whose neighbours share that much or more."""
    return np.flatnonzero(common < depth) if len(common) else np.zeros(0, np.int64)


class _Block:
    """The candidate suffixes of a block of documents: where each starts, and the distinct ones sorted by group and words."""

    def __init__(self, ids: np.ndarray, bodies: pa.Array, sketches: np.ndarray, may_repeat: Callable[[np.ndarray], np.ndarray], min_words: int, groups: int) -> None:
        data, edges = text_bytes_of(bodies)
        h, self.own = word_hashes(data, edges)
        at, who = _starts(self.own, min_words)
        here = may_repeat(anchors(h, min_words)[at])
        at, self.who = at[here], who[here]
        self.at = at - self.own[self.who]
        group, open_ = np.zeros(len(at), np.uint32), np.ones(len(at), bool)
        for length, counts in zip(prefix_lengths(min_words), sketches, strict=True):
            names = window_hashes(h, length, FACTORS[1])[at]
            group = np.where(open_, _range_of(mixed(names), groups).astype(np.uint32), group)
            open_ &= counts[(names & np.uint64(len(counts) - 1)).astype(np.int64)] > PREFIX_SUFFIXES
        rows = np.empty((len(at), 4 + min_words * SYMBOL_BYTES + 8), np.uint8)
        rows[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
        symbols = (h >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
        for j in range(min_words):
            rows[:, 4 + j * SYMBOL_BYTES : 4 + (j + 1) * SYMBOL_BYTES] = symbols[at + j]
        rows[:, -8:] = window_hashes(h, min_words, FACTORS[2])[at].astype(">u8").view(np.uint8).reshape(-1, 8)
        order, common = _sorted_suffixes(rows)
        starts = deep_nodes(common, rows.shape[1])
        self.node = np.empty(len(rows), np.int64)
        self.node[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        self.keys = rows[order[starts]][:, 4:]
        group = np.ascontiguousarray(rows[order[starts]][:, :4]).view(">u4").reshape(-1).astype(np.int64)
        self.groups, self.edges = np.unique(group, return_index=True)
        self.edges = np.append(self.edges, len(group))
        self.ids = ids
        self.least = np.minimum.reduceat(ids[self.who[order]], starts) if len(starts) else np.zeros(0, np.int64)


def _dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """The rows with ``block``: by text, and texts whose copies are many by key and partition as well."""
    mark = F.xxhash64("body")
    marked = docs.withColumn("mark", mark)
    hot = marked.groupBy("mark").agg(F.sum(F.octet_length("body")).alias("bytes"), F.count(F.lit(1)).alias("copies")).where((F.col("bytes") > HOT_TEXT_BYTES) & (F.col("copies") > 1)).select(F.col("mark").alias("hot"))
    hot = staged(hot, "hot-texts")
    small = hot.count() <= BROADCAST_TEXTS
    joined = marked.join(F.broadcast(hot) if small else hot, F.col("mark") == F.col("hot"), "left")
    spread = F.when(F.col("hot").isNotNull(), F.xxhash64("k", F.spark_partition_id())).otherwise(F.lit(0))
    return joined.select("k", "body", F.pmod(F.xxhash64("mark", spread), F.lit(blocks)).cast("int").alias("block"))


def remove_repeats(df: DataFrame, *, min_words: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop words under a ``min_words``-word window that also starts in a document with a smaller key.

    Returns key, n_words, n_removed, removed (start and length in words of each run of removed words, which may join several repeats) and text (the
    kept words joined by one space). Words are runs of bytes other than space and 0x09-0x0D, unchanged; windows are
    judged on the input. The key is an integer. Null and empty texts have no words. A null key counts as larger than any
    other; rows with equal keys don't remove each other's words. Texts shorter than ``min_words`` words are returned
    whole. An empty table gives no rows; other columns are not read.
    """
    if min_words < GRAM + 1:
        raise ValueError(f"min_words must be more than {GRAM}")
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    text_bytes = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    repeated, parts, sketches = scan(docs, min_words, text_bytes)
    ranges, filtered = len(parts), _set_share(parts) <= FULL
    known = spark.sparkContext.broadcast((parts if filtered else None, sketches))
    groups = power_of_two(text_bytes / 6 / 4 / GROUP_SUFFIXES, 16, 2**24)
    blocks = max(1, math.ceil(text_bytes / BLOCK_BYTES))
    dealt = _dealt(docs, blocks)
    width = min_words * SYMBOL_BYTES + 8

    def block_of(t: pa.Table, told: pa.Table) -> _Block:
        """told: range and bits for the block's distinct anchors; not read if the filter says which may repeat."""
        parts, sketches = known.value

        def may_repeat(least: np.ndarray) -> np.ndarray:
            if parts is not None:
                return _may_repeat(least, parts)
            own, back = np.unique(least, return_inverse=True)
            at, n = np.unique(_range_of(own, ranges).astype(np.int64), return_counts=True)
            bits = dict(zip(told.column("group").to_pylist(), told.column("bits").to_pylist(), strict=True))
            return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(bits[-1 - r], np.uint8), count=c).astype(bool) for r, c in zip(at.tolist(), n.tolist(), strict=True))])[back]

        ids = t.column("k").fill_null(NO_ID).to_numpy().astype(np.int64)
        return _Block(ids, pa.concat_arrays(t.column("body").chunks), sketches, may_repeat, min_words, groups)

    def ask(t: pa.Table) -> pa.Table:
        data, edges = text_bytes_of(pa.concat_arrays(t.column("body").chunks))
        words, own = word_hashes(data, edges)
        h = np.unique(anchors(words, min_words)[_starts(own, min_words)[0]])
        at, first = np.unique(_range_of(h, ranges).astype(np.int64), return_index=True)
        block = t.column("block")[0].as_py()
        return pa.table({"range": pa.array(at, pa.int32()), "block": pa.array([block] * len(at), pa.int32()), "asked": pa.array([x.tobytes() for x in np.split(h, first[1:])] if len(at) else [], pa.binary())})

    def tell(asked: pa.Table, held: pa.Table) -> pa.Table:
        h = np.frombuffer(held.column("hashes")[0].as_py(), np.uint64) if held.num_rows else np.zeros(0, np.uint64)
        bits = [np.packbits(np.isin(np.frombuffer(x, np.uint64), h)).tobytes() for x in asked.column("asked").to_pylist()]
        places = [-1 - r for r in asked.column("range").to_pylist()]
        return pa.table({"block": asked.column("block"), "group": pa.array(places, pa.int32()), "bits": pa.array(bits, pa.binary())})

    answer = "block int, group int, bits binary"
    if not filtered:
        asked = dealt.groupBy("block").applyInArrow(ask, "range int, block int, asked binary")
        told = staged(asked.groupBy("range").cogroup(repeated.groupBy("range")).applyInArrow(tell, answer), "told")

    def send(t: pa.Table, told: pa.Table) -> pa.Table:
        b = block_of(t, told)
        cuts = list(zip(b.edges[:-1], b.edges[1:], strict=True)) if len(b.groups) else []
        # column by column, as sorted suffixes begin alike
        suffixes = pa.array([b.keys[x:y].T.tobytes() for x, y in cuts], pa.binary())
        least = pa.array([b.least[x:y].tobytes() for x, y in cuts], pa.binary())
        block = t.column("block")[0].as_py()
        return pa.table({"group": pa.array(b.groups, pa.int32()), "block": pa.array([block] * len(cuts), pa.int32()), "suffixes": suffixes, "least": least})

    def subtree(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint8).reshape(width, -1).T for x in t.column("suffixes").to_pylist()])
        least = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("least").to_pylist()])
        order, common = _sorted_suffixes(keys)
        nodes = deep_nodes(common, width)
        smallest = np.repeat(np.minimum.reduceat(least[order], nodes), np.diff(np.append(nodes, len(order))))
        older = np.empty(len(order), bool)
        older[order] = smallest < least[order]
        ends = np.cumsum([len(x) // 8 for x in t.column("least").to_pylist()])
        return pa.table({"block": t.column("block"), "group": t.column("group"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(older, ends[:-1])], pa.binary())})

    def remove(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        b = block_of(docs_of, answers)
        bits = dict(zip(answers.column("group").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        sizes = np.diff(b.edges).tolist() if len(b.groups) else []
        older = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(bits[g], np.uint8), count=n).astype(bool) for g, n in zip(b.groups.tolist(), sizes, strict=True))])
        gone = older[b.node] | (b.least[b.node] < b.ids[b.who])
        at, who = b.at[gone], b.who[gone]
        n_words, n_removed, removed, kept = [], [], [], []
        edge = np.searchsorted(who, np.arange(len(b.ids) + 1))
        for i, body in enumerate(docs_of.column("body").to_pylist()):
            words, mine = body.split(), at[edge[i] : edge[i + 1]]
            n_words.append(len(words))
            if not len(mine):
                n_removed.append(0)
                removed.append([])
                kept.append(b" ".join(words))
                continue
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, mine, 1)
            np.add.at(marks, mine + min_words, -1)
            inside = np.cumsum(marks)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
            removed.append([{"start": int(x), "length": int(y - x)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
            n_removed.append(int(inside.sum()))
            kept.append(b" ".join([w for w, x in zip(words, inside.tolist(), strict=True) if not x]))
        ids = [None if x == NO_ID else int(x) for x in b.ids]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table({key: pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(removed, spans), "body": pa.array(kept, pa.binary())})

    sending = "group int, block int, suffixes binary, least binary"
    if filtered:
        sent = dealt.groupBy("block").applyInArrow(lambda t: send(t, t), sending)
    else:
        sent = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, sending)
    answers = sent.groupBy("group").applyInArrow(subtree, answer)
    if not filtered:
        answers = answers.unionByName(told)
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, f"`{key}` long, n_words long, n_removed long, removed array<struct<start:long,length:long>>, body binary")
    return out.select(key, "n_words", "n_removed", "removed", F.col("body").cast("string").alias(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) AS name FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs)),
firsts AS (SELECT name, min(doc_id) AS first_doc FROM windows GROUP BY name),
gone AS (SELECT DISTINCT w.doc_id, w.i + j AS i FROM windows w JOIN firsts f ON w.name = f.name AND f.first_doc < w.doc_id, range(13) r(j)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs),
judged AS (SELECT w.*, g.i IS NOT NULL AS lost FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE lost) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT lost) AS body FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
