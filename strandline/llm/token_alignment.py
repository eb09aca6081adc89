"""Alignment of two tokenizers' tokens over the bytes of each text.

Tokenizer A is a byte-level BPE file (JSON), B a sentencepiece file. Both see a space and the text. Neither has a token
that crosses from a character that isn't white space to a space or line end, so a text is cut there into segments (a run of
white space and what follows up to the next cut), and each distinct segment is tokenized and aligned once in a task.

The alignment is DuckDB over the Arrow tables of a task's segments: tables of token intervals by byte offset; the cuts are
where intervals of both sides end together (a join); a window sum numbers the groups between cuts; an ASOF join finds the
group of each token, a range join the segment of each cut. Each task also returns partial counts of id pairs; Spark merges
them, and each text's pairs meet their corpus-wide counts again: the frequent ones by a broadcast of a checked size, the
others by a shuffle join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import lists_of, slices, staged, table, text_bytes_of

#: Unicode's White_Space, which both tokenizers' patterns know.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_OTHER = re.sub("[ \n]", "", WHITE)
#: Some pieces end with a carriage return, so only a space or a line end begins a segment.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:[{_OTHER}][{WHITE}]*[^{WHITE}]*)*|[{WHITE}]+")
#: Distinct segments that a task remembers before it starts anew, and bytes of texts worked on together.
MEMO_SEGMENTS, CHUNK = 150_000, 2**21
#: Id pairs that are broadcast with their counts (24 bytes each); the others are joined.
MOST_PAIRS = 2**19
#: Pairs in a row of partial counts.
ROW_PAIRS = 50_000


@dataclass(frozen=True)
class Files:
    """The two tokenizer files, read where the plan is built: workers need no access to them."""

    a: str
    b: bytes

    @classmethod
    def read(cls, a: str, b: str) -> Files:
        """Checks that the segments can be tokenized apart."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = json.loads(Path(a).read_text(encoding="utf-8"))
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not all(x["special"] for x in spec["added_tokens"]):
            raise ValueError(f"{a} isn't a plain byte-level BPE")
        model = proto.ModelProto.FromString(Path(b).read_bytes())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{b} changes texts before it cuts them")
        plain = [p.piece.replace("▁", " ") for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED)]
        if any(len(SEGMENT.findall(x)) > 1 for x in plain):
            raise ValueError(f"{b} has pieces that go on after white space")
        rules.add_dummy_prefix = False  # segments bring their own space
        byte_ranks(spec)
        return cls(Path(a).read_text(encoding="utf-8"), model.SerializeToString())


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: The pattern by which byte-level files of this kind cut texts before they merge (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(spec: dict) -> dict[bytes, int]:
    """Id of each token of a byte-level file by its bytes; ids must rise in the order of merges."""
    to_byte, special = byte_level_alphabet(), {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [ranks[bytes(map(to_byte.__getitem__, "".join(m)))] for m in merges]
    if ids != sorted(set(ids)) or len(ranks) != 256 + len(ids):
        raise ValueError("merges aren't in the order of ids")
    return ranks


class Tokenizers:
    """Ids of both sides and the bytes of each id."""

    def __init__(self, files: Files) -> None:
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        ranks = byte_ranks(json.loads(files.a))
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return list(map(self.a.encode_ordinary, texts)), self.b.encode(texts, num_threads=1)


class Aligner:
    """Alignments of distinct segments, by number in the order of their first use."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        import duckdb

        self.tokenizers = tokenizers
        # one thread a task and nothing on local disks: a chunk's tables are bounded
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        # by id: its decimal and what follows it; the last of a group's A ids has a bar, of its B ids a semicolon
        marks = lambda n, last: [f"{i},".encode() for i in range(n)] + [f"{i}{last}".encode() for i in range(n)]
        self.words = marks(len(tokenizers.a_bytes), "|") + marks(len(tokenizers.b_bytes), ";")
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (tokenizers.a_bytes, tokenizers.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []  # groups of each segment as text
        self.counts = np.zeros((4, 0), np.int64)  # tokens of A and B, groups, and whether the bytes are the segment's
        self.times = np.zeros(0, np.int64)
        self.db.execute("CREATE OR REPLACE TABLE links (segment BIGINT, pair BIGINT)")

    def add(self, segments: list[str]) -> None:
        """Aligns segments that aren't known yet; those whose bytes don't come back have no tokens."""
        ids = self.tokenizers.encode(segments)
        names = (self.tokenizers.a_bytes, self.tokenizers.b_bytes)
        raw = [x.encode("utf-8") for x in segments]
        good = np.ones(len(raw), bool)
        if any(b"".join(map(of.__getitem__, chain.from_iterable(side))) != b"".join(raw) for of, side in zip(names, ids, strict=True)):
            good = np.array([all(b"".join(map(of.__getitem__, side[i])) == text for of, side in zip(names, ids, strict=True)) for i, text in enumerate(raw)], bool)
            ids = [[x if ok else [] for x, ok in zip(side, good, strict=True)] for side in ids]
        sizes = np.array([len(text) if ok else 0 for text, ok in zip(raw, good, strict=True)])
        n_a, n_b = (np.array(list(map(len, side))) for side in ids)
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in ids)
        a_stop, b_stop, stop = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(sizes)
        first = len(self.texts)
        for name, columns in (
            ("a_in", {"id": a, "start": a_stop - self.a_size[a], "stop": a_stop}),
            ("b_in", {"id": b, "start": b_stop - self.b_size[b], "stop": b_stop}),
            ("segment_in", {"segment": np.arange(first, first + len(segments))[good], "start": (stop - sizes)[good], "stop": stop[good]}),
        ):
            self.db.register(name, pa.table(columns))
        self.db.execute("CREATE OR REPLACE TEMP TABLE cuts AS SELECT a_in.id AS a, b_in.id AS b, stop, sum(1) OVER (ORDER BY stop ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS grp FROM a_in JOIN b_in USING (stop)")
        self.db.execute("CREATE OR REPLACE TEMP TABLE fresh AS SELECT s.segment, c.a << 32 | c.b AS pair, c.grp FROM cuts c JOIN segment_in s ON c.stop > s.start AND c.stop <= s.stop")
        self.db.execute("INSERT INTO links SELECT segment, pair FROM fresh")
        groups = self.db.execute("SELECT segment, count(*) AS n FROM fresh GROUP BY segment").fetchnumpy()
        n_groups = np.zeros(len(segments), np.int64)
        n_groups[groups["segment"].astype(np.int64) - first] = groups["n"]
        of = [self.db.execute(f"SELECT c.grp FROM {side} t ASOF JOIN cuts c ON t.stop <= c.stop ORDER BY t.stop").fetchnumpy()["grp"].astype(np.int64) for side in ("a_in", "b_in")]
        total = int(n_groups.sum())
        a_of, b_of = (np.bincount(x, minlength=total) for x in of)
        # a group's A tokens, then its B tokens
        order = np.empty(len(a) + len(b), np.int64)
        n_words = [len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)]
        order[np.arange(len(a)) + (np.cumsum(b_of) - b_of)[of[0]]] = a + n_words[0] * np.isin(np.arange(len(a)), np.cumsum(a_of) - 1)
        order[np.arange(len(b)) + np.cumsum(a_of)[of[1]]] = 2 * n_words[0] + b + n_words[1] * np.isin(np.arange(len(b)), np.cumsum(b_of) - 1)
        words, at = [self.words[i] for i in order.tolist()], 0
        for n in (n_a + n_b).tolist():
            self.texts.append(b"".join(words[at : at + n]))
            at += n
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, n_groups, good))), axis=1)
        self.times = np.concatenate((self.times, np.zeros(len(segments), np.int64)))

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The segments of each text by number."""
        known, number = len(self.number), self.number
        out = [[number.setdefault(s, len(number)) for s in SEGMENT.findall(" " + text)] if text else [] for text in texts]
        if len(number) > known:
            self.add(list(number)[known:])
        return out

    def pairs(self, whose: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each of the rows ``whose`` (rising), and how often each is linked there."""
        self.db.register("used_in", pa.table({"row": whose, "segment": segments}))
        got = self.db.execute("SELECT u.row, l.pair, count(*) AS n FROM used_in u JOIN links l USING (segment) GROUP BY u.row, l.pair ORDER BY u.row").fetchnumpy()
        return got["row"].astype(np.int64), got["pair"].astype(np.int64), got["n"].astype(np.int64)

    def tally(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of all segments used so far, and how often each is linked."""
        self.db.register("times_in", pa.table({"segment": np.arange(len(self.times)), "n": self.times}))
        got = self.db.execute("SELECT l.pair, sum(t.n)::BIGINT AS n FROM links l JOIN times_in t USING (segment) WHERE t.n > 0 GROUP BY l.pair").fetchnumpy()
        return got["pair"].astype(np.int64), got["n"].astype(np.int64)


_LISTS = "pairs array<long>, times array<long>"


def _aligned(docs: DataFrame, files: Files, groups: bool) -> DataFrame:
    """A row for each of ``docs`` (k, body), and rows without id that hold partial counts of pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    key_type = docs.schema["k"].dataType
    names = ["id", "k", "n_a", "n_b", "n_groups", "sha", "groups", "pairs", "times"]

    def partial(aligner: Aligner, keys: pa.DataType) -> Iterator[pa.RecordBatch]:
        pair, n = aligner.tally()
        for at in range(0, len(pair), ROW_PAIRS):
            lists = [lists_of(np.zeros(len(x[at : at + ROW_PAIRS]), np.int64), pa.array(x[at : at + ROW_PAIRS]), 1) for x in (pair, n)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, keys), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), *lists], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, serial = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            aligner = aligner or Aligner(Tokenizers(shared.value))
            edges = text_bytes_of(batch.column(1).cast(pa.binary()))[1]
            for low, high in slices(edges, CHUNK):
                rows = high - low
                used = aligner.numbers(batch.column(1).slice(low, rows).to_pylist())
                lengths = np.array(list(map(len, used)))
                segments = np.fromiter(chain.from_iterable(used), np.int64, int(lengths.sum()))
                whose = np.repeat(np.arange(rows), lengths)
                bad = np.zeros(rows, bool)
                bad[whose[aligner.counts[3][segments] == 0]] = True  # one segment that doesn't come back costs the text
                stays = ~bad[whose]
                segments, whose = segments[stays], whose[stays]
                np.add.at(aligner.times, segments, 1)
                sums = [np.bincount(whose, aligner.counts[i][segments], rows).astype(np.int64) for i in range(3)]
                texts = [b"" if bad[i] else b"".join([aligner.texts[s] for s in x])[:-1] for i, x in enumerate(used)]
                sha = [hashlib.sha256(x).hexdigest() if x else "" for x in texts]
                row, pair, n = aligner.pairs(whose, segments)
                lists = [lists_of(row, pa.array(x), rows) for x in (pair, n)]
                shown = pa.array([x.decode() for x in texts], pa.string()) if groups else pa.nulls(rows, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(serial, serial + rows)), batch.column(0).slice(low, rows), *map(pa.array, sums), pa.array(sha, pa.string()), shown, *lists], names=names)
                serial += rows
                if len(aligner.number) > MEMO_SEGMENTS:
                    yield from partial(aligner, batch.column(0).type)
                    aligner.clear()
        if aligner is not None:
            yield from partial(aligner, batch.column(0).type)

    return docs.mapInArrow(work, f"id long, k {key_type.simpleString()}, n_a long, n_b long, n_groups long, sha string, groups string, {_LISTS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links of the whole corpus) and best (no A id is linked with this B id more often), from partial counts."""
    counts = aligned.where("id IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = staged(counts, "pairs")
    b = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each B id: the vocabulary bounds it
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def _usual(counts: DataFrame) -> Column | None:
    """Condition for the most frequent pairs, at most MOST_PAIRS; nothing where all are."""
    by_size = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("b")).count().collect()
    if sum(x["count"] for x in by_size) <= MOST_PAIRS:
        return None
    low, room = 63, MOST_PAIRS
    for x in sorted(by_size, key=lambda x: -x["b"]):
        room -= x["count"]
        if room < 0:
            break
        low = x["b"]
    return F.col("n") >= F.lit(2**low) if low < 63 else F.lit(False)


def align(df: DataFrame, files: Files, *, key: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups of each whole text.

    groups: the alignment as text, "a1,a2|b1;a3|b2,b3" with ids in order; null where not asked for. A link is a pair of
    tokens that end together; a pair's count is the number of links of the corpus that hold it. Null and empty texts,
    and texts whose bytes a tokenizer doesn't give back, have no tokens: zeros and empty strings, and no links. Repeated
    rows count and return each; a null key is returned as it is. An empty table gives no rows; other columns aren't read.
    A very long text, or one without white space, is worked on alone, in memory linear in its length. Ties for the
    highest count of a B id are all best.
    """
    docs = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    aligned = staged(_aligned(docs, files, groups), "aligned")
    texts, counts = aligned.where("id IS NOT NULL"), staged(pair_counts(aligned), "counts")
    usual = _usual(counts)
    links = texts.select("id", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("id", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    near = F.broadcast(counts if usual is None else counts.where(usual))
    met = links.join(near, "pair")
    if usual is not None:
        met = met.unionByName(links.join(near.select("pair"), "pair", "left_anti").join(counts.where(~usual), "pair").select(*met.columns))
    sums = met.groupBy("id").agg(F.sum("times").alias("links"), F.sum(F.col("times") * F.col("best")).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return texts.select("id", "k", "n_a", "n_b", "n_groups", "sha", "groups").join(sums, "id", "left").select(
        F.col("k").alias(key), "n_a", "n_b", "n_groups", zero(F.col("links")).alias("n_links"), zero(F.col("best")).alias("n_best"),
        zero(F.col("total")).alias("count_sum"), F.col("sha").alias("groups_sha256"), "groups",
    )


def query(spark: SparkSession, sf_dir: str, a: str = "/opt/tokenizers/byte_bpe_50k.json", b: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return align(table(spark, sf_dir, "documents"), Files.read(a, b), groups=False).drop("groups")
