"""Token counts without tokens: dynamic programming over vocabulary matches carries a score and a number of pieces.

An Aho-Corasick automaton of the vocabulary lists, for each position of a text, the pieces that end there, longest first.
Which of them ends the best path to the position is the tokenizer's own rule, by the kind of its file:

* Unigram: the best score; among equal ones the piece that starts earliest. A character that no one-character piece covers
  may be unknown, at the least score less 10.
* Merges (BPE): the piece that stays apart from the one before it, that is, whose merges with it in the order of their
  scores, leftmost first, end in just these two pieces. There is exactly one. A sequence of pieces is what all merges of a
  text leave if and only if each two neighbours stay apart, so the path is the tokenizer's. Pairs are judged once.

Unknown characters count as their UTF-8 bytes. Words are segmented once and remembered, as far as no piece crosses the
start of a word.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import MEMO_WORDS, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Longer segments are worked out each time.
MEMO_CHARS = 48


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]  # those that text can match
    least: float  # least score of all pieces, special ones included
    byte_fallback: bool
    merges: bool = False  # scores rank merges; otherwise they are log probabilities

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto.FromString(Path(path).read_bytes()).trainer_spec
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls(tuple((model.id_to_piece(i), model.get_score(i)) for i in plain), min(model.get_score(i) for i in ids), any(model.is_byte(i) for i in ids), spec.model_type == spec.BPE)


class Counter:
    """Pieces and score of texts by a vocabulary, on the best path."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.unknown, self.bytes = vocabulary.least - UNKNOWN_PENALTY, vocabulary.byte_fallback
        self.found = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.found.add_word(piece, (len(piece), score, piece))
        self.found.make_automaton()
        crosses = any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary.pieces)
        lines = any("\n" in p for p, _ in vocabulary.pieces)
        words = rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if not lines else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.segments = re.compile(r"[\s\S]+" if crosses else words)
        self.memo: dict[str, tuple[int, float]] = {}

    def best(self, segment: str) -> tuple[int, float]:
        """Number of pieces and score of the best path through a segment."""
        size = len(segment)
        score, count, single = [0.0] + [float("-inf")] * size, [0] * (size + 1), bytearray(size + 1)
        matches = self.found.iter(segment)
        end, (length, value, _) = next(matches, (size, (0, 0.0, "")))
        for at in range(size):
            to, top, n = at + 1, float("-inf"), 0
            while end == at:
                if length == 1:
                    single[to] = 1
                if score[to - length] + value > top:
                    top, n = score[to - length] + value, count[to - length] + 1
                end, (length, value, _) = next(matches, (size, (0, 0.0, "")))
            if not single[to] and score[at] + self.unknown > top:
                top, n = score[at] + self.unknown, count[at] + (len(segment[at].encode("utf-8", "surrogatepass")) if self.bytes else 1)
            score[to], count[to] = top, n
        return count[size], score[size]

    def __call__(self, text: str) -> tuple[int, float]:
        """A text is prefixed by a space, and spaces are the pieces' space mark; an empty text has no pieces."""
        if not text:
            return 0, 0.0
        pieces, total, memo = 0, 0.0, self.memo
        for segment in self.segments.findall(SPACE + text.replace(" ", SPACE)):
            got = memo.get(segment)
            if got is None:
                got = self.best(segment)
                if len(memo) < MEMO_WORDS and len(segment) <= MEMO_CHARS:
                    memo[segment] = got
            pieces += got[0]
            total += got[1]
        return pieces, total


class MergeCounter(Counter):
    """Pieces and score of texts by a vocabulary of merges; the score is the sum of the pieces' scores, 0 for bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        if not vocabulary.byte_fallback:
            raise ValueError("merges without byte pieces aren't supported")
        self.scores = dict(vocabulary.pieces)
        # a piece that its own merges don't end in never stands in a text
        whole = tuple((p, v) for p, v in vocabulary.pieces if self.merged(p) == [p])
        super().__init__(Vocabulary(whole, vocabulary.least, True, True))
        self.characters = frozenset(p for p, _ in whole if len(p) == 1)
        if not all(self.characters.issuperset(p) for p, _ in whole):
            raise ValueError("merges of characters that are no pieces aren't supported")
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, segment: str) -> list[str]:
        """What is left of a segment's characters after all merges."""
        size, scores = len(segment), self.scores
        parts, after, before = list(segment), list(range(1, size + 1)), list(range(-1, size - 1))
        waiting: list[tuple[float, int, int]] = []  # less score, start and length of a joint piece

        def offer(i: int, j: int) -> None:
            value = scores.get(parts[i] + parts[j])
            if value is not None:
                heapq.heappush(waiting, (-value, i, len(parts[i]) + len(parts[j])))

        for i in range(size - 1):
            offer(i, i + 1)
        while waiting:
            _, i, length = heapq.heappop(waiting)
            j = after[i]
            if not parts[i] or j == size or len(parts[i]) + len(parts[j]) != length:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def apart(self, one: str, two: str) -> bool:
        """Whether two neighbouring pieces stay apart."""
        got = self.merged(one + two) == [one, two]
        if len(self.pairs) < MEMO_WORDS:
            self.pairs[one, two] = got
        return got

    def best(self, segment: str) -> tuple[int, float]:
        """Number of pieces and score of the one path of neighbours that stay apart."""
        if self.characters.issuperset(segment):
            return self.path(segment)
        # a character that is no piece has no merges, so what is between such is apart from the rest
        total, score, run = 0, 0.0, []
        for c in [*segment, None]:
            if c is not None and c in self.characters:
                run.append(c)
                continue
            n, value = self.path("".join(run))
            total, score, run = total + n + (len(c.encode("utf-8", "surrogatepass")) if c else 0), score + value, []
        return total, score

    def path(self, segment: str) -> tuple[int, float]:
        size, pairs = len(segment), self.pairs
        last: list[str | None] = [""] + [None] * size
        count, score = [0] * (size + 1), [0.0] * (size + 1)
        for end, (length, value, piece) in self.found.iter(segment):
            to = end + 1
            if last[to] is not None:
                continue
            at = to - length
            before = last[at]
            if before is None:
                continue
            if before:
                stay = pairs.get((before, piece))
                if not (self.apart(before, piece) if stay is None else stay):
                    continue
            last[to], count[to], score[to] = piece, count[at] + 1, score[at] + value
        return count[size], score[size]


def count_tokens(df: DataFrame, vocabulary: Vocabulary, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and score (of the vocabulary's segmentation) of each whole text.

    For a file of merges n_tokens is the number of ids that the file's library encodes the text in, for a unigram file
    that of its model without normalisation of the text. Null and empty texts have no tokens and score 0. Repeated rows are counted each; a null key is returned as it is. A
    very long word is segmented in one pass, in memory linear in its length. An empty table gives no rows; other columns
    are not read. The vocabulary is broadcast (a tokenizer's file, about a megabyte).
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = (MergeCounter if shared.value.merges else Counter)(shared.value)
        for batch in batches:
            got: Sequence[tuple[int, float]] = [counter(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=[key, "n_tokens", "score"])

    return rows.mapInArrow(work, f"`{key}` {rows.schema['k'].dataType.simpleString()}, n_tokens long, score double")


def query(spark: SparkSession, sf_dir: str, path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), Vocabulary.from_sentencepiece(path))
