"""Languages of each text as a mixture: expectation-maximisation over n-gram likelihoods, with a penalty on each language.

A text is its letters in lower case, words apart by one space. Its runs of three characters (spaces at both ends of a word
included) are hashed into buckets; a language is the distribution of its learning texts over the buckets. A text is drawn
from a mixture of languages. The set starts with the single most likely language; the one whose share would raise the
likelihood fastest is added, all shares are fitted by expectation-maximisation, and the language stays if the log
likelihood gains more than the penalty. When no share could raise the likelihood, or the gain is too small, the set is
final. The language with the largest share is the text's, and the share its score.

Counts of the learning texts are gathered over all of them: each task returns sums by language and bucket, Spark merges
them, and the model, of a bounded size, is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import lists_of, mixed, slices, table, text_bytes_of

#: Languages times buckets, at most: the model is 8 bytes for each.
MODEL_SIZE = 2**21
BUCKETS, MOST_LANGUAGES = 2**16, 2**11
#: Numbers that a chunk of texts may need at once: about one for each byte and language.
CHUNK_NUMBERS = 2**24
GRAM = 3
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def buckets_for(languages: int) -> int:
    """Buckets of a model, a power of two."""
    size = BUCKETS
    while size * languages > MODEL_SIZE:
        size //= 2
    return size


def normal(text: str) -> str:
    """Words of letters in lower case, each with a space before and after; empty where there is no letter."""
    words = _WORDS.findall(text.lower())
    return f" {' '.join(words)} " if words and any(map(str.isalpha, chain.from_iterable(words))) else ""


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of GRAM characters, and its text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(points) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h += points[j : j + n] * _FACTORS[j]
    whose = np.repeat(np.arange(len(texts)), lengths)
    own = whose[:n] == whose[GRAM - 1 :] if n else np.zeros(0, bool)  # not across two texts
    return (mixed(h[own]) & np.uint64(buckets - 1)).astype(np.int64), whose[:n][own]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # buckets x languages: log likelihoods
    penalty: float
    rounds: int

    def shares(self, bucket: np.ndarray, whose: np.ndarray, texts: int) -> np.ndarray:
        """Share of each language in each text; all zero for a text without n-grams."""
        size, n_lang = len(self.logs), len(self.languages)
        cells, count = np.unique(whose * size + bucket, return_counts=True)
        text, count = cells // size, count.astype(float)
        logs = self.logs[cells % size]
        p = np.exp(logs)
        by_text = lambda x, of, n: np.stack([np.bincount(of, x[:, l], n) for l in range(x.shape[1])], axis=1)
        total = np.bincount(text, count, texts)
        singles = by_text(count[:, None] * logs, text, texts)
        out = np.zeros((texts, n_lang))
        out[np.arange(texts), singles.argmax(axis=1)] = 1.0
        out[total == 0] = 0.0
        likelihood, open_ = singles.max(axis=1), total > 0
        while n_lang > 1 and open_.any():
            rows = np.flatnonzero(open_)
            mine = open_[text]
            place = np.cumsum(open_) - 1
            of, c, q = place[text[mine]], count[mine], p[mine]
            pi = out[rows]
            mean = (q * pi[of]).sum(axis=1)
            slope = by_text(q * (c / mean)[:, None], of, len(rows)) - total[rows, None]
            slope[pi > 0] = -np.inf
            more = slope.argmax(axis=1)
            hopeful = slope[np.arange(len(rows)), more] > 0
            open_[rows[~hopeful]] = False
            if not hopeful.any():
                break
            trial, gained = self._fitted(q, c, of, pi, more, hopeful, total[rows])
            better = hopeful & (gained - likelihood[rows] > self.penalty * np.log(np.maximum(total[rows], 2.0)))
            out[rows[better]], likelihood[rows[better]] = trial[better], gained[better]
            open_[rows[~better]] = False
            open_ &= (out > 0).sum(axis=1) < n_lang
        return out

    def _fitted(self, p: np.ndarray, count: np.ndarray, of: np.ndarray, pi: np.ndarray, more: np.ndarray, which: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares after one more language has joined those in ``pi``, and the log likelihood. Each text stops by itself."""
        n, n_lang = pi.shape
        pi = pi * 0.9
        pi[np.arange(n), more] = 0.1
        moving = which.copy()
        for _ in range(self.rounds):
            mine = moving[of]
            o = of[mine]
            r = p[mine] * pi[o]
            r *= (count[mine] / r.sum(axis=1))[:, None]
            new = np.stack([np.bincount(o, r[:, l], n) for l in range(n_lang)], axis=1)[moving] / total[moving, None]
            still = np.abs(new - pi[moving]).max(axis=1) > 1e-4
            pi[moving] = new
            moving[np.flatnonzero(moving)[~still]] = False
            if not moving.any():
                break
        mine = which[of]
        gained = np.bincount(of[mine], count[mine] * np.log((p[mine] * pi[of[mine]]).sum(axis=1)), n)
        return pi, gained


def _learns(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", smooth: float = 0.1, penalty: float = 2.0, rounds: int = 60) -> Model | None:
    """Model of the languages of ``docs``, from all their rows with a text and a language; None if there are none.

    smooth: added to each count. penalty: log likelihood that a further language must gain, times the logarithm of the
    text's n-grams. rounds: most steps of a fit. At most MOST_LANGUAGES different values of ``lang``, else a ValueError.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("body")).where("lang IS NOT NULL AND body IS NOT NULL")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has over {MOST_LANGUAGES} values")
    if not languages:
        return None
    size = buckets_for(len(languages))
    names = spark.sparkContext.broadcast({x: i for i, x in enumerate(languages)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = names.value
        sums = np.zeros(size * len(number), np.int64)
        for batch in batches:
            of = np.array([number[x.as_py()] for x in batch.column(0)], np.int64)
            for low, high in slices(text_bytes_of(batch.column(1).cast(pa.binary()))[1], CHUNK_NUMBERS // 4):
                bucket, whose = grams([normal(x.as_py()) for x in batch.column(1).slice(low, high - low)], size)
                found, n = np.unique(of[low:high][whose] * size + bucket, return_counts=True)
                sums[found] += n
        cells = np.flatnonzero(sums)
        for at in range(0, len(cells), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (cells, sums[cells])], names=["cell", "n"])

    got = rows.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # MODEL_SIZE rows at most
    counts = np.zeros(size * len(languages))
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(len(languages), size).T + smooth
    return Model(tuple(languages), np.log(counts) - np.log(counts.sum(axis=0)), penalty, rounds)


def identify(df: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, langs and shares (languages of the text with their shares, largest first) of each whole text.

    A null text, one without letters and, without a model, every text is UNKNOWN with score 0 and no languages. Equal
    shares go to the language first in the alphabet. Repeated rows get equal answers; a null key is returned as it is. A
    very long text takes memory linear in its length. An empty table gives no rows; other columns aren't read.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array([*(model.languages if model else ()), UNKNOWN], object)
        for batch in batches:
            for low, high in slices(text_bytes_of(batch.column(1).cast(pa.binary()))[1], max(1, CHUNK_NUMBERS // len(languages))):
                rows = high - low
                shares = np.zeros((rows, len(languages) - 1))
                if model:
                    shares = model.shares(*grams([normal(x.as_py()) for x in batch.column(1).slice(low, rows)], len(model.logs)), rows)
                known = shares.any(axis=1) if shares.shape[1] else np.zeros(rows, bool)
                first = np.where(known, shares.argmax(axis=1) if shares.shape[1] else 0, len(languages) - 1)
                score = np.where(known, shares.max(axis=1, initial=0.0), 0.0).clip(0.0, 1.0)
                whose, which = np.nonzero(shares)
                by = np.lexsort((which, -shares[whose, which], whose))
                whose, which = whose[by], which[by]
                lists = lists_of(whose, pa.array(languages[which], pa.string()), rows), lists_of(whose, pa.array(shares[whose, which]), rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), pa.array(languages[first], pa.string()), pa.array(score), *lists], names=["k", "lang_pred", "score", "langs", "shares"])

    out = rows.mapInArrow(work, f"k {rows.schema['k'].dataType.simpleString()}, lang_pred string, score double, langs array<string>, shares array<double>")
    return out.withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(_learns(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", (~_learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "langs", "shares")
