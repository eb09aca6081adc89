"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: White space of every word contract here: space and 0x09-0x0D.
WS_CLASS = r"[\x20\x09-\x0D]"
#: Distinct words that one task remembers the hash of (memory bound, not a limit on the data).
MEMO_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all tasks run in this process."""
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="strandline-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


#: Paths staged inside each open :func:`scratch`, the innermost last.
_SCRATCH: list[list[str]] = []


def staged(df: DataFrame, name: str, outer: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    outer: how many open scratches, from the innermost, leave it alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if len(_SCRATCH) > outer:
        _SCRATCH[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged inside; results must have been written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def power_of_two(n: float, least: int, most: int) -> int:
    """Smallest power of two >= n, between ``least`` and ``most`` (both powers of two)."""
    size = least
    while size < n and size < most:
        size *= 2
    return size


class WordHasher(dict):
    """64-bit hashes of words (bytes), remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def slices(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts, cut at ``edges``, of up to ``most`` bytes in all, or of one longer text."""
    low = 0
    while low < len(edges) - 1:
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + most, "right")) - 1)
        yield low, high
        low = high


def lists_of(whose: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    """A list for each of ``rows`` rows, of the values whose row (rising) it is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(rows + 1)), pa.int32()), values)


#: Bytes of texts that are hashed at a time.
HASH_BYTES = 2**20
_PLACES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.where(_WHITE, 0, np.arange(1, 257)).astype(np.uint64)
_LOWER = _BYTES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]


def text_bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, one after the other, and where each text starts (and the last one ends)."""
    flat = texts.cast(pa.large_binary())
    edges = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]] if len(flat) else data[:0], edges - edges[0]


def word_hashes(data: np.ndarray, edges: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the texts that ``edges`` cut ``data`` into, and each text's first word (and their number).

    A byte counts by its place in the word: a sum of bytes times random odd numbers, finalised. lower: A-Z as a-z.
    """
    white = _WHITE[data]
    first = ~white
    first[1:] &= white[:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = ~white[inner]
    starts = np.flatnonzero(first)
    own, out, table = np.searchsorted(starts, edges), np.empty(len(starts), np.uint64), _LOWER if lower else _BYTES
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + HASH_BYTES)))
        low, high = int(starts[at]), int(starts[to]) if to < len(starts) else len(data)
        here = starts[at:to] - low
        place = np.arange(high - low) - np.repeat(here, np.diff(np.append(here, high - low)))
        value = table[data[low:high]]
        value *= _PLACES[place & 4095]
        far = place >> 12
        if far.any():
            value *= _PLACES[far & 4095]
        out[at:to] = np.add.reduceat(value, here)
        at = to
    return mixed(out), own


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; ``factor`` (odd) picks the function."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, by = np.zeros(n, np.uint64), np.uint64(factor)
    for j in range(size):
        h *= by
        h += words[j : j + n]
    return mixed(h)
