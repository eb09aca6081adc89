"""Benchmark decontamination by templates: questions are found again though their numbers, names or units changed.

Words become template tokens: numbers, units after numbers and names turn into typed placeholders (slots), other words
into their lower-cased form without marks around them. A name is a word with a capital first letter and small ones after;
names in small letters or in capitals throughout stay as they are. Whether a word that starts a sentence is a name can't be
told, so an item's windows come in both readings, as a slot and as the word; in documents it is a slot. Windows of template
tokens are joined by hash between documents and benchmark items; a window that is less than half words holds too little to
tell a template by, and is joined by its own words instead. Items with the same template and the same pattern of equal
values are one class, represented by its least item. Windows on one diagonal (document position less item position) form an
alignment, whose slots should agree: each item value goes with one document value and each document value with one item
value, by type. Where they don't, a pair of values holds if it is at more positions than each pair it conflicts with, at
equal numbers if it is the only one with equal values; windows with other pairs don't count. A document is contaminated by
an item if the windows that count cover enough of the item's tokens.

Windows that many items share make no pairs of items and documents. The windows of an item that most items share are set
aside while all of them together cover too little of it; a document that the item contaminates has one of the others, the
probes, so only probes are joined for candidates, and only candidates are compared over all their windows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import MEMO_WORDS, mixed, staged, table, window_hashes

FACTOR = 0x9E3779B97F4A7C15
#: Benchmark windows up to so many bytes (checked) are broadcast, as hashes and as a side of the join; beyond, all document
#: windows go to the join, which shuffles.
MOST_BROADCAST = 2**25
#: Longest window: each of its words may start a sentence, and all readings of these are joined.
MOST_WORDS = 12
LITERAL, NUMBER, UNIT, CAPITAL = 0, 1, 2, 3
SLOT_HASH = np.array([0, 0x51ED270B3A5F1C11, 0x6C8E9CF570932BD5, 0x2545F4914F6CDD1D], np.uint64)
# Units of measure and number words, lower case.
UNITS = frozenset("% percent cm mm m km kilometers kilometres meters metres meter metre inch inches in ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms tonne tonnes ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph kph km/h m/s hz khz mhz ghz kb mb gb tb bytes bits w kw mw j kj cal kcal v mv a ma ohm ohms pa kpa bar psi mol °c °f c f k degrees degree dollars dollar cents cent euros euro usd eur gbp".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
NUMBER_FORM = re.compile(r"[+\-−]?[$€£¥]?\d[\d.,:/x×^]*(?:st|nd|rd|th|%|[a-zA-Z°/]{1,4})?")
EDGES = re.compile(r"^\W+|\W+$")


class Templates(dict):
    """Template tokens of texts; remembers words by their place in arrays."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.h, self.kind, self.ends = np.empty(1024, np.uint64), np.empty(1024, np.int8), np.empty(1024, bool)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.h):
            self.h, self.kind, self.ends = (np.concatenate((x, x)) for x in (self.h, self.kind, self.ends))
        letters = word.isalpha()  # most words: no marks around them and no digits
        core = word if letters else EDGES.sub("", word)
        low = core.lower()
        if low in NUMBER_WORDS or not letters and NUMBER_FORM.fullmatch(word.strip("()[]{}\"'.,;:!?")):
            kind = NUMBER
        elif low in UNITS or word == "%":
            kind = UNIT
        elif len(core) > 1 and core[0].isupper() and core[1:].islower():
            kind = CAPITAL
        else:
            kind = LITERAL
        self.h[at], self.kind[at] = xxhash.xxh3_64_intdigest((low or word).encode("utf-8", "surrogatepass")), kind
        self.ends[at] = not letters and word.rstrip("\"')]”’")[-1:] in (".", "!", "?", ":")
        self[word] = at
        return at

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word, its kind (0 for a literal), and whether it is a name only if it doesn't just start a sentence."""
        if len(self) > MEMO_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        kind = self.kind[at]
        kind[1:][(kind[1:] == UNIT) & (kind[:-1] != NUMBER)] = LITERAL
        if len(kind) and kind[0] == UNIT:
            kind[0] = LITERAL
        first = np.concatenate(([True], self.ends[at][:-1]))[: len(at)]
        return self.h[at], kind, first & (kind == CAPITAL)


def _window_names(h: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
    """Name of each window of ``size`` tokens: of its template, or of its words if it is less than half literal."""
    slots = np.concatenate(([0], np.cumsum(kind != LITERAL)))
    names = window_hashes(np.where(kind > 0, SLOT_HASH[kind], h), size, FACTOR + 2 * size)
    heavy = np.flatnonzero(2 * (slots[size:] - slots[:-size]) > size)
    if len(heavy):
        own, by = np.zeros(len(heavy), np.uint64), np.uint64(FACTOR - 2 * size)
        for j in range(size):
            own = own * by + h[heavy + j]
        names[heavy] = mixed(own)
    return names


def _readings(h: np.ndarray, kind: np.ndarray, unsure: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start, name and kinds of each window of an item, in each reading of its sentence starts; once if joined by its words."""
    for a in range(len(h) - size + 1):
        places, by_words = np.flatnonzero(unsure[a : a + size]), False
        for bits in range(2 ** len(places)):
            k = kind[a : a + size].copy()
            k[places[(bits >> np.arange(len(places)) & 1).astype(bool)]] = LITERAL
            if 2 * (k != LITERAL).sum() > size:
                if by_words:
                    continue
                by_words = True
            yield a, int(_window_names(h[a : a + size], k, size).view(np.int64)[0]), k


def _probes(item_words: int, size: int, sharers: dict[int, int], least_share: float) -> list[int]:
    """Window positions left when those of most sharers are set aside, as long as these cover less than ``least_share``."""
    covered, total, out = np.zeros(item_words, bool), 0, []
    for at in sorted(sharers, key=lambda at: (-sharers[at], at)):
        fresh = size - int(covered[at : at + size].sum())
        if (total + fresh) / item_words < least_share:
            covered[at : at + size] = True
            total += fresh
        else:
            out.append(at)
    return out


def _is_slot(kind: np.ndarray) -> np.ndarray:
    """Slots of a window; one that is joined by its words has none."""
    return (kind > 0) & (2 * (kind == LITERAL).sum() >= len(kind))


def _slots(words: list[str], kind: np.ndarray, at: int) -> list[str]:
    return [f"{kind[i]}:{EDGES.sub('', words[at + i]).lower()}" for i in np.flatnonzero(_is_slot(kind)).tolist()]


def _wrong_places(pairs: list[tuple[int, str, str]]) -> list[int]:
    """Item positions of slots whose pair of values doesn't hold, of a diagonal's (item position, item value, document value)."""
    at = Counter((a, b) for _, a, b in pairs)
    weight = {(a, b): (n, a == b) for (a, b), n in at.items()}
    best: list[dict[str, list[tuple[int, bool]]]] = [{}, {}]
    for pair, w in weight.items():
        for side in (0, 1):
            best[side].setdefault(pair[side], []).append(w)
    for side in best:
        for value, ws in side.items():
            side[value] = sorted(ws, reverse=True)[:2]
    # a pair holds if it outweighs all others of its item value and of its document value
    holds = {pair for pair, w in weight.items() if all(best[side][pair[side]][:1] == [w] != best[side][pair[side]][1:] for side in (0, 1))}
    return sorted(i for i, a, b in pairs if (a, b) not in holds)


def _covers(starts: list[int], size: int, pairs: list[tuple[int, str, str]]) -> list[int]:
    """Item positions under the windows that hold no wrong slot."""
    wrong, out = _wrong_places(pairs), set()
    for s in starts:
        if bisect_left(wrong, s) == bisect_left(wrong, s + size):
            out.update(range(s, s + size))
    return sorted(out)


def template_classes(benchmark: DataFrame, *, item_key: str = "item_id", item_text: str = "text", window: int = 8) -> DataFrame:
    """item, body and class of each benchmark item: the least item with the same template and pattern of equal values.

    Words that start sentences, and all under windows that are joined by their words, count as they are.
    """
    items = benchmark.select(F.col(item_key).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("body"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            names = []
            for body in batch.column(1).to_pylist():
                words = body.split()
                h, kind, unsure = templates.tokens(words)
                plain, size = (kind == LITERAL) | unsure, min(window, len(words))
                literal = np.concatenate(([0], np.cumsum(kind == LITERAL)))
                for a in np.flatnonzero(2 * (literal[size:] - literal[:-size]) < size).tolist() if size else []:
                    plain[a : a + size] = True
                values: dict[int, int] = {}
                token = [f"w{x}" if p else f"{k}.{values.setdefault(x, len(values))}" for x, k, p in zip(h.tolist(), kind.tolist(), plain.tolist(), strict=True)]
                names.append(xxhash.xxh3_128_digest(" ".join(token).encode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], names=["item", "body", "pattern"])

    named = staged(items.mapInArrow(patterns, f"item {items.schema['item'].dataType.simpleString()}, body string, pattern binary"), "patterns")
    return named.join(named.groupBy("pattern").agg(F.min("item").alias("class")), "pattern").select("item", "body", "class")


def _probe_windows(known: DataFrame, item_type: str, least_share: float) -> DataFrame:
    """item, size and h of the windows that candidates are joined by, of an item's windows in all readings."""
    shared = known.join(known.groupBy("h", "size").agg(F.count_distinct("item").alias("sharers")), ["h", "size"])
    at = shared.groupBy("item", "item_words", "size", "item_at").agg(F.max("sharers").alias("sharers"), F.collect_set("h").alias("hs"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, names = [], []
            for i, (item_words, size, windows) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                hs = {w["item_at"]: w["hs"] for w in windows}
                for a in _probes(item_words, size, {w["item_at"]: w["sharers"] for w in windows}, least_share):
                    names += hs[a]
                    whose += [i] * len(hs[a])
            at = pa.array(whose, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(names, pa.int64())], names=["item", "size", "h"])

    lists = at.groupBy("item", "item_words", "size").agg(F.collect_list(F.struct("item_at", "sharers", "hs")).alias("windows"))
    return lists.mapInArrow(choose, f"item {item_type}, size int, h long").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 8, least_share: float = 0.6) -> DataFrame:
    """One row for each contaminated document: key, item_ids (sorted), n_items and share (most of an item covered).

    item_ids name classes of items by their least id, see :func:`template_classes`. Items of fewer than ``window`` words
    are one window of their own; items of fewer than 4 words, null or empty, match nothing. window: 4 to 12 words. Null and empty documents are
    clean. Texts are judged whole; rows with equal keys and texts count once, and equal keys with different texts are
    judged apart and reported together. A null document key is reported as null. An empty table on either side gives no
    rows; other columns are not read.
    """
    if not 4 <= window <= MOST_WORDS:
        raise ValueError(f"window must be 4 to {MOST_WORDS}")
    spark = docs.sparkSession
    items = staged(template_classes(benchmark, item_key=item_key, item_text=item_text, window=window).groupBy("class").agg(F.min_by("body", F.struct("item", "body")).alias("body")), "classes")

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows = []
            for item, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = body.split()
                if len(words) >= 4:
                    size = min(window, len(words))
                    h, kind, unsure = templates.tokens(words)
                    rows += [(item, len(words), size, a, name, _slots(words, k, a), (a + np.flatnonzero(_is_slot(k))).tolist()) for a, name, k in _readings(h, kind, unsure, size)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["item", "item_words", "size", "item_at", "h", "item_slots", "places"])

    item_type = items.schema["class"].dataType.simpleString()
    known = staged(items.mapInArrow(item_windows, f"item {item_type}, item_words long, size int, item_at long, h long, item_slots array<string>, places array<long>"), "templates")
    held = known.agg(F.sum(F.octet_length(F.concat_ws("", "item_slots")) + 8 * F.size("places") + 64), F.collect_set("size")).first()
    sizes, small = sorted(held[1]), (held[0] or 0) <= MOST_BROADCAST
    probes = staged(_probe_windows(known, item_type, least_share), "probes")
    every, probing = (np.unique(x.select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)) if small else None for x in (known, probes))
    wanted = spark.sparkContext.broadcast((every, np.isin(every, probing)) if small else (None, None))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    key_type = rows.schema["k"].dataType.simpleString()

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, (hashes, probing) = Templates(), wanted.value
        for batch in batches:
            whose, found = [], []
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                words, mine, probed = body.split(), [], hashes is None
                h, kind, _ = templates.tokens(words)
                for size in sizes:
                    if len(h) < size or hashes is not None and not len(hashes):
                        continue
                    names = _window_names(h, kind, size)
                    at = np.arange(len(names))
                    if hashes is not None:
                        place = np.minimum(np.searchsorted(hashes, names), len(hashes) - 1)
                        at = np.flatnonzero(hashes[place] == names)
                        probed |= bool(probing[place[at]].any())
                    mine += [(size, a, x) for a, x in zip(at.tolist(), names[at].view(np.int64).tolist(), strict=True)]
                if mine and probed:
                    mark = xxhash.xxh3_64_intdigest(body.encode("utf-8", "surrogatepass")) - 2**63
                    whose += [i] * len(mine)
                    found += [(mark, size, a, x, _slots(words, kind[a : a + size], a)) for size, a, x in mine]
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True))], names=["k", "mark", "size", "at", "h", "slots"])

    hits = rows.mapInArrow(doc_windows, f"k {key_type}, mark long, size int, at long, h long, slots array<string>")
    if not small:
        hits = hits.join(known.select("h", "size").distinct(), ["h", "size"], "left_semi")
    hits = staged(hits, "hits")
    near = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    candidates = hits.select("k", "mark", "h", "size").join(near(probes), ["h", "size"]).select("k", "mark", "item").distinct()
    asked = candidates.withColumnsRenamed({"k": "_k", "mark": "_mark", "item": "_item"}).join(near(known), F.col("_item").eqNullSafe(F.col("item"))).withColumnsRenamed({"h": "_h", "size": "_size"})
    same = F.col("_k").eqNullSafe(F.col("k")) & (F.col("_mark") == F.col("mark")) & (F.col("_h") == F.col("h")) & (F.col("_size") == F.col("size"))
    pairs = F.transform(F.arrays_zip("places", "item_slots", "slots"), lambda p: F.struct(p["places"].alias("p"), p["item_slots"].alias("a"), p["slots"].alias("b")))
    diagonals = (
        hits.join(asked, same)
        .where(F.size("slots") == F.size("item_slots"))
        .select("k", "mark", "item", "item_words", "size", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", pairs.alias("pairs"))
        .groupBy("k", "mark", "item", "item_words", "size", "diagonal")
        .agg(F.collect_set("item_at").alias("starts"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
        .select("k", "mark", "item", "item_words", "size", "starts", "pairs")
    )

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = [_covers(starts, size, [(x["p"], x["a"], x["b"]) for x in found]) for size, starts, found in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(covers, pa.list_(pa.int64()))], names=["k", "mark", "item", "item_words", "covers"])

    by_item = (
        diagonals.mapInArrow(agreed, f"k {key_type}, mark long, item {item_type}, item_words long, covers array<long>")
        .groupBy("k", "mark", "item", "item_words")
        .agg((F.size(F.array_distinct(F.flatten(F.collect_list("covers")))) / F.col("item_words")).alias("share"))
        .where(F.col("share") >= least_share)
    )
    return by_item.groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.countDistinct("item").alias("n_items"), F.max("share").alias("share")).withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
