"""Edited copies of benchmark items: one inconsistent slot costs its own windows, not the whole alignment."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from strandline.llm import decontamination
from strandline.llm.common import table

TAIL = "and then the class writes down every single step of the long calculation on the board so that all of them can follow it until the end of the lesson"
ITEM = f"Then Maria gives the box with 3 apples to the teacher while Maria holds 5 of the pears in the other hand {TAIL}"


@pytest.mark.parametrize("most", [2**22, 1])
def test_edited_copies(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [
        (1, ITEM),
        (2, ITEM.replace("while Maria", "while Clara")),  # one of two occurrences of a name
        (3, ITEM.replace("with 3", "with 4").replace("holds 5", "holds 4")),  # two values become one
        (4, ITEM.replace("Maria", "Clara").replace("with 3", "with 8")),
        (5, f"Nothing of it, though Maria has 3 apples {TAIL[:40]}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["share"] for r in decontamination.contaminated(docs, items).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1] == got[4] == 1.0 and 0.6 <= got[3] < 1 and 0.6 <= got[2] < 1


def test_pairs_that_hold():
    wrong = decontamination._wrong_places
    assert wrong([(0, "a", "x"), (5, "b", "y"), (9, "a", "x")]) == []
    assert wrong([(0, "a", "x"), (5, "a", "y"), (9, "a", "x")]) == [5]
    assert wrong([(0, "a", "a"), (5, "a", "y")]) == [5]
    assert wrong([(0, "a", "x"), (5, "b", "x")]) == [0, 5]


def test_items_of_mostly_slots(spark):
    item = "Alice and Bob bought 3 kg and 5 kg in Paris Rome Oslo Bonn today"
    docs = spark.createDataFrame([(1, f"It says {item} and no more"), (2, "Clara and Dora bought 4 kg and 6 kg in Genoa Turin Milan Pisa today")], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["share"]) for r in got] == [(1, 1.0)]


def test_sentence_starts_read_both_ways(spark):
    text = "Maria counts the pears in the box and then she asks how many of them are left for tomorrow"
    items = spark.createDataFrame([(1, text), (2, "How many pears are in the box after the boy took half of them away ?"), (3, text.replace("Maria", "Clara"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text.replace("Maria", "Dora")), (2, "He asks how many pears are in the box after the boy took half of them away ?")], "doc_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["share"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {1: ([1, 3], 1.0), 2: ([2], 1.0)}


def test_classes_of_equal_templates(spark):
    rows = [(i, f"Then the shop sold {i + 3} of its {i + 20} red apples to a man who came late in the day") for i in (5, 2, 9)] + [(1, "Then the shop sold 7 of its 7 red apples to a man who came late in the day")]
    classes = {r["item"]: r["class"] for r in decontamination.template_classes(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert classes == {5: 2, 2: 2, 9: 2, 1: 1}
    docs = spark.createDataFrame([(1, rows[0][1].replace("8", "11"))], "doc_id long, text string")
    assert decontamination.contaminated(docs, spark.createDataFrame(rows, "item_id long, text string")).first()["item_ids"] == [2]


def _reference(docs, items):
    """Contaminated documents by plain loops over windows as tuples of tokens, without hashes, classes or joins."""
    D = decontamination

    def tokens(words):
        out = []
        for w in words:
            core = re.sub(r"^\W+|\W+$", "", w)
            if D.NUMBER_FORM.fullmatch(w.strip("()[]{}\"'.,;:!?")) or core.lower() in D.NUMBER_WORDS:
                kind = 1
            elif (core.lower() in D.UNITS or w == "%") and out and out[-1][0] == 1:
                kind = 2
            elif len(core) > 1 and core[0].isupper() and core[1:].islower() and core.lower() not in D.UNITS:
                kind = 3
            else:
                kind = 0
            out.append((kind, core.lower() or w, w))
        return out

    def name(part):
        heavy = 2 * sum(k == 0 for k, *_ in part) < len(part)
        return (heavy, tuple(v if heavy or k == 0 else k for k, v, _ in part))

    windows, sizes = defaultdict(set), set()
    for item, text in items:
        t = tokens((text or "").split())
        size = min(8, len(t))
        if len(t) < 4:
            continue
        sizes.add(size)
        for a in range(len(t) - size + 1):
            unsure = [i for i in range(size) if t[a + i][0] == 3 and (a + i == 0 or t[a + i - 1][2].rstrip("\"')]”’")[-1:] in tuple(".!?:"))]
            for n in range(len(unsure) + 1):
                for plain in itertools.combinations(unsure, n):
                    part = [(0, *t[a + i][1:]) if i in plain else t[a + i] for i in range(size)]
                    heavy, key = name(part)
                    slots = () if heavy else tuple((a + i, k, v) for i, (k, v, _) in enumerate(part) if k)
                    windows[size, heavy, key].add((item, len(t), a, slots))
    found = {}
    for doc, text in docs:
        t = tokens((text or "").split())
        diagonals = defaultdict(lambda: (set(), set()))
        for size in sizes:
            for a in range(len(t) - size + 1):
                heavy, key = name(t[a : a + size])
                for item, n, at, slots in windows.get((size, heavy, key), ()):
                    starts, pairs = diagonals[item, n, size, a - at]
                    starts.add(at)
                    pairs.update((p, (k, v), t[a - at + p][:2]) for p, k, v in slots)
        covered = defaultdict(set)
        for (item, n, size, _), (starts, pairs) in diagonals.items():
            count = Counter((x, y) for _, x, y in pairs)
            strength = {p: (c, p[0] == p[1]) for p, c in count.items()}
            bad = {at for at, x, y in pairs if any(o != (x, y) and (o[0] == x or o[1] == y) and strength[o] >= strength[x, y] for o in count)}
            for s in starts:
                if not bad & set(range(s, s + size)):
                    covered[item, n].update(range(s, s + size))
        hit = {item: len(c) / n for (item, n), c in covered.items() if len(c) / n >= 0.6}
        if hit:
            found[doc] = hit
    return found


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_equals_plain_loops(spark):
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    for i, (_, text) in enumerate(items[:60]):
        words = [str(rng.randrange(90)) if w.isdigit() and rng.random() < 0.7 else "Zora" if w.istitle() and rng.random() < 0.3 else w for w in text.split()]
        if rng.random() < 0.5 and len(words) > 6:
            words[rng.randrange(len(words))] = "different"
        docs.append((10**6 + i, f"Before. {' '.join(words)} after"))
    want = _reference(docs, items)
    got = {r["doc_id"]: r for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(want) and len(got) > 30 and all(set(r["item_ids"]) <= set(want[d]) for d, r in got.items())
    assert all(r["share"] == max(want[d][i] for i in r["item_ids"]) for d, r in got.items())


def test_repeated_rows_and_items(spark):
    items = spark.createDataFrame([(1, "What is the sum of twelve and the number nine in this case ?"), (1, "What is the sum of twelve and the number nine in this case ?"), (2, "Name the largest of these four rivers that flow to the north sea .")], "item_id long, text string")
    rows = [(5, "Intro. What is the sum of fifteen and the number seven in this case ? Right.")] * 3 + [(5, "clean words only"), (6, "Name the largest of these four rivers that flow to the north sea .")] + [(7, "clean words only")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `a.b`", "2 as __gone", "3 as item")
    got = decontamination.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], list(r["item_ids"])) for r in got) == [(5, [1]), (6, [2])]


OPENING = "Read the passage below and answer the question that follows it with care :"


@pytest.mark.parametrize("most", [2**25, 1])
def test_windows_of_many_items_make_no_pairs(spark, monkeypatch, most):
    """Items and documents that share an opening phrase: candidates come from other windows, and none is lost."""
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    tables, write = {}, decontamination.staged
    monkeypatch.setattr(decontamination, "staged", lambda df, name: tables.setdefault(name, write(df, name)))
    rng = random.Random(5)
    own = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    items = [(i, f"{OPENING} {own(25)}") for i in range(60)]
    docs = [(i, f"{own(9)} {OPENING} {own(20)}") for i in range(60)] + [(100 + i, f"{own(5)} {items[i][1]} {own(5)}") for i in range(7)]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (list(r["item_ids"]), r["share"]) for r in got} == {100 + i: ([i], 1.0) for i in range(7)}
    probes, hits = tables["probes"], tables["hits"]
    assert hits.join(probes, ["h", "size"]).select("k", "item").distinct().count() == 7


def test_probes():
    assert decontamination._probes(20, 8, dict.fromkeys(range(13), 1), 0.6) == [4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert decontamination._probes(20, 8, dict.fromkeys(range(9), 1) | dict.fromkeys(range(9, 13), 9), 0.6) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert decontamination._probes(5, 5, {0: 9}, 0.6) == [0] and decontamination._probes(20, 8, {0: 1}, 1.1) == []
    assert decontamination._probes(20, 8, dict.fromkeys(range(13), 1), 0.0) == list(range(13))


def test_all_sentence_starts(spark):
    """A window of eight words that all may start sentences is met in each reading."""
    text = "Yes. Clara! Then. Maria? Once. Again. Down. Under. all of them went home and nobody said a word of it"
    docs = [(1, text), (2, text.replace("Clara", "Dora")), (3, f"{text.lower()}")]
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = {r["doc_id"] for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items, window=8).collect()}
    h, kind, unsure = decontamination.Templates().tokens(text.split()[:8])
    names = {n for _, n, _ in decontamination._readings(h, kind, unsure, 8)}
    assert unsure.all() and len(names) == sum(1 for bits in range(256) if bits.bit_count() >= 4) + 1 and 1 in got
