"""Lexical search against SQL and a plain ranking of all documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import lexical_search as S
from strandline.llm.common import staged

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """Every document's score for every item."""
    docs = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n_docs, length, out = len(docs), sum(n for *_, n in docs), []
    df = Counter(t for _, c, _ in docs for t in c)
    for item, text in items:
        scored = []
        for d, counts, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in words(text) if t in counts)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, rank, d, -score) for rank, (score, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_query_equals_sql_and_plain_ranking(spark):
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in S.query(spark, SF).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert got == sorted(con.execute(S.ORACLE_SQL).fetchall())
    docs, items = (con.execute(f"SELECT * FROM (SELECT {k}, text FROM {t})").fetchall() for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert got == sorted(plain(docs, items, 20)) and len(got) > 500


ROWS = [
    (1, "The quick fox"), (2, "the QUICK brown fox fox"), (3, None), (4, ""), (5, "... ---"), (None, "quick fox"), (6, "quick fox"), (7, "quick fox"), (7, "quick fox"), (8, "Ünïcode É é 12"),
    (9, "word " * 50_000 + "fox"), (10, "fox " * 30), (-3, "quick fox"), (11, "under_score\tand\x00nul fox's"),
]
ITEMS = [(1, "quick FOX"), (2, None), (3, ""), (4, "unknown"), (None, "fox"), (5, "fox fox é É"), (5, "the word score nul s")]


@pytest.mark.parametrize("shard_docs", [1, 3, 100])
@pytest.mark.parametrize("k", [1, 4, 20])
def test_odd_rows(spark, monkeypatch, shard_docs, k):
    monkeypatch.setattr(S, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(S, "BLOCK_TERMS", 3 if k == 4 else 2**20)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as k", "2 as body", "3 as `a.b`", "4 as terms").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as item", "2 as score", "3 as rank")
    index = staged(S.build_index(docs), "index")
    got = S.search(index, items, k=k).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == Counter(plain(ROWS, ITEMS, k))
    assert S.search(index, items.limit(0), k=k).collect() == []
    assert S.search(staged(S.build_index(docs.limit(0)), "index"), items, k=k).collect() == []


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "two one"), (None, "one two")], "name string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    got = S.search(staged(S.build_index(docs, key="name"), "index"), items, doc_key="name").orderBy("rank").collect()
    assert [r["name"] for r in got] == ["a", "b", None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=30))
def test_packed_numbers(values):
    data, ends = S.pack(np.array(values, np.int64))
    assert S.unpack(data.tobytes()).tolist() == values and (not values or ends[-1] == len(data))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 9), min_size=1), max_size=6), st.integers(1, 5), st.integers(1, 3))
def test_merge_equals_sums(lists, k, times):
    def postings(d):
        p = object.__new__(S.Postings)
        p.docs, p.adds = sorted(d), [d[x] for x in sorted(d)]
        p.most, p.kth = max(p.adds), sorted(p.adds)[-k] if len(d) >= k else 0
        return p

    total = Counter()
    for i, d in enumerate(lists):
        for doc, add in d.items():
            total[doc] += add * (times + i % 2)
    want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    assert S.best([(postings(d), times + i % 2) for i, d in enumerate(lists)], k) == want
