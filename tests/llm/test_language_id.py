"""Language mixtures against plain loops, held-out accuracy, and mixed texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language_id as L

SF = Path("/root/testdata")
needs_tables = pytest.mark.skipif(not (SF / "sf0.001").exists(), reason="no test tables here")
MASK = 2**64 - 1


def plain_grams(text, buckets):
    words = re.findall(r"[^\W\d_]+", text.lower())
    body = " " + " ".join(words) + " " if any(c.isalpha() for w in words for c in w) else ""
    out = Counter()
    for i in range(len(body) - 2):
        h = sum(ord(c) * f for c, f in zip(body[i : i + 3], (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True)) & MASK
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & MASK
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & MASK
        h ^= h >> 31
        out[h % buckets] += 1
    return out


def plain_model(rows, smooth=0.1):
    """Distribution of each language over the buckets, as a function of a bucket."""
    languages = sorted({lang for _, lang in rows})
    size, counts = L.buckets_for(len(languages)), {x: Counter() for x in languages}
    for text, lang in rows:
        counts[lang].update(plain_grams(text, size))
    totals = {x: sum(c.values()) + smooth * size for x, c in counts.items()}
    return size, {x: lambda g, x=x: (counts[x][g] + smooth) / totals[x] for x in languages}


def plain_shares(text, size, model, penalty=2.0):
    found = plain_grams(text, size)
    total = sum(found.values())
    if not total:
        return {}
    p = {x: {g: f(g) for g in found} for x, f in model.items()}
    mean = lambda pi: {g: sum(w * p[x][g] for x, w in pi.items()) for g in found}
    likelihood = lambda pi: sum(c * math.log(m) for c, m in zip(found.values(), mean(pi).values(), strict=True))
    pi = {max(p, key=lambda x: (likelihood({x: 1.0}), [-ord(c) for c in x])): 1.0}
    while len(pi) < len(p):
        m = mean(pi)
        slopes = {x: sum(c * p[x][g] / m[g] for g, c in found.items()) - total for x in p if x not in pi}
        more = max(slopes, key=slopes.get)
        if slopes[more] <= 0:
            break
        trial = {x: w * 0.9 for x, w in pi.items()} | {more: 0.1}
        for _ in range(60):
            m = mean(trial)
            new = {x: sum(c * w * p[x][g] / m[g] for g, c in found.items()) / total for x, w in trial.items()}
            moved = max(abs(new[x] - trial[x]) for x in trial)
            trial = new
            if moved <= 1e-4:
                break
        if likelihood(trial) - likelihood(pi) <= penalty * math.log(max(total, 2)):
            break
        pi = trial
    return pi


@needs_tables
def test_query_equals_plain_loops(spark):
    rows = spark.read.parquet(f"{SF}/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    learns = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    size, model = plain_model([(t, lang) for i, t, lang in rows if learns(i) and t is not None and lang is not None])
    got = {r["doc_id"]: r for r in L.query(spark, f"{SF}/sf0.001").collect()}
    assert len(got) == len(rows)
    mixtures = 0
    for i, text, _ in rows:
        want, r = plain_shares(text or "", size, model), got[i]
        assert r["held_out"] == (not learns(i)) and set(r["langs"]) == set(want)
        assert all(want[x] == pytest.approx(s, abs=1e-6) for x, s in zip(r["langs"], r["shares"], strict=True))
        assert r["lang_pred"] == (r["langs"][0] if want else "und") and r["score"] == (r["shares"][0] if want else 0.0)
        mixtures += len(want) > 1
    assert mixtures > 0


@needs_tables
def test_held_out_accuracy(spark):
    d = f"{SF}/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    right = L.query(spark, d).where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99


@needs_tables
def test_mixed_texts_have_their_shares(spark):
    docs = spark.read.parquet(f"{SF}/sf0.01/documents.parquet")
    model = L.learn(docs)
    parts = {x: " ".join(r[0] for r in docs.where(F.col("lang") == x).select("text").limit(8).collect()) for x in ("de", "es", "fr")}
    rows = [(1, parts["de"][:3000] + " " + parts["es"][:3000]), (2, parts["fr"][:4500] + " " + parts["de"][:1500]), (3, parts["es"][:2000] + " " + parts["fr"][:2000] + " " + parts["de"][:2000]), (4, parts["fr"][:3000])]
    got = {r["doc_id"]: dict(zip(r["langs"], r["shares"], strict=True)) for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {k: set(v) for k, v in got.items()} == {1: {"de", "es"}, 2: {"fr", "de"}, 3: {"de", "es", "fr"}, 4: {"fr"}}
    assert abs(got[1]["de"] - 0.5) < 0.1 and abs(got[2]["fr"] - 0.75) < 0.1 and all(abs(x - 1 / 3) < 0.1 for x in got[3].values())


def test_odd_rows(spark, monkeypatch):
    learn = [("one two three", "en"), ("un deux trois", "fr"), (None, "fr"), ("eins zwei", None), ("", "xx"), ("1 2 3", "xx")]
    model = L.learn(spark.createDataFrame(learn, "text string, lang string").selectExpr("*", "1 as body", "2 as `a.b`", "3 as n"))
    assert model.languages == ("en", "fr", "xx")
    letters = [None, "", "12 + 3 = 15", "½ ² Ⅷ", "_", "\U0001f642"]
    rows = [(i, t) for i, t in enumerate(letters)] + [(10, "three"), (None, "deux"), (10, "three"), (11, "THREE two " * 40_000), (12, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as body", "3 as `a.b`", "4 as score")
    got = L.identify(df, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"], r["langs"]) for r in got}
    assert all(by[i] == ("und", 0.0, []) for i in range(len(letters)))
    assert by[10][0] == by[11][0] == "en" and by[None][0] == "fr" and by[12][0] in model.languages and all(0 <= x[1] <= 1 for x in by.values())
    assert L.identify(df.limit(0), model).collect() == []
    none = L.learn(spark.createDataFrame([("a", None)], "text string, lang string"))
    assert none is None and {r["lang_pred"] for r in L.identify(df, none).collect()} == {"und"}
    monkeypatch.setattr(L, "CHUNK_NUMBERS", 64)  # chunks don't matter
    assert {r["doc_id"]: (r["lang_pred"], r["score"], r["langs"]) for r in L.identify(df, model).collect()} == by
    same = L.Model(("a", "b"), np.zeros((L.BUCKETS, 2)), 2.0, 10)
    assert {r["lang_pred"] for r in L.identify(df.where("doc_id = 10"), same).collect()} == {"a"}  # ties
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        L.learn(spark.createDataFrame(learn, "text string, lang string"))
