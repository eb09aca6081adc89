"""Each pipeline stage over all documents of the smallest tables against a plain version."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import pytest
from test_brute_force import near_reference
from test_decontamination_edits import _reference

import corpus_pipeline
from strandline.llm import common, quality
from strandline.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def unit(text):
    return (int(md5(text)[:13], 16) + 0.5) / 2**52


def copies(rate, doc):
    assert rate <= 16
    u, p, k = unit(f"mix|0|{doc}"), math.exp(-rate), 0
    total = p
    while u >= total:
        k += 1
        p *= rate / k
        total += p
    return k


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = rows_of(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = rows_of(docs)
    return out


def test_quality(spark):
    larger = "/root/testdata/sf0.01"  # the smallest tables have too few labels for a rule
    docs = table(spark, larger, "documents")
    stats = common.staged(quality.text_statistics(docs), "statistics")
    rules = quality.learn(stats, table(spark, larger, "labels"))
    got = [r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, larger).collect()]
    stats = {r["doc_id"]: r for r in stats.collect()}

    def fires(rule, s):
        return all(s[c.feature] >= c.threshold if c.at_least else s[c.feature] < c.threshold for c in rule.conditions)

    want = [i for i, s in stats.items() if s["n_words"] >= 20 and s["n_repeat_words"] * 100 <= 30 * s["n_words"] and not any(fires(r, s) for r in rules)]
    assert rules and sorted(got) == sorted(want)


def test_near_duplicates_of_all(spark, outputs):
    want = [i for i, (_, c) in near_reference([(r["doc_id"], r["text"]) for r in outputs["quality_rules"]], 5, 80).items() if i == c]
    assert sorted(r["doc_id"] for r in outputs["near_duplicates"]) == sorted(want)


def test_contaminated(spark, outputs):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    gone = _reference([(r["doc_id"], r["text"]) for r in outputs["near_duplicates"]], items)
    assert sorted(r["doc_id"] for r in outputs["benchmark_decontamination"]) == sorted(r["doc_id"] for r in outputs["near_duplicates"] if r["doc_id"] not in gone)


def test_mixed_and_sharded(spark, outputs):
    docs = outputs["benchmark_decontamination"]
    n = Counter(r["source"] for r in docs)
    whole = sum(math.sqrt(c) for c in n.values())
    times = {r["doc_id"]: copies(round(math.sqrt(n[r["source"]]) / whole * len(docs) / n[r["source"]], 9), r["doc_id"]) for r in docs}
    assert Counter(r["doc_id"] for r in outputs["mixing_sources"]) == Counter({i: k for i, k in times.items() if k})
    last, by_shard = outputs["rendezvous_sharding"], {}
    assert Counter((r["doc_id"], r["text"]) for r in last) == Counter((r["doc_id"], r["text"]) for r in outputs["mixing_sources"])
    for r in last:
        scores = [(-math.log(unit(f"0|{j}|{r['doc_id']}")), j) for j in range(17)]
        assert r["shard"] == min(scores[:16])[1] and r["grown_shard"] == min(scores)[1]
        assert r["text_crc32"] == zlib.crc32(r["text"].encode()) and r["size"] == len(r["text"].encode()) + 1
        by_shard.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    beside = 0
    for members in by_shard.values():
        members.sort()
        assert [s for s, _ in members] == list(range(len(members)))
        beside += sum(a[1] == b[1] for a, b in zip(members, members[1:], strict=False))
    repeats = sum(k - 1 for k in times.values() if k)
    assert repeats > 5 and beside < repeats / 2  # replicas don't lie side by side


def test_staged_tables_go(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert left == ["mixing_sources", "shards"]
