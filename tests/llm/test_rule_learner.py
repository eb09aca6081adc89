"""The learned decision list against sequential covering by plain counting."""

from __future__ import annotations

import math
from pathlib import Path

import pytest
import xxhash

from strandline.llm import common, quality
from strandline.llm.common import table

SF = "/root/testdata/sf0.01"


def quantile(values, p):
    """Interpolated, as SQL's percentile."""
    place = p * (len(values) - 1)
    low, high = math.floor(place), math.ceil(place)
    return values[low] if low == high else (high - place) * values[low] + (place - low) * values[high]


def grows(key):
    h = xxhash.xxh64(str(key).encode(), seed=42).intdigest()
    return (h - 2**64 if h >= 2**63 else h) % 3 < 2


def holds(condition, row):
    feature, at_least, cut = condition
    return row[feature] >= cut if at_least else row[feature] < cut


def plain_rules(rows, features, key, *, most_rules=8, most_conditions=3, least=8, precision=0.95):
    """rows: dicts with the features, the key and ``bad``."""
    cuts = {}
    for f in features:
        sides = [sorted(float(r[f]) for r in rows if r["bad"] == side) for side in (True, False)]
        cuts[f] = sorted({quantile(v, i / 24) for v in sides if v for i in range(25)})
    rules, left = [], rows
    while len(rules) < most_rules:
        inside, rule = [r for r in left if grows(r[key])], []
        while len(rule) < most_conditions:
            p_all, best = sum(r["bad"] for r in inside), None
            if p_all in (0, len(inside)):
                break
            for f in sorted(features):
                for cut in cuts[f]:
                    for at_least in (False, True):
                        met = [r["bad"] for r in inside if holds((f, at_least, cut), r)]
                        p = sum(met)
                        if p < least:
                            continue
                        gain = p * (math.log2(p / len(met)) - math.log2(p_all / len(inside)))
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, (f, at_least, cut), len(met) - p)
            if best is None:
                break
            rule.append(best[1])
            inside = [r for r in inside if holds(best[1], r)]
            if best[2] == 0:
                break
        # the shortest prefix that does best on the rows held back
        kept = None
        for n in range(1, len(rule) + 1):
            met = [r for r in left if all(holds(c, r) for c in rule[:n])]
            grown, held = ([r["bad"] for r in met if grows(r[key]) is g] for g in (True, False))
            judged = held or grown
            worth = (2 * sum(judged) - len(judged)) / len(judged) if judged else 0
            if sum(grown) >= least and (kept is None or worth > kept[0]):
                kept = (worth, rule[:n], sum(judged) / len(judged), len(met))
        if kept is None or kept[2] < precision:
            break
        rules.append(kept[1:])
        left = [r for r in left if not all(holds(c, r) for c in kept[1])]
    return rules


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_rules_equal_plain_covering(spark, label):
    stats = common.staged(quality.text_statistics(table(spark, SF, "documents")), "statistics")
    labels = {r["doc_id"]: r[label] for r in table(spark, SF, "labels").collect()}
    rows = [{**r.asDict(), "bad": labels[r["doc_id"]] == 0} for r in stats.collect() if labels.get(r["doc_id"]) is not None]
    got = quality.learn(stats, table(spark, SF, "labels"), label=label)
    want = plain_rules(rows, quality.FEATURES, "doc_id")
    assert [[(c.feature, c.at_least, c.threshold) for c in r.conditions] for r in got] == [r[0] for r in want]
    assert [(r.precision, r.covered) for r in got] == [(pytest.approx(r[1]), r[2]) for r in want]
    assert label == "toxic" or want
