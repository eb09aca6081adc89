"""Catalogue queries against results worked out from the view's rows, not from their own SQL."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from pathlib import Path

import pytest

from strandline import schema
from strandline.plans import catalog, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def test_term_structure_has_every_expiry(spark):
    want = {(str(r["time"])[:10], r["option_type"], r["days_to_expiry"]) for r in schema.options(spark, SF).collect() if r["days_to_expiry"] > 0}
    got = [(r["day"], r["option_type"], r["days_to_expiry"]) for r in registry.queries()["q17_atm_term_structure"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(d for _, _, d in want) > 30


def test_greeks_hold_every_contract(spark):
    want, got = Counter(), Counter()
    for r in schema.options(spark, SF).collect():
        want[(int(Fraction(r["moneyness"]) * 1000 + Fraction(1, 2)) + 5) // 10 / 100] += float(r["option_volume"])
    for r in registry.queries()["q19_greeks_by_bucket"](spark, SF).collect():
        got[r["m"]] += float(r["volume"])
    assert got == want


def test_names_of_views_in_text_stay(spark):
    got = catalog.run(spark, SF, "SELECT 'all trades' AS trades, COUNT(*) AS n FROM trades WHERE ticker <> :t", {"t": "trades"}).first()
    assert got["trades"] == "all trades" and got["n"] > 0
