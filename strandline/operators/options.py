"""Option-chain aggregates: one pass of conditional sums per (underlying, snapshot) group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OptionsConfig:
    expiries: tuple[int, ...] = (7, 30, 60, 90)
    moneyness: tuple[float, ...] = (0.95, 0.975, 1.0, 1.025, 1.05)
    surface: bool = True
    greeks: bool = True
    ratios: bool = True
    slope: bool = True

    def __post_init__(self) -> None:
        if not self.expiries or min(self.expiries) <= 0 or not self.moneyness or min(self.moneyness) <= 0:
            raise ValueError("expiries and moneyness must be positive, at least one each")

    def names(self) -> list[str]:
        out = [f"iv_{b}d_m{int(m * 100)}" for b in self.expiries for m in self.moneyness] if self.surface else []
        out += ["net_delta", "net_gamma", "net_vega", "net_theta"] if self.greeks else []
        out += ["pc_volume_ratio", "pc_oi_ratio"] if self.ratios else []
        return out + (["term_slope"] if self.slope else [])


def moneyness(strike: Column, spot: Column, *, strict: bool = False) -> Column:
    """strike / spot; without a positive spot null, or an error if ``strict``."""
    bad = F.raise_error(F.lit("spot must be positive")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(spot > 0, strike / spot).otherwise(bad)


def days_to_expiry(expiry: Column, now: Column) -> Column:
    """Days as a fraction, 0 once expired."""
    return F.greatest((F.unix_micros(expiry) - F.unix_micros(now)) / F.lit(86_400_000_000.0), F.lit(0.0))


def _in_expiry(days: Column, bucket: int) -> Column:
    return F.abs(days - F.lit(float(bucket))) <= F.lit(min(0.3 * bucket, 7.0))


def _weighted_iv(m: Column, days: Column, iv: Column, center: float, width: float, bucket: int) -> Column:
    """Mean IV weighted by closeness to ``center``; the band is open, the expiry margin closed."""
    off = F.abs(m - F.lit(center))
    inside = (off < F.lit(width)) & _in_expiry(days, bucket) & iv.isNotNull()
    weight = F.when(inside, F.lit(1.0) / (off + F.lit(0.001)))
    return F.sum(iv * weight) / F.sum(weight)


def atm_iv(m: Column, days: Column, iv: Column, expiries: Sequence[int]) -> dict[str, Column]:
    return {f"atm_iv_{b}d": _weighted_iv(m, days, iv, 1.0, 0.02, b) for b in expiries}


def iv_surface(m: Column, days: Column, iv: Column, cfg: OptionsConfig) -> dict[str, Column]:
    """Expiry-major grid of weighted IVs; names cut percent to whole numbers, as m97 for 0.975."""
    return {f"iv_{b}d_m{int(x * 100)}": _weighted_iv(m, days, iv, x, 0.015, b) for b in cfg.expiries for x in cfg.moneyness}


def net_greeks(delta: Column, gamma: Column, vega: Column, theta: Column, oi: Column) -> dict[str, Column]:
    """Means weighted by open interest (gamma by size); null without open interest."""
    total = F.sum(oi)
    mean = lambda x: F.when(total > 0, F.sum(x * oi) / total)
    return {"net_delta": mean(delta), "net_gamma": mean(F.abs(gamma)), "net_vega": mean(vega), "net_theta": mean(theta)}


def put_call_ratios(kind: Column, volume: Column, oi: Column) -> dict[str, Column]:
    """Put over call sums; null without calls, 0 without puts."""

    def ratio(x: Column) -> Column:
        calls = F.sum(F.when(kind == "call", x))
        return F.when(calls > 0, F.coalesce(F.sum(F.when(kind == "put", x)), F.lit(0.0)) / calls)

    return {"pc_volume_ratio": ratio(volume), "pc_oi_ratio": ratio(oi)}


def term_slope(ivs: Sequence[tuple[float, Column]]) -> Column:
    """Least-squares slope of IV on days over buckets that have one; null under two points."""
    known = lambda f: sum((F.when(v.isNotNull(), f(F.lit(float(d)), v)).otherwise(F.lit(0.0)) for d, v in ivs), F.lit(0.0))
    n, sx, sy = known(lambda d, v: F.lit(1.0)), known(lambda d, v: d), known(lambda d, v: v)
    mx, my = sx / F.nullif(n, F.lit(0.0)), sy / F.nullif(n, F.lit(0.0))
    sxy, sxx = known(lambda d, v: (d - mx) * (v - my)), known(lambda d, v: (d - mx) * (d - mx))
    return F.when((n >= 2) & (sxx >= 1e-10), F.try_divide(sxy, sxx))


def options_features(df: DataFrame, *, keys: Sequence[str | Column], cfg: OptionsConfig = OptionsConfig()) -> DataFrame:
    """All configured features of each group, by partial aggregation in one shuffle; raises if input columns lack."""
    needed = {"surface": ["moneyness", "days_to_expiry", "implied_vol"], "slope": ["moneyness", "days_to_expiry", "implied_vol"], "greeks": ["delta", "gamma", "vega", "theta", "open_interest"], "ratios": ["option_type", "option_volume", "open_interest"]}
    for part, columns in needed.items():
        if getattr(cfg, part) and (missing := [c for c in columns if c not in df.columns]):
            raise ValueError(f"{part} needs {', '.join(missing)}")
    c = F.col
    aggs: dict[str, Column] = {}
    if cfg.surface:
        aggs |= iv_surface(c("moneyness"), c("days_to_expiry"), c("implied_vol"), cfg)
    if cfg.greeks:
        aggs |= net_greeks(*(c(x) for x in ("delta", "gamma", "vega", "theta", "open_interest")))
    if cfg.ratios:
        aggs |= put_call_ratios(c("option_type"), c("option_volume"), c("open_interest"))
    atm = atm_iv(c("moneyness"), c("days_to_expiry"), c("implied_vol"), cfg.expiries) if cfg.slope else {}
    if not aggs and not atm:
        return df.select(*keys).distinct()
    out = df.groupBy(*keys).agg(*[v.alias(k) for k, v in (aggs | atm).items()])
    if cfg.slope:
        out = out.withColumn("term_slope", term_slope([(b, c(f"atm_iv_{b}d")) for b in cfg.expiries]))
    return out.drop(*atm)
