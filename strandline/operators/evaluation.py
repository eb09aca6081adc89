"""Metrics, losses, calibration and parity of predicted distributions, grouped by horizon."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A


def default_centers(n: int, low: float = -50.0, high: float = 50.0) -> list[float]:
    return [float(x) for x in np.linspace(low, high, n)]


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def with_probabilities(df: DataFrame, logits: str = "logits", temperature: Column | float = 1.0) -> DataFrame:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return df.withColumn("probs", A.softmax(F.transform(logits, lambda x: x / t)))


def brier_by_bucket(df: DataFrame) -> DataFrame:
    """Mean squared error of each bucket's probability, by horizon."""
    rows = df.select("horizon", "target", F.posexplode("probs").alias("bucket", "p"))
    hit = F.when(F.col("bucket") == F.col("target"), 1.0).otherwise(0.0)
    return rows.groupBy("horizon", "bucket").agg(F.avg(F.pow(F.col("p") - hit, F.lit(2.0))).alias("brier"))


def confidence_bin(confidence: Column, bins: int) -> Column:
    """Inner edges at or below the confidence: an edge goes to the upper bin."""
    return F.size(F.filter(literal([i / bins for i in range(1, bins)]), lambda e: e <= confidence))


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """horizon, bin, n, confidence and accuracy of all bins; empty ones have 0."""
    if bins < 1:
        raise ValueError("bins must be 1 or more")
    judged = df.select("horizon", F.array_max("probs").alias("c"), (A.argmax(F.col("probs")) == F.col("target")).cast("double").alias("ok")).withColumn("bin", confidence_bin(F.col("c"), bins))
    filled = judged.groupBy("horizon", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("ok").alias("accuracy"))
    frame = judged.select("horizon").distinct().select("horizon", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(filled, ["horizon", "bin"], "left").na.fill(0).na.fill(0.0)


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and greatest calibration error by horizon."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return calibration_bins(df, bins).groupBy("horizon").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(F.when(F.col("n") > 0, gap).otherwise(0.0)).alias("mce"))


def bucket_calibration(df: DataFrame, n: int) -> DataFrame:
    """For rows predicted as a bucket: mean probability of it, share that was right, count; empty buckets have 0."""
    judged = df.select("horizon", A.argmax(F.col("probs")).alias("bucket"), F.array_max("probs").alias("p"), "target")
    filled = judged.groupBy("horizon", "bucket").agg(F.avg("p").alias("predicted"), F.avg((F.col("bucket") == F.col("target")).cast("double")).alias("actual"), F.count(F.lit(1)).alias("n"))
    frame = judged.select("horizon").distinct().select("horizon", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))
    return frame.join(filled, ["horizon", "bucket"], "left").na.fill(0).na.fill(0.0)


def with_moments(df: DataFrame, centers: Sequence[float]) -> DataFrame:
    c = literal(centers)
    return df.withColumns({"mean_bps": A.mean_of(F.col("probs"), c), "std_bps": A.std_of(F.col("probs"), c), "actual_bps": F.get(c, F.col("target"))})


def metrics_by_horizon(df: DataFrame, centers: Sequence[float], *, threshold: float = 0.0, bins: int = 10) -> DataFrame:
    """nll, brier, entropy, sharpness, directional accuracy (0.5 if no row passes), ece and mce by horizon."""
    p, t = F.col("probs"), F.col("target")
    rows = with_moments(df, centers).select("horizon", "mean_bps", "std_bps", "actual_bps", A.log_likelihood(p, t).alias("ll"), A.brier(p, t).alias("br"), A.entropy(p).alias("h"))
    counts = (F.abs("mean_bps") > threshold) & (F.abs("actual_bps") > threshold)
    right = F.when(counts, (F.signum("mean_bps") == F.signum("actual_bps")).cast("double"))
    out = rows.groupBy("horizon").agg((-F.avg("ll")).alias("nll"), F.avg("br").alias("brier"), F.avg("h").alias("entropy"), F.avg("std_bps").alias("sharpness"), F.coalesce(F.avg(right), F.lit(0.5)).alias("directional_accuracy"), F.count(F.lit(1)).alias("n"))
    return out.join(calibration_error(df, bins), "horizon")


def metrics_overall(by_horizon: DataFrame) -> DataFrame:
    """Unweighted means over horizons."""
    return by_horizon.agg(*[F.avg(c).alias(c) for c in ("nll", "brier", "ece", "directional_accuracy")])


def simulate_pnl(df: DataFrame, centers: Sequence[float], *, confidence: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """Trades in the direction of the mean where confident: total, mean, win rate, Sharpe (not annualised) and count."""
    trade = (F.array_max("probs") > confidence) & (F.abs("mean_bps") > threshold)
    pnl = F.when(trade, F.signum("mean_bps") * F.col("actual_bps"))
    sums = with_moments(df, centers).groupBy("horizon").agg(F.sum(pnl).alias("s"), F.avg(pnl).alias("m"), F.avg((pnl > 0).cast("double")).alias("w"), F.stddev_pop(pnl).alias("d"), F.count(pnl).alias("n_trades"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sharpe = F.when((F.col("n_trades") > 1) & (F.col("d") > 0), F.col("m") / F.col("d")).otherwise(0.0)
    return sums.select("horizon", zero("s").alias("total_pnl"), zero("m").alias("mean_pnl"), zero("w").alias("win_rate"), sharpe.alias("sharpe"), "n_trades")


def calibration_quality(mean_ece: float) -> str:
    return next((name for bound, name in ((0.05, "excellent"), (0.10, "good"), (0.15, "fair")) if mean_ece < bound), "poor")


def report(rows: Mapping[int, Mapping[str, float]]) -> str:
    """Text table of a few horizons' metrics (after ``collect``)."""
    names = sorted({k for r in rows.values() for k in r})
    head = "horizon".ljust(8) + "".join(n.rjust(22) for n in names)
    return "\n".join([head, *(f"{h}s".ljust(8) + "".join(f"{rows[h].get(n, float('nan')):22.4f}" for n in names) for h in sorted(rows))])


# Losses


def loss(kind: str, logits: Column, target: Column, n: int, *, sigma: float = 1.0, gamma: float = 2.0, power: int = 2) -> Column:
    """Row loss by name: ``emd``, ``soft_ce`` or ``focal``."""
    if kind == "emd":
        return A.emd(A.softmax(logits), A.one_hot(target, F.lit(n)), power)
    if kind == "soft_ce":
        weights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(F.lit(-0.5) * F.pow((i - target) / F.lit(float(sigma)), F.lit(2.0))))
        return A.soft_cross_entropy(logits, A.let(weights, lambda w: A.let(A.total(w), lambda s: F.transform(w, lambda x: x / s))))
    if kind == "focal":
        return A.focal(F.get(A.softmax(logits), target), gamma)
    raise ValueError(f"no loss {kind!r}")


def reduced(value: Column, how: str) -> Column:
    if how not in ("mean", "sum"):
        raise ValueError("how must be mean or sum; keep the row column for none")
    return F.avg(value) if how == "mean" else F.sum(value)


def multi_horizon_loss(by_horizon: DataFrame, weights: Mapping[int, float], value: str = "loss") -> DataFrame:
    """Weighted sum of the horizons' losses, weights normalised to 1; every horizon needs a weight."""
    found = {r["horizon"] for r in by_horizon.select("horizon").distinct().collect()}
    if found != set(weights) or not sum(weights.values()) > 0:
        raise ValueError("weights must name exactly the horizons and have a positive sum")
    s = sum(weights.values())
    w = F.create_map(*[x for h, v in sorted(weights.items()) for x in (F.lit(h), F.lit(v / s))])
    return by_horizon.agg(F.sum(F.col(value) * F.element_at(w, F.col("horizon"))).alias("loss"))


# Calibration


class TemperatureScaling:
    """softmax(logits / T) with T of least negative log likelihood, for each horizon; Newton steps on 1 / T.

    Each step is one aggregation of the first two derivatives by horizon; logits never leave the executors.
    """

    def __init__(self, max_steps: int = 50, tolerance: float = 1e-8) -> None:
        if max_steps < 1 or tolerance <= 0:
            raise ValueError("max_steps and tolerance must be positive")
        self.max_steps, self.tolerance, self.temperatures = max_steps, tolerance, None

    def fit(self, df: DataFrame, logits: str = "logits", target: str = "target", horizon: str = "horizon") -> TemperatureScaling:
        rows = df.select(F.col(horizon).alias("h"), F.col(logits).alias("x"), F.get(logits, F.col(target)).alias("xt")).persist()
        beta = {r["h"]: 1.0 for r in rows.select("h").distinct().collect()}
        for _ in range(self.max_steps):
            b = F.element_at(F.create_map(*[v for h, x in beta.items() for v in (F.lit(h), F.lit(x))]), F.col("h"))
            step = rows.withColumn("p", A.softmax(F.transform("x", lambda v: v * b))).withColumn("m", A.dot(F.col("p"), F.col("x")))
            second = A.total(F.zip_with("p", "x", lambda p, x: p * x * x)) - F.col("m") * F.col("m")
            got = step.groupBy("h").agg(F.avg(F.col("m") - F.col("xt")).alias("g"), F.avg(second).alias("c")).collect()
            moved = 0.0
            for r in got:
                change = max(-0.5 * beta[r["h"]], min(2.0 * beta[r["h"]], -r["g"] / max(r["c"], 1e-12)))
                beta[r["h"]] += change
                moved = max(moved, abs(change))
            if moved < self.tolerance:
                break
        rows.unpersist()
        self.temperatures = {h: 1.0 / b for h, b in beta.items()}
        return self

    def transform(self, df: DataFrame, logits: str = "logits", horizon: str = "horizon") -> DataFrame:
        if self.temperatures is None:
            raise RuntimeError("fit first")
        t = F.element_at(F.create_map(*[v for h, x in self.temperatures.items() for v in (F.lit(h), F.lit(x))]), F.col(horizon))
        return with_probabilities(df, logits, t)


class PlattScaling:
    """softmax(a * logits + b) with a, b from a logistic fit of "argmax is right" on the greatest logit (b cancels)."""

    def __init__(self) -> None:
        self.a = self.b = None

    def fit(self, df: DataFrame, logits: str = "logits", target: str = "target") -> PlattScaling:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        rows = df.select(array_to_vector(F.array(F.array_max(logits))).alias("features"), (A.argmax(F.col(logits)) == F.col(target)).cast("double").alias("label"))
        model = LogisticRegression(regParam=0.0, maxIter=200, tol=1e-12).fit(rows)
        self.a, self.b = float(model.coefficients[0]), float(model.intercept)
        return self

    def transform(self, df: DataFrame, logits: str = "logits") -> DataFrame:
        if self.a is None:
            raise RuntimeError("fit first")
        out = df.withColumn("probs", A.softmax(F.transform(logits, lambda x: x * F.lit(self.a) + F.lit(self.b))))
        return out.withColumn("right", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.array_max(logits) * F.lit(self.a) + F.lit(self.b)))))


def calibration_tail(df: DataFrame, *, keys: Sequence[str], index: str, share: float = 0.2) -> DataFrame:
    """The last ``share`` of each series, which calibration is fitted on; at least one row of a series that isn't empty."""
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(sizes, list(keys)).where(F.col(index) >= F.least(F.floor(F.col("__n") * F.lit(1 - share)), F.col("__n") - 1)).drop("__n")


def calibration_report(before: Mapping[int, Mapping[str, float]], after: Mapping[int, Mapping[str, float]], temperatures: Mapping[int, float] | None = None) -> str:
    """Text of what calibration changed: by horizon nll and ece before and after, the temperature, and a verdict."""
    lines = ["horizon    nll before  nll after  ece before  ece after  temperature"]
    for h in sorted(after):
        b, a = before[h], after[h]
        t = f"{temperatures[h]:.3f}" if temperatures else "-"
        lines.append(f"{h}s".ljust(8) + f"{b['nll']:13.4f}{a['nll']:11.4f}{b['ece']:12.4f}{a['ece']:11.4f}{t:>13}")
    mean = sum(a["ece"] for a in after.values()) / max(1, len(after))
    return "\n".join([*lines, f"mean ece {mean:.4f}: {calibration_quality(mean)}"])


def parity_report(checked: DataFrame) -> str:
    """Text of a :func:`parity` result: rows, failures and greatest differences."""
    r = checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("passed")).alias("failed"), F.max("abs_diff").alias("a"), F.max("rel_diff").alias("r")).first()
    verdict = "FAILED" if r["failed"] else "passed"
    return f"{verdict}: {r['n']} compared, {r['failed']} over tolerance, greatest difference {r['a'] or 0:.3g} absolute, {r['r'] or 0:.3g} relative"


# Training-side helpers


def cosine_warmup(step: Column, *, warmup: int, total: int, least: float = 0.0) -> Column:
    """Learning-rate factor: linear warm-up, then half a cosine down to ``least``."""
    if warmup < 0 or total <= warmup:
        raise ValueError("total must be more than warmup, warmup 0 or more")
    progress = F.least((step - F.lit(warmup)) / F.lit(float(total - warmup)), F.lit(1.0))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.lit(least) + F.lit(1 - least) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))


def keep_best(history: DataFrame, n: int, loss_column: str = "val_loss") -> DataFrame:
    return history.orderBy(loss_column, *[c for c in history.columns if c != loss_column]).limit(n)


def checkpoint_index(history: DataFrame, n: int, *, epoch: str = "epoch", loss_column: str = "val_loss") -> DataFrame:
    """Adds rank (1 is the least loss, the earlier epoch among equals), kept (the first n), improved and since_best.

    improved: the loss is below all earlier ones; since_best: epochs since the last improvement, for early stopping. A
    row without a loss ranks last and improves nothing. One row an epoch: a history is small.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    by_epoch = Window.orderBy(epoch)
    before = F.min(loss_column).over(by_epoch.rowsBetween(Window.unboundedPreceding, -1))
    ranked = history.withColumn("rank", F.row_number().over(Window.orderBy(F.col(loss_column).asc_nulls_last(), epoch)))
    out = ranked.withColumns({"kept": F.col("rank") <= n, "improved": F.coalesce(F.col(loss_column) < before, before.isNull() & F.col(loss_column).isNotNull())})
    last = F.last(F.when(F.col("improved"), F.col(epoch)), ignorenulls=True).over(by_epoch.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("since_best", F.col(epoch) - last)


def calibration_grade(mean_ece: Column) -> Column:
    """The word of :func:`calibration_quality` for a column."""
    return F.when(mean_ece < 0.05, "excellent").when(mean_ece < 0.10, "good").when(mean_ece < 0.15, "fair").otherwise("poor")


def append_history(df: DataFrame, path: str) -> int:
    """Adds rows of a training history (epoch, losses, metrics, checkpoint path) to a table; returns how many."""
    before = df.persist()
    try:
        n = before.count()
        before.write.mode("append").parquet(path)
        return n
    finally:
        before.unpersist()


def parity(left: DataFrame, right: DataFrame, *, keys: Sequence[str], column: str, atol: float = 1e-5, rtol: float = 1e-3) -> DataFrame:
    """Greatest absolute and relative difference of two array columns by key; fails only if both are over tolerance."""
    both = left.select(*keys, F.col(column).alias("a")).join(right.select(*keys, F.col(column).alias("b")), list(keys))
    gaps = both.select(*keys, F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("abs_diff"), F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y) / F.greatest(F.abs(y), F.lit(1e-12)))).alias("rel_diff"))
    return gaps.withColumn("passed", (F.col("abs_diff") <= atol) | (F.col("rel_diff") <= rtol))
