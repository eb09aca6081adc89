"""Chronological splits, sequences with targets, batches and rolling folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import rolling as R

#: Display name by split.
SPLIT_NAMES = {"train": "Training", "val": "Validation", "test": "Test"}


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15
    gap: int = 0

    def __post_init__(self) -> None:
        if min(self.train, self.val, self.test) < 0 or abs(self.train + self.val + self.test - 1) > 1e-6 or self.gap < 0:
            raise ValueError("shares must be 0 or more and sum to 1, gap 0 or more")


def split_bounds(n: int, cfg: SplitConfig) -> dict[str, tuple[int, int]]:
    """Half-open row ranges of the splits of n rows in order."""
    available = n - 2 * cfg.gap
    if available <= 0:
        raise ValueError("no rows are left between the gaps")
    train, val = int(available * cfg.train), int(available * cfg.val)
    if train < 1:
        raise ValueError("no training rows")
    test_at = train + val + 2 * cfg.gap
    return {"train": (0, train), "val": (train + cfg.gap, train + cfg.gap + val), "test": (test_at, n)}


def chronological_split(df: DataFrame, *, keys: Sequence[str], index: str, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Adds ``split``; rows in a gap, or of a series too short to train, have null. Needs the 0-based position ``index``."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    left = F.col("__n") - F.lit(2 * cfg.gap)
    train, val = F.floor(left * F.lit(cfg.train)), F.floor(left * F.lit(cfg.val))
    i, g = F.col(index), cfg.gap
    name = F.when((left <= 0) | (train < 1), None).when(i < train, "train").when((i >= train + g) & (i < train + g + val), "val").when(i >= train + val + 2 * g, "test")
    return df.join(sizes, list(keys)).withColumn("split", name).drop("__n")


def forward_labels(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], price: str, horizons: Sequence[int]) -> DataFrame:
    """Adds ``price_h{h}``: the price h rows ahead, for each horizon. Long series are cut into chunks."""

    def add(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = R.series(keys, order)
        return rows.withColumns({f"price_h{h}": F.lead(price, h).over(w) for h in horizons})

    return R.by_series(df, keys, order, 0, add, ahead=max(horizons))


def sequences(df: DataFrame, *, keys: Sequence[str], index: str, features: Sequence[str], targets: Sequence[tuple[str, int]], length: int, targets_are_forward: bool = False, chunk: int | None = None) -> DataFrame:
    """One row for each valid start: ``start``, ``features`` (length rows of an array) and a target by (column, horizon).

    The target of horizon h is read h rows after the last row of the window, or at that row if the targets already look
    forward. Valid starts leave room for the longest horizon. Series are cut into chunks of rows.
    """
    if length < 1 or not targets or min(h for _, h in targets) < 1:
        raise ValueError("length must be 1 or more, horizons 1 or more, at least one target")
    ahead = max(h for _, h in targets)

    def cut(rows: DataFrame, own: list[str]) -> DataFrame:
        w = R.series(own, [index])
        window = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(w.rowsBetween(0, length - 1))
        out = {f"target_{h}": F.lead(c, length - 1 + (0 if targets_are_forward else h)).over(w) for c, h in targets}
        left = F.count(F.lit(1)).over(w.rowsBetween(0, length + ahead - 1))
        return rows.select(*own, F.col(index).alias("start"), window.alias("features"), *[v.alias(k) for k, v in out.items()], left.alias("__left")).where(F.col("__left") == length + ahead).drop("__left")

    narrow = df.select(*{*keys, index, *features, *(c for c, _ in targets)})
    return R.in_chunks(narrow, keys, index, 0, lambda rows, own: cut(rows, own).withColumn(index, F.col("start")), chunk=chunk, ahead=length + ahead - 1).drop(index)


def split_loaders(df: DataFrame, *, keys: Sequence[str], index: str, features: Sequence[str], targets: Sequence[tuple[str, int]], length: int, batch_size: int, cfg: SplitConfig = SplitConfig(), drop_last: bool = True, targets_are_forward: bool = False) -> dict[str, DataFrame | None]:
    """Batched sequences of the chronological splits, by split name; validation and test are None if they have none.

    Windows and targets stay inside a split. ``batch`` numbers runs of ``batch_size`` starts of a series; only training
    drops a last short one.
    """
    placed = chronological_split(df, keys=keys, index=index, cfg=cfg)
    out: dict[str, DataFrame | None] = {}
    for name in SPLIT_NAMES:
        part = placed.where(F.col("split") == name).drop("split")
        firsts = part.groupBy(*keys).agg(F.min(index).alias("__first"))
        local = part.join(firsts, list(keys)).withColumn(index, F.col(index) - F.col("__first"))
        rows = sequences(local.drop("__first"), keys=keys, index=index, features=features, targets=targets, length=length, targets_are_forward=targets_are_forward)
        loader = batches(rows, keys=keys, index="start", size=batch_size, drop_last=drop_last and name == "train")
        out[name] = None if name != "train" and loader.isEmpty() else loader
    return out


def batches(df: DataFrame, *, keys: Sequence[str], index: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds ``batch``: contiguous runs of ``size`` rows in order; optionally without a last short one."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    out = df.withColumn("batch", F.floor(F.col(index) / F.lit(size)))
    if not drop_last:
        return out
    full = out.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == size).drop("__n")
    return out.join(full, [*keys, "batch"], "left_semi")


def collate(df: DataFrame, *, keys: Sequence[str], index: str, columns: Sequence[str]) -> DataFrame:
    """One row a batch with its rows as a sorted array."""
    return df.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct(index, *columns))).alias("rows"))


def rolling_folds(df: DataFrame, *, keys: Sequence[str], index: str, size: int, step: int, least_rows: int = 1) -> DataFrame:
    """Each row once for each fold that holds it, with ``fold`` and ``fold_start``; folds start at 0, step, ... and are full."""
    if size < 1 or step < 1:
        raise ValueError("size and step must be 1 or more")
    if size < least_rows:
        return df.withColumns({"fold": F.lit(None).cast("bigint"), "fold_start": F.lit(None).cast("bigint")}).limit(0)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    i = F.col(index)
    first = F.greatest(F.ceil((i - F.lit(size) + 1) / F.lit(step)), F.lit(0))
    last = F.least(F.floor(i / F.lit(step)), F.floor((F.col("__n") - F.lit(size)) / F.lit(step)))
    folds = F.when(last >= first, F.sequence(first, last))
    return df.join(sizes, list(keys)).withColumn("fold", F.explode(folds)).withColumn("fold_start", F.col("fold") * step).drop("__n")
