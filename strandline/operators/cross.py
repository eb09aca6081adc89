"""Co-movement of series that tick at different times: covariance by overlapping intervals, over a grid of lags.

Two returns count together where the intervals they were made in overlap; no series is put on a grid first. The returns of
one series that overlap an interval of the other add up to a difference of two of its log prices: at its first tick at or
after the interval's end, and at its last one at or before the start. So the sum over all overlapping pairs takes an as-of
look-up a tick (two an interval by windows), and the number of rows grows with the ticks, not with pairs of ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import align, scan
from strandline.operators import rolling as R


def tick_steps(ticks: DataFrame, *, key: str, time: str, order: Sequence[str], price: str) -> DataFrame:
    """key, start_us, end_us, step (log return between), level (log price from the series' first tick), next_level, i.

    One row for each tick with a positive price, the last by ``order`` where several share a time; the first tick of a
    series has no start and no step. ``i`` counts ticks from 0. Series are worked through in chunks where they are long,
    and over more tasks the more ticks there are: they are counted, so stage ticks that are dear to make.
    """
    good = ticks.where((F.col(price) > 0) & F.col(key).isNotNull() & F.col(time).isNotNull())
    tasks = R.tasks_for(good)
    single = R.spread(good, tasks, key, time).groupBy(F.col(key).alias("key"), F.col(time).alias("__time")).agg(F.max_by(F.log(F.col(price).cast("double")), F.struct(*order)).alias("__log"))
    firsts = single.groupBy("key").agg(F.min_by("__log", "__time").alias("__first"))
    level = single.join(firsts, "key").select("key", "__time", F.unix_micros("__time").alias("end_us"), (F.col("__log") - F.col("__first")).alias("level"))
    indexed = R.with_row_index(level, ["key"], "__time", [], name="i", tasks=tasks)

    def add(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("i")
        return rows.withColumns({"start_us": F.lag("end_us").over(w), "step": F.col("level") - F.lag("level").over(w), "next_level": F.lead("level").over(w)})

    return R.in_chunks(indexed, ["key"], "i", 1, add, chunk=min(R.SPAN_ROWS, R.CHUNK_ROWS), ahead=1, tasks=tasks).select("key", "start_us", "end_us", "step", "level", "next_level", "i")


def index_ticks(steps: DataFrame, *, groups: DataFrame | None = None) -> DataFrame:
    """key, time, price, order: an equally weighted index of the steps of all series, a tick wherever one of them has one.

    The index's log price is the sum so far of all steps over the number of series; its ticks go into :func:`tick_steps`
    like any other series'. groups: (key, index) rows say which index a series counts in, a key in several if need be;
    without it all count in the index "all". The running sum is made in chunks, see :mod:`strandline.operators.scan`.
    """
    named = steps.select("key").distinct().withColumn("index", F.lit("all")) if groups is None else groups.select("key", "index").distinct()
    members = named.join(steps.select("key").distinct(), "key", "left_semi").groupBy("index").agg(F.count(F.lit(1)).alias("__members"))
    rows = steps.join(named, "key").join(members, "index")
    # series' first ticks have no step, but the index has a level there
    moves = rows.groupBy("index", F.timestamp_micros("end_us").alias("time")).agg((F.sum(F.coalesce("step", F.lit(0.0))) / F.first("__members")).alias("__move"))
    summed = scan.affine_scan(moves, keys=["index"], order=["time"], maps={"__level": (F.lit(1.0), F.col("__move"))}, tasks=R.tasks_for(rows))
    return summed.select(F.col("index").alias("key"), "time", F.exp("__level").alias("price"), F.lit(0).alias("order"))


def lead_lag(steps: DataFrame, pairs: DataFrame, lags_us: Sequence[int], *, window_us: int | None = None) -> DataFrame:
    """a, b, lag_us, n_overlaps, covariance and correlation of each pair (a, b) of ``pairs`` at each lag.

    b's times are moved by the lag: at a positive one b's past meets a's present, so a correlation there says that b
    leads. n_overlaps counts pairs of intervals. window_us: by windows of this length in which an interval of a ends (adds
    ``window``); squared returns are summed by the windows that their own intervals end in. The correlation is null
    where a series has no variation or b has no ticks; a pair whose a has no two ticks gives no rows.
    """
    ids = pairs.select("a", "b").distinct().withColumn("lag_us", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in sorted(set(lags_us))])))
    group = ["a", "b", "lag_us"]
    window = F.floor(F.col("end_us") / F.lit(window_us)) if window_us else F.lit(None).cast("bigint")
    # the level at an interval's end goes with its step, the one at its start with its negative step; a tick that ends one
    # interval and starts the next asks once for both, unless their windows may differ
    if window_us:
        ends = F.explode(F.array(F.struct(F.col("end_us").alias("at"), F.col("step").alias("plus"), F.lit(None).cast("double").alias("minus")), F.struct(F.col("start_us").alias("at"), F.lit(None).cast("double").alias("plus"), F.col("step").alias("minus"))))
        own = steps.where(F.col("step").isNotNull()).withColumns({"__window": window, "__end": ends}).select("key", "__window", "__end.at", "__end.plus", "__end.minus")
    else:
        own = steps.select("key", window.alias("__window"), F.col("end_us").alias("at"), F.col("step").alias("plus"), (F.col("next_level") - F.col("level")).alias("minus")).where("plus IS NOT NULL OR minus IS NOT NULL")
    # b's ticks are there once for all pairs and lags: the times asked for are moved back instead of b's on
    asked = ids.join(own.withColumnRenamed("key", "a"), "a").select(*group, "__window", "plus", "minus", (F.col("at") - F.col("lag_us")).alias("at_us"))
    theirs = ids.select("b").distinct().join(steps.withColumnRenamed("key", "b"), "b").select("b", "end_us", F.col("end_us").alias("tick_us"), "level", "next_level", "i")
    seen = align.as_of(asked, theirs, keys=["b"], grid_us="at_us", obs_us="end_us", order=["i"], values=["level", "next_level", "tick_us", "i"])
    # at an end between two ticks the next tick counts; after the last tick, the last; before the first one nothing moved
    between = (F.col("tick_us") < F.col("at_us")) & F.col("next_level").isNotNull()
    before, place = F.coalesce("level", F.lit(0.0)), F.coalesce("i", F.lit(0).cast("bigint"))
    after, next_place = F.when(between, F.col("next_level")).otherwise(before), place + F.coalesce(between.cast("bigint"), F.lit(0).cast("bigint"))
    moved = F.coalesce(F.col("plus") * after, F.lit(0.0)) - F.coalesce(F.col("minus") * before, F.lit(0.0))
    counted = F.when(F.col("plus").isNotNull(), next_place).otherwise(0) - F.when(F.col("minus").isNotNull(), place).otherwise(0)
    by = [*group, "__window"]
    sums = seen.groupBy(*by).agg(F.sum(counted).alias("n_overlaps"), F.sum(moved).alias("covariance"), F.sum(F.col("plus") * F.col("plus")).alias("__a2"))
    lagged = ids.select("b", "lag_us").distinct().join(steps.where(F.col("step").isNotNull()).withColumnRenamed("key", "b"), "b").withColumn("end_us", F.col("end_us") + F.col("lag_us"))
    b2 = lagged.groupBy("b", "lag_us", window.alias("__window")).agg(F.sum(F.col("step") * F.col("step")).alias("__b2"))
    condition = (sums["b"] == b2["b"]) & (sums["lag_us"] == b2["lag_us"]) & sums["__window"].eqNullSafe(b2["__window"])
    out = sums.join(b2, condition, "left").select(*[sums[c] for c in by], "n_overlaps", "covariance", "__a2", "__b2")
    spread = F.sqrt(F.col("__a2") * F.col("__b2"))
    return out.select(*group, *([F.col("__window").alias("window")] if window_us else []), "n_overlaps", "covariance", F.when(spread > 0, F.col("covariance") / spread).alias("correlation"))


def best_lag(by_lag: DataFrame) -> DataFrame:
    """a, b, lag_us and correlation where a pair moves together most (the least lag among equals), and lead_ratio.

    lead_ratio: squared correlations at positive lags over those at negative ones; above 1 b leads a.
    """
    square = F.col("correlation") * F.col("correlation")
    best = F.max_by(F.struct("lag_us", "correlation"), F.struct(F.abs("correlation"), -F.abs("lag_us"), -F.col("lag_us")))
    ahead, behind = F.sum(F.when(F.col("lag_us") > 0, square)), F.sum(F.when(F.col("lag_us") < 0, square))
    out = by_lag.where(F.col("correlation").isNotNull()).groupBy("a", "b").agg(best.alias("x"), F.try_divide(ahead, behind).alias("lead_ratio"))
    return out.select("a", "b", F.col("x.lag_us").alias("lag_us"), F.col("x.correlation").alias("correlation"), "lead_ratio")
