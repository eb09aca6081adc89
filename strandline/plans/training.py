"""Queries of what surrounds a model's training: batches and rates, histories and checkpoints, sanity of outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions import arrays as A
from strandline.functions import discretize as D
from strandline.operators import evaluation, rolling, splits
from strandline.plans.market import CENTERS, KEYS, N_LOGITS, ORDER, rounded
from strandline.sources import files

BATCH, WARMUP_SHARE, LEAST = 50, 10, 0.1
EPOCHS, KEEP = 20, 5
VOLUME = D.volume_buckets()


def learning_rate(spark: SparkSession, d: str) -> DataFrame:
    """The rate's factor at each step of an epoch over all events: a step is a batch of events in order of time."""
    events = schema.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("time"))
    steps = splits.batches(rolling.with_row_index(events, [], "time", ["event_id"], name="i"), keys=[], index="i", size=BATCH)
    total = events.count() // BATCH
    found = steps.groupBy(F.col("batch").alias("step")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return found.select("step", "first_id", "n", F.round(evaluation.cosine_warmup(F.col("step"), warmup=total // WARMUP_SHARE, total=total, least=LEAST), 6).alias("factor"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    """An epoch is a twentieth of the predictions; its losses are theirs, for training and for validation."""
    rows = schema.predictions(spark, d).select((F.col("id") % EPOCHS).alias("epoch"), (F.floor(F.col("id") / EPOCHS) % 4 == 0).alias("held_out"), evaluation.loss("focal", F.col("logits"), F.col("target"), N_LOGITS).alias("loss"))
    means = {name: F.round(F.avg(F.when(F.col("held_out") == out, F.col("loss"))), 9).alias(name) for name, out in (("train_loss", False), ("val_loss", True))}
    return rows.groupBy("epoch").agg(*means.values()).withColumn("checkpoint", F.format_string("epoch-%03d", "epoch"))


def history_index(spark: SparkSession, d: str) -> DataFrame:
    """A history appended in two parts and read again, with its checkpoints ranked."""
    path = f"{files.shared_dir(spark)}/history-{uuid.uuid4().hex}"
    epochs = files.staged(_history(spark, d), "epochs")
    for half in (F.col("epoch") < EPOCHS // 2, F.col("epoch") >= EPOCHS // 2):
        evaluation.append_history(epochs.where(half), path)
    out = evaluation.checkpoint_index(spark.read.parquet(path), KEEP)
    return rounded(out, ["train_loss", "val_loss"]).select("epoch", "train_loss", "val_loss", "checkpoint", "rank", "kept", "improved", "since_best")


def best_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.keep_best(_history(spark, d).select("epoch", "val_loss"), KEEP), ["val_loss"])


def loaders(spark: SparkSession, d: str) -> DataFrame:
    """Batches of the three splits' sequences, counted, with the first and last start of each."""
    rows = rolling.with_row_index(schema.trades(spark, d), KEYS, "time", ["sequence_number"], name="i")
    bundle = splits.split_loaders(rows, keys=KEYS, index="i", features=["price", "size"], targets=[("price", 5)], length=10, batch_size=32, cfg=splits.SplitConfig(gap=10))
    out: DataFrame | None = None
    for name, loader in bundle.items():
        if loader is not None:
            part = loader.groupBy("ticker", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("start").alias("last_start")).withColumn("split", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out.select("split", "ticker", "batch", "n", "first_start", "last_start")


def grades(spark: SparkSession, d: str) -> DataFrame:
    """How well calibrated each horizon is, in a word."""
    found = evaluation.calibration_error(evaluation.with_probabilities(schema.predictions(spark, d)))
    return found.select("horizon", F.round("ece", 6).alias("ece"), evaluation.calibration_grade(F.col("ece")).alias("grade"))


def expected_moves(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each predicted distribution over the centers, and whether it, scaled by a little, is one still."""
    rows = evaluation.with_probabilities(schema.predictions(spark, d))
    scaled = F.transform("probs", lambda p: p * (F.lit(1.0) + (F.col("id") % 3).cast("double") * F.lit(0.008)))
    return rows.select("id", F.round(A.mean_of(F.col("probs"), evaluation.literal(CENTERS)), 6).alias("mean_bps"), A.sums_to_one(scaled).alias("valid"))


def finite_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots of embeddings; those of negative numbers aren't numbers and count as 0."""
    rows = schema.table(spark, d, "embeddings")
    roots = F.transform("embedding", lambda x: A.finite_or_zero(F.sqrt(x.cast("double"))))
    return rows.select("vec_id", F.round(A.total(roots), 5).alias("total"), F.size(F.filter(roots, lambda x: x > 0)).alias("n"))


def tick_moves(spark: SparkSession, d: str) -> DataFrame:
    """Moves to the next tick in basis points, and the bucket of average volume."""
    out = splits.forward_labels(schema.trades(spark, d), keys=KEYS, order=ORDER, price="price", horizons=[1])
    return out.select("id", F.round(D.log_return_bps(F.col("price_h1"), F.col("price")), 4).alias("bps"), F.lit(D.average_volume_bucket(VOLUME)).alias("average_bucket"), VOLUME.bucket(F.lit(1.0)).alias("bucket_of_one"))


_T = f"WITH {schema.TRADES_SQL}"
_HISTORY = f"""WITH {schema.PREDICTIONS_SQL}, f AS (SELECT id % {EPOCHS} AS epoch, (id // {EPOCHS}) % 4 = 0 AS held_out, power(1 - probs[target + 1], 2) * -ln(greatest(probs[target + 1], 1e-8)) AS loss FROM probabilities),
h AS (SELECT epoch, round(avg(CASE WHEN NOT held_out THEN loss END), 9) AS train_loss, round(avg(CASE WHEN held_out THEN loss END), 9) AS val_loss, 'epoch-' || lpad(epoch::VARCHAR, 3, '0') AS checkpoint FROM f GROUP BY epoch)"""
_STARTS = """s AS (SELECT ticker, n - 20 AS a, n FROM (SELECT ticker, count(*) AS n FROM trades GROUP BY ticker)),
b AS (SELECT ticker, n, floor(a * 0.7::DOUBLE)::BIGINT AS tr, floor(a * 0.15::DOUBLE)::BIGINT AS va FROM s WHERE a > 0),
p AS (SELECT ticker, 'train' AS split, tr AS rows_ FROM b WHERE tr >= 1 UNION ALL SELECT ticker, 'val', va FROM b WHERE tr >= 1 UNION ALL SELECT ticker, 'test', n - tr - va - 20 FROM b WHERE tr >= 1),
starts AS (SELECT ticker, split, unnest(range(rows_ - 14)) AS start FROM p WHERE rows_ > 14)"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "nn4_learning_rate": (learning_rate, f"""WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // {BATCH} AS step, count(*) OVER () // {BATCH} AS total FROM events),
g AS (SELECT step, any_value(total) AS total, any_value(total) // {WARMUP_SHARE} AS warmup, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY step)
SELECT step, first_id, n, round(CASE WHEN step < warmup THEN step / greatest(warmup, 1)::DOUBLE ELSE {LEAST}::DOUBLE + {1 - LEAST}::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least((step - warmup) / (total - warmup)::DOUBLE, 1))) END, 6) AS factor FROM g"""),
    "s17_history_index": (history_index, f"""{_HISTORY}, r AS (SELECT *, row_number() OVER (ORDER BY val_loss NULLS LAST, epoch)::INT AS rank, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
i AS (SELECT *, coalesce(val_loss < before, before IS NULL AND val_loss IS NOT NULL) AS improved FROM r)
SELECT epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, checkpoint, rank, rank <= {KEEP} AS kept, improved, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since_best FROM i"""),
    "t04_best_checkpoints": (best_checkpoints, f"{_HISTORY} SELECT epoch, round(val_loss, 6) AS val_loss FROM h ORDER BY h.val_loss NULLS FIRST, epoch LIMIT {KEEP}"),
    "x04_split_loaders": (loaders, f"""{_T}, {_STARTS} SELECT split, ticker, start // 32 AS batch, count(*) AS n, min(start) AS first_start, max(start) AS last_start FROM starts GROUP BY ALL HAVING split <> 'train' OR count(*) = 32"""),
    "m13_calibration_grades": (grades, f"WITH {schema.PREDICTIONS_SQL}, j AS (SELECT horizon, list_max(probs) AS c, (list_position(probs, list_max(probs)) - 1 = target)::INT AS ok FROM probabilities), b AS (SELECT horizon, least(floor(c * 10), 9) AS bin, count(*) AS n, abs(avg(c) - avg(ok)) AS gap FROM j GROUP BY 1, 2), e AS (SELECT horizon, sum(n * gap) / sum(n) AS ece FROM b GROUP BY horizon) SELECT horizon, round(ece, 6) AS ece, CASE WHEN ece < 0.05 THEN 'excellent' WHEN ece < 0.1 THEN 'good' WHEN ece < 0.15 THEN 'fair' ELSE 'poor' END AS grade FROM e"),
    "m14_expected_moves": (expected_moves, f"WITH {schema.PREDICTIONS_SQL} SELECT id, round(list_sum(list_transform(probs, lambda p, i: p * (-50 + (i - 1) * 100.0::DOUBLE / {N_LOGITS - 1}))), 6) AS mean_bps, id % 3 < 2 AS valid FROM probabilities"),
    "p05_finite_roots": (finite_roots, "SELECT vec_id, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: sqrt(x::DOUBLE))), 0), 5) AS total, len(list_filter(embedding, lambda x: x > 0))::INT AS n FROM embeddings"),
    "d09_tick_moves": (tick_moves, f"{_T}, l AS (SELECT id, price, lead(price) OVER (PARTITION BY ticker ORDER BY time, sequence_number) AS next FROM trades) SELECT id, CASE WHEN price > 0 AND next > 0 THEN round(ln(next / price) * 1e4::DOUBLE, 4) END AS bps, {D.average_volume_bucket(VOLUME)} AS average_bucket, {VOLUME.bucket_of(1.0)} AS bucket_of_one FROM l"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
