"""List state with timers: triggers, restarts and replays don't change what comes out."""

from __future__ import annotations

import random
import time

import pytest

from strandline.sources import files
from strandline.streaming import buffers, processor, sinks

HOUR = 3_600_000_000
START = 1_704_067_200_000_000
CFG = processor.SessionConfig(buffers.BufferConfig(lookback_seconds=8, sequence_length=3, reset_gap_seconds=5 * 3600), close_us=20 * HOUR)


def rows_of(seed=4, n=160):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 80 * 3600) for _ in range(n))
    return [(rng.choice("ab"), START + t * 1_000_000, i, None if i % 17 == 5 else 10 + rng.random(), float(rng.randrange(1, 5))) for i, t in enumerate(times)]


def feed(spark, path, slices):
    for rows in slices:
        spark.createDataFrame(rows, buffers.TICK_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def features(spark, path, cfg=CFG):
    ticks = files.stream_table(spark, path, spark.createDataFrame([], buffers.TICK_SCHEMA).schema, files_per_trigger=1)
    return processor.session_features(ticks, cfg)


def run(spark, path, out, name="q", change=None, cfg=CFG):
    with processor.rocksdb_state(spark):
        stream = features(spark, path, cfg)
        sinks.write_batches(stream, f"{out}/rows", name, change=change).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return sinks.read_batches(spark, f"{out}/rows", processor.OUT_SCHEMA)


def last(df):
    found = sinks.newest(df.drop("query", "batch"), keys=["series"], order=["ts_us"])
    return sorted((r["series"], r["ts_us"], r["buffered"], r["last"]) for r in found.collect())


def plain(rows, cfg=CFG):
    """Newest tick of each series with the ticks that count, by hand."""
    out = []
    for series in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == series), key=lambda r: (r[1], r[2]))
        newest = (mine[-1][1] - cfg.close_us) // processor.DAY_US
        held = [mine[-1]]
        for r in reversed(mine[:-1]):
            if (r[1] - cfg.close_us) // processor.DAY_US != newest or held[-1][1] - r[1] > 5 * HOUR or len(held) == 8:
                break
            held.append(r)
        out.append((series, mine[-1][1], len(held)))
    return out


def test_triggers_and_restart(spark, tmp_path):
    rows = rows_of()
    cuts = [rows[i : i + 40] for i in range(0, 160, 40)]
    feed(spark, str(tmp_path / "one"), [rows])
    feed(spark, str(tmp_path / "four"), cuts)
    one, four = run(spark, str(tmp_path / "one"), str(tmp_path / "o1")), run(spark, str(tmp_path / "four"), str(tmp_path / "o4"))
    assert last(one) == last(four) and [x[:3] for x in last(one)] == plain(rows)
    assert four.select("batch").distinct().count() >= 4 > one.select("batch").distinct().count()
    feed(spark, str(tmp_path / "stop"), cuts[:2])
    run(spark, str(tmp_path / "stop"), str(tmp_path / "os"))
    feed(spark, str(tmp_path / "stop"), cuts[2:])
    again = run(spark, str(tmp_path / "stop"), str(tmp_path / "os"))
    assert last(again) == last(one)
    assert again.where("series = 'a'").count() == four.where("series = 'a'").count()


def test_replayed_batch_leaves_one_copy(spark, tmp_path):
    rows = rows_of(9, 60)
    feed(spark, str(tmp_path / "in"), [rows[:30], rows[30:]])
    whole = run(spark, str(tmp_path / "in"), str(tmp_path / "a"))
    failed = []

    class Once:
        """Writes a half of the second batch, then fails; the next time it is whole."""

        def __call__(self, batch):
            if len(failed) == 1 and batch.count():
                failed.append("half")
                batch.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/b/rows/query=q/batch=1")
                raise RuntimeError("lost")
            if not failed:
                failed.append("first")
            return batch

    with pytest.raises(Exception, match="lost"):
        run(spark, str(tmp_path / "in"), str(tmp_path / "b"), change=Once())
    assert failed == ["first", "half"]
    again = run(spark, str(tmp_path / "in"), str(tmp_path / "b"))
    count = lambda df: sorted((r["batch"], r["series"], r["ts_us"], r["buffered"]) for r in df.collect())
    assert count(again) == count(whole) and last(again) == last(whole)
    other = run(spark, str(tmp_path / "in"), str(tmp_path / "c"), name="other")
    assert {r["query"] for r in other.select("query").distinct().collect()} == {"other"}
    with pytest.raises(ValueError):
        sinks.write_batches(features(spark, str(tmp_path / "in")), str(tmp_path / "d"), "a/b")


def test_time_to_live_and_settings(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [rows_of(2, 20)])
    quiet = processor.SessionConfig(buffers.BufferConfig(lookback_seconds=8, sequence_length=3, idle_timeout="2 hours"))
    with processor.rocksdb_state(spark):  # a query with a time to live goes on without news, so it is stopped
        writer = sinks.write_batches(features(spark, str(tmp_path / "in"), quiet), f"{tmp_path}/o/rows", "q")
        query = writer.option("checkpointLocation", f"{tmp_path}/o/state").trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and not any(p.numInputRows for p in query.recentProgress):
        time.sleep(0.2)
    query.stop()
    out = sinks.read_batches(spark, f"{tmp_path}/o/rows", processor.OUT_SCHEMA)
    counts = [sum(r[0] == x for r in rows_of(2, 20)) for x in "ab"]
    assert sorted(r["buffered"] for r in out.collect()) == sorted(min(8, n) for n in counts)
    with pytest.raises(ValueError):
        processor.SessionConfig(buffers.BufferConfig(idle_timeout="1 hour"), close_us=0)
    with pytest.raises(ValueError):
        processor.SessionConfig(close_us=processor.DAY_US)
