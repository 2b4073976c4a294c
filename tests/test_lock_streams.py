"""Streams of lock samples and heartbeats equal their batch forms, with rows out of order, late rows and a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from schemaloom.operators import locks
from schemaloom.streaming import locks as streams

START = dt.datetime(2026, 1, 1)
AT = lambda s: START + dt.timedelta(seconds=s)




def run(df, path, name):
    """Reads what is there, a file at a time, to the end."""
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/{name}-check").option("path", f"{path}/{name}-out").trigger(availableNow=True).start()
    try:
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        q.stop()


def test_holds_equal_islands_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    ticks = {(t, pid) for pid in range(6) for start in range(0, 900, 150) for t in range(start, start + rng.randrange(10, 130), 10)}
    rows = sorted(ticks)
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for a, b in zip(batches, batches[1:]):  # some rows come a batch too late, but within the watermark
        for _ in range(4):
            b.append(a.pop(rng.randrange(len(a))))
    shown = {(t, p) for b in batches for t, p in b}
    assert shown == ticks
    schema = "tick timestamp, pid long"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = streams.holds(source, 20, "10 minutes")
    half = len(batches) // 2
    feed = [*batches, [(5000, 99)], [(5600, 98)], [(100, 1)], [(9000, 97)]]  # the sample of second 100 is too late by then
    for k, batch in enumerate(feed):
        spark.createDataFrame([(AT(t), p) for t, p in batch], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if k in (half, len(feed) - 1):
            run(out, f"file://{tmp_path}", "holds")
    got = {(r.pid, r.held_from, r.held_to, r.ticks) for r in spark.read.parquet(f"file://{tmp_path}/holds-out").collect() if r.pid < 90}
    want = locks.hold_islands(spark.createDataFrame([(AT(t), p) for t, p in rows], schema), 20).collect()
    assert got == {(r.pid, r.held_from, r.held_to, r.ticks) for r in want} and len(got) > 20


def test_locks_without_heartbeats_equal_stale_holders(spark, tmp_path):
    rng = random.Random(4)
    seen = [(AT(10 * k), k % 7, f"n{k}") for k in range(60)]
    beats = [(AT(10 * k + rng.randrange(1, 60)), k % 7) for k in range(0, 60, 2)]
    for name in ("locks", "beats"):
        (tmp_path / name).mkdir()
    a, b = "at timestamp, lock long, note string", "beat_at timestamp, lock long"
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")
    out = streams.stale_locks(read("locks", a), read("beats", b), 30, "20 seconds")
    end = [(AT(5000), 99, "end")], [(AT(5000), 98)]
    for k in range(0, 60, 20):
        some = [r for r in beats if AT(10 * k) <= r[0] < AT(10 * k + 200)]
        spark.createDataFrame(seen[k : k + 20], a).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/locks")
        spark.createDataFrame(some, b).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/beats")
        if k == 20:
            run(out, f"file://{tmp_path}", "stale")
    for rows, schema, name in ((end[0], a, "locks"), (end[1], b, "beats")):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
    run(out, f"file://{tmp_path}", "stale")
    got = {(r.at, r.lock, r.note) for r in spark.read.parquet(f"file://{tmp_path}/stale-out").collect() if r.lock < 90}
    held = []
    for at, lock, note in seen:
        last = [t for t, x in beats if x == lock and t <= at + dt.timedelta(seconds=30)]
        held.append((at, lock, note, lock, max(last, default=dt.datetime(2000, 1, 1))))
    rows = spark.createDataFrame(held, a + ", pid long, last_heartbeat timestamp")
    live = rows.select("pid").distinct()
    want = locks.stale_holders(rows, live, F.col("at") + F.expr("INTERVAL 30 SECONDS"), 30).filter("status = 'STALE'").collect()
    assert got == {(r.at, r.lock, r.note) for r in want} and 10 < len(got) < 60
