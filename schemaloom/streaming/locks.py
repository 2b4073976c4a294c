"""Lock samples and change logs as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from schemaloom.operators.ledger import replay


def queue_trips(samples: DataFrame, window: str = "1 minute", late: str = "5 minutes", max_depth: int = 5, max_wait: float = 200.0) -> DataFrame:
    """(start, depth, longest, trip) per event-time window of a stream (ts, wait); later rows than ``late`` are left out."""
    w = samples.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("depth"), F.max("wait").alias("longest"))
    return w.select(F.col("w.start").alias("start"), "depth", "longest", ((F.col("depth") > max_depth) | (F.col("longest") > max_wait)).alias("trip"))


def hold_sessions(samples: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(pid, held_from, held_to, ticks) per session of a stream (ts, pid): a session ends after ``gap`` without a sample."""
    s = samples.withWatermark("ts", late).groupBy("pid", F.session_window("ts", gap).alias("w"))
    return s.agg(F.min("ts").alias("held_from"), F.max("ts").alias("held_to"), F.count("*").alias("ticks")).select("pid", "held_from", "held_to", "ticks")


def apply_changes(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, values: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that replays each batch of a change log (id, op, key, values) on the table that ``read`` gives.
    ``write`` gets the batch's number too: writing a number twice must leave one copy, as batches can be repeated."""

    def batch(log: DataFrame, number: int) -> None:
        write(replay(read(), log, key, values), number)

    return batch


class _Holds(StatefulProcessor):
    """Of each pid the hold that goes on, in ``open`` (first tick, last tick, ticks), and the ticks that the watermark has not passed
    yet, in ``ahead``: rows may come in any order until then. A timer behind each tick puts them in order, and ends a hold that
    no tick continues; then nothing is kept of the pid."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, ticks long")
        self.ahead = handle.getMapState("ahead", "tick long", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            tick = r.tick_ms
            if tick >= passed and not self.ahead.containsKey((tick,)):  # an earlier one is too late
                self.ahead.updateValue((tick,), (True,))
                self.handle.registerTimer(tick + self.gap + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        run = self.open.get() if self.open.exists() else None
        done = []
        ticks = sorted(k[0] for k in self.ahead.keys())
        for tick in (t for t in ticks if t < passed):
            self.ahead.removeKey((tick,))
            if run and tick - run[1] <= self.gap:
                run = (run[0], tick, run[2] + 1)
            else:
                if run:
                    done.append(run)
                run = (tick, tick, 1)
        if run and run[1] + self.gap < passed:
            done.append(run)
            run = None
        if run:
            self.open.update(run)
        else:
            self.open.clear()
        for first, last, n in done:
            yield Row(pid=key[0], first_ms=first, last_ms=last, ticks=n)

    def close(self) -> None:
        pass


def holds(samples: DataFrame, gap_seconds: int, late: str = "1 minute") -> DataFrame:
    """(pid, held_from, held_to, ticks) of a stream (tick, pid), as ``operators.locks.hold_islands`` has them of all rows: first seen,
    last seen and how many ticks, told when a pid has not been seen for longer than ``gap_seconds``. Rows later than ``late`` are
    left out; state is kept of pids that are held now. Needs the RocksDB state store, which it sets for the session."""
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = samples.schema["pid"].dataType.simpleString()
    rows = samples.withWatermark("tick", late).withColumn("tick_ms", F.unix_millis(F.col("tick").cast("timestamp")))
    out = rows.groupBy("pid").transformWithState(_Holds(1000 * gap_seconds), f"pid {kind}, first_ms long, last_ms long, ticks long", "Append", "EventTime")
    return out.select("pid", F.timestamp_millis("first_ms").alias("held_from"), F.timestamp_millis("last_ms").alias("held_to"), "ticks")


def stale_locks(locks: DataFrame, beats: DataFrame, seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """The rows of a stream of lock sightings (at, lock, ...) for which no heartbeat of a stream (beat_at, lock) comes from then on within ``seconds``.
    An outer join of both streams over that interval: a row is told when the watermark shows that no heartbeat can come any more, and only the
    rows of that interval are kept as state."""
    left = locks.withWatermark("at", late).alias("l")
    right = beats.select("beat_at", F.col("lock").alias("beat_lock")).withWatermark("beat_at", late).alias("b")
    within = F.expr(f"lock = beat_lock AND beat_at >= at AND beat_at <= at + INTERVAL {seconds} SECONDS")
    return left.join(right, within, "left_outer").filter("beat_lock IS NULL").select("l.*")
