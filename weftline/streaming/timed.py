"""Streams with timers and state that ends: heartbeats, counters of runs, samples that change.

All keep their state in RocksDB, one small row a key, and take time from the events: a timer fires when the watermark
passes it, which any key's events may bring about, not only those of the key that is silent. State is
gone ``keep`` after a key's last event, so a stream that runs for years holds the keys of about that long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from weftline.streaming.live import event_time, saved_so_far

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def timed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """``rows`` (with an event time ``ts``) through a processor a key. Sets the session's state store, which timers need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


class _Quiet(StatefulProcessor):
    """Keeps one timer a key; ``at`` names the state in which its time lies."""

    def _move(self, to: int | None) -> None:
        for t in list(self.handle.listTimers()):
            if t != to:
                self.handle.deleteTimer(t)
        if to is not None:
            self.handle.registerTimer(to)

    def close(self) -> None:
        pass


class _Stale(_Quiet):
    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "first_ms long, last_ms long, beats long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, beats = self.last.get() if self.last.exists() else (None, None, 0)
        over = []
        for at in sorted(_ms(x) for batch in rows for x in batch["ts"]):
            # silent for so long before this one came, whether or not the timer was first
            if last is not None and at - last >= self.gap:
                over.append(self._row(key, first, last, beats))
                first, last, beats = None, None, 0
            first, last, beats = at if first is None else min(first, at), at if last is None else max(last, at), beats + 1
        self.last.update((first, last, beats))
        self._move(last + self.gap)
        yield pd.DataFrame(over, columns=["session_id", "first_at", "last_at", "stale_at", "beats"])

    def _row(self, key, first, last, beats):
        return key[0], _at(first), _at(last), _at(last + self.gap), beats

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self._row(key, *self.last.get())
        self.last.clear()
        yield pd.DataFrame([row], columns=["session_id", "first_at", "last_at", "stale_at", "beats"])


def stale(heartbeats: DataFrame, gap_s: float = 15.0, late: str = "10 seconds") -> DataFrame:
    """(session_id, first_at, last_at, stale_at, beats): a session ``gap_s`` after its last heartbeat. A session that beats again
    is a new one. Nothing is reclaimed by silence: see ``reclaimable``."""
    return timed(event_time(heartbeats).select("session_id", "ts"), "session_id", _Stale(int(gap_s * 1000)), "session_id string, first_at timestamp, last_at timestamp, stale_at timestamp, beats long", late)


class _Reclaimable(_Quiet):
    def __init__(self, gap_ms: int, keep_ms: int):
        self.gap, self.keep = gap_ms, keep_ms

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        # heartbeats of a moment count before proofs of it
        for ts, gone in sorted(x for batch in rows for x in zip(batch["ts"], batch["gone"])):
            at = _ms(ts)
            if not gone:
                last = at if last is None else max(last, at)
            elif last is not None and at - last >= self.gap:
                out.append((key[0], _at(last), ts))
                last = None
        if last is None:
            self.last.clear()
            self._move(None)
        else:
            self.last.update((last,))
            self._move(last + self.keep)
        yield pd.DataFrame(out, columns=["session_id", "last_at", "gone_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame()


def reclaimable(heartbeats: DataFrame, proofs: DataFrame, gap_s: float = 15.0, keep_s: float = 86_400.0, late: str = "10 seconds") -> DataFrame:
    """(session_id, last_at, gone_at): sessions whose process was proved gone ``gap_s`` or more after their
    last heartbeat. ``proofs``: session_id, ts, gone. Silence alone reclaims nothing, nor does a proof of a
    session that still beats; a session silent for ``keep_s`` is forgotten."""
    beats = event_time(heartbeats).select("session_id", "ts", F.lit(False).alias("gone"))
    every = beats.unionByName(event_time(proofs).where("gone").select("session_id", "ts", "gone"))
    return timed(every, "session_id", _Reclaimable(int(gap_s * 1000), int(keep_s * 1000)), "session_id string, last_at timestamp, gone_at timestamp", late)


FIELDS = ["running", "ready", "completed", "failed"]


class _Changed(_Quiet):
    def __init__(self, every_ms: int, keep_ms: int):
        self.every, self.keep = every_ms, keep_ms

    def init(self, handle):
        self.handle = handle
        # the last sample that was kept, and whether a like one came since
        self.last = handle.getValueState("last", "at_ms long, running long, ready long, completed long, failed long, held boolean, seen_ms long")

    def _row(self, key, at, values):
        return (key[0], _at(at), *values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        at, values, held, seen = (state[0], tuple(state[1:5]), state[5], state[6]) if state else (None, None, False, None)
        kept = []
        for row in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            now, new = _ms(row.ts), tuple(int(getattr(row, f)) for f in FIELDS)
            seen = now if seen is None else max(seen, now)
            if at is None or new != values or now - at >= self.every:
                at, values, held = now, new, False
                kept.append(self._row(key, at, values))
            else:
                held = True
        self.last.update((at, *values, held, seen))
        self._move(at + self.every if held else seen + self.keep)
        yield pd.DataFrame(kept, columns=["run_id", "ts", *FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, *values, held, seen = self.last.get()
        out = []
        if held:
            at = at + self.every
            out.append(self._row(key, at, values))
            self.last.update((at, *values, False, seen))
            self._move(max(seen + self.keep, at + 1))
        else:
            self.last.clear()
        yield pd.DataFrame(out, columns=["run_id", "ts", *FIELDS])


def changed_samples(samples: DataFrame, every_s: float = 0.9, keep_s: float = 86_400.0, late: str = "5 seconds") -> DataFrame:
    """Samples (run_id, ts, running, ready, completed, failed) whose counters differ from those kept last, or that come ``every_s`` or
    more after them. A sample that was held back, being like the one before, is kept by timer once ``every_s`` has passed."""
    rows = event_time(samples).select("run_id", "ts", *[F.col(f).cast("long").alias(f) for f in FIELDS])
    return timed(rows, "run_id", _Changed(int(every_s * 1000), int(keep_s * 1000)), "run_id string, ts timestamp, running long, ready long, completed long, failed long", late)


class _Counters(_Quiet):
    def __init__(self, tick_ms: int, keep_ms: int):
        self.tick, self.keep = tick_ms, keep_ms

    def init(self, handle):
        self.handle = handle
        self.counts = handle.getValueState("counts", "ready long, running long, completed long, failed long, done_s double, began_us long, open_start_us long, last_ms long")

    def _row(self, key, at, c):
        ready, running, completed, failed, done, began, open_start, _ = c
        began = pd.NaT if began is None else pd.Timestamp(began, unit="us")
        return pd.DataFrame([(key[0], _at(at), ready, running, completed, failed, done, began, open_start)], columns=["run_id", "at", "ready", "running", "completed", "failed", "done_s", "began", "open_start_us"])

    def _next(self, at, c):
        busy = c[0] > 0 or c[1] > 0
        self._move(max(at + 1, at + self.tick if busy and at < c[7] + self.keep else c[7] + self.keep))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ready, running, completed, failed, done, began, open_start, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0.0, None, 0, 0)
        for b in rows:
            us = b["ts"].astype("datetime64[us]").astype("int64")
            start, end = b["event"] == "start", b["event"] == "end"
            seconds = b["duration_s"].fillna(0.0)
            ready += int((b["event"] == "ready").sum()) - int(start.sum())
            running += int(start.sum()) - int(end.sum())
            completed += int((end & (b["status"] == "succeeded")).sum())
            failed += int((end & b["status"].isin(["failed", "timed_out"])).sum())
            done += float(seconds[end & (b["status"] != "skipped")].sum())
            open_start += int(us[start].sum()) - int((us[end] - (seconds[end] * 1e6).round().astype("int64")).sum())
            if start.any():
                began = int(us[start].min()) if began is None else min(began, int(us[start].min()))
            last = max(last, _ms(b["ts"].max()))
        c = (ready, running, completed, failed, done, began, open_start, last)
        self.counts.update(c)
        self._next(last, c)
        yield self._row(key, last, c)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c, at = self.counts.get(), expiredTimerInfo.getExpiryTimeInMs()
        if at >= c[7] + self.keep:
            self.counts.clear()
            yield pd.DataFrame()
        else:
            self._next(at, c)
            yield self._row(key, at, c)


def live_counters(events: DataFrame, tick_s: float = 5.0, keep_s: float = 86_400.0, late: str = "10 seconds") -> DataFrame:
    """(run_id, at, ready, running, completed, failed, done_s, began, open_start_us): a run's counters after each batch with events of it, and
    every ``tick_s`` while tasks wait or run. An event that comes again (same run, task and kind) counts once. The counters
    of a run are forgotten ``keep_s`` after its last event."""
    rows = event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "task_id", "event"])
    kind = "run_id string, at timestamp, ready long, running long, completed long, failed long, done_s double, began timestamp, open_start_us long"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.select("run_id", "ts", "event", "status", "duration_s").groupBy("run_id").transformWithStateInPandas(_Counters(int(tick_s * 1000), int(keep_s * 1000)), kind, "append", "EventTime")


def watch_savings(events: DataFrame, write, checkpoint: str, **how):
    """Runs ``write(rows, epoch)`` for each batch with (run_id, at, ..., saved_s) of ``live_counters``: what a run has saved up to ``at``,
    its own time, so a batch that runs again gives the same rows. Returns the started query."""

    def each(batch: DataFrame, epoch: int) -> None:
        write(saved_so_far(batch, F.col("at")), epoch)

    return live_counters(events, **how).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()
