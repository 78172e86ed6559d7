"""Streams with timers and state that ends, over several batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.streaming import live, timed


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches of rows as files, one a trigger, and gives the rows that a query has put out and its checkpoint."""

    def run(schema, build, *batches, mode="append"):
        folder = tmp_path / f"in{len(os.listdir(tmp_path))}"
        folder.mkdir()
        for i, rows in enumerate(batches):
            names = [c.split()[0] for c in schema.split(", ")]
            (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
            os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        name, checkpoint = f"q{folder.name}_{abs(hash(str(tmp_path))) % 10**8}", f"{tmp_path}/cp-{folder.name}"
        q = build(s).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect(), checkpoint

    return run


def t(s):
    return f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"


def state(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def seconds(x):
    return x.hour * 3600 + x.minute * 60 + x.second + x.microsecond / 1e6


def test_stale_by_timer(spark, feed):
    # a falls silent; b keeps the clock going; c comes back after it was stale
    got, checkpoint = feed("session_id string, ts timestamp", lambda s: timed.stale(s, 15, "1 second"), [("a", t(0)), ("a", t(5)), ("b", t(0)), ("c", t(1))], [("b", t(10))], [("b", t(30))], [("c", t(31)), ("b", t(40))], [("b", t(41))])
    rows = sorted((r["session_id"], seconds(r["last_at"]), seconds(r["stale_at"]), r["beats"]) for r in got)
    assert ("a", 5, 20, 2) in rows and ("c", 1, 16, 1) in rows
    assert [r for r in rows if r[0] == "a"] == [("a", 5, 20, 2)] and state(spark, checkpoint, "last") == 2


def test_silence_alone_reclaims_nothing(spark, feed):
    # a: silent and gone; b: silent, no proof; c: proof while it still beats; d: proof without a heartbeat
    beats = [("a", t(0), None), ("a", t(5), None), ("b", t(0), None), ("c", t(0), None), ("c", t(10), None), ("c", t(20), None)]
    proofs = [("a", t(30), True), ("b", t(40), False), ("c", t(12), True), ("d", t(50), True)]
    build = lambda keep: lambda s: timed.reclaimable(s.where("gone is null").drop("gone"), s.where("gone is not null"), 15, keep, "1 minute")
    got, checkpoint = feed("session_id string, ts timestamp, gone boolean", build(86_400), beats + proofs, [("z", t(300), None)])
    assert [r["session_id"] for r in got] == ["a"] and state(spark, checkpoint, "last") == 3
    # forgotten a minute after the last heartbeat
    got, checkpoint = feed("session_id string, ts timestamp, gone boolean", build(60), beats, [("z", t(300), None)], [("z", t(301), None)], [("b", t(302), True)])
    assert got == [] and state(spark, checkpoint, "last") == 1


SAMPLE = "run_id string, ts timestamp, running long, ready long, completed long, failed long"


def test_changed_samples(spark, feed):
    same = (2, 1, 0, 0)
    first = [("r", t(0), *same), ("r", t(1), *same), ("r", t(2), 1, 1, 1, 0), ("r", t(3), 1, 1, 1, 0)]
    got, checkpoint = feed(SAMPLE, lambda s: timed.changed_samples(s, 15, 60, "1 second"), first, [("z", t(30), *same)], [("z", t(31), *same)], [("z", t(200), *same)], [("z", t(201), *same)])
    rows = [(r["run_id"], seconds(r["ts"]), r["running"]) for r in got]
    # the sample of second 3 was held back and kept by timer, without a further one of its run
    assert [r for r in rows if r[0] == "r"] == [("r", 0, 2), ("r", 2, 1), ("r", 17, 1)]
    assert [r[1] for r in rows if r[0] == "z"][:1] == [30] and state(spark, checkpoint, "last") == 1


def test_samples_do_not_depend_on_batches(spark, feed):
    rows = [("r", t(i), i // 7, 0, 0, 0) for i in range(40)]
    build = lambda s: timed.changed_samples(s, 3, 600, "1 minute")
    one, many = (sorted((seconds(r["ts"]), r["running"]) for r in feed(SAMPLE, build, *b)[0]) for b in ([rows], [rows[i : i + 1] for i in range(0, 40)][:12]))
    assert many == [r for r in one if r[0] < 12]


EVENT = "run_id string, task_id string, event string, status string, duration_s double, ready long, ts timestamp"


def test_live_counters_count_once_and_end(spark, feed):
    e = lambda run, task, event, at, status=None, d=None: (run, task, event, status, d, None, t(at))
    start = [e("r", "a", "ready", 0), e("r", "a", "start", 1), e("r", "b", "ready", 0), e("r", "b", "start", 1), e("r", "c", "ready", 2)]
    end = [e("r", "a", "end", 5, "succeeded", 4.0), e("r", "a", "start", 1), e("r", "b", "end", 6, "timed_out", 5.0)]
    last = [e("r", "c", "start", 7), e("r", "c", "end", 8, "succeeded", 1.0)]
    build = lambda s: timed.live_counters(s, 5, 60, "1 second")
    got, checkpoint = feed(EVENT, build, start, end, last, [e("z", "a", "ready", 100)], [e("z", "b", "ready", 101)])
    mine = [(seconds(r["at"]), r["ready"], r["running"], r["completed"], r["failed"]) for r in got if r["run_id"] == "r"]
    assert (2, 1, 2, 0, 0) in mine and (6, 1, 0, 1, 1) in mine and mine[-1][1:] == (0, 0, 2, 1)
    # r is over, and forgotten a minute after its end; z ticks
    assert state(spark, checkpoint, "counts") == 1


def test_counters_tick_without_events(spark, feed):
    e = lambda run, task, event, at: (run, task, event, None, None, None, t(at))
    got, _ = feed(EVENT, lambda s: timed.live_counters(s, 5, 600, "1 second"), [e("r", "a", "start", 0)], [e("z", "a", "ready", 13)], [e("z", "b", "ready", 14)])
    assert [seconds(r["at"]) for r in got if r["run_id"] == "r"] == [0, 5, 10]


def test_savings_are_watched(spark, tmp_path):
    rows = [("r", "a", "start", None, None, 0), ("r", "b", "start", None, None, 0), ("r", "a", "end", "succeeded", 4.0, 4), ("f", "a", "start", None, None, 0), ("f", "a", "end", "failed", 9.0, 9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"run_id": r, "task_id": k, "event": e, "status": s, "duration_s": d, "ts": t(at)}) for r, k, e, s, d, at in rows))
    seen = {}

    def write(batch, epoch):
        seen.update({r["run_id"]: r["saved_s"] for r in batch.collect()})

    q = timed.watch_savings(live.task_events(spark, str(tmp_path / "in")), write, str(tmp_path / "cp"), keep_s=60)
    q.processAllAvailable()
    q.stop()
    # at second 4: 4 done and 4 under way, in 4 seconds
    assert seen == {"r": 4.0, "f": 0.0}


def test_first_seen_and_capacity(spark, feed):
    calls = [("c1", t(0)), ("c1", t(1)), ("c2", t(2))]
    got, _ = feed("call_id string, ts timestamp", lambda s: live.first_seen(s, "call_id"), calls, [("c1", t(3)), ("c3", t(4))])
    assert sorted(r["call_id"] for r in got) == ["c1", "c2", "c3"]
    load = [(t(0), 4.0, 1.0), (t(3), 2.0, 3.0), (t(6), 9.0, 0.5)]
    got, _ = feed("ts timestamp, capacity double, load double", lambda s: live.capacity_signal(s, "1 second"), load, [(t(30), 1.0, 1.0)], [(t(31), 1.0, 1.0)])
    assert sorted((seconds(r["window_start"]), r["capacity"], r["load"]) for r in got) == [(0, 2.0, 3.0), (5, 9.0, 0.5)]
