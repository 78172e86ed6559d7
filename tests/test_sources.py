import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import files, sinks
from weftline.streaming import live


def test_plans(spark, tmp_path):
    plan = {"plan_id": "p", "capacities": {"cores": 4}, "atoms": [{"id": "a", "operation": {"kind": "read"}, "accesses": [{"resource": "r", "mode": "read"}], "claims": [{"resource": "c", "units": 1}, {"resource": "c", "units": 2}], "depends_on": [{"atom": "b"}]}]}
    (tmp_path / "p.json").write_text(json.dumps(plan, indent=1))
    (tmp_path / "bad.json").write_text("{")
    t = files.read_plans(spark, str(tmp_path))
    assert [tuple(r) for r in t["edges"].collect()] == [("p", "a", "b", "success")]
    assert [r["units"] for r in t["claims"].collect()] == [3.0]


def test_traces(spark, tmp_path):
    call = lambda i, n: json.dumps({"type": "response_item", "payload": {"type": "function_call", "call_id": i, "name": n, "namespace": "ns"}})
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"type": "session_meta", "payload": {"cwd": "/x"}}), call("1", "f"), "{broken", call("1", "g"), call("2", "f")]))
    t = files.read_traces(spark, str(tmp_path))
    assert sorted((r["call_id"], r["tool"]) for r in files.calls(t).collect()) == [("1", "ns.f"), ("2", "ns.f")]
    assert files.sessions_of(t, "/x").count() == 1 and files.sessions_of(t, "/y").count() == 0


def test_worker_line_and_reports(spark, tmp_path):
    out = '{"event": "worker_complete", "iterations": 1}\nnoise\n{"event": "worker_complete", "iterations": 2}\n{"event": "x"}'
    assert spark.createDataFrame([(out,)], "o string").select(files.last_worker_line(F.col("o")).alias("w")).first()["w"]["iterations"] == 2
    (tmp_path / "r.xml").write_text('<testsuites><testsuite><testcase classname="c" name="a" time="1.5"/><testcase classname="c" name="b"><failure>x</failure></testcase><testcase classname="c" name="d"><skipped/></testcase></testsuite></testsuites>')
    got = {r["name"]: r["outcome"] for r in files.read_test_cases(spark, str(tmp_path)).collect()}
    assert got["a"] == "passed" and got["b"] == "failed" and got["d"] == "skipped"


def test_content_and_tail(spark, tmp_path):
    (tmp_path / "a.py").write_text("import x\n" + "y\n" * 100)
    (tmp_path / "b.min.js").write_text("import x")
    assert files.content_hits(spark, str(tmp_path), "**/*", "import x").count() == 1
    got = files.tail_sample(spark, str(tmp_path / "a.py"), 5).first()["text"]
    assert got == "y\ny\n"
    assert files.inventory(spark, str(tmp_path)).count() == 2


def run_stream(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streams_in_one_batch_and_many(spark, tmp_path):
    rows = [("r", "ready", None, None, "2024-01-01 00:00:00"), ("r", "start", None, None, "2024-01-01 00:00:01"), ("r", "end", "succeeded", 4.0, "2024-01-01 00:00:05"), ("r", "start", None, None, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "run_id string, event string, status string, duration_s double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, part in enumerate([df.where("event = 'ready'"), df.where("event = 'start'"), df.where("event = 'end'")]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = spark.readStream.schema(df.schema).option("recursiveFileLookup", True)
    out = [run_stream(spark, live.run_counters(r.parquet(f"{tmp_path}/in")), n, "complete")[0].asDict() for r, n in ((read.option("maxFilesPerTrigger", 1), "many"), (read.option("maxFilesPerTrigger", 100), "one"))]
    assert out[0] == out[1] and (out[0]["running"], out[0]["completed"]) == (1, 1)
    saved = live.saved_so_far(live.run_counters(df), "2024-01-01 00:00:11").first()["saved_s"]
    assert saved == 4.0 + 9.0 - 10.0


def test_credit_once_survives_replay(spark, tmp_path):
    ev = spark.createDataFrame([(1, "measured", 5.0, "2024-01-01"), (1, "measured", 7.0, "2024-01-02"), (2, "measured", 1.0, "2024-01-01")], "run_id long, provenance string, saved_s double, at string")
    for i in range(2):
        ev.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sinks.credit_once(s, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sinks.credits(spark, f"{tmp_path}/out").agg(F.sum("saved_s")).first()[0] == 6.0


def test_lines_keep_their_numbers_over_blocks(spark, tmp_path):
    lines = [json.dumps({"type": "event", "payload": {"call_id": str(i)}}) if i % 3 else "{broken" for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = [(r["line_no"], r["payload"]["call_id"]) for r in files.read_traces(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [(i, str(i)) for i in range(400) if i % 3]


def test_histories_of_both_shapes(spark, tmp_path):
    run = lambda i, **k: {"run_id": i, "status": "passed", "wall_time_seconds": 1.0, "serial_equivalent_seconds": 4.0, "saved_seconds": 3.0, "speedup_multiplier": 4.0, **k}
    new = {"realms": {"Linux Box": {"latest": run("b"), "history": [run("a"), run("b@linux-box")]}, "mac": {"history": [run("c", execution_realm="macos_native")]}}, "history": [run("unread")]}
    old = {"latest": run("z", execution_realm="windows_native"), "history": [run("y"), run("x", execution_realm="mac")]}
    for n, d in (("new", new), ("old", old), ("none", {})):
        (tmp_path / f"{n}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "bad.json").write_text("{")
    got = sorted((r["realm"], r["run_id"], r["saved_s"]) for r in files.read_bench_history(spark, str(tmp_path)).collect())
    assert got == [("linux-box", "a@linux-box", 3.0), ("linux-box", "b@linux-box", 3.0), ("mac", "x@mac", 3.0), ("macos_native", "c@macos_native", 3.0), ("windows_native", "y@windows_native", 3.0)]


def test_project_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": "1.2", "results": [{"id": "a", "repetitions": 3, "parallel": {"speedup": 2.0}}, {"id": "b", "environment": {"os": "x"}}]}, indent=1))
    (tmp_path / "e.json").write_text(json.dumps({"schema_version": "1.2", "results": []}))
    (tmp_path / "bad.json").write_text("[{")
    got = sorted((r["schema_version"], r["id"], r["repetitions"], r["parallel"]["speedup"] if r["parallel"] else None) for r in files.read_project_results(spark, str(tmp_path)).collect())
    assert got == [("1.2", "a", 3, 2.0), ("1.2", "b", None, None)]


def test_task_events_feed_the_counters(spark, tmp_path):
    e = [{"run_id": "r", "event": "start", "ts": "2024-01-01T00:00:00"}, {"run_id": "r", "event": "end", "status": "succeeded", "duration_s": 2.0, "ts": "2024-01-01T00:00:02"}, {"run_id": "r", "event": "other"}, {"event": "start"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, e)) + "\n{broken\n")
    got = run_stream(spark, live.run_counters(live.task_events(spark, str(tmp_path / "in"))), "fed", "complete")
    assert [(r["run_id"], r["running"], r["completed"]) for r in got] == [("r", 0, 1)]


CREDIT = "run_id long, provenance string, saved_s double, at string"


def credits_of(spark, path):
    return sorted((r["run_id"], r["saved_s"]) for r in sinks.credits(spark, path).collect())


def test_credits_survive_a_new_checkpoint(spark, tmp_path):
    for part, runs in (("a", [1, 2]), ("b", [3]), ("c", [2, 4])):
        spark.createDataFrame([(r, "measured", float(r), part) for r in runs], CREDIT).coalesce(1).write.parquet(f"{tmp_path}/{part}")
        s = spark.readStream.schema(CREDIT).parquet(f"{tmp_path}/{part}")
        q = sinks.credit_once(s, f"{tmp_path}/out", f"{tmp_path}/checkpoint-{part}", buckets=4)
        q.processAllAvailable()
        q.stop()
    assert credits_of(spark, f"{tmp_path}/out") == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_a_batch_lost_before_its_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    batch = lambda *runs, s=1.0: spark.createDataFrame([(r, "measured", s, "t") for r in runs], CREDIT)
    ledger = sinks.Ledger(spark, f"{tmp_path}/out", 4)
    assert sinks.credits(spark, f"{tmp_path}/out") is None
    ledger.add(batch(1, 2))

    def lost(self, state):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks.Ledger, "_commit", lost)
        with pytest.raises(OSError):
            ledger.add(batch(3, s=9.0))
    assert credits_of(spark, f"{tmp_path}/out") == [(1, 1.0), (2, 1.0)]
    ledger.add(batch(3, 1))
    assert credits_of(spark, f"{tmp_path}/out") == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert ledger.sweep() == 1 and credits_of(spark, f"{tmp_path}/out") == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_two_writers_of_credits_both_count(spark, tmp_path, monkeypatch):
    batch = lambda *runs, s=1.0: spark.createDataFrame([(r, "measured", s, "t") for r in runs], CREDIT)
    ledger, other = (sinks.Ledger(spark, f"{tmp_path}/out", 2) for _ in range(2))
    commit, seen = sinks.Ledger._commit, []

    def overtaken(self, state):
        if self is ledger and not seen:
            seen.append(other.add(batch(1, 5, s=7.0)))
        return commit(self, state)

    monkeypatch.setattr(sinks.Ledger, "_commit", overtaken)
    ledger.add(batch(1, 2))
    assert seen == [1] and credits_of(spark, f"{tmp_path}/out") == [(1, 7.0), (2, 1.0), (5, 7.0)]


def test_buckets_are_read_and_put_together(spark, tmp_path, monkeypatch):
    batch = lambda *runs: spark.createDataFrame([(r, "measured", 1.0, "t") for r in runs], CREDIT)
    monkeypatch.setattr(sinks, "MOST_PIECES", 2)
    ledger = sinks.Ledger(spark, f"{tmp_path}/out", 3)
    for i in range(6):
        ledger.add(batch(*range(i, i + 4)))
    assert [r for r, _ in credits_of(spark, f"{tmp_path}/out")] == list(range(9))
    assert all(len(p) <= 3 for p in ledger.state()["pieces"].values())
    read, rows = [], sinks.Ledger._rows
    monkeypatch.setattr(sinks.Ledger, "_rows", lambda self, state, buckets=None: read.append(buckets) or rows(self, state, buckets))
    version = ledger.state()["version"]
    assert ledger.add(batch(4)) == version and len(read[0]) == 1
    ledger.add(spark.createDataFrame([(None, "measured", 1.0, "t"), (77, "x", 1.0, None), (77, "y", 2.0, "t")], CREDIT))
    assert credits_of(spark, f"{tmp_path}/out")[-1] == (77, 2.0)


def test_reports_are_one_sorted_file(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "n int, a string").repartition(2), f"{tmp_path}/r", "n")
    files_ = list((tmp_path / "r").glob("part-*"))
    assert [json.loads(x) for x in files_[0].read_text().splitlines()] == [{"a": "a", "n": 1}, {"a": "b", "n": 2}] and len(files_) == 1
