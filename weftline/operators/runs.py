"""Runs of tasks: status, savings, concurrency, ledgers and benchmark evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import scan


def _num(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def run_status(tasks: DataFrame) -> DataFrame:
    """Counts per status, and the ids of tasks that failed, timed out or were skipped. For runs whose ids are too many
    for one row, ``unfinished`` has a row for each."""
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("task_id"))))
    statuses = ("succeeded", "failed", "timed_out", "skipped")
    return tasks.groupBy("run_id").agg(*[_num(F.col("status") == s).alias(s) for s in statuses], *[ids(s).alias(f"{s}_ids") for s in statuses[1:]])


def unfinished(tasks: DataFrame) -> DataFrame:
    """(run_id, status, task_id) of tasks that failed, timed out or were skipped."""
    return tasks.where(F.col("status").isin("failed", "timed_out", "skipped")).select("run_id", "status", "task_id")


def peak_overlap(rows: DataFrame, keys: list[str], start: str, duration: str, units: Column | None = None, parts: int | None = None) -> DataFrame:
    """(keys, peak): the largest sum of units that overlap; an end frees its units before a start
    at the same time. Edges of intervals are summed per moment before the running sum, which is taken in
    two passes, so that the moments of one key may lie in many tasks."""
    u = units if units is not None else F.lit(1)
    up = rows.select(*keys, F.col(start).alias("t"), F.lit(1).alias("o"), u.alias("d"))
    down = rows.select(*keys, (F.col(start) + F.col(duration)).alias("t"), F.lit(0).alias("o"), (-u).alias("d"))
    moments = up.unionByName(down).groupBy(*keys, "t", "o").agg(F.sum("d").alias("d"))
    return scan.running(moments, keys, [F.col("t"), F.col("o")], [scan.total("now", F.col("d"))], parts).groupBy(*keys).agg(F.max("now").alias("peak"))


def run_savings(tasks: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Per run: eligible (some success, and no task that ran failed), comparison seconds (serial
    baseline, else the sum of successful durations), elapsed, speedup, saved, overhead, kind, efficiency."""
    ok, ran = F.col("status") == "succeeded", F.col("status") != "skipped"
    agg = tasks.groupBy("run_id").agg(
        ((_num(ok) > 0) & (_num(ok) == _num(ran))).alias("eligible"),
        F.coalesce(F.sum(F.when(ok, F.col("duration_s"))), F.lit(0.0)).alias("task_s"),
        (F.max(F.when(ran, F.col("start_s") + F.col("duration_s"))) - F.min(F.when(ran, F.col("start_s")))).alias("elapsed_s"),
    )
    agg = agg.join(peak_overlap(tasks.where(ran), ["run_id"], "start_s", "duration_s"), "run_id", "left")
    if baselines is None:
        agg = agg.withColumn("serial_s", F.lit(None).cast("double"))
    else:
        agg = agg.join(baselines.select("run_id", "serial_s"), "run_id", "left")
    kind = F.when(~F.col("eligible"), "ineligible_failed_or_empty_run").when(F.col("serial_s").isNotNull(), "measured_serial_baseline").otherwise("estimated_sum_of_task_durations")
    compare = F.when(F.col("eligible"), F.coalesce("serial_s", "task_s")).otherwise(0.0)
    out = agg.withColumn("kind", kind).withColumn("comparison_s", compare).withColumn("elapsed_s", F.coalesce("elapsed_s", F.lit(0.0)))
    delta = F.when(F.col("eligible"), F.col("comparison_s") - F.col("elapsed_s")).otherwise(0.0)
    speedup = F.when((F.col("elapsed_s") > 0) & (F.col("comparison_s") > 0), F.col("comparison_s") / F.col("elapsed_s")).otherwise(0.0)
    out = out.withColumn("speedup", speedup).withColumn("saved_s", F.greatest(delta, F.lit(0.0))).withColumn("overhead_s", F.greatest(-delta, F.lit(0.0)))
    return out.withColumn("efficiency", F.when(F.coalesce("peak", F.lit(0)) > 0, F.col("speedup") / F.col("peak")).otherwise(0.0)).drop("serial_s", "task_s")


def native_savings_kind(eligible: Column, exclusive: Column, evidence: Column, baseline_ok: Column, case_times: Column) -> Column:
    """The kind of comparison a run of a native worker pool allows, first that applies."""
    return (
        F.when(~eligible, "ineligible_failed_or_empty_run")
        .when(~exclusive, "unavailable_mixed_native_workload")
        .when(~evidence, "unavailable_native_execution_evidence")
        .when(baseline_ok, "measured_serial_baseline")
        .when(case_times, "estimated_sum_of_testcase_durations")
        .otherwise("unavailable_native_serial_comparison")
    )


def ledger_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and seconds by provenance; the primary total is legacy and measured, never estimated.
    Rows of the old ledger carry provenance legacy."""
    of = lambda p: F.coalesce(F.sum(F.when(F.col("provenance") == p, F.col("saved_s"))), F.lit(0.0))
    kinds = ("measured", "estimated", "legacy")
    out = events.groupBy(*keys).agg(*[_num(F.col("provenance") == k).alias(f"{k}_runs") for k in kinds], *[of(k).alias(f"{k}_s") for k in kinds])
    return out.withColumn("primary_s", F.col("legacy_s") + F.col("measured_s"))


def from_old_ledger(rows: DataFrame, version: str = "version") -> DataFrame:
    """A first-version row keeps no proof, so it is legacy whatever it says."""
    return rows.withColumn("provenance", F.when(F.col(version) == 1, F.lit("legacy")).otherwise(F.col("provenance"))).drop(version)


def ledger_running(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Credited seconds of a host so far, by provenance, in order of time and run."""
    return scan.running(events, ["host", "provenance"], [F.col("at"), F.col("run_id")], [scan.total("running_s", F.col("saved_s"))], parts)


def bench_summary(tasks: DataFrame, required: list[str], target_s: float, minimum_s: float) -> DataFrame:
    """Per run: serial, wall, saved, percent, speedup, efficiency, minimum, the gates and the status."""
    tolerance = max(2.0, 0.02 * target_s)
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.col("outer_s"), F.lit(0.0)) <= 0, "invalid_outer_duration"),
        F.when(F.coalesce(F.col("worker_s"), F.lit(0.0)) <= 0, "invalid_worker_duration"),
        F.when(F.abs(F.col("outer_s") - F.col("worker_s")) > tolerance, "worker_outer_duration_mismatch"),
        F.when(F.coalesce(F.col("iterations"), F.lit(0)) <= 0, "invalid_worker_iterations"),
    ))
    t = tasks.withColumn("errors", errors)
    out = t.groupBy("run_id").agg(
        F.sum("worker_s").alias("serial_s"), F.max("outer_s").alias("wall_s"), F.min("worker_s").alias("minimum_s"), F.count("*").alias("tasks"),
        (F.array_sort(F.collect_set("task_id")) == F.array(*[F.lit(x) for x in sorted(required)])).alias("all_present"),
        F.bool_and(F.size("errors") == 0).alias("all_valid"), F.sum(F.size("errors")).alias("error_count"),
    )
    out = out.withColumn("saved_s", F.greatest(F.lit(0.0), F.col("serial_s") - F.col("wall_s"))).withColumn("speedup", F.when(F.col("wall_s") > 0, F.col("serial_s") / F.col("wall_s")).otherwise(0.0))
    out = out.withColumn("percent", F.when(F.col("serial_s") > 0, F.col("saved_s") * 100 / F.col("serial_s")).otherwise(0.0)).withColumn("efficiency", F.col("speedup") / F.col("tasks"))
    return out.withColumn("status", F.when(F.col("all_present") & F.col("all_valid") & (F.col("minimum_s") >= minimum_s), "passed").otherwise("failed"))


def arithmetic_errors(stored: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run_id, wrong): stored wall, serial and saved that differ from the recomputed by over .01."""
    made = tasks.groupBy("run_id").agg(F.max("worker_s").alias("w"), F.sum("worker_s").alias("s"))
    met = stored.join(made, "run_id")
    off = lambda a, b: F.abs(a - b) > 0.01
    wrong = F.array_compact(F.array(F.when(off(F.col("wall_s"), F.col("w")), "wall"), F.when(off(F.col("serial_s"), F.col("s")), "serial"), F.when(off(F.col("saved_s"), F.col("s") - F.col("wall_s")), "saved")))
    return met.select("run_id", wrong.alias("wrong")).where(F.size("wrong") > 0)


def evidence_errors(stored: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run_id, wrong): what of a stored summary does not follow from its tasks or from itself: seconds
    within .01, ratios within .0001. ``stored``: wall_s, serial_s, saved_s, minimum_s, speedup, percent,
    efficiency, peak. A null is wrong; a run without tasks has none to add up."""
    made = tasks.groupBy("run_id").agg(F.sum("worker_s").alias("sum_s"), F.min("worker_s").alias("min_s"))
    c = F.col
    near = lambda a, b, by: F.coalesce(F.abs(a - b) <= by, F.lit(False))
    ratio = F.try_divide(c("serial_s"), c("wall_s"))
    checks = {
        "bounds": F.coalesce((c("wall_s") > 0) & (c("peak") > 0) & (c("serial_s") > 0) & (c("saved_s") >= 0), F.lit(False)),
        "serial": near(c("serial_s"), F.coalesce("sum_s", F.lit(0.0)), 0.01),
        "saved": near(c("saved_s"), F.greatest(F.lit(0.0), c("serial_s") - c("wall_s")), 0.01),
        "minimum": near(c("minimum_s"), F.coalesce("min_s", F.lit(0.0)), 0.01),
        "speedup": near(c("speedup"), ratio, 0.0001),
        "percent": near(c("percent"), F.try_divide(c("saved_s"), c("serial_s")) * 100, 0.0001),
        "efficiency": near(c("efficiency"), F.try_divide(ratio, c("peak")), 0.0001),
    }
    wrong = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()]))
    return stored.join(made, "run_id", "left").select("run_id", wrong.alias("wrong")).where(F.size("wrong") > 0)


def live_sample_seen(samples: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run_id, seen): some sample, from the start of the run until before its end, had every task running, fewer than all
    completed, and savings still eligible. ``samples``: run_id, at_s, running, completed, eligible; null does not count."""
    c = F.col
    ends = tasks.groupBy("run_id").agg(F.count("*").alias("n"), F.min("start_s").alias("began_s"), F.max(c("start_s") + c("duration_s")).alias("end_s"))
    good = (c("running") == c("n")) & (c("completed") >= 0) & (c("completed") < c("n")) & (c("at_s") >= c("began_s")) & (c("at_s") < c("end_s")) & c("eligible")
    return samples.join(ends, "run_id").groupBy("run_id").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("seen"))


def repeat_percentiles(rows: DataFrame, keys: list[str], value: str, least: int = 3, parts: int | None = None) -> DataFrame:
    """(keys, p50, p90, repetitions): exact percentiles, between two values in proportion, of groups with at least
    ``least`` rows. Values are counted first and ranked in two passes: no task holds a group's values."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("repetitions"), F.count(value).alias("known")).where(F.col("repetitions") >= least)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = scan.met(scan.running(counts, keys, [F.col("v")], [scan.total("upto", F.col("n"))], parts), sizes, keys, "inner")
    at = lambda p: p * (F.col("known") - 1)
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    ends = [first(end(at(p))).alias(f"{n}_{which}") for n, p in (("p50", 0.5), ("p90", 0.9)) for which, end in (("lo", F.floor), ("hi", F.ceil))]
    found = scan.met(sizes, ranked.groupBy(*keys).agg(*ends), keys)
    share = lambda p: at(p) - F.floor(at(p))
    between = lambda n, p: (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * share(p)).alias(n)
    return found.select(*keys, between("p50", 0.5), between("p90", 0.9), "repetitions")


def unique_calls(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool").agg(F.count_distinct("call_id").alias("calls"), F.count("*").alias("lines"))


def top_counts(calls: DataFrame, column: str, n: int, key: str = "call_id", order: str = "line_no") -> DataFrame:
    """(column, n): the n most frequent values, of each call the first line alone; ties by value."""
    first = calls.groupBy(key).agg(F.min_by(column, order).alias(column))
    return first.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def plan_profile(units: DataFrame) -> DataFrame:
    """(plan_id, profile, any_accelerator, memory_mb): the one profile or mixed; the largest positive estimate."""
    return units.groupBy("plan_id").agg(
        F.when(F.size(F.collect_set("profile")) == 1, F.min("profile")).otherwise("mixed").alias("profile"),
        F.bool_or(F.col("profile") == "accelerator").alias("any_accelerator"),
        F.max(F.when(F.col("memory_mb") > 0, F.col("memory_mb"))).alias("memory_mb"),
    )
