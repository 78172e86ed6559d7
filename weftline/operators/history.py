"""Histories: benchmark realms and growth snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import scan


def clean_realm(text: Column, fallback: str = "unknown") -> Column:
    """Lower case; runs of other characters than letters, digits, ``_ . -`` become one dash."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9_.-]+", "-")
    trimmed = F.regexp_replace(dashed, "^[-.]+|[-.]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(fallback)).otherwise(trimmed)


def realm_of(explicit: Column, system: Column, direct: Column, machine: Column, fallback: str = "unknown") -> Column:
    """The explicit realm, else one by operating system, else the record's own, else one by machine text."""
    low, box = F.lower(system), F.lower(machine)
    return (
        F.when(F.coalesce(explicit, F.lit("")) != "", clean_realm(explicit, fallback))
        .when(low == "windows", "windows_native")
        .when(low.isin("darwin", "macos"), "macos_native")
        .when(low == "linux", "linux_native")
        .when(F.coalesce(direct, F.lit("")) != "", clean_realm(direct, fallback))
        .when(box.contains("apple") | box.contains("mac"), "macos_native")
        .when(box.contains("windows"), "windows_native")
        .otherwise(F.lit(fallback))
    )


def qualified(run_id: Column, realm: Column) -> Column:
    end = F.concat(F.lit("@"), realm)
    return F.when(run_id.endswith(end), run_id).otherwise(F.concat(run_id, end))


def cumulative(runs: DataFrame) -> DataFrame:
    """Per realm, passed runs only: count, wall, serial and saved seconds. A realm without one has zeros."""
    ok = F.col("status") == "passed"
    some = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0.0)).alias(c)
    return runs.groupBy("realm").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("passed_runs"), some("wall_s"), some("serial_s"), some("saved_s"))


def latest(runs: DataFrame, key: str = "realm") -> DataFrame:
    """The newest run of each realm, failed ones included; ties go to the larger run id."""
    return _last(runs, [key], ["generated_at", "run_id"])


def last_per_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with the same key the last by position."""
    return _last(rows, [key], [position])


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, nulls first, ties by all columns: an aggregate, which needs no sort of a key's rows."""
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("row")))
    return rows.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(last.alias("last")).select("last.row.*")


def consistency(runs: DataFrame) -> DataFrame:
    """Per realm: one row per run id, and saved = serial - wall in every row."""
    good = F.abs(F.col("saved_s") - (F.col("serial_s") - F.col("wall_s"))) <= 0.01
    return runs.groupBy("realm").agg(F.count("*").alias("runs"), (F.count("*") == F.count_distinct("run_id")).alias("unique_ids"), F.bool_and(good).alias("arithmetic_ok"), F.max("generated_at").alias("newest"))


def evidence(history: DataFrame, newest: DataFrame, totals: DataFrame) -> DataFrame:
    """Per realm whether a published history holds: only passed runs, unique run ids, saved and speedup of
    each row from its own seconds, the newest run in it once and equal, the totals its sums. Seconds within
    .01, speedup within .0001. ``newest``: one row a realm; ``totals``: realm, run_count, wall_s, serial_s, saved_s."""
    near = lambda a, b, by=0.01: F.coalesce(F.abs(a - b) <= by, F.lit(False))
    c, sec = F.col, ("wall_s", "serial_s", "saved_s")
    row = (c("wall_s") > 0) & (c("serial_s") > 0) & (c("saved_s") >= 0) & near(c("saved_s"), F.greatest(F.lit(0.0), c("serial_s") - c("wall_s"))) & near(c("speedup"), F.try_divide(c("serial_s"), c("wall_s")), 0.0001)
    now = newest.select("realm", *[c(x).alias(f"now_{x}") for x in ("run_id", *sec, "speedup")])
    is_now = c("run_id") == c("now_run_id")
    equal = near(c("speedup"), c("now_speedup"), 0.0001)
    for x in sec:
        equal = equal & near(c(x), c(f"now_{x}"))
    per = history.join(now, "realm", "left").groupBy("realm").agg(
        F.bool_and(F.coalesce(c("status") == "passed", F.lit(False))).alias("all_passed"), (F.count("*") == F.count_distinct("run_id")).alias("unique_ids"), F.bool_and(F.coalesce(row, F.lit(False))).alias("arithmetic_ok"),
        ((F.count(F.when(is_now, 1)) == 1) & (F.count(F.when(is_now & equal, 1)) == 1)).alias("current_ok"), F.count("*").alias("n"), *[F.sum(x).alias(f"sum_{x}") for x in sec],
    )
    good = F.coalesce(c("run_count") == c("n"), F.lit(False))
    for x in sec:
        good = good & near(c(x), c(f"sum_{x}"))
    return per.join(totals, "realm", "left").select("realm", "all_passed", "unique_ids", "arithmetic_ok", "current_ok", good.alias("cumulative_ok"))


def carry_forward(rows: DataFrame, key: str = "counter", at: str = "captured_on", value: str = "n", parts: int | None = None) -> DataFrame:
    """Fills a null value from the last known one. ``stale_from_previous`` is the time of the row
    before a filled one, ``last_real_at`` that of the last real sample. Counters are few and long: the values
    known last are carried from part to part."""
    real = F.when(F.col(value).isNotNull(), F.col(at))
    folds = [scan.last_known("filled", F.col(value)), scan.last_known("last_real_at", real), scan.row_before("previous", F.col(at))]
    seen = scan.running(rows.select(key, at, value), [key], [F.col(at)], folds, parts)
    stale = F.when(F.col(value).isNull() & F.col("filled").isNotNull(), F.col("previous"))
    return seen.select(key, at, "filled", stale.alias("stale_from_previous"), "last_real_at")


def append_keeping(old: DataFrame, new: DataFrame, key: str, order: str, keep: int = 180) -> DataFrame:
    """Old rows without the new keys, then the new; the last ``keep`` by order stay."""
    every = old.join(new.select(key), key, "left_anti").unionByName(new)
    return every.orderBy(F.desc(order), F.desc(key)).limit(keep)


def target_progress(counters: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(counter, value, target, ratio) of the latest row's counters, each a column."""
    names = list(targets)
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    long = counters.selectExpr(f"stack({len(names)}, {pairs}) as (counter, value)")
    goal = F.create_map(*[F.lit(x) for n in names for x in (n, float(targets[n]))])
    return long.withColumn("target", goal[F.col("counter")]).withColumn("ratio", F.col("value") / F.col("target"))
