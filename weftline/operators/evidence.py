"""Evidence about sources, test suites and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import chains
from weftline.operators.store import cut


def _num(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def snapshot_drift(expected: DataFrame, current: DataFrame) -> DataFrame:
    """(plan_id, path, state): same, changed, missing (expected only) or new (current only); a
    current row without a digest is unreadable."""
    e = expected.select("plan_id", "path", F.col("digest").alias("was"), F.lit(True).alias("e"))
    c = current.select("plan_id", "path", F.col("digest").alias("now"), F.lit(True).alias("c"))
    state = F.when(F.col("e").isNull(), "new").when(F.col("c").isNull(), "missing").when(F.col("now").isNull(), "unreadable").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return e.join(c, ["plan_id", "path"], "full_outer").select("plan_id", "path", state.alias("state"))


def dyadic(first: Column, last: Column) -> Column:
    """The whole numbers from first to last as the fewest blocks (level, at): those that shifted right by level
    give at. At most two a level; empty where first is null or above last."""
    at = lambda c, k: F.call_function("shiftright", c, k)

    def blocks(k: Column) -> Column:
        lo, hi = at(first + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), at(last + 1, k)
        piece = lambda odd, x: F.when((lo < hi) & (odd % 2 != 0), F.struct(k.alias("level"), x.alias("at")))
        return F.array_compact(F.array(piece(lo, lo), piece(hi, hi - 1)))

    top = F.length(F.bin(last - first + 1))
    return F.when(first <= last, F.flatten(F.transform(F.sequence(F.lit(0), top), blocks))).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))


def hotspot_spans(spans: DataFrame, hotspots: DataFrame) -> DataFrame:
    """(path, span_id, hotspot_id, wall_s): of the hotspots inside a span the one with the largest
    wall time, then the lowest line.

    A span is cut into the fewest blocks of lines whose sizes are powers of two, a hotspot lies in one block of each size; they
    meet by path and block. So a span of n lines is some 2 log n rows, a hotspot a row for each size that spans have.
    """
    line = lambda c: F.floor(F.col(c)).cast("long")
    longest = spans.agg(F.max(line("last_line") - line("first_line"))).first()[0] or 0
    cuts = spans.where("first_line <= last_line").withColumn("block", F.explode(dyadic(line("first_line"), line("last_line"))))
    sizes = F.sequence(F.lit(0), F.lit(max(1, int(longest) + 1).bit_length()))
    spots = hotspots.withColumn("block", F.explode(F.transform(sizes, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", line("line"), k).alias("at")))))
    met = cuts.join(spots, ["path", "block"]).where((F.col("first_line") <= F.col("line")) & (F.col("line") <= F.col("last_line")))
    best = F.max_by(F.struct("hotspot_id", "wall_s"), F.struct("wall_s", -F.col("line"), -F.col("hotspot_id"))).alias("b")
    return met.groupBy("path", "span_id").agg(best).select("path", "span_id", "b.hotspot_id", "b.wall_s")


def baseline_match(cases: DataFrame) -> DataFrame:
    """(suite_id, serial_set, parallel_set, same): digests of the sorted case identities of both sides."""
    digest = lambda side: F.md5(F.array_join(F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("case_id").cast("string")))), ","))
    has = lambda side: _num(F.col("side") == side) > 0
    out = cases.groupBy("suite_id").agg(digest("serial").alias("serial_set"), digest("parallel").alias("parallel_set"), has("serial").alias("s"), has("parallel").alias("p")).where("s and p")
    return out.select("suite_id", "serial_set", "parallel_set", (F.col("serial_set") == F.col("parallel_set")).alias("same"))


def baseline_compatible(baselines: DataFrame, reports: DataFrame) -> DataFrame:
    """(suite_id, compatible): a serial baseline fits a fresh parallel report of its suite: as many tests, as
    many passed, none skipped on either side, the same case set, and the report counts as evidence.
    Both: suite_id, tests, passed, skipped, case_set; reports also eligible. Null on either side: not compatible."""
    b = baselines.select("suite_id", *[F.col(c).alias(f"b_{c}") for c in ("tests", "passed", "skipped", "case_set")])
    fits = F.col("eligible") & (F.col("b_tests") == F.col("tests")) & (F.col("b_passed") == F.col("passed")) & (F.col("b_skipped") == 0) & (F.col("skipped") == 0) & (F.col("b_case_set") == F.col("case_set"))
    return b.join(reports, "suite_id").select("suite_id", F.coalesce(fits, F.lit(False)).alias("compatible"))


def fingerprint(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fingerprint): SHA-256 over all rows of a key, whatever their order, repeats included.

    Rows are hashed as JSON, digests of equal first three hex digits are hashed in sorted order, and
    these again, so that no group holds more than a small part of a large key's digests.
    """
    digest = rows.select(key, F.sha2(F.to_json(F.struct(*fields)), 256).alias("d"))
    joined = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d")
    return digest.groupBy(key, F.substring("d", 1, 3).alias("part")).agg(joined()).groupBy(key).agg(joined()).withColumnRenamed("d", "fingerprint")


def case_fingerprint(cases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint): SHA-256 of the sorted case identities, whatever the order of rows."""
    identity = F.struct("classname", "name", "file", "line")
    return cases.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(identity))), 256).alias("fingerprint"))


def suite_summary(cases: DataFrame, suites: DataFrame) -> DataFrame:
    """Counts of each suite, whether its declared count is the observed one, and whether its case
    times are plausible: at most wall * workers and a tolerance of the larger of .05 and 5 %."""
    seen = cases.groupBy("run_id", "suite_id").agg(F.count("*").alias("tests"), *[_num(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "skipped")], F.sum("time_s").alias("case_s"), F.bool_and(F.col("time_s").isNotNull()).alias("timing_complete"))
    room = F.col("wall_s") * F.col("workers")
    met = suites.join(seen, ["run_id", "suite_id"])
    out = met.withColumn("consistent", F.col("declared_tests") == F.col("tests")).withColumn("timing_plausible", F.col("case_s") <= room + F.greatest(F.lit(0.05), room * 0.05))
    eligible = F.col("consistent") & F.col("timing_plausible") & (F.col("tests") > 0) & (F.col("failed") == 0)
    return out.withColumn("eligible", eligible)


def run_report(summary: DataFrame) -> DataFrame:
    """Totals over the suites of a run, and what they are evidence of.

    ``summary``: as ``suite_summary`` gives it, with fresh (the report is of this run; null: no) and exclusive (the run does
    nothing but tests; of one run alike). fresh: all reports are. timing_complete: every case has a plausible time. evidence: an exclusive
    run whose reports are all fresh and consistent, with passed cases and no failed one. comparison_kind: with complete
    times of more than 0 s, ``fresh_junit_testcase_durations``, else null.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    out = summary.groupBy("run_id").agg(
        F.count("*").alias("suites"), *[F.sum(x).alias(x) for x in ("tests", "passed", "failed", "skipped")], F.bool_and("eligible").alias("all_eligible"), _num(yes(c("fresh"))).alias("fresh_suites"), F.bool_and(yes(c("fresh"))).alias("fresh"),
        F.bool_and(yes(c("consistent"))).alias("consistent"), F.bool_and(yes(c("timing_complete") & c("timing_plausible"))).alias("timing_complete"), F.sum("case_s").alias("case_s"), F.bool_and(yes(c("exclusive"))).alias("exclusive"),
    )
    out = out.withColumn("timing_complete", c("timing_complete") & (c("tests") > 0)).withColumn("attribution", F.when(c("exclusive"), "exclusive_test_plan").otherwise("unavailable_mixed_workload"))
    out = out.withColumn("evidence", c("exclusive") & c("fresh") & c("consistent") & (c("tests") > 0) & (c("passed") > 0) & (c("failed") == 0))
    kind = F.when(c("evidence") & c("timing_complete") & (c("case_s") > 0), "fresh_junit_testcase_durations")
    return out.withColumn("comparison_kind", kind).drop("consistent", "exclusive", "case_s")


def domain_rollup(cases: DataFrame, modules: DataFrame, module_of: Column) -> DataFrame:
    """Per module, with modules that have no case: total, outcomes, seconds and pass rate
    (passed of those neither skipped nor expected to fail, 0 where there are none)."""
    seen = cases.withColumn("module", module_of).groupBy("module").agg(F.count("*").alias("total"), *[_num(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "skipped", "expected_failure")], F.sum("time_s").alias("case_s"))
    zero = ["total", "passed", "failed", "skipped", "expected_failure"]
    out = modules.join(seen, "module", "left").select("module", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], F.coalesce("case_s", F.lit(0.0)).alias("case_s"))
    return out.withColumn("pass_rate", F.coalesce(F.col("passed") / F.nullif(F.col("total") - F.col("skipped") - F.col("expected_failure"), F.lit(0)), F.lit(0.0)))


def inconsistent_reports(stored: DataFrame, cases: DataFrame, key: list[str], total: str) -> DataFrame:
    """(key, stored, observed) where a stored total is not the one recomputed from the rows,
    or where one side is missing."""
    seen = cases.groupBy(*key).agg(F.count("*").alias("observed"))
    return stored.select(*key, F.col(total).alias("stored")).join(seen, key, "full_outer").where(~F.col("stored").eqNullSafe(F.col("observed")))


def domain_errors(stored: DataFrame, cases: DataFrame) -> DataFrame:
    """(module, wrong): stored counts (total, passed, failed, errors, skipped) that are not those of the cases
    (module, status). ``missing``: cases without a stored module; ``unknown``: the other way round."""
    names = {"passed": "passed", "failed": "failed", "errors": "error", "skipped": "skipped"}
    seen = cases.groupBy("module").agg(F.count("*").alias("s_total"), *[_num(F.col("status") == v).alias(f"s_{k}") for k, v in names.items()])
    met = stored.withColumn("s", F.lit(True)).join(seen, "module", "full_outer")
    off = [F.when(~F.col(k).eqNullSafe(F.col(f"s_{k}")), k) for k in ("total", *names)]
    wrong = F.when(F.col("s").isNull(), F.array(F.lit("missing"))).when(F.col("s_total").isNull(), F.array(F.lit("unknown"))).otherwise(F.array_compact(F.array(*off)))
    return met.select("module", wrong.alias("wrong")).where(F.size("wrong") > 0)


def serial_baselines(runs: DataFrame, suites: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, eligible): whether a run may serve as a serial baseline: no native pool, one task at a time,
    each suite with one worker, its sources declared and covered, passed wholly and nothing skipped, and a
    succeeded result for exactly these suites. ``runs``: run_id, native_pools, peak; ``suites``: run_id,
    suite_id, workers, snapshots, declared, covered, tests, passed, skipped, case_set; ``results``: run_id,
    suite_id, status. Nulls speak against it, as does a run without suites."""
    c = F.col
    fit = (c("workers") == 1) & (c("snapshots") >= 1) & c("declared") & c("covered") & (c("skipped") == 0) & (c("passed") == c("tests")) & c("case_set").isNotNull()
    s = suites.groupBy("run_id", "suite_id").agg(F.bool_and(F.coalesce(fit, F.lit(False))).alias("fit"), F.count("*").alias("ns"))
    r = results.groupBy("run_id", "suite_id").agg(F.bool_and(F.coalesce(c("status") == "succeeded", F.lit(False))).alias("won"), F.count("*").alias("nr"))
    each = F.coalesce(c("fit") & c("won") & (c("ns") == c("nr")), F.lit(False))
    per = s.join(r, ["run_id", "suite_id"], "full_outer").groupBy("run_id").agg(F.bool_and(each).alias("each"))
    good = (c("native_pools") == 0) & (c("peak") == 1) & c("each")
    return runs.join(per, "run_id", "left").select("run_id", F.coalesce(good, F.lit(False)).alias("eligible"))


def baseline_eligible(summary: DataFrame) -> DataFrame:
    """(run_id, eligible): all suites of a run passed wholly, nothing skipped, counts as declared."""
    return summary.groupBy("run_id").agg(F.bool_and((F.col("passed") == F.col("tests")) & (F.col("skipped") == 0) & F.col("consistent")).alias("eligible"))


def evidence_still_valid(run_commits: DataFrame, parents: DataFrame, changes: DataFrame, head: str, allowed_prefix: str = "docs/") -> DataFrame:
    """(run_id, valid): the run's commit is the head, or an ancestor of it since which something was
    changed, and only paths under ``allowed_prefix``. ``parents``: (commit, parent), or (commit, ancestor) of all; ``changes``: (commit, path).

    Two sweeps from the head: what can be reached from it, and on the ways there the most commits that
    changed something, and something else than allowed, above each.
    """
    up = parents.select(F.lit(0).alias("plan_id"), F.col("parent" if "parent" in parents.columns else "ancestor").alias("unit_id"), F.col("commit").alias("pred_id")).where("unit_id is not null and pred_id is not null").distinct()
    start = parents.sparkSession.createDataFrame([(0, head)], "plan_id int, unit_id string")
    older = cut(chains.reachable(start, up))
    ways = up.join(older.select("plan_id", F.col("unit_id").alias("pred_id")), ["plan_id", "pred_id"], "left_semi").select("plan_id", "unit_id", "pred_id")
    marks = changes.groupBy(F.col("commit").alias("unit_id")).agg(F.lit(1).alias("some"), F.max(F.when(F.col("path").startswith(allowed_prefix), 0).otherwise(1)).alias("other"))
    none = F.lit(0)
    own = older.join(marks, "unit_id", "left").select("plan_id", "unit_id", F.coalesce("some", none).alias("some"), F.coalesce("other", none).alias("other"))
    most = chains.longest(own, ways, ("some", "other")).toDF("plan_id", "unit_id", "most_some", "most_other")
    fine = own.join(most, ["plan_id", "unit_id"]).where("most_some > some and most_other = other").select(F.col("unit_id").alias("commit"), F.lit(True).alias("fine"))
    return run_commits.join(fine, "commit", "left").select("run_id", F.coalesce((F.col("commit") == head) | F.coalesce("fine", F.lit(False)), F.lit(False)).alias("valid"))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The last n rows of each key by the given descending order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
