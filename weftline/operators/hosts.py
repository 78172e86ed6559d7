"""Claims and capacities, sessions of hosts, shares, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import patterns, scan


def claim_totals(claims: DataFrame, units: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """(plan_id, unit_id, resource, units): sums, with defaults for resources a unit doesn't claim."""
    summed = claims.groupBy("plan_id", "unit_id", "resource").agg(F.sum("units").alias("units"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("resource"), F.lit(float(v)).alias("units")) for k, v in defaults.items()]))
    base = units.select("plan_id", "unit_id", rows.alias("d")).select("plan_id", "unit_id", "d.resource", "d.units")
    return summed.unionByName(base.join(summed, ["plan_id", "unit_id", "resource"], "left_anti"))


def claims_with_costs(claims: DataFrame, units: DataFrame) -> DataFrame:
    """(plan_id, unit_id, resource, units): summed claims; what a unit does not claim it takes from its costs:
    one worker_slot, its cores as cpu_core, its memory_mb, an accelerator_slot of the profile accelerator.
    ``inner_tokens`` (null unless the inner workers are known) are the least cpu_core claimed.
    ``units``: plan_id, unit_id, cores, memory_mb, profile, inner_tokens."""
    row = lambda resource, base, least: F.struct(F.lit(resource).alias("resource"), base.cast("double").alias("base"), least.cast("double").alias("least"))
    no = F.lit(None)
    given = F.array(row("worker_slot", F.lit(1.0), no), row("cpu_core", F.col("cores"), F.col("inner_tokens")), row("memory_mb", F.col("memory_mb"), no), row("accelerator_slot", F.when(F.col("profile") == "accelerator", 1.0), no))
    ids = ["plan_id", "unit_id"]
    base = units.select(*ids, F.explode(given).alias("g")).select(*ids, "g.*", F.lit(None).cast("double").alias("claimed"))
    said = claims.select(*ids, "resource", F.lit(None).cast("double").alias("base"), F.lit(None).cast("double").alias("least"), F.col("units").cast("double").alias("claimed"))
    out = base.unionByName(said).groupBy(*ids, "resource").agg(F.greatest(F.coalesce(F.sum("claimed"), F.max("base")), F.max("least")).alias("units"))
    return out.where("units is not null")


def resource_bounds(units: DataFrame, claims: DataFrame, capacities: DataFrame, seconds: str) -> DataFrame:
    """(plan_id, resource, bound_s): no schedule is shorter than the unit-seconds claimed of a resource over its
    capacity; an unknown capacity is 1."""
    work = claims.join(units.select("plan_id", "unit_id", F.col(seconds).alias("s")), ["plan_id", "unit_id"]).groupBy("plan_id", "resource").agg(F.sum(F.col("units") * F.col("s")).alias("work"))
    return work.join(capacities, ["plan_id", "resource"], "left").select("plan_id", "resource", F.try_divide(F.col("work"), F.coalesce("capacity", F.lit(1.0))).alias("bound_s"))


def resource_capacity(sessions: DataFrame, capacities: DataFrame, claims: DataFrame) -> DataFrame:
    """(resource, capacity, used): the least capacity of the sessions that have ready or running tasks, and what
    all reservations claim. ``sessions``: session_id, ready, running; ``capacities``: session_id, resource,
    capacity; ``claims``: resource, units. A resource that no active session has is left out."""
    active = sessions.where((F.col("ready") > 0) | (F.col("running") > 0)).select("session_id")
    least = capacities.join(active, "session_id", "left_semi").groupBy("resource").agg(F.min("capacity").alias("capacity"))
    used = claims.groupBy("resource").agg(F.sum("units").alias("used"))
    return least.join(used, "resource", "left").select("resource", "capacity", F.coalesce("used", F.lit(0.0)).alias("used"))


def stale_sessions(sessions: DataFrame, processes: DataFrame, now: Column, after_s: float = 15.0) -> DataFrame:
    """(session_id): sessions without a heartbeat for ``after_s`` whose process is proved gone: it is not
    alive, or its id now names another process. ``sessions``: session_id, pid, identity, heartbeat_at;
    ``processes``: pid, alive, identity, an observation. A process nobody observed keeps its session."""
    p = processes.select("pid", "alive", F.col("identity").alias("seen"))
    silent = (now.cast("double") - F.col("heartbeat_at").cast("double")) > after_s
    gone = ~F.col("alive") | F.coalesce(F.col("identity") != F.col("seen"), F.lit(False))
    return sessions.where(silent).join(p, "pid").where(gone).select("session_id").distinct()


def unsatisfiable(claims: DataFrame, capacities: DataFrame) -> DataFrame:
    """Claims above their capacity; an unknown capacity is 1."""
    met = claims.join(capacities, ["plan_id", "resource"], "left").withColumn("capacity", F.coalesce("capacity", F.lit(1.0)))
    return met.where("units > capacity").select("plan_id", "unit_id", "resource", "units", "capacity")


def shared_capacity(sessions: DataFrame, reservations: DataFrame) -> DataFrame:
    """One row: sessions, waiting, running, the least capacity of all sessions, claimed units of
    known sessions and the fair share of what is left for each waiting session."""
    live = sessions.agg(F.count("*").alias("sessions"), F.sum("ready").alias("ready"), F.sum("running").alias("running"), F.min("slots").alias("capacity"), F.sum(F.when(F.col("ready") > 0, 1).otherwise(0)).alias("waiting"))
    held = reservations.join(sessions.select("session_id"), "session_id", "left_semi").agg(F.count("*").alias("reservations"), F.coalesce(F.sum("claim"), F.lit(0.0)).alias("claimed"))
    # one row each
    out = live.withColumn("one", F.lit(1)).join(held.withColumn("one", F.lit(1)), "one").drop("one")
    return out.withColumn("fair_share", F.when(F.col("waiting") > 0, F.col("capacity") / F.col("waiting")).otherwise(F.col("capacity").cast("double")))


def orphans(reservations: DataFrame, sessions: DataFrame) -> DataFrame:
    return reservations.join(sessions.select("session_id"), "session_id", "left_anti")


def external_load(sessions: DataFrame, reservations: DataFrame) -> DataFrame:
    """(session_id, external_load): the observed load less the session's own claims, at least 0. ``sessions``: session_id,
    observed_load (of the last minute) and, where they are known, busy_percent and logical_cpus, whose product is the load
    of the moment and counts first unless it is null or not finite."""
    own = reservations.groupBy("session_id").agg(F.sum("claim").alias("own"))
    load = F.col("observed_load")
    if {"busy_percent", "logical_cpus"} <= set(sessions.columns):
        live = F.col("busy_percent") / 100 * F.col("logical_cpus")
        load = F.coalesce(F.when(~F.isnan(live) & (F.abs(live) != float("inf")), live), load)
    return sessions.join(own, "session_id", "left").select("session_id", F.greatest(F.lit(0.0), load - F.coalesce("own", F.lit(0.0))).alias("external_load"))


def fusion_groups(units: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Per plan and batch key with two or more units: members and what keeps them from one batch.
    ``frontiers``: (plan_id, unit_id, frontier), the sorted predecessors as text. Units without a batch key are in no group."""
    u = units.where("batch_key is not null").join(frontiers, ["plan_id", "unit_id"], "left").withColumn("frontier", F.coalesce("frontier", F.lit("")))
    g = u.groupBy("plan_id", "batch_key").agg(
        F.count("*").alias("members"), F.count_distinct("cwd").alias("cwds"), F.count_distinct("frontier").alias("frontiers"),
        F.bool_or("side_effect").alias("effects"), F.bool_or(F.col("codegen_assurance") != "exact_argv").alias("inexact"), F.count_distinct("retryable").alias("retries"),
    ).where("members >= 2")
    blockers = F.array_compact(F.array(F.when(F.col("cwds") != 1, "MIXED_CWD"), F.when(F.col("frontiers") != 1, "MIXED_DEPENDENCY_FRONTIER"), F.when(F.col("retries") > 1, "MIXED_RETRY_SEMANTICS"), F.when(F.col("inexact"), "NON_EXACT_CODEGEN"), F.when(F.col("effects"), "SIDE_EFFECT_BOUNDARY")))
    return g.select("plan_id", "batch_key", "members", blockers.alias("blockers"))


def frontier(edges: DataFrame) -> DataFrame:
    item = F.concat_ws(":", F.col("pred_id").cast("string"), "kind")
    return edges.groupBy("plan_id", "unit_id").agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("frontier"))


def same_shape(argvs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, same_shape): all argument lists are of one length and differ in exactly one place."""
    places = argvs.select(*keys, F.size("argv").alias("n"), F.posexplode("argv").alias("i", "a"))
    per = places.groupBy(*keys, "i").agg(F.count_distinct("a").alias("values"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    return per.groupBy(*keys).agg(((F.min("lo") == F.max("hi")) & (F.sum(F.when(F.col("values") > 1, 1).otherwise(0)) == 1)).alias("same_shape"))


def weighted_share(rows: DataFrame, group: str = "grp", member: str = "member", parts: int | None = None) -> DataFrame:
    """(group, member, share): each member gets its floor, and the rest by weight up to its cap;
    what capped members can't take goes to the others. If floors exceed the total they are scaled.

    Closed form: members fill up in order of headroom / weight, so the water level is where the
    running sums first cover the rest. A member of weight 0 gets its floor. Running sums are taken in two passes, and
    a group's sums are aggregates, so a group's members may lie in many tasks.
    """
    h = F.greatest(F.lit(0.0), F.col("cap") - F.col("floor_units"))
    base = rows.withColumn("h", F.when(F.col("weight") > 0, h).otherwise(0.0)).withColumn("key", F.when(F.col("weight") > 0, F.col("h") / F.col("weight")))
    folds = [scan.total("hs", F.col("h")), scan.total("ws", F.col("weight"))]
    whole = scan.group_totals(base, [group], floors=F.sum("floor_units"), w_all=F.sum("weight")).withColumn("rest", F.greatest(F.lit(0.0), F.col("total") - F.col("floors")))
    r = scan.running(whole, [group], [F.col("key").asc_nulls_last(), F.col(member)], folds, parts)
    filled = F.col("hs") + F.col("key") * (F.col("w_all") - F.col("ws"))
    level = (F.col("rest") - (F.col("hs") - F.col("h"))) / (F.col("w_all") - (F.col("ws") - F.col("weight")))
    r = scan.group_totals(r, [group], level=F.min(F.when(filled >= F.col("rest"), F.struct("key", member, level.alias("l"))))["l"])
    free = F.col("floor_units") + F.when(F.col("level").isNull(), F.col("h")).otherwise(F.least(F.col("h"), F.col("level") * F.col("weight")))
    return r.select(group, member, F.when(F.col("floors") > F.col("total"), F.col("floor_units") * F.col("total") / F.col("floors")).otherwise(free).alias("share"))


# fixed values: weight of a source of evidence
EVIDENCE = {"marker": 0.16, "directory": 0.18, "glob": 0.18, "make_target": 0.18, "content": 0.20, "tag": 0.20, "tool_volume": 0.20, "agent_task": 0.20, "hint": 0.22}


def evidence_score(hits: DataFrame, weights: dict[str, float], key: str = "project") -> DataFrame:
    """(key, score, label): each source its weight and .03 a further hit up to .06; .08 for three
    or more sources; at most .99. high from .72, medium from .45, else exploratory."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")]
    per = hits.withColumn("s", w + F.least(F.lit(0.06), 0.03 * (F.col("hits") - 1)))
    out = per.groupBy(key).agg(F.sum("s").alias("sum"), F.count_distinct("source").alias("sources"))
    out = out.select(key, "sources", F.least(F.lit(0.99), F.col("sum") + F.when(F.col("sources") >= 3, 0.08).otherwise(0.0)).alias("score"))
    return out.withColumn("label", evidence_label(F.round("score", 9)))


def evidence_label(score: Column) -> Column:
    return F.when(score >= 0.72, "high").when(score >= 0.45, "medium").otherwise("exploratory")


def requirement_gate(scored: DataFrame, requirements: DataFrame, key: str = "scenario") -> DataFrame:
    """Rows that meet what their scenario requires, or are hinted where a hint may override it (unless said
    otherwise it may). Requirements, null or absent: none: min_sources, min_file_hits, min_content_hits,
    min_project_files (of project_files), any_globs, one of which must be among the row's globs_hit."""
    need = ["min_sources", "min_file_hits", "min_content_hits", "min_project_files"]
    rules = requirements.select(key, *[(F.col(c) if c in requirements.columns else F.lit(None).cast("long")).alias(f"_{c}") for c in need], (F.col("any_globs") if "any_globs" in requirements.columns else F.lit(None).cast("array<string>")).alias("_any"), (F.col("hint_overrides") if "hint_overrides" in requirements.columns else F.lit(True)).alias("_may"))
    met = scored.join(rules, key, "left")
    enough = F.lit(True)
    for c in need:
        have = c.removeprefix("min_")
        if have in scored.columns:
            enough = enough & (F.col(have) >= F.coalesce(f"_{c}", F.lit(0)))
    if "globs_hit" in scored.columns:
        enough = enough & ((F.coalesce(F.size("_any"), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap("globs_hit", "_any"), F.lit(False)))
    return met.where(enough | (F.coalesce("_may", F.lit(True)) & F.col("hinted"))).select(*scored.columns)


def detector_hits(evidence: DataFrame, rules: DataFrame, most: int = 5) -> DataFrame:
    """(project, scenario, source, value): evidence that matches a scenario's pattern, at most
    ``most`` a source, the first by value. Rules (scenario, source, pattern) are a catalogue of bounded size; all their
    patterns are tried in one pass over the evidence."""
    met = patterns.value_hits(evidence, rules.select(F.col("scenario").alias("rule"), "source", "pattern")).withColumnRenamed("rule", "scenario")
    few = met.groupBy("project", "scenario", "source").agg(F.slice(F.array_sort(F.collect_set("value")), 1, most).alias("values"))
    return few.select("project", "scenario", "source", F.explode("values").alias("value"))


def ranked_scenarios(scored: DataFrame, k: int) -> DataFrame:
    """The k best scenarios of a project: score, not a guardrail, more goals, then name."""
    w = Window.partitionBy("project").orderBy(F.desc("score"), F.col("guardrail").asc(), F.desc("goals"), "scenario")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def catalog_counts(scenarios: DataFrame) -> DataFrame:
    """(dimension, name, scenarios, goals): scenarios and their goals per category, per layer and in all."""
    by = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(d).cast("string") if d != "all" else F.lit("all")).alias("name")) for d in ("category", "layer", "all")])
    rows = scenarios.select(F.explode(by).alias("b"), F.coalesce(F.size("goals"), F.lit(0)).alias("g")).select("b.*", "g")
    return rows.groupBy("dimension", "name").agg(F.count("*").alias("scenarios"), F.sum("g").alias("goals"))


def targets(scenarios: DataFrame) -> DataFrame:
    """(project, scenario, goal): parallel or conditional goals with an executor, from score .45."""
    rows = scenarios.where("score >= 0.45").select("project", "scenario", F.explode("goals").alias("g"))
    return rows.where(F.col("g.mode").isin("parallel", "conditional") & F.col("g.executor").isNotNull()).select("project", "scenario", F.col("g.name").alias("goal"))


def capacity_windows(rows: DataFrame, ts: str = "ts", width: str = "5 seconds") -> DataFrame:
    """(window_start, least, most) per refresh window; for a stream or a table."""
    return rows.groupBy(F.window(ts, width)).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "least", "most", "n")
