"""Graph operators over many plans at once: keys are (plan_id, unit_id).

Chains of units are contracted first (``chains``); loops run on the driver, carry what changed last and stop when nothing does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import chains, scan
from weftline.operators.store import cut

# fixed values: kinds of edge that ask for a predecessor that succeeded
ON_SUCCESS = ("hard", "success", "data", "stream", "after_ready", "after_healthy", "after_completion")


def ready_order(units: DataFrame, edges: DataFrame, priority: str, parts: int | None = None) -> DataFrame:
    """(plan_id, unit_id, place): pending units that wait for no pending one, from the highest priority down,
    then by id. ``units``: plan_id, unit_id, status and the priority."""
    pending = units.where("status = 'pending'")
    ahead = pending.select("plan_id", F.col("unit_id").alias("pred_id"))
    waits = edges.select("plan_id", "unit_id", "pred_id").join(ahead, ["plan_id", "pred_id"], "left_semi").select("plan_id", "unit_id")
    ready = pending.join(waits, ["plan_id", "unit_id"], "left_anti").select("plan_id", "unit_id", priority)
    return scan.running(ready, ["plan_id"], [F.desc_nulls_last(priority), F.col("unit_id")], [scan.place("place")], parts).select("plan_id", "unit_id", "place")


def levels(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, unit_id, level): level 0 has no predecessor, others follow their last one.

    Units in a cycle, or below one, have a null level. Edges to unknown units are ignored.
    """
    nodes = units.select("plan_id", "unit_id").distinct()
    links = _known(chains.links_of(edges), nodes)
    return nodes.join(chains.longest(nodes.withColumn("n", F.lit(1)), links, ("n",)), ["plan_id", "unit_id"], "left").select("plan_id", "unit_id", (F.col("n") - 1).cast("int").alias("level"))


def _known(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between known units."""
    return links.join(nodes, ["plan_id", "unit_id"], "left_semi").join(nodes.select("plan_id", F.col("unit_id").alias("pred_id")), ["plan_id", "pred_id"], "left_semi").select("plan_id", "unit_id", "pred_id")


def level_order(unit_levels: DataFrame, paths: DataFrame) -> DataFrame:
    """(plan_id, unit_id, level, path_s, place): the units of a level by longest path, then id."""
    met = unit_levels.where("level is not null").join(paths, ["plan_id", "unit_id"])
    rows = met.select("plan_id", "unit_id", "level", "path_s")
    return scan.running(rows, ["plan_id", "level"], [F.desc_nulls_first("path_s"), F.col("unit_id")], [scan.place("place")])


def ancestors(edges: DataFrame) -> DataFrame:
    """(plan_id, unit_id, ancestor): all predecessors; (u, u) where u is in a cycle.

    Small plans are closed whole. Others by doubling, and only pairs found last are carried on: a shortest way of l steps, with
    L < l <= 2 L, starts with one of L steps, which was found last, and ends with a known one.
    """
    every = cut(edges.select("plan_id", "unit_id", F.col("pred_id").alias("ancestor")).distinct())
    known = F.col("plan_id").isNotNull() & F.col("unit_id").isNotNull() & F.col("ancestor").isNotNull()
    small, large = chains.by_size(every.where(known).withColumnRenamed("ancestor", "pred_id"))
    near = chains.small_closure(small).unionByName(every.where(~known))
    return near if large is None else near.unionByName(_doubled(large))


def _doubled(links: DataFrame) -> DataFrame:
    fresh = now = cut(links.select("plan_id", "unit_id", F.col("pred_id").alias("ancestor")))
    for _ in range(64):
        x = fresh.select("plan_id", F.col("unit_id").alias("low"), F.col("ancestor").alias("mid"))
        far = x.join(now.select("plan_id", F.col("unit_id").alias("mid"), F.col("ancestor").alias("high")), ["plan_id", "mid"]).select("plan_id", "low", "high").distinct()
        known = now.select("plan_id", F.col("unit_id").alias("low"), F.col("ancestor").alias("high"))
        fresh = cut(far.join(known, ["plan_id", "low", "high"], "left_anti").toDF("plan_id", "unit_id", "ancestor"))
        if fresh.isEmpty():
            return now
        now = now.unionByName(fresh)
    raise RuntimeError("closure did not settle")


def longest_path(units: DataFrame, edges: DataFrame, duration: str = "duration_s") -> DataFrame:
    """(plan_id, unit_id, path_s): own duration plus the longest of its children's; failure edges
    don't count, nor do edges to unknown units. Null where a cycle lies below, as the path has no bound there. A null
    or negative duration is 0."""
    own = units.groupBy("plan_id", "unit_id").agg(F.greatest(F.coalesce(F.max(duration).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("path_s"))
    links = _known(chains.turned(chains.links_of(edges.where("kind <> 'failure'"))), own.select("plan_id", "unit_id"))
    return chains.longest(own, links, ("path_s",))


def with_descendants(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, unit_id) of the seeds and all below them."""
    return chains.reachable(seeds, chains.links_of(edges))


def edge_satisfied(kind: str = "kind", pred_status: str = "pred_status"):
    """Whether a finished predecessor lets a unit run: order and finally always, failure unless it
    succeeded, every other kind if it succeeded."""
    k, s = F.col(kind), F.col(pred_status)
    return F.when(k.isin("order", "finally"), F.lit(True)).when(k == "failure", s != "succeeded").when(
        k.isin(*ON_SUCCESS), s == "succeeded"
    ).otherwise(F.lit(False))


def skip_cascade(units: DataFrame, edges: DataFrame, status: str = "status") -> DataFrame:
    """(plan_id, unit_id, status) after pending units with an unsatisfied edge to a finished
    predecessor are skipped, until nothing changes: those at once, and what follows them over edges between pending units
    that a skipped predecessor does not satisfy."""
    now = cut(units.select("plan_id", "unit_id", F.col(status).alias("status")))
    links = cut(edges.select("plan_id", "unit_id", "pred_id", "kind").distinct())
    ended = now.where("status <> 'pending'").select("plan_id", F.col("unit_id").alias("pred_id"), F.col("status").alias("pred_status"))
    pending = now.where("status = 'pending'").select("plan_id", "unit_id").distinct()
    seeds = links.join(ended, ["plan_id", "pred_id"]).where(~edge_satisfied()).select("plan_id", "unit_id").distinct().join(pending, ["plan_id", "unit_id"], "left_semi")
    passing = _known(links.withColumn("pred_status", F.lit("skipped")).where(~edge_satisfied()).select("plan_id", "unit_id", "pred_id").distinct(), pending)
    hit = chains.reachable(seeds, passing).withColumn("skip", F.lit(True))
    return now.join(hit, ["plan_id", "unit_id"], "left").select("plan_id", "unit_id", F.when(F.col("skip") & (F.col("status") == "pending"), "skipped").otherwise(F.col("status")).alias("status"))


def effect_reach(closure: DataFrame, effects: DataFrame, functions: DataFrame) -> DataFrame:
    """(module, fn, effects, in_cycle): own effects and those of all reachable callees.

    ``closure``: (module, fn, callee); a callee that is not among ``functions`` adds unknown_call.
    """
    cycle = closure.where("fn = callee").select("module", "fn").distinct().withColumn("cyc", F.lit(True))
    own = effects.select("module", "fn", "effect")
    far = closure.join(effects.select("module", F.col("fn").alias("callee"), "effect"), ["module", "callee"]).select("module", "fn", "effect")
    unknown = closure.join(functions.select("module", F.col("fn").alias("callee")), ["module", "callee"], "left_anti").select("module", "fn", F.lit("unknown_call").alias("effect"))
    got = own.unionByName(far).unionByName(unknown).groupBy("module", "fn").agg(F.array_sort(F.collect_set("effect")).alias("effects"))
    out = functions.select("module", "fn").distinct().join(got, ["module", "fn"], "left").join(cycle, ["module", "fn"], "left")
    return out.select("module", "fn", F.coalesce("effects", F.array().cast("array<string>")).alias("effects"), F.coalesce("cyc", F.lit(False)).alias("in_cycle"))


def cyclic_edges(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate edges (plan_id, unit_id, pred_id) that lie inside a strongly connected part of
    ``edges`` and the candidates: all of them, whatever order they would be added in."""
    new = chains.links_of(candidates)
    parts = cut(chains.components(chains.links_of(edges).unionByName(new).distinct()))
    ends = parts.select("plan_id", F.col("unit_id").alias("pred_id"), F.col("component").alias("other"))
    inside = new.join(parts, ["plan_id", "unit_id"]).join(ends, ["plan_id", "pred_id"]).where("component = other").select("plan_id", "unit_id", "pred_id")
    return candidates.join(inside, ["plan_id", "unit_id", "pred_id"], "left_semi")


def serialisation_edges(pairs: DataFrame, unit_levels: DataFrame) -> DataFrame:
    """(plan_id, before, after) for unordered conflicting pairs: the lower (level, id) goes first."""
    a = unit_levels.select("plan_id", F.col("unit_id").alias("first"), F.col("level").alias("la"))
    b = unit_levels.select("plan_id", F.col("unit_id").alias("second"), F.col("level").alias("lb"))
    met = pairs.where("not ordered").select("plan_id", "first", "second").distinct().join(a, ["plan_id", "first"]).join(b, ["plan_id", "second"])
    swap = F.col("lb") < F.col("la")
    return met.select("plan_id", F.when(swap, F.col("second")).otherwise(F.col("first")).alias("before"), F.when(swap, F.col("first")).otherwise(F.col("second")).alias("after"))
