"""Graphs without their closure: chains are contracted, what is left is walked by its frontier.

Only plans of up to ``SMALL`` links are closed, each in one row. Chains are first ranked inside ranges of their units, so that
where ids follow the links as few units as ranges have entries look further.

A link (plan_id, unit_id, pred_id) says that the unit follows its predecessor. Links from the only predecessor of
a unit that is this one's only successor form chains. Chains are ranked by pointer jumping: every unit looks ahead
twice as far each round, so a chain of n units takes log n rounds; what never comes to an end is a ring. The graph
of chains is then settled, searched or coloured round by round, and only what changed last is carried on. So
the rounds are as many as the longest way over branches and joins, not over units.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.store import cut, cut_counting

KEY = ["plan_id", "unit_id"]
MOST_ROUNDS = 10_000
#: rounds after which what was found is written together
TOGETHER = 24
#: links of a plan that is closed whole, in one row; units of a range of a chain that are ranked in one task
SMALL, RANGE = 64, 500_000


class Chains(NamedTuple):
    #: plan_id, unit_id, head, hops and sums from the head (without it) to the unit; in a ring head is null and ring its least unit
    placed: DataFrame
    #: plan_id, unit_id (a head), pred_id (a head), hops, sums: from a chain's head to where it leads into another
    links: DataFrame


def links_of(edges: DataFrame) -> DataFrame:
    """Distinct links; a closure (plan_id, unit_id, ancestor) is as good as the edges it is of."""
    pred = "pred_id" if "pred_id" in edges.columns else "ancestor"
    return edges.select(*KEY, F.col(pred).alias("pred_id")).where("plan_id is not null and unit_id is not null and pred_id is not null").distinct()


def ends_of(links: DataFrame) -> DataFrame:
    return links.select(*KEY).unionByName(links.select("plan_id", F.col("pred_id").alias("unit_id"))).distinct()


def turned(links: DataFrame) -> DataFrame:
    swap = {"unit_id": "pred_id", "pred_id": "unit_id"}
    return links.select(*[F.col(swap.get(c, c)).alias(c) for c in links.columns])


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_size(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``links`` (written, distinct) of plans of at most ``SMALL`` links, and of larger plans where there are any."""
    large, n = cut_counting(links.groupBy("plan_id").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("plan_id"))
    return (links.join(large, "plan_id", "left_anti"), links.join(large, "plan_id", "left_semi")) if n else (links, None)


def _closed(units: list, preds: list) -> dict:
    """All that each unit of a small plan follows; itself too in a cycle."""
    above: dict = {}
    for u, p in zip(units, preds):
        above.setdefault(u, set()).add(p)
    more = True
    while more:
        more = False
        for u, s in above.items():
            far = s.union(*(above[p] for p in s if p in above))
            if len(far) > len(s):
                above[u], more = far, True
    return above


def _closure_rows(units: list, preds: list) -> list[tuple]:
    return [(u, a) for u, s in _closed(units, preds).items() for a in s]


def _component_rows(units: list, preds: list) -> list[tuple]:
    above = _closed(units, preds)
    return [(u, min(a for a in s if a in above and u in above[a])) for u, s in above.items() if u in s]


def _whole(small: DataFrame, rows, name: str) -> DataFrame:
    """(plan_id, unit_id, ``name``): what ``rows`` gives for all links of each small plan."""
    kind = small.schema["unit_id"].dataType.simpleString()
    found = F.udf(rows, f"array<struct<unit_id:{kind},{name}:{kind}>>")
    plans = small.groupBy("plan_id").agg(F.collect_list(F.struct("unit_id", "pred_id")).alias("l"))
    return plans.select("plan_id", F.explode(found("l.unit_id", "l.pred_id")).alias("r")).select("plan_id", "r.*")


def small_closure(small: DataFrame) -> DataFrame:
    """(plan_id, unit_id, ancestor) of small plans; (u, u) where u is in a cycle."""
    return _whole(small, _closure_rows, "ancestor")


def small_above(small: DataFrame, parts: int) -> DataFrame:
    """(plan_id, above) of small plans, made in ``parts``: for each unit that follows others all of them."""
    kind = small.schema["unit_id"].dataType.simpleString()
    found = F.udf(lambda units, preds: {u: list(s) for u, s in _closed(units, preds).items()}, f"map<{kind},array<{kind}>>")
    plans = small.repartition(parts, "plan_id").groupBy("plan_id").agg(F.collect_list(F.struct("unit_id", "pred_id")).alias("l"))
    return plans.select("plan_id", found("l.unit_id", "l.pred_id").alias("above"))


class _Found:
    """Rows found round by round, written together now and then."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > TOGETHER:
            self.parts = [cut(_union(self.parts))]

    def all(self) -> DataFrame:
        return _union(self.parts)


def _further(rows: DataFrame, ahead: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """``rows`` that look on to where the unit they look at looks."""
    ahead = ahead.select("plan_id", F.col("unit_id").alias("at"), F.col("at").alias("at_2"), *[F.col(c).alias(f"{c}_2") for c in ("hops", *sums, "ring", "done")])
    plus = [(F.col(c) + F.col(f"{c}_2")).alias(c) for c in ("hops", *sums)]
    return rows.join(ahead, ["plan_id", "at"]).select(*KEY, F.col("at_2").alias("at"), *plus, F.least("ring", "ring_2").alias("ring"), F.col("done_2").alias("done"))


def _in_ranges(begun: DataFrame, sums: tuple[str, ...], parts: int) -> DataFrame:
    """``begun``, every unit looking as far ahead as the units of its range of (plan_id, unit_id) lead; pointers are
    jumped inside each range. A ring inside one looks at itself."""
    names = begun.columns

    def run(batches):
        batches = list(batches)
        # a part without rows may have no batches either
        if not any(b.num_rows for b in batches):
            return
        t = pa.Table.from_batches(batches)
        n, d = t.num_rows, {c: t.column(c).to_pandas().to_numpy() for c in names}
        plan, unit = pd.factorize(d["plan_id"])[0].astype(np.int64), pd.factorize(np.concatenate([d["unit_id"], d["at"]]))[0].astype(np.int64)
        key, wide = plan * (2 * n) + unit[:n], plan * (2 * n) + unit[n:]
        ahead = np.where(d["done"], -1, pd.Index(key).get_indexer(wide))
        for _ in range(n.bit_length() + 1):
            i = np.flatnonzero(ahead >= 0)
            if not len(i):
                break
            j = ahead[i]
            new = {c: d[c][i] + d[c][j] for c in ("hops", *sums)} | {c: d[c][j] for c in ("at", "done")} | {"ring": np.where(d["ring"][j] < d["ring"][i], d["ring"][j], d["ring"][i])}
            for c, v in new.items():
                d[c] = d[c].copy() if not d[c].flags.writeable else d[c]
                d[c][i] = v
            ahead[i] = ahead[j]
        yield from pa.Table.from_pydict({c: pa.array(d[c], t.schema.field(c).type) for c in names}).to_batches(65_536)

    ranged = begun.coalesce(1) if parts == 1 else begun.repartitionByRange(parts, *KEY)
    return ranged.mapInArrow(run, begun.schema)


def contract(nodes: DataFrame, links: DataFrame, sums: tuple[str, ...] = (), parts: int | None = None) -> Chains:
    """``nodes``: plan_id, unit_id (distinct) and a number for each of ``sums``; ``links``: distinct, between nodes.
    ``parts``: ranges whose chains are ranked in a task each before ranges are; by default of ``RANGE`` links."""
    nodes, links = cut(nodes.select(*KEY, *sums)), cut(links.select(*KEY, "pred_id"))
    lone = links.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("pred_id").alias("pred_id")).where("n = 1").drop("n")
    only = links.groupBy("plan_id", "pred_id").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    inner = cut(lone.join(only, ["plan_id", "pred_id"], "left_semi").select(*KEY, "pred_id"))
    beyond = inner.select("plan_id", F.col("unit_id").alias("at"), F.lit(False).alias("here"))
    chain = inner.join(nodes, KEY).withColumnRenamed("pred_id", "at").join(beyond, ["plan_id", "at"], "left")
    begun = chain.select(*KEY, "at", F.lit(1).cast("long").alias("hops"), *sums, F.col("unit_id").alias("ring"), F.coalesce("here", F.lit(True)).alias("done"))
    begun, n = cut_counting(begun)
    near, left = cut_counting(_in_ranges(begun, sums, n // RANGE + 1 if parts is None else parts), ~F.col("done"))
    # what leads out of its range leads to an entry of another one: only entries look further ahead, the rest looks at them
    entries = cut(near.where("not done").select("plan_id", F.col("at").alias("unit_id")).distinct()) if left else None
    chain, left = cut_counting(near.join(entries, KEY, "left_semi"), ~F.col("done")) if left else (near.where("false"), 0)
    done, active = [chain.where("done")], chain.where("not done")
    jumps = 0
    while left:
        before, jumps = left, jumps + 1
        active, left = cut_counting(_further(active, _union([*done, active]), sums), ~F.col("done"))
        done.append(active.where("done"))
        active = active.where("not done")
        # as long as a chain is not ranked some of its units come to its head each round; the rest is rings, looked over once
        # the jumps are as long as all of them
        if left == before and 1 << jumps >= left:
            break
    if entries is None:
        done = [near]
    else:
        others = near.join(entries, KEY, "left_anti")
        far = cut(_further(others.where("not done"), _union([*done, active]), sums))
        done, active = [*done, others.where("done"), far.where("done")], active.unionByName(far.where("not done"))
    cols = ["hops", *sums]
    none = F.lit(None)
    kind = nodes.schema["unit_id"].dataType
    heads = nodes.join(inner.select(*KEY), KEY, "left_anti").select(*KEY, F.col("unit_id").alias("head"), F.lit(0).cast("long").alias("hops"), *[F.lit(0).cast(nodes.schema[c].dataType).alias(c) for c in sums], none.cast(kind).alias("ring"))
    inside = _union(done).select(*KEY, F.col("at").alias("head"), *cols, none.cast(kind).alias("ring"))
    rings = active.select(*KEY, none.cast(kind).alias("head"), *cols, "ring")
    placed = cut(heads.unionByName(inside).unionByName(rings))
    into = links.join(inner.select(*KEY), KEY, "left_anti")
    where = placed.select("plan_id", F.col("unit_id").alias("pred_id"), "head", *cols)
    crossing = into.join(where, ["plan_id", "pred_id"]).select(*KEY, F.col("head").alias("pred_id"), *cols)
    return Chains(placed, cut(crossing))


def settle(nodes: DataFrame, links: DataFrame, sums: tuple[str, ...] = (), maxima: tuple[str, ...] = ()) -> DataFrame:
    """(plan_id, unit_id, values) of the nodes that settle: those that wait for no node, then those that wait for these.

    A sum is the node's own number plus the largest, or 0, of its predecessors' plus that of the link; a maximum is
    the largest of its own and its predecessors'. Nodes in a cycle or after one don't settle. A round carries
    the nodes that some but not all predecessors have reached.
    """
    names = [*sums, *maxima]
    waits = links.groupBy(*KEY).agg(F.count("*").alias("__waits"))
    info = cut(nodes.select(*KEY, *names).join(waits, KEY, "left").withColumn("__waits", F.coalesce("__waits", F.lit(0))))
    fresh = info.where("__waits = 0").select(*KEY, *names)
    found, partial = _Found(fresh), None
    for _ in range(MOST_ROUNDS):
        reached = links.join(fresh.select("plan_id", F.col("unit_id").alias("pred_id"), *[F.col(c).alias(f"{c}_in") for c in names]), ["plan_id", "pred_id"])
        passed = reached.select(*KEY, F.lit(1).cast("long").alias("__n"), *[(F.col(f"{c}_in") + F.col(c)).alias(f"{c}_in") for c in sums], *[f"{c}_in" for c in maxima])
        every = passed if partial is None else passed.unionByName(partial)
        met = every.groupBy(*KEY).agg(F.sum("__n").alias("__n"), *[F.max(f"{c}_in").alias(f"{c}_in") for c in names]).join(info, KEY)
        met, settled = cut_counting(met, F.col("__n") == F.col("__waits"))
        ready = met.where("__n = __waits")
        fresh = ready.select(*KEY, *[(F.col(c) + F.greatest(F.col(f"{c}_in"), F.lit(0))).alias(c) for c in sums], *[F.greatest(c, f"{c}_in").alias(c) for c in maxima])
        if not settled:
            return found.all()
        partial = met.where("__n < __waits").select(*KEY, "__n", *[f"{c}_in" for c in names])
        found.add(fresh)
    raise RuntimeError("too many rounds")


def longest(nodes: DataFrame, links: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """(plan_id, unit_id, sums): for each number the largest total on a way that ends in the unit, itself included;
    null in and after a cycle. ``nodes``: plan_id, unit_id (distinct) and numbers that are not null or negative."""
    chains = contract(nodes, links, sums)
    heads = chains.placed.where("head = unit_id").select(*KEY).join(nodes, KEY)
    totals = settle(heads, chains.links, sums).select("plan_id", F.col("unit_id").alias("head"), *[F.col(c).alias(f"{c}_head") for c in sums])
    out = chains.placed.join(totals, ["plan_id", "head"], "left")
    return out.select(*KEY, *[(F.col(f"{c}_head") + F.col(c)).alias(c) for c in sums])


def reachable(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(plan_id, unit_id) of the seeds and of all that follow them."""
    seeds, links = cut(seeds.select(*KEY).distinct()), cut(links)
    chains = contract(ends_of(links), links)
    placed = chains.placed
    at = seeds.join(placed, KEY)
    entry = cut(at.where("head is not null").groupBy("plan_id", "head").agg(F.min("hops").alias("hops")))
    seen = _Found(entry.select("plan_id", F.col("head").alias("unit_id")))
    fresh, from_top = seen.all(), None
    for _ in range(MOST_ROUNDS):
        step = chains.links.join(fresh.select("plan_id", F.col("unit_id").alias("pred_id")), ["plan_id", "pred_id"], "left_semi").select(*KEY).distinct()
        # heads met by a link are reached from their first unit on, whether or not a seed lies further down
        top, new = cut_counting(step if from_top is None else step.join(from_top.all(), KEY, "left_anti"))
        if not new:
            break
        fresh = cut(top.join(seen.all(), KEY, "left_anti"))
        seen.add(fresh)
        if from_top is None:
            from_top = _Found(top)
        else:
            from_top.add(top)
    else:
        raise RuntimeError("too many rounds")
    if from_top is not None:
        entry = entry.unionByName(from_top.all().select("plan_id", F.col("unit_id").alias("head"), F.lit(0).cast("long").alias("hops"))).groupBy("plan_id", "head").agg(F.min("hops").alias("hops"))
    first = entry.withColumnRenamed("hops", "from_hops")
    below = placed.join(first, ["plan_id", "head"]).where("hops >= from_hops").select(*KEY)
    rings = placed.where("ring is not null").join(at.where("ring is not null").select("plan_id", "ring").distinct(), ["plan_id", "ring"], "left_semi").select(*KEY)
    return seeds.unionByName(below).unionByName(rings).distinct()


def components(links: DataFrame) -> DataFrame:
    """(plan_id, unit_id, component) of the units in cycles: the strongly connected parts, each named by one of its units.

    Rings fall out of the contraction. Of the graph of chains, what settles from the front or from the back is in no
    cycle; the rest is coloured by the largest unit that leads to each, and of each colour what leads back to that
    unit is a part, until nothing is left.
    """
    small, links = by_size(cut(links))
    near = _whole(small, _component_rows, "component")
    return near if links is None else near.unionByName(_large_components(links))


def _large_components(links: DataFrame) -> DataFrame:
    links = cut(links)
    chains = contract(ends_of(links), links)
    placed = chains.placed
    rings = placed.where("ring is not null").select(*KEY, F.col("ring").alias("component"))
    left = cut(chains.links.select(*KEY, "pred_id").distinct())
    nodes = cut(ends_of(left))
    found = None
    for _ in range(MOST_ROUNDS):
        for way in (left, turned(left)):
            nodes, open_ = cut_counting(nodes.join(settle(nodes, way.select(*KEY, "pred_id")), KEY, "left_anti"))
            if not open_:
                break
            left = cut(_among(left, nodes))
        if not open_:
            break
        colour = _coloured(nodes, left)
        part = _of_colour(colour, left)
        found = part if found is None else found.unionByName(part)
        nodes = cut(nodes.join(part.select(*KEY), KEY, "left_anti"))
        left = _among(left, nodes)
    else:
        raise RuntimeError("too many rounds")
    if found is None:
        return rings
    parts = found.select("plan_id", F.col("unit_id").alias("head"), "component")
    return rings.unionByName(placed.join(parts, ["plan_id", "head"]).select(*KEY, "component"))


def _among(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return links.join(nodes, KEY, "left_semi").join(nodes.select("plan_id", F.col("unit_id").alias("pred_id")), ["plan_id", "pred_id"], "left_semi").select(*KEY, "pred_id")


def _coloured(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(plan_id, unit_id, colour): the largest unit from which each can be reached, itself included."""
    colour = cut(nodes.select(*KEY, F.col("unit_id").alias("colour")))
    fresh = colour
    for _ in range(MOST_ROUNDS):
        given = links.join(fresh.select("plan_id", F.col("unit_id").alias("pred_id"), F.col("colour").alias("new")), ["plan_id", "pred_id"]).groupBy(*KEY).agg(F.max("new").alias("new"))
        better, changed = cut_counting(given.join(colour, KEY).where("new > colour").select(*KEY, F.col("new").alias("colour")))
        if not changed:
            return colour
        colour = cut(colour.unionByName(better).groupBy(*KEY).agg(F.max("colour").alias("colour")))
        fresh = better
    raise RuntimeError("too many rounds")


def _of_colour(colour: DataFrame, links: DataFrame) -> DataFrame:
    """(plan_id, unit_id, component) of what leads to the unit that gave it its colour."""
    a = colour.select("plan_id", F.col("unit_id").alias("pred_id"), F.col("colour").alias("before"))
    same = cut(links.join(colour, KEY).join(a, ["plan_id", "pred_id"]).where("colour = before").select("plan_id", "colour", "unit_id", "pred_id"))
    fresh = cut(colour.where("unit_id = colour"))
    seen = _Found(fresh)
    for _ in range(MOST_ROUNDS):
        back = same.join(fresh, ["plan_id", "unit_id", "colour"], "left_semi").select("plan_id", F.col("pred_id").alias("unit_id"), "colour").distinct()
        fresh, new = cut_counting(back.join(seen.all(), ["plan_id", "unit_id", "colour"], "left_anti").select(*KEY, "colour"))
        if not new:
            return cut(seen.all().select(*KEY, F.col("colour").alias("component")))
        seen.add(fresh)
    raise RuntimeError("too many rounds")


def order_of(pairs: DataFrame, links: DataFrame, labels: int = 3) -> DataFrame:
    """(plan_id, first, second, forward, backward) of distinct pairs: whether the second follows the first by some
    links, and the other way round. Both hold inside a cycle.

    Cycles are made one unit, chains one node. Of two nodes the one of the lower level may lead to the other. Each node has
    ``labels`` random intervals, from the least to the largest random number of what follows it, and leads to no node whose
    interval is not inside its own. Only pairs that levels and intervals leave open are searched, back from
    the second, and only through nodes that they leave open as well.
    """
    pairs = cut(pairs.select("plan_id", "first", "second").distinct())
    links = cut(links.join(pairs.select("plan_id").distinct(), "plan_id", "left_semi"))
    small, large = by_size(links)
    if large is None:
        return _order_in_small(pairs, small)
    plans = cut(large.select("plan_id").distinct())
    near = _order_in_small(pairs.join(plans, "plan_id", "left_anti"), small)
    return near.unionByName(_order_in_large(pairs.join(plans, "plan_id", "left_semi"), large, labels))


def _order_in_small(pairs: DataFrame, small: DataFrame) -> DataFrame:
    """``order_of`` pairs by the closure of their plans."""
    ends = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    c = small_closure(small).select("plan_id", *ends("unit_id", "ancestor"), (F.col("unit_id") >= F.col("ancestor")).alias("up"), (F.col("unit_id") <= F.col("ancestor")).alias("down"))
    known = c.groupBy("plan_id", "lo", "hi").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    met = pairs.select("*", *ends("first", "second")).join(known, ["plan_id", "lo", "hi"], "left")
    ahead = F.col("first") <= F.col("second")
    pick = lambda a, b: F.coalesce(F.when(ahead, F.col(a)).otherwise(F.col(b)), F.lit(False))
    return met.select("plan_id", "first", "second", pick("up", "down").alias("forward"), pick("down", "up").alias("backward"))


def _order_in_large(pairs: DataFrame, links: DataFrame, labels: int) -> DataFrame:
    pairs, links = cut(pairs), cut(links)
    cycles = cut(components(links).select(*KEY, "component"))

    def as_one(rows: DataFrame, column: str, name: str, ring: str | None = None) -> DataFrame:
        c = cycles.select("plan_id", F.col("unit_id").alias(column), F.col("component").alias("__c"))
        out = rows.join(c, ["plan_id", column], "left").withColumn(name, F.coalesce("__c", column))
        return (out.withColumn(ring, F.col("__c").isNotNull()) if ring else out).drop("__c")

    single = as_one(as_one(links, "unit_id", "to"), "pred_id", "from").where("`to` <> `from`").select("plan_id", F.col("to").alias("unit_id"), F.col("from").alias("pred_id")).distinct()
    single = cut(single)
    chains = contract(ends_of(single), single)
    h = chains.placed.where("head = unit_id").select(*KEY)
    over = cut(chains.links.select(*KEY, "pred_id").distinct())
    level = settle(h.withColumn("level", F.lit(1)), over.withColumn("level", F.lit(0)), sums=("level",))
    number = lambda i: F.xxhash64(F.lit(i), *KEY)
    # of the largest complement of a number it is the least number
    own = h.withColumns({f"hi{i}": number(i) for i in range(labels)} | {f"lo{i}": F.bitwise_not(number(i)) for i in range(labels)})
    names = tuple(f"{x}{i}" for i in range(labels) for x in ("hi", "lo"))
    known = cut(level.join(settle(own, turned(over), maxima=names), KEY))

    met = as_one(as_one(pairs, "first", "a", "ring"), "second", "b")
    same = F.col("a") == F.col("b")
    for side in ("a", "b"):
        where = chains.placed.select("plan_id", F.col("unit_id").alias(side), F.col("head").alias(f"head_{side}"), F.col("hops").alias(f"hops_{side}"))
        met = met.join(where, ["plan_id", side], "left")
    one = F.coalesce(F.col("head_a") == F.col("head_b"), F.lit(False))
    met = cut(met.withColumns({"both": same & F.col("ring"), "one": one & ~same}))
    apart = met.where("head_a <> head_b").select("plan_id", "head_a", "head_b").distinct()
    lev = lambda s: known.select("plan_id", F.col("unit_id").alias(f"head_{s}"), F.col("level").alias(f"level_{s}"))
    asked = apart.join(lev("a"), ["plan_id", "head_a"]).join(lev("b"), ["plan_id", "head_b"]).where("level_a <> level_b")
    low = F.col("level_a") < F.col("level_b")
    asked = asked.select("plan_id", F.when(low, F.col("head_a")).otherwise(F.col("head_b")).alias("src"), F.when(low, F.col("head_b")).otherwise(F.col("head_a")).alias("dst")).distinct()
    hits = _searched(asked, over, known, names)
    for way, x, y in (("ab", "a", "b"), ("ba", "b", "a")):
        hit = hits.select("plan_id", F.col("src").alias(f"head_{x}"), F.col("dst").alias(f"head_{y}"), F.lit(True).alias(way))
        met = met.join(hit, ["plan_id", "head_a", "head_b"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return met.select(
        "plan_id", "first", "second", (F.col("both") | (F.col("one") & (F.col("hops_a") < F.col("hops_b"))) | yes("ab")).alias("forward"),
        (F.col("both") | (F.col("one") & (F.col("hops_a") > F.col("hops_b"))) | yes("ba")).alias("backward"),
    )


def _searched(asked: DataFrame, links: DataFrame, known: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(plan_id, src, dst) of the questions to which a way of links is the answer."""
    source = known.select("plan_id", F.col("unit_id").alias("src"), F.col("level").alias("src_level"), *[F.col(c).alias(f"src_{c}") for c in names])
    inside = F.lit(True)
    for c in names:
        inside = inside & (F.col(c) <= F.col(f"src_{c}"))

    def left_open(rows: DataFrame) -> DataFrame:
        """Rows (plan_id, src, dst, at) whose node may still follow the source."""
        here = known.select("plan_id", F.col("unit_id").alias("at"), "level", *names)
        return rows.join(source, ["plan_id", "src"]).join(here, ["plan_id", "at"]).where((F.col("level") >= F.col("src_level")) & inside).select("plan_id", "src", "dst", "at")

    fresh = cut(left_open(asked.withColumn("at", F.col("dst"))))
    seen, hits = _Found(fresh), _Found(fresh.where("src = at"))
    for _ in range(MOST_ROUNDS):
        step = fresh.join(links.select("plan_id", F.col("unit_id").alias("at"), "pred_id"), ["plan_id", "at"]).select("plan_id", "src", "dst", F.col("pred_id").alias("at")).distinct()
        found = left_open(step).join(seen.all(), ["plan_id", "src", "dst", "at"], "left_anti")
        fresh, new = cut_counting(found.select("plan_id", "src", "dst", "at"))
        if not new:
            return cut(hits.all().select("plan_id", "src", "dst").distinct())
        hit = fresh.where("src = at")
        hits.add(hit)
        seen.add(fresh)
        # a question that is answered is asked no more
        fresh = fresh.join(hit.select("plan_id", "src", "dst"), ["plan_id", "src", "dst"], "left_anti")
    raise RuntimeError("too many rounds")
