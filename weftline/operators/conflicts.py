"""Conflicts between the units of a plan, and the data edges they imply.

Tables: accesses(plan_id, unit_id, resource, mode, commutative), effects(plan_id, unit_id,
domain, key, mode, commutative), edges(plan_id, unit_id, pred_id, kind).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import chains
from weftline.operators.store import cut, cut_counting, dealt, parts

SHARED_MODES = ("read", "snapshot")


#: rows of one key that meet in one piece; of more, pieces of both sides meet
PIECE = 2048
#: rows of a plan up to which its pairs are made where its rows lie
NEAR = 512


def meet(x: DataFrame, y: DataFrame, by: list[str], on: Column, times: int = 1) -> DataFrame:
    """(x, y): the rows of both tables, as structs, that agree in the columns ``by`` and for which ``on`` (of ``x.`` and ``y.``) holds.

    Both are dealt by key into as many parts as their files ask for. A key with very many rows would have all its pairs made by one task: its rows
    are dealt by hash into pieces of ``PIECE``, and each piece of one side meets each of the other in a place of its own.
    """
    spark, same = x.sparkSession, x is y
    n = parts(x, times) if same else max(parts(x, times), parts(y, times))
    # rows without a key meet nothing
    sides = [t.dropna(subset=by).repartition(n, *by) for t in ((x,) if same else (x, y))]
    sides = sides * 2 if same else sides

    def pieces(side: DataFrame, name: str) -> DataFrame:
        # all columns are named, so that these rows come from the shuffle that the join reads
        row = F.nullif(F.xxhash64(*side.columns), F.lit(0))
        return side.groupBy(*by).agg(F.ceil(F.count(row) / PIECE).alias(name)).where(f"{name} > 1")

    hot = pieces(sides[0], "px").withColumn("py", F.col("px")) if same else pieces(sides[0], "px").join(pieces(sides[1], "py"), by, "full").fillna(1, ["px", "py"])
    hot = F.broadcast(hot)

    def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        every = on
        for k in keys:
            every = every & (F.col(f"x.{k}") == F.col(f"y.{k}"))
        return a.alias("x").join(b.alias("y"), every).select(*(F.struct(*(F.col(f"{s}.{c}") for c in t.columns)).alias(s) for s, t in (("x", x), ("y", y))))

    def places(side: DataFrame, own: str, other: str) -> DataFrame:
        row = side.join(hot, by).withColumn(own, F.pmod(F.xxhash64(*side.columns), own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return row.repartition(max(n, 8 * spark.sparkContext.defaultParallelism), *by, "px", "py")

    few = met(*(s.join(hot, by, "left").where("px is null").drop("px", "py") for s in sides), by)
    return few.unionByName(met(places(sides[0], "px", "py"), places(sides[1], "py", "px"), [*by, "px", "py"]))


def _pairs(rows: DataFrame, keys: list[str], harmless: Column) -> DataFrame:
    """(x, y): pairs of units (first < second) that meet on the keys and do harm; rows are made distinct before the join."""
    return meet(rows, rows, ["plan_id", *keys], (F.col("x.unit_id") < F.col("y.unit_id")) & ~harmless)


def _once(pairs: DataFrame) -> DataFrame:
    return dealt(pairs, "plan_id", "first", "second").distinct()


def _both(column: str, values: tuple[str, ...]) -> Column:
    return F.col(f"x.{column}").isin(*values) & F.col(f"y.{column}").isin(*values)


def _append_freely() -> Column:
    return (F.col("x.mode") == "append") & (F.col("y.mode") == "append") & F.col("x.commutative") & F.col("y.commutative")


def access_conflicts(accesses: DataFrame) -> DataFrame:
    """(plan_id, first, second, resource, first_mode, second_mode)."""
    rows = accesses.select("plan_id", "unit_id", "resource", "mode", "commutative").distinct()
    met = _pairs(rows, ["resource"], _both("mode", SHARED_MODES) | _append_freely())
    return met.select("x.plan_id", F.col("x.unit_id").alias("first"), F.col("y.unit_id").alias("second"), "x.resource", F.col("x.mode").alias("first_mode"), F.col("y.mode").alias("second_mode"))


def _class_rows(accesses: DataFrame) -> DataFrame:
    return accesses.select("plan_id", "resource", "unit_id", "mode", F.coalesce("commutative", F.lit(False)).alias("free")).distinct()


def conflict_classes(accesses: DataFrame) -> DataFrame:
    """(plan_id, resource, first_mode, first_free, second_mode, second_free, first_units, second_units, pairs): how many pairs of accesses
    of different units clash, by their modes and whether they commute (free). A resource has as few rows as
    it has pairs of classes, however many units touch it; ``class_pairs`` gives the pairs of some of them.

    Units are counted by the set of classes they have, so no two units are ever joined.
    """
    rows = dealt(_class_rows(accesses), "plan_id", "resource")
    sets = rows.groupBy("plan_id", "resource", "unit_id").agg(F.array_sort(F.collect_set(F.struct("mode", "free"))).alias("classes"))
    counts = sets.groupBy("plan_id", "resource", "classes").agg(F.count("*").alias("n"))
    size = counts.select("plan_id", "resource", F.explode("classes").alias("c"), "n").groupBy("plan_id", "resource", "c").agg(F.sum("n").alias("units"))
    # units that have both classes of a pair clash with themselves only
    pair = F.explode(F.flatten(F.transform("classes", lambda a: F.transform(F.filter("classes", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    both = counts.select("plan_id", "resource", "n", pair.alias("p")).groupBy("plan_id", "resource", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("own"))
    one, two = (size.select("plan_id", "resource", F.col("c").alias(x), F.col("units").alias(f"units_{x}")) for x in ("a", "b"))
    met = one.join(two, ["plan_id", "resource"]).where(F.col("a") <= F.col("b")).join(both, ["plan_id", "resource", "a", "b"], "left")
    calm = (F.col("a.mode").isin(*SHARED_MODES) & F.col("b.mode").isin(*SHARED_MODES)) | ((F.col("a.mode") == "append") & (F.col("b.mode") == "append") & F.col("a.free") & F.col("b.free"))
    n, m = F.col("units_a"), F.col("units_b")
    pairs = F.when(F.col("a") == F.col("b"), F.floor(n * (n - 1) / 2)).otherwise(n * m - F.coalesce("own", F.lit(0))).cast("long")
    out = met.where(~calm).select("plan_id", "resource", F.col("a.mode").alias("first_mode"), F.col("a.free").alias("first_free"), F.col("b.mode").alias("second_mode"), F.col("b.free").alias("second_free"), n.alias("first_units"), m.alias("second_units"), pairs.alias("pairs"))
    return out.where("pairs > 0")


def class_pairs(classes: DataFrame, accesses: DataFrame) -> DataFrame:
    """(plan_id, first, second, resource, first_mode, second_mode): the pairs of units behind rows of ``conflict_classes``."""
    rows = _class_rows(accesses)
    x = rows.toDF("plan_id", "resource", "x", "first_mode", "first_free")
    y = rows.toDF("plan_id", "resource", "y", "second_mode", "second_free")
    alike = (F.col("first_mode") == F.col("second_mode")) & (F.col("first_free") == F.col("second_free"))
    met = classes.join(x, ["plan_id", "resource", "first_mode", "first_free"]).join(y, ["plan_id", "resource", "second_mode", "second_free"]).where((F.col("x") != F.col("y")) & (~alike | (F.col("x") < F.col("y"))))
    ahead = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return met.select("plan_id", pick("x", "y").alias("first"), pick("y", "x").alias("second"), "resource", pick("first_mode", "second_mode").alias("first_mode"), pick("second_mode", "first_mode").alias("second_mode"))


def resource_units(accesses: DataFrame) -> DataFrame:
    """(plan_id, resource, units, writers): how many units touch each resource, and how many change it: where pairs would be many."""
    per = accesses.groupBy("plan_id", "resource", "unit_id").agg(F.bool_or(~F.col("mode").isin(*SHARED_MODES)).alias("writes"))
    return per.groupBy("plan_id", "resource").agg(F.count("*").alias("units"), F.count(F.when(F.col("writes"), 1)).alias("writers"))


class _Plans(NamedTuple):
    #: rows of plans of up to ``NEAR`` rows, dealt by plan into ``parts``
    near: DataFrame
    #: rows of the others, where there are any
    far: DataFrame | None
    parts: int


def _by_plan(rows: DataFrame, others: DataFrame | None = None) -> _Plans:
    """``rows`` are written and dealt by plan once: what is made of the rows of one plan then needs no further shuffle.
    A plan with many rows would all be one task's, so these are left to ``meet``; so are the plans of ``others`` (plan_id, distinct)."""
    rows = cut(rows.dropna(subset=["plan_id", "unit_id"]))
    # a part holds some 1 MB of the files, as rows meet in more than one folder
    n = parts(rows, times=4)
    large = rows.groupBy("plan_id").agg(F.count("*").alias("n")).where(F.col("n") > NEAR).select("plan_id")
    large, some = cut_counting(large if others is None else large.unionByName(others).distinct())
    if not some:
        return _Plans(rows.repartition(n, "plan_id"), None, n)
    return _Plans(rows.join(large, "plan_id", "left_anti").repartition(n, "plan_id"), rows.join(large, "plan_id", "left_semi"), n)


def _folders() -> Column:
    """A resource and the folders above it."""
    names = F.split("resource", "/")
    return F.transform(F.sequence(F.when(F.startswith("resource", F.lit("/")), 2).otherwise(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))


def _row(rows: DataFrame) -> Column:
    return F.struct(*(c for c in rows.columns if c != "plan_id"))


def _ahead(met: DataFrame) -> DataFrame:
    """(plan_id, x, y) of (plan_id, a, b): the lesser unit first."""
    below = F.col("a.unit_id") < F.col("b.unit_id")
    return met.select("plan_id", F.when(below, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(below, F.col("b")).otherwise(F.col("a")).alias("y"))


def _overlap(a: Column, b: Column) -> Column:
    """Of two rows of one resource each finds the other."""
    return (a["unit_id"] < b["unit_id"]) | ((a["unit_id"] > b["unit_id"]) & (a["resource"] != b["resource"]))


def _near_nested(near: DataFrame, harmless: Column) -> DataFrame:
    """As ``_nested_pairs``, of rows dealt by plan, in lists by folder; they stay dealt by plan."""
    deep = near.select("plan_id", _row(near).alias("a"), F.explode(_folders()).alias("folder"))
    own = F.when(F.col("a.resource") == F.col("folder"), F.col("a"))
    lists = deep.groupBy("plan_id", "folder").agg(F.collect_list("a").alias("under"), F.collect_list(own).alias("own"))
    met = lists.select("plan_id", "under", F.explode("own").alias("b")).select("plan_id", F.explode("under").alias("a"), "b")
    return _ahead(met.where(_overlap(F.col("a"), F.col("b")))).where(~harmless)


def _nested_pairs(rows: DataFrame, harmless: Column) -> DataFrame:
    """(plan_id, x, y): as ``_pairs``, for resources that are equal or nested. Each row looks up itself and the folders above it, so
    rows that only share a folder don't meet."""
    deep = rows.select("plan_id", _row(rows).alias("a"), F.explode(_folders()).alias("key"))
    whole = rows.select("plan_id", _row(rows).alias("b"), F.col("resource").alias("key"))
    met = meet(deep, whole, ["plan_id", "key"], _overlap(F.col("x.a"), F.col("y.b")), times=2)
    return _ahead(met.select("x.plan_id", "x.a", "y.b")).where(~harmless)


def nested_conflicts(accesses: DataFrame) -> DataFrame:
    """(plan_id, first, second, first_resource, second_resource): accesses to files where one is the
    other or lies below it.

    Each path is exploded into itself and the directories above it; two paths overlap where one of
    them is the shared key itself, so that nesting is an equality and each pair meets once.
    """
    harmless = _both("mode", SHARED_MODES) | _append_freely()
    plans = _by_plan(accesses.select("plan_id", "unit_id", "resource", "mode", "commutative").distinct())

    def named(met: DataFrame) -> DataFrame:
        return met.select("plan_id", F.col("x.unit_id").alias("first"), F.col("y.unit_id").alias("second"), F.col("x.resource").alias("first_resource"), F.col("y.resource").alias("second_resource"))

    near = named(_near_nested(plans.near, harmless)).distinct()
    return near if plans.far is None else near.unionByName(named(_nested_pairs(plans.far, harmless)).transform(_once))


def effect_conflicts(effects: DataFrame) -> DataFrame:
    """(plan_id, first, second, domain, key): every mode of a key counts, not one per key."""
    rows = effects.select("plan_id", "unit_id", "domain", "key", "mode", "commutative").distinct()
    met = _pairs(rows, ["domain", "key"], _both("mode", ("read",)) | _append_freely())
    return met.select("x.plan_id", F.col("x.unit_id").alias("first"), F.col("y.unit_id").alias("second"), "x.domain", "x.key").transform(_once)


def path_overlaps(paths: DataFrame) -> DataFrame:
    """(plan_id, ancestor, descendant) of owners whose paths are equal or nested.

    Each path is exploded into its ancestors, so that nesting is an equality join. Pairs are as many as its members times
    those below it for each path, and all of them are given; ``meet`` deals the pairs of one path over tasks.
    """
    up = F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(F.split("path", "/"))))).alias("up")
    deep = dealt(paths, "owner").select("plan_id", "owner", F.col("path").alias("full"), up).select("plan_id", "owner", "full", F.expr("substring_index(full, '/', up)").alias("path"))
    deep = deep.select("plan_id", "path", "owner", (F.col("full") == F.col("path")).alias("whole"))
    nested = ~F.col("x.whole") | (F.col("y.owner") < F.col("x.owner"))
    met = meet(deep, paths.select("plan_id", "path", "owner"), ["plan_id", "path"], (F.col("x.owner") != F.col("y.owner")) & nested, times=16)
    return met.select("x.plan_id", F.col("y.owner").alias("ancestor"), F.col("x.owner").alias("descendant"))


def exclusive_conflicts(units: DataFrame, exclusive: Column) -> DataFrame:
    """(plan_id, first, second): a unit whose inner workers are unbounded conflicts with all of its plan."""
    rows = units.select("plan_id", "unit_id", exclusive.alias("alone"))
    x, y = rows.where("alone").alias("x"), rows.alias("y")
    met = x.join(y, (F.col("x.plan_id") == F.col("y.plan_id")) & (F.col("x.unit_id") != F.col("y.unit_id")))
    a, b = F.col("x.unit_id"), F.col("y.unit_id")
    return met.select("x.plan_id", F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).distinct()


def with_order(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``ordered``: one of the pair follows the other. Only these pairs are looked up; no closure is made."""
    pairs = cut(pairs)
    o = chains.order_of(pairs, chains.links_of(edges)).withColumn("ordered", F.col("forward") | F.col("backward")).drop("forward", "backward")
    return pairs.join(o, ["plan_id", "first", "second"])


def reorder_fences(pairs: DataFrame, units: DataFrame, reorderable: Column) -> DataFrame:
    """Adds ``fenced`` to unordered pairs: not both units may be reordered."""
    free = units.select("plan_id", "unit_id", reorderable.alias("free"))
    a = free.select("plan_id", F.col("unit_id").alias("first"), F.col("free").alias("free_a"))
    b = free.select("plan_id", F.col("unit_id").alias("second"), F.col("free").alias("free_b"))
    met = pairs.join(a, ["plan_id", "first"]).join(b, ["plan_id", "second"])
    return met.withColumn("fenced", ~F.col("ordered") & ~(F.col("free_a") & F.col("free_b"))).drop("free_a", "free_b")


def creators(accesses: DataFrame) -> DataFrame:
    """(plan_id, resource, creators): how many units create each resource."""
    return accesses.where("mode = 'create'").groupBy("plan_id", "resource").agg(F.count_distinct("unit_id").alias("creators"))


def data_edges(accesses: DataFrame) -> DataFrame:
    """(plan_id, producer, consumer, resources): create before read, single creators only."""
    lone = creators(accesses).where("creators = 1").select("plan_id", "resource")
    made = accesses.where("mode = 'create'").join(lone, ["plan_id", "resource"]).select("plan_id", "resource", F.col("unit_id").alias("producer"))
    used = accesses.where(F.col("mode").isin(*SHARED_MODES)).select("plan_id", "resource", F.col("unit_id").alias("consumer"))
    met = made.join(used, ["plan_id", "resource"]).where("producer <> consumer")
    return met.groupBy("plan_id", "producer", "consumer").agg(F.sort_array(F.collect_set("resource")).alias("resources"))


def contradictions(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, producer, consumer, both_ways, against_order, already_ordered) of data edges."""
    pair = cut(candidates.select("plan_id", "producer", "consumer"))
    back = pair.select("plan_id", F.col("producer").alias("consumer"), F.col("consumer").alias("producer"), F.lit(True).alias("both_ways"))
    order = chains.order_of(pair.toDF("plan_id", "first", "second"), chains.links_of(edges)).toDF("plan_id", "producer", "consumer", "already_ordered", "against_order")
    out = pair.join(back, ["plan_id", "producer", "consumer"], "left").join(order, ["plan_id", "producer", "consumer"])
    return out.select("plan_id", "producer", "consumer", F.coalesce("both_ways", F.lit(False)).alias("both_ways"), "against_order", "already_ordered")


def data_flow(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, code, first, second, detail): what accesses to equal or nested files say of the order of two units.

    A create before a read or snapshot flows from its unit to the other, unless several units create
    the resource. Flow in one direction alone is a ``DATA_EDGE`` from first to second, against the
    dependencies a ``CONTRADICTORY_DATA_ORDER``, along them nothing new; in both directions a
    ``BIDIRECTIONAL_DATA_FLOW``. Any other harmful overlap is ambiguous: it takes the edge away, and is an
    ``UNORDERED_ARTIFACT_CONFLICT`` where dependencies do not order the units.
    """
    links = cut(chains.links_of(edges))
    small, large = chains.by_size(links)
    rows = accesses.select("plan_id", "unit_id", "resource", "mode", "commutative").distinct()
    near, far, n = _by_plan(rows, None if large is None else large.select("plan_id").distinct())
    harmless = _both("mode", SHARED_MODES) | _append_freely()
    create, one = F.col("mode") == "create", Window.partitionBy("plan_id", "resource")
    maker = F.when(create, F.col("unit_id"))
    # of many creators the first is not the last
    near = near.withColumn("sole", create & ~F.coalesce(F.min(maker).over(one) < F.max(maker).over(one), F.lit(False)))
    follows = lambda a, b: F.coalesce(F.array_contains(F.try_element_at("above", F.col(a)), F.col(b)), F.lit(False))
    # pairs stay dealt by plan; merged, what units follow is not sent to the driver
    pair = _flows(_near_nested(near, harmless)).join(chains.small_above(small, n).hint("merge"), "plan_id", "left")
    out = _said(pair.withColumns({"after": follows("second", "first"), "before": follows("first", "second")}))
    if far is None:
        return out
    many = creators(far).where("creators > 1").select("plan_id", "resource", F.lit(True).alias("many"))
    far = far.join(many, ["plan_id", "resource"], "left").withColumn("sole", create & F.col("many").isNull()).drop("many")
    pair = cut(_flows(_nested_pairs(far, harmless)))
    order = chains.order_of(pair, links).toDF("plan_id", "first", "second", "after", "before")
    return out.unionByName(_said(pair.join(order, ["plan_id", "first", "second"])))


def _flows(met: DataFrame) -> DataFrame:
    """(plan_id, first, second, ahead, behind, clash): what flows from the first to the second unit and back, and what else overlaps."""
    ahead = F.col("x.sole") & F.col("y.mode").isin(*SHARED_MODES)
    behind = F.col("y.sole") & F.col("x.mode").isin(*SHARED_MODES)
    clash = F.concat(F.col("x.mode"), F.lit("/"), F.col("y.mode"), F.lit(" on "), F.col("x.resource"), F.lit(" and "), F.col("y.resource"))
    return met.groupBy("plan_id", F.col("x.unit_id").alias("first"), F.col("y.unit_id").alias("second")).agg(
        F.array_sort(F.collect_set(F.when(ahead, F.col("x.resource")))).alias("ahead"), F.array_sort(F.collect_set(F.when(behind, F.col("y.resource")))).alias("behind"), F.array_sort(F.collect_set(F.when(~ahead & ~behind, clash))).alias("clash")
    )


def _said(o: DataFrame) -> DataFrame:
    """``data_flow`` of ``_flows`` with (after, before): whether the second unit follows the first, and the other way round."""
    has = lambda c: F.size(c) > 0
    row = lambda code, a, b, items, sep=",": F.struct(F.lit(code).alias("code"), F.col(a).alias("first"), F.col(b).alias("second"), F.array_join(items, sep).alias("detail"))
    one = lambda a, b, items, against, along: F.when(F.col(against), row("CONTRADICTORY_DATA_ORDER", a, b, items)).when(~F.col(along), row("DATA_EDGE", a, b, items))
    both = F.array_sort(F.array_union("ahead", "behind"))
    flow = (
        F.when(has("ahead") & has("behind"), row("BIDIRECTIONAL_DATA_FLOW", "first", "second", both))
        .when(has("clash"), F.lit(None))
        .when(has("ahead"), one("first", "second", F.col("ahead"), "before", "after"))
        .when(has("behind"), one("second", "first", F.col("behind"), "after", "before"))
    )
    loose = F.when(has("clash") & ~F.col("after") & ~F.col("before"), row("UNORDERED_ARTIFACT_CONFLICT", "first", "second", F.col("clash"), "; "))
    return o.select("plan_id", F.explode(F.array_compact(F.array(flow, loose))).alias("f")).select("plan_id", "f.*")


def unit_conflict_reasons(accesses: DataFrame, exclusive: DataFrame, serial: DataFrame, nested: bool = False) -> DataFrame:
    """(plan_id, first, second, reasons): write-write, write-read, shared exclusive resource, forced serial.

    ``exclusive``: (plan_id, unit_id, resource) held alone; ``serial``: (plan_id, unit_id) that run alone;
    ``nested``: resources are paths, and a folder overlaps what lies below it.
    """
    kind = F.when(F.col("mode").isin(*SHARED_MODES), "read").otherwise("write")
    used = accesses.select("plan_id", "unit_id", "resource", kind.alias("mode")).distinct()
    if not nested:
        # resources that are equal are joined at less cost
        return _met_reasons(used, accesses, exclusive.distinct(), serial.distinct(), nested)
    held = exclusive.select("plan_id", "unit_id", "resource", F.lit("exclusive").alias("mode")).distinct()
    lone = serial.select("plan_id", "unit_id", F.lit(None).cast(used.schema["resource"].dataType).alias("resource"), F.lit("serial").alias("mode")).distinct()
    near, far, _ = _by_plan(used.unionByName(held).unionByName(lone))
    out = _near_reasons(near)
    if far is None:
        return out
    used = far.where("mode in ('read', 'write')")
    return out.unionByName(_met_reasons(used, used, far.where("mode = 'exclusive'"), far.where("mode = 'serial'"), nested))


def _reason() -> Column:
    return F.when((F.col("x.mode") == "write") & (F.col("y.mode") == "write"), "write-write").when(F.col("x.mode") == "write", "write-read").otherwise("read-write")


def _reasons_of(every: DataFrame) -> DataFrame:
    return every.groupBy("plan_id", "first", "second").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def _near_reasons(near: DataFrame) -> DataFrame:
    """Reasons of rows dealt by plan, in lists: by folder, by exclusive resource, and one of the whole plan for units that run alone."""
    held, lone = F.col("mode") == "exclusive", F.col("mode") == "serial"
    whole = F.lit("alone")
    named = lambda what, c: F.concat(F.lit(what), c)
    used = F.concat(F.when(F.col("resource").isNotNull(), F.transform(_folders(), lambda f: named("on ", f))).otherwise(F.array().cast("array<string>")), F.array(whole))
    keys = F.when(lone, F.array(whole)).when(held, F.array(named("held ", F.col("resource")))).otherwise(used)
    deep = near.select("plan_id", _row(near).alias("a"), F.explode(keys).alias("key"))
    single = F.col("a.mode") == "serial"
    own = F.when(F.col("key") == whole, single).when(F.col("a.mode") == "exclusive", True).otherwise(F.col("key") == named("on ", F.col("a.resource")))
    lists = deep.groupBy("plan_id", "key").agg(F.collect_list(F.when(~single, F.col("a"))).alias("under"), F.collect_list(F.when(own, F.col("a"))).alias("own"))
    # a unit that runs alone is one that has accesses
    lists = lists.withColumn("own", F.when(F.col("key") == whole, F.filter("own", lambda b: F.array_contains(F.col("under.unit_id"), b["unit_id"]))).otherwise(F.col("own")))
    met = lists.select("plan_id", "under", F.explode("own").alias("b")).select("plan_id", F.explode("under").alias("a"), "b")
    a, b = F.col("a"), F.col("b")
    alone = b["mode"] == "serial"
    on = (alone & (a["unit_id"] != b["unit_id"])) | (~alone & _overlap(a, b) & ~((a["mode"] == "read") & (b["mode"] == "read")))
    both = lambda mode: (F.col("x.mode") == mode) | (F.col("y.mode") == mode)
    reason = F.when(both("serial"), "forced-serial").when(both("exclusive"), "exclusive-resource").otherwise(_reason())
    return _reasons_of(_ahead(met.where(on)).select("plan_id", F.col("x.unit_id").alias("first"), F.col("y.unit_id").alias("second"), reason.alias("reason")))


def _met_reasons(used: DataFrame, accesses: DataFrame, exclusive: DataFrame, serial: DataFrame, nested: bool) -> DataFrame:
    """Reasons of rows (distinct) that ``meet`` deals by resource; all units of ``accesses`` conflict with those that run alone."""
    rows = used.withColumn("commutative", F.lit(False))
    met = _nested_pairs(rows, _both("mode", ("read",))) if nested else _pairs(rows, ["resource"], _both("mode", ("read",))).select("x.plan_id", "x", "y")
    cols = ["plan_id", "first", "second", "reason"]
    hit = met.select("plan_id", F.col("x.unit_id").alias("first"), F.col("y.unit_id").alias("second"), _reason().alias("reason"))
    held = _pairs(exclusive, ["resource"], F.lit(False)).select("x.plan_id", F.col("x.unit_id").alias("first"), F.col("y.unit_id").alias("second"), F.lit("exclusive-resource").alias("reason"))
    lone = serial.select("plan_id", "unit_id", F.lit(True).alias("alone"))
    units = dealt(accesses.select("plan_id", "unit_id").distinct(), "plan_id").join(lone, ["plan_id", "unit_id"], "left")
    alone = exclusive_conflicts(units, F.coalesce("alone", F.lit(False))).withColumn("reason", F.lit("forced-serial"))
    every = hit.select(cols).unionByName(held.select(cols)).unionByName(alone.select(cols))
    return _reasons_of(dealt(every, "plan_id", "first", "second"))


def bad_references(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, unit_id, pred_id, problem): a dependency on a missing unit or on itself, a repeated id."""
    known = units.select("plan_id", F.col("unit_id").alias("pred_id")).distinct()
    missing = edges.join(known, ["plan_id", "pred_id"], "left_anti").select("plan_id", "unit_id", "pred_id", F.lit("missing").alias("problem"))
    itself = edges.where("unit_id = pred_id").select("plan_id", "unit_id", "pred_id", F.lit("self").alias("problem"))
    twice = units.groupBy("plan_id", "unit_id").count().where("count > 1").select("plan_id", "unit_id", F.lit(None).cast("long").alias("pred_id"), F.lit("repeated").alias("problem"))
    return missing.distinct().unionByName(itself.distinct()).unionByName(twice)
