"""Registered queries: a view of the given tables, then one operator; and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import conflicts, evidence, graph, history, hosts, rules, runs
from weftline.operators.store import dealt
from weftline.plans.views import view, with_views

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def _r(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to six places, for comparison between engines."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


# ---------------------------------------------------------------- conflicts

_PAIR = """
    SELECT a.plan_id, a.unit_id AS first, b.unit_id AS second, a.resource, a.mode AS first_mode, b.mode AS second_mode
    FROM {accesses} a JOIN {accesses} b ON a.plan_id = b.plan_id AND a.resource = b.resource AND a.unit_id < b.unit_id
    WHERE NOT (a.mode IN ('read', 'snapshot') AND b.mode IN ('read', 'snapshot'))
      AND NOT (a.mode = 'append' AND b.mode = 'append' AND a.commutative AND b.commutative)"""
# closure: the other engine may recurse, Spark doubles
_CLOSURE = "closure AS (SELECT plan_id, unit_id, pred_id AS ancestor FROM {edges} UNION SELECT c.plan_id, c.unit_id, e.pred_id FROM closure c JOIN {edges} e ON e.plan_id = c.plan_id AND e.unit_id = c.ancestor)"


@query(_PAIR)
def access_conflicts(spark, d):
    return conflicts.access_conflicts(view(spark, d, "accesses"))


@query("""
    SELECT DISTINCT a.plan_id, a.unit_id AS first, b.unit_id AS second, a.resource AS first_resource, b.resource AS second_resource
    FROM {file_accesses} a JOIN {file_accesses} b ON a.plan_id = b.plan_id AND a.unit_id < b.unit_id
    WHERE (a.resource = b.resource OR starts_with(a.resource, concat(b.resource, '/')) OR starts_with(b.resource, concat(a.resource, '/')))
      AND NOT (a.mode IN ('read', 'snapshot') AND b.mode IN ('read', 'snapshot'))
      AND NOT (a.mode = 'append' AND b.mode = 'append' AND a.commutative AND b.commutative)""")
def nested_conflicts(spark, d):
    return conflicts.nested_conflicts(view(spark, d, "file_accesses"))


_CLASSES = """
    x AS (SELECT DISTINCT plan_id, resource, unit_id, mode, coalesce(commutative, false) AS free FROM {accesses}),
    p AS (SELECT a.plan_id, a.resource, a.mode AS first_mode, a.free AS first_free, b.mode AS second_mode, b.free AS second_free, a.unit_id AS u, b.unit_id AS v FROM x a JOIN x b ON a.plan_id = b.plan_id AND a.resource = b.resource AND a.unit_id <> b.unit_id
        WHERE (a.mode < b.mode OR (a.mode = b.mode AND (a.free < b.free OR (a.free = b.free AND a.unit_id < b.unit_id)))) AND NOT (a.mode IN ('read', 'snapshot') AND b.mode IN ('read', 'snapshot')) AND NOT (a.mode = 'append' AND b.mode = 'append' AND a.free AND b.free))"""


@query(f"WITH {_CLASSES} SELECT plan_id, resource, first_mode, first_free, second_mode, second_free, count(*) AS pairs FROM p GROUP BY ALL")
def conflict_classes(spark, d):
    return conflicts.conflict_classes(view(spark, d, "accesses")).select("plan_id", "resource", "first_mode", "first_free", "second_mode", "second_free", "pairs")


@query("""
    SELECT plan_id, resource, count(DISTINCT unit_id) AS units, count(DISTINCT CASE WHEN mode NOT IN ('read', 'snapshot') THEN unit_id END) AS writers FROM {accesses} GROUP BY 1, 2""")
def resource_units(spark, d):
    return conflicts.resource_units(view(spark, d, "accesses"))


@query("""
    SELECT DISTINCT a.plan_id, a.unit_id AS first, b.unit_id AS second, a.domain, a.key
    FROM {effects} a JOIN {effects} b ON a.plan_id = b.plan_id AND a.domain = b.domain AND a.key = b.key AND a.unit_id < b.unit_id
    WHERE NOT (a.mode = 'read' AND b.mode = 'read')""")
def effect_conflicts(spark, d):
    return conflicts.effect_conflicts(view(spark, d, "effects"))


@query("""
    SELECT a.plan_id, a.owner AS ancestor, b.owner AS descendant FROM {paths} a JOIN {paths} b ON a.plan_id = b.plan_id AND a.owner <> b.owner
    WHERE (a.path = b.path AND a.owner < b.owner) OR b.path LIKE a.path || '/%'""")
def path_overlap(spark, d):
    return conflicts.path_overlaps(view(spark, d, "paths"))


@query("""
    SELECT DISTINCT a.plan_id, least(a.unit_id, b.unit_id) AS first, greatest(a.unit_id, b.unit_id) AS second
    FROM {units} a JOIN {units} b ON a.plan_id = b.plan_id AND a.unit_id <> b.unit_id WHERE a.unit_id % 20 = 0""")
def exclusive_units(spark, d):
    return conflicts.exclusive_conflicts(view(spark, d, "units"), F.col("unit_id") % 20 == 0)


@query(f"""
    WITH RECURSIVE {_CLOSURE}, pair AS ({_PAIR}),
    ord AS (SELECT DISTINCT plan_id, least(unit_id, ancestor) AS first, greatest(unit_id, ancestor) AS second FROM closure),
    p AS (SELECT DISTINCT plan_id, first, second FROM pair)
    SELECT p.plan_id, p.first, p.second, ord.first IS NOT NULL AS ordered,
           ord.first IS NULL AND NOT (a.commutative AND b.commutative) AS fenced
    FROM p LEFT JOIN ord USING (plan_id, first, second)
    JOIN {{units}} a ON a.plan_id = p.plan_id AND a.unit_id = p.first JOIN {{units}} b ON b.plan_id = p.plan_id AND b.unit_id = p.second""".replace("{{", "{").replace("}}", "}"))
def unordered_conflicts(spark, d):
    pairs = conflicts.access_conflicts(view(spark, d, "accesses")).select("plan_id", "first", "second").distinct()
    ordered = conflicts.with_order(pairs, view(spark, d, "edges"))
    return conflicts.reorder_fences(ordered, view(spark, d, "units"), F.col("commutative")).select("plan_id", "first", "second", "ordered", "fenced")


_DATA = """
    lone AS (SELECT plan_id, resource FROM {accesses} WHERE mode = 'create' GROUP BY 1, 2 HAVING count(DISTINCT unit_id) = 1),
    made AS (SELECT a.plan_id, a.resource, a.unit_id FROM {accesses} a JOIN lone USING (plan_id, resource) WHERE a.mode = 'create'),
    data_edge AS (SELECT m.plan_id, m.unit_id AS producer, u.unit_id AS consumer, string_agg(DISTINCT u.resource, ',' ORDER BY u.resource) AS resources
        FROM made m JOIN {accesses} u ON u.plan_id = m.plan_id AND u.resource = m.resource AND u.mode IN ('read', 'snapshot') AND u.unit_id <> m.unit_id GROUP BY 1, 2, 3)"""


@query(f"WITH {_DATA} SELECT * FROM data_edge")
def data_edges(spark, d):
    return _text(conflicts.data_edges(view(spark, d, "accesses")), "resources")


@query("SELECT plan_id, resource, count(DISTINCT unit_id) AS creators FROM {accesses} WHERE mode = 'create' GROUP BY 1, 2 HAVING count(DISTINCT unit_id) > 1")
def ambiguous_producers(spark, d):
    return conflicts.creators(view(spark, d, "accesses")).where("creators > 1")


@query(f"""
    WITH RECURSIVE {_CLOSURE}, {_DATA}, anc AS (SELECT DISTINCT * FROM closure)
    SELECT e.plan_id, e.producer, e.consumer, b.producer IS NOT NULL AS both_ways, x.unit_id IS NOT NULL AS against_order, y.unit_id IS NOT NULL AS already_ordered
    FROM data_edge e LEFT JOIN data_edge b ON b.plan_id = e.plan_id AND b.producer = e.consumer AND b.consumer = e.producer
    LEFT JOIN anc x ON x.plan_id = e.plan_id AND x.unit_id = e.producer AND x.ancestor = e.consumer
    LEFT JOIN anc y ON y.plan_id = e.plan_id AND y.unit_id = e.consumer AND y.ancestor = e.producer""")
def edge_contradictions(spark, d):
    return conflicts.contradictions(conflicts.data_edges(view(spark, d, "accesses")), view(spark, d, "edges"))


@query("""
    WITH a AS (SELECT DISTINCT plan_id, unit_id, resource, CASE WHEN mode IN ('read', 'snapshot') THEN 'read' ELSE 'write' END AS m FROM {accesses}),
    hit AS (SELECT x.plan_id, x.unit_id AS first, y.unit_id AS second, CASE WHEN x.m = 'write' AND y.m = 'write' THEN 'write-write' WHEN x.m = 'write' THEN 'write-read' ELSE 'read-write' END AS reason
            FROM a x JOIN a y ON x.plan_id = y.plan_id AND x.resource = y.resource AND x.unit_id < y.unit_id WHERE NOT (x.m = 'read' AND y.m = 'read')),
    ex AS (SELECT DISTINCT plan_id, unit_id, resource FROM {claims} WHERE resource = 'license' AND units > 90),
    held AS (SELECT x.plan_id, x.unit_id AS first, y.unit_id AS second, 'exclusive-resource' AS reason FROM ex x JOIN ex y ON x.plan_id = y.plan_id AND x.resource = y.resource AND x.unit_id < y.unit_id),
    u AS (SELECT DISTINCT plan_id, unit_id FROM a),
    alone AS (SELECT DISTINCT x.plan_id, least(x.unit_id, y.unit_id) AS first, greatest(x.unit_id, y.unit_id) AS second, 'forced-serial' AS reason FROM u x JOIN u y ON x.plan_id = y.plan_id AND x.unit_id <> y.unit_id WHERE x.unit_id % 50 = 0),
    every AS (SELECT * FROM hit UNION SELECT * FROM held UNION SELECT * FROM alone)
    SELECT plan_id, first, second, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM every GROUP BY 1, 2, 3""")
def unit_conflict_reasons(spark, d):
    ex = view(spark, d, "claims").where("resource = 'license' and units > 90").select("plan_id", "unit_id", "resource")
    serial = view(spark, d, "units").where("unit_id % 50 = 0").select("plan_id", "unit_id")
    return _text(conflicts.unit_conflict_reasons(view(spark, d, "accesses"), ex, serial), "reasons")


@query("""
    WITH u AS (SELECT plan_id, unit_id FROM {units} WHERE unit_id % 10 <> 0 UNION ALL SELECT plan_id, unit_id FROM {units} WHERE unit_id % 97 = 1),
    e AS (SELECT plan_id, unit_id, CASE WHEN unit_id % 101 = 0 THEN unit_id ELSE pred_id END AS pred_id FROM {edges})
    SELECT DISTINCT plan_id, unit_id, pred_id, 'missing' AS problem FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.plan_id = e.plan_id AND u.unit_id = e.pred_id)
    UNION ALL SELECT DISTINCT plan_id, unit_id, pred_id, 'self' FROM e WHERE unit_id = pred_id
    UNION ALL SELECT plan_id, unit_id, NULL, 'repeated' FROM u GROUP BY 1, 2 HAVING count(*) > 1""")
def bad_references(spark, d):
    u = view(spark, d, "units").select("plan_id", "unit_id")
    u = u.where("unit_id % 10 <> 0").unionByName(u.where("unit_id % 97 = 1"))
    e = view(spark, d, "edges").selectExpr("plan_id", "unit_id", "case when unit_id % 101 = 0 then unit_id else pred_id end as pred_id")
    return conflicts.bad_references(u, e)


_NESTED = "(x.resource = y.resource OR starts_with(x.resource, concat(y.resource, '/')) OR starts_with(y.resource, concat(x.resource, '/')))"


@query(f"""
    WITH RECURSIVE {_CLOSURE}, many AS (SELECT plan_id, resource FROM {{file_accesses}} WHERE mode = 'create' GROUP BY 1, 2 HAVING count(DISTINCT unit_id) > 1),
    a AS (SELECT f.*, f.mode = 'create' AND m.resource IS NULL AS sole FROM {{file_accesses}} f LEFT JOIN many m ON m.plan_id = f.plan_id AND m.resource = f.resource),
    met AS (SELECT x.plan_id, x.unit_id AS first, y.unit_id AS second, CASE WHEN x.sole AND y.mode IN ('read', 'snapshot') THEN x.resource END AS fw, CASE WHEN y.sole AND x.mode IN ('read', 'snapshot') THEN y.resource END AS bw,
            x.mode || '/' || y.mode || ' on ' || x.resource || ' and ' || y.resource AS said
        FROM a x JOIN a y ON x.plan_id = y.plan_id AND x.unit_id < y.unit_id
        WHERE {_NESTED} AND NOT (x.mode IN ('read', 'snapshot') AND y.mode IN ('read', 'snapshot')) AND NOT (x.mode = 'append' AND y.mode = 'append' AND x.commutative AND y.commutative)),
    m AS (SELECT plan_id, first, second, fw, bw, coalesce(fw, bw) AS fb, CASE WHEN fw IS NULL AND bw IS NULL THEN said END AS cl FROM met),
    g AS (SELECT plan_id, first, second, string_agg(DISTINCT fw, ',' ORDER BY fw) AS ahead, string_agg(DISTINCT bw, ',' ORDER BY bw) AS behind, string_agg(DISTINCT fb, ',' ORDER BY fb) AS both_ways, string_agg(DISTINCT cl, '; ' ORDER BY cl) AS clash FROM m GROUP BY 1, 2, 3),
    anc AS (SELECT DISTINCT * FROM closure),
    o AS (SELECT g.*, b.unit_id IS NOT NULL AS along, c.unit_id IS NOT NULL AS against FROM g LEFT JOIN anc b ON b.plan_id = g.plan_id AND b.unit_id = g.second AND b.ancestor = g.first
        LEFT JOIN anc c ON c.plan_id = g.plan_id AND c.unit_id = g.first AND c.ancestor = g.second)
    SELECT plan_id, 'BIDIRECTIONAL_DATA_FLOW' AS code, first, second, both_ways AS detail FROM o WHERE ahead IS NOT NULL AND behind IS NOT NULL
    UNION ALL SELECT plan_id, CASE WHEN against THEN 'CONTRADICTORY_DATA_ORDER' ELSE 'DATA_EDGE' END, first, second, ahead FROM o WHERE ahead IS NOT NULL AND behind IS NULL AND clash IS NULL AND (against OR NOT along)
    UNION ALL SELECT plan_id, CASE WHEN along THEN 'CONTRADICTORY_DATA_ORDER' ELSE 'DATA_EDGE' END, second, first, behind FROM o WHERE behind IS NOT NULL AND ahead IS NULL AND clash IS NULL AND (along OR NOT against)
    UNION ALL SELECT plan_id, 'UNORDERED_ARTIFACT_CONFLICT', first, second, clash FROM o WHERE clash IS NOT NULL AND NOT along AND NOT against""")
def data_flow(spark, d):
    return conflicts.data_flow(view(spark, d, "file_accesses"), view(spark, d, "edges"))


@query(f"""
    WITH a AS (SELECT DISTINCT plan_id, unit_id, resource, CASE WHEN mode IN ('read', 'snapshot') THEN 'read' ELSE 'write' END AS m FROM {{file_accesses}}),
    hit AS (SELECT x.plan_id, x.unit_id AS first, y.unit_id AS second, CASE WHEN x.m = 'write' AND y.m = 'write' THEN 'write-write' WHEN x.m = 'write' THEN 'write-read' ELSE 'read-write' END AS reason
            FROM a x JOIN a y ON x.plan_id = y.plan_id AND x.unit_id < y.unit_id WHERE {_NESTED} AND NOT (x.m = 'read' AND y.m = 'read')),
    ex AS (SELECT DISTINCT plan_id, unit_id, resource FROM {{claims}} WHERE resource = 'license' AND units > 90),
    held AS (SELECT x.plan_id, x.unit_id AS first, y.unit_id AS second, 'exclusive-resource' AS reason FROM ex x JOIN ex y ON x.plan_id = y.plan_id AND x.resource = y.resource AND x.unit_id < y.unit_id),
    u AS (SELECT DISTINCT plan_id, unit_id FROM a),
    alone AS (SELECT DISTINCT x.plan_id, least(x.unit_id, y.unit_id) AS first, greatest(x.unit_id, y.unit_id) AS second, 'forced-serial' AS reason FROM u x JOIN u y ON x.plan_id = y.plan_id AND x.unit_id <> y.unit_id WHERE x.unit_id % 50 = 0),
    every AS (SELECT * FROM hit UNION SELECT * FROM held UNION SELECT * FROM alone)
    SELECT plan_id, first, second, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM every GROUP BY 1, 2, 3""")
def nested_conflict_reasons(spark, d):
    ex = view(spark, d, "claims").where("resource = 'license' and units > 90").select("plan_id", "unit_id", "resource")
    serial = view(spark, d, "units").where("unit_id % 50 = 0").select("plan_id", "unit_id")
    return _text(conflicts.unit_conflict_reasons(view(spark, d, "file_accesses"), ex, serial, nested=True), "reasons")


@query("""
    WITH part AS (SELECT plan_id, substr(d, 1, 3) AS p, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM (SELECT plan_id, sha256(CAST(json_object('part', part, 'a', a, 'b', b, 't', t) AS VARCHAR)) AS d FROM {plan_rows}) GROUP BY 1, 2)
    SELECT plan_id, sha256(string_agg(d, ',' ORDER BY d)) AS fingerprint FROM part GROUP BY 1""")
def plan_fingerprint(spark, d):
    return evidence.fingerprint(view(spark, d, "plan_rows"), "plan_id", ["part", "a", "b", "t"])


# ---------------------------------------------------------------- graphs


@query("""
    WITH st AS (SELECT plan_id, unit_id, duration_s, rn <= 2 AS done FROM {units}),
    waits AS (SELECT DISTINCT e.plan_id, e.unit_id FROM {edges} e JOIN st p ON p.plan_id = e.plan_id AND p.unit_id = e.pred_id WHERE NOT p.done)
    SELECT s.plan_id, s.unit_id, row_number() OVER (PARTITION BY s.plan_id ORDER BY duration_s DESC NULLS LAST, s.unit_id)::INTEGER AS place
    FROM st s LEFT JOIN waits w ON w.plan_id = s.plan_id AND w.unit_id = s.unit_id WHERE NOT s.done AND w.unit_id IS NULL""")
def ready_order(spark, d):
    u = view(spark, d, "units").withColumn("status", F.expr("case when rn <= 2 then 'succeeded' else 'pending' end"))
    return graph.ready_order(u, view(spark, d, "edges"), "duration_s")


@query("""
    WITH RECURSIVE lv AS (
        SELECT plan_id, unit_id, 0 AS level FROM {units} u WHERE NOT EXISTS (SELECT 1 FROM {acyclic_edges} e WHERE e.plan_id = u.plan_id AND e.unit_id = u.unit_id)
        UNION SELECT e.plan_id, e.unit_id, lv.level + 1 FROM lv JOIN {acyclic_edges} e ON e.plan_id = lv.plan_id AND e.pred_id = lv.unit_id WHERE lv.level < 1000),
    cyc AS (SELECT DISTINCT plan_id FROM {edges} e JOIN {units} u USING (plan_id, unit_id) WHERE u.rn = 1),
    top AS (SELECT plan_id, unit_id, max(level) AS level FROM lv GROUP BY 1, 2)
    SELECT u.plan_id, u.unit_id, CASE WHEN c.plan_id IS NULL THEN CASE WHEN u.plan_id % 10 = 3 THEN floor(log2(u.rn))::INTEGER ELSE t.level END END AS level
    FROM {units} u LEFT JOIN top t USING (plan_id, unit_id) LEFT JOIN cyc c ON c.plan_id = u.plan_id""")
def levels(spark, d):
    return graph.levels(view(spark, d, "units"), view(spark, d, "edges"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT plan_id, unit_id, ancestor FROM closure")
def ancestors(spark, d):
    return graph.ancestors(view(spark, d, "edges"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT e.plan_id, e.unit_id, e.pred_id FROM {{edges}} e JOIN closure c ON c.plan_id = e.plan_id AND c.unit_id = e.pred_id AND c.ancestor = e.unit_id")
def cyclic_edges(spark, d):
    e = view(spark, d, "edges").select("plan_id", "unit_id", "pred_id")
    return graph.cyclic_edges(e.where("unit_id % 2 = 0"), e).distinct()


_DURATION = "CASE WHEN duration_s IS NOT NULL THEN greatest(0.001, duration_s + 0.5) ELSE CASE kind WHEN 'read' THEN 0.25 WHEN 'test' THEN 2.0 WHEN 'build' THEN 3.0 WHEN 'network' THEN 1.0 WHEN 'opaque' THEN 1.5 ELSE 1.0 END + 0.5 END"


def _timed(spark, d):
    return view(spark, d, "units").withColumn("s", rules.effective_duration(F.col("duration_s"), F.lit(0.5), F.col("kind")))


_PATHS = f"""
    links AS (SELECT DISTINCT plan_id, pred_id AS u, unit_id AS v FROM {{edges}} WHERE kind <> 'failure'),
    reach AS (SELECT plan_id, u, v FROM links UNION SELECT r.plan_id, r.u, l.v FROM reach r JOIN links l ON l.plan_id = r.plan_id AND l.u = r.v),
    cyclic AS (SELECT DISTINCT plan_id, u FROM reach WHERE u = v),
    unbounded AS (SELECT plan_id, u FROM cyclic UNION SELECT r.plan_id, r.u FROM reach r JOIN cyclic c ON c.plan_id = r.plan_id AND c.u = r.v),
    own AS (SELECT plan_id, unit_id, {_DURATION} AS s FROM {{units}}),
    walk AS (SELECT o.plan_id, o.unit_id, o.unit_id AS at, o.s AS total FROM own o LEFT JOIN unbounded b ON b.plan_id = o.plan_id AND b.u = o.unit_id WHERE b.u IS NULL
        UNION ALL SELECT w.plan_id, w.unit_id, l.v, w.total + o.s FROM walk w JOIN links l ON l.plan_id = w.plan_id AND l.u = w.at JOIN own o ON o.plan_id = l.plan_id AND o.unit_id = l.v),
    paths AS (SELECT o.plan_id, o.unit_id, any_value(o.s) AS s, max(w.total) AS p FROM own o LEFT JOIN walk w ON w.plan_id = o.plan_id AND w.unit_id = o.unit_id GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_PATHS} SELECT plan_id, unit_id, round(p, 6) AS path_s FROM paths")
def longest_path(spark, d):
    return _r(graph.longest_path(_timed(spark, d), view(spark, d, "edges"), "s"), "path_s")


@query(f"WITH RECURSIVE {_PATHS} SELECT plan_id, round(sum(s), 6) AS serial_s, round(CASE WHEN count(p) = count(*) THEN max(p) END, 6) AS longest_s FROM paths GROUP BY 1")
def forecast_bounds(spark, d):
    u = _timed(spark, d)
    met = u.join(graph.longest_path(u, view(spark, d, "edges"), "s"), ["plan_id", "unit_id"])
    longest = F.when(F.count("path_s") == F.count("*"), F.max("path_s"))
    return _r(met.groupBy("plan_id").agg(F.sum("s").alias("serial_s"), longest.alias("longest_s")), "serial_s", "longest_s")


@query(f"""
    WITH RECURSIVE {_CLOSURE}, seed AS (SELECT DISTINCT c.plan_id, c.unit_id FROM {{claims}} c LEFT JOIN {{capacities}} k USING (plan_id, resource) WHERE c.units > coalesce(k.capacity, 1) )
    SELECT DISTINCT plan_id, unit_id FROM (SELECT * FROM seed UNION SELECT c.plan_id, c.unit_id FROM closure c JOIN seed s ON s.plan_id = c.plan_id AND s.unit_id = c.ancestor)""")
def blocked_units(spark, d):
    bad = hosts.unsatisfiable(view(spark, d, "claims"), view(spark, d, "capacities")).select("plan_id", "unit_id").distinct()
    return graph.with_descendants(bad, view(spark, d, "edges"))


@query("""
    WITH RECURSIVE st AS (SELECT plan_id, unit_id, rn, CASE WHEN rn = 1 THEN CASE WHEN status_code = 'O' THEN 'failed' ELSE 'succeeded' END WHEN rn = 2 THEN CASE WHEN status_code = 'F' THEN 'failed' ELSE 'succeeded' END ELSE 'pending' END AS status FROM {units}),
    dep AS (SELECT e.plan_id, e.unit_id, e.pred_id, e.kind FROM {edges} e),
    sk AS (
        SELECT s.plan_id, s.unit_id FROM st s JOIN dep e USING (plan_id, unit_id) JOIN st p ON p.plan_id = e.plan_id AND p.unit_id = e.pred_id
        WHERE s.status = 'pending' AND p.status <> 'pending' AND e.kind <> 'order' AND ((e.kind = 'failure' AND p.status = 'succeeded') OR (e.kind <> 'failure' AND p.status <> 'succeeded'))
        UNION SELECT e.plan_id, e.unit_id FROM sk JOIN dep e ON e.plan_id = sk.plan_id AND e.pred_id = sk.unit_id JOIN st s ON s.plan_id = e.plan_id AND s.unit_id = e.unit_id
        WHERE s.status = 'pending' AND e.kind IN ('success', 'data'))
    SELECT st.plan_id, st.unit_id, CASE WHEN k.unit_id IS NOT NULL THEN 'skipped' ELSE st.status END AS status FROM st LEFT JOIN (SELECT DISTINCT * FROM sk) k USING (plan_id, unit_id)""")
def skip_cascade(spark, d):
    s = F.expr("CASE WHEN rn = 1 THEN CASE WHEN status_code = 'O' THEN 'failed' ELSE 'succeeded' END WHEN rn = 2 THEN CASE WHEN status_code = 'F' THEN 'failed' ELSE 'succeeded' END ELSE 'pending' END")
    return graph.skip_cascade(view(spark, d, "units").withColumn("status", s), view(spark, d, "edges"))


@query(f"""
    WITH RECURSIVE {_CLOSURE}, fns AS (SELECT plan_id, unit_id FROM {{units}} WHERE unit_id % 30 <> 0),
    got AS (SELECT module, fn, effect FROM {{fn_effects}} UNION SELECT c.plan_id, c.unit_id, f.effect FROM closure c JOIN {{fn_effects}} f ON f.module = c.plan_id AND f.fn = c.ancestor
        UNION SELECT c.plan_id, c.unit_id, 'unknown_call' FROM closure c WHERE NOT EXISTS (SELECT 1 FROM fns WHERE fns.plan_id = c.plan_id AND fns.unit_id = c.ancestor)),
    agg AS (SELECT module, fn, string_agg(DISTINCT effect, ',' ORDER BY effect) AS effects FROM got GROUP BY 1, 2)
    SELECT f.plan_id AS module, f.unit_id AS fn, coalesce(a.effects, '') AS effects, EXISTS (SELECT 1 FROM closure c WHERE c.plan_id = f.plan_id AND c.unit_id = f.unit_id AND c.ancestor = f.unit_id) AS in_cycle
    FROM fns f LEFT JOIN agg a ON a.module = f.plan_id AND a.fn = f.unit_id""")
def effect_reach(spark, d):
    fns = view(spark, d, "units").where("unit_id % 30 <> 0").select(F.col("plan_id").alias("module"), F.col("unit_id").alias("fn"))
    closure = graph.ancestors(view(spark, d, "edges")).select(F.col("plan_id").alias("module"), F.col("unit_id").alias("fn"), F.col("ancestor").alias("callee"))
    return _text(graph.effect_reach(closure, view(spark, d, "fn_effects"), fns), "effects")


# ---------------------------------------------------------------- runs


_TIMED_OUT = "CASE WHEN status = 'failed' AND duration_s > 3456000 THEN 'timed_out' ELSE status END"


@query(f"""
    WITH t AS (SELECT run_id, task_id, {_TIMED_OUT} AS status FROM {{task_results}})
    SELECT run_id, count(CASE WHEN status = 'succeeded' THEN 1 END) AS succeeded, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'timed_out' THEN 1 END) AS timed_out, count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped,
           coalesce(string_agg(CASE WHEN status = 'failed' THEN task_id END, ',' ORDER BY task_id), '') AS failed_ids, coalesce(string_agg(CASE WHEN status = 'timed_out' THEN task_id END, ',' ORDER BY task_id), '') AS timed_out_ids,
           coalesce(string_agg(CASE WHEN status = 'skipped' THEN task_id END, ',' ORDER BY task_id), '') AS skipped_ids
    FROM t GROUP BY 1""")
def run_status(spark, d):
    t = view(spark, d, "task_results").withColumn("status", F.expr(_TIMED_OUT))
    return _text(runs.run_status(t), "failed_ids", "timed_out_ids", "skipped_ids")


@query(f"SELECT run_id, status, task_id FROM (SELECT run_id, task_id, {_TIMED_OUT} AS status FROM {{task_results}}) t WHERE status <> 'succeeded'")
def unfinished_tasks(spark, d):
    return runs.unfinished(view(spark, d, "task_results").withColumn("status", F.expr(_TIMED_OUT)))


def _peak(keys: str, table: str, units: str) -> str:
    return f"""
    ev AS (SELECT {keys}, start_s AS t, 1 AS o, {units} AS dl FROM {table} UNION ALL SELECT {keys}, start_s + duration_s, 0, -({units}) FROM {table}),
    mo AS (SELECT {keys}, t, o, sum(dl) AS dl FROM ev GROUP BY ALL),
    pk AS (SELECT {keys}, max(n) AS peak FROM (SELECT {keys}, sum(dl) OVER (PARTITION BY {keys} ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS n FROM mo) GROUP BY ALL)"""


@query(f"WITH {_peak('run_id', '{task_results}', '1')} SELECT run_id, peak::BIGINT AS peak FROM pk")
def peak_concurrency(spark, d):
    return runs.peak_overlap(view(spark, d, "task_results"), ["run_id"], "start_s", "duration_s")


@query(f"WITH {_peak('run_id, resource_no', '{task_results}', 'duration_s / 86400')} SELECT run_id, resource_no, round(peak, 6) AS peak FROM pk")
def resource_peak(spark, d):
    return _r(runs.peak_overlap(view(spark, d, "task_results"), ["run_id", "resource_no"], "start_s", "duration_s", F.col("duration_s") / 86400), "peak")


@query(f"""
    WITH ran AS (SELECT * FROM {{task_results}} WHERE status <> 'skipped'), {_peak('run_id', 'ran', '1')},
    a AS (SELECT run_id, count(CASE WHEN status = 'succeeded' THEN 1 END) > 0 AND count(CASE WHEN status = 'failed' THEN 1 END) = 0 AS eligible,
          coalesce(sum(CASE WHEN status = 'succeeded' THEN duration_s END), 0) AS task_s,
          coalesce(max(CASE WHEN status <> 'skipped' THEN start_s + duration_s END) - min(CASE WHEN status <> 'skipped' THEN start_s END), 0) AS elapsed_s FROM {{task_results}} GROUP BY 1),
    b AS (SELECT a.*, CASE WHEN a.run_id % 4 = 0 THEN 5000000.0 END AS serial_s, pk.peak FROM a LEFT JOIN pk USING (run_id)),
    c AS (SELECT *, CASE WHEN NOT eligible THEN 'ineligible_failed_or_empty_run' WHEN serial_s IS NOT NULL THEN 'measured_serial_baseline' ELSE 'estimated_sum_of_task_durations' END AS kind,
          CASE WHEN eligible THEN coalesce(serial_s, task_s) ELSE 0 END AS comparison_s FROM b),
    e AS (SELECT *, CASE WHEN elapsed_s > 0 AND comparison_s > 0 THEN comparison_s / elapsed_s ELSE 0 END AS speedup, CASE WHEN eligible THEN comparison_s - elapsed_s ELSE 0 END AS dl FROM c)
    SELECT run_id, eligible, elapsed_s, peak::BIGINT AS peak, kind, comparison_s, round(speedup, 9) AS speedup, greatest(dl, 0) AS saved_s, greatest(-dl, 0) AS overhead_s,
           round(CASE WHEN coalesce(peak, 0) > 0 THEN speedup / peak ELSE 0 END, 9) AS efficiency FROM e""")
def run_savings(spark, d):
    t = view(spark, d, "task_results")
    base = t.where("run_id % 4 = 0").select("run_id", F.lit(5000000.0).alias("serial_s")).distinct()
    return runs.run_savings(t, base).withColumns({c: F.round(c, 9) for c in ("speedup", "efficiency")})


@query("""
    SELECT host, count(CASE WHEN provenance = 'measured' THEN 1 END) AS measured_runs, count(CASE WHEN provenance = 'estimated' THEN 1 END) AS estimated_runs, count(CASE WHEN provenance = 'legacy' THEN 1 END) AS legacy_runs,
           round(sum(CASE WHEN provenance = 'measured' THEN saved_s ELSE 0 END), 6) AS measured_s, round(sum(CASE WHEN provenance = 'estimated' THEN saved_s ELSE 0 END), 6) AS estimated_s, round(sum(CASE WHEN provenance = 'legacy' THEN saved_s ELSE 0 END), 6) AS legacy_s,
           round(sum(CASE WHEN provenance <> 'estimated' THEN saved_s ELSE 0 END), 6) AS primary_s FROM {savings_events} GROUP BY 1""")
def ledger_totals(spark, d):
    return _r(runs.ledger_totals(view(spark, d, "savings_events"), ["host"]), "measured_s", "estimated_s", "legacy_s", "primary_s")


@query("SELECT run_id, host, provenance, round(sum(saved_s) OVER (PARTITION BY host, provenance ORDER BY savings_events.at, run_id ROWS UNBOUNDED PRECEDING), 6) AS running_s FROM {savings_events}")
def ledger_running(spark, d):
    return _r(runs.ledger_running(view(spark, d, "savings_events")), "running_s").select("run_id", "host", "provenance", "running_s")


@query("""
    WITH t AS (SELECT *, (CASE WHEN coalesce(outer_s, 0) <= 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(worker_s, 0) <= 0 THEN 1 ELSE 0 END + CASE WHEN abs(outer_s - worker_s) > 2 THEN 1 ELSE 0 END + CASE WHEN coalesce(iterations, 0) <= 0 THEN 1 ELSE 0 END) AS e FROM {bench_tasks}),
    a AS (SELECT run_id, sum(worker_s) AS serial_s, max(outer_s) AS wall_s, min(worker_s) AS minimum_s, count(*) AS tasks, string_agg(DISTINCT task_id, '' ORDER BY task_id) = 'ANR' AS all_present, bool_and(e = 0) AS all_valid, sum(e)::BIGINT AS error_count FROM t GROUP BY 1)
    SELECT run_id, round(serial_s, 6) AS serial_s, round(wall_s, 6) AS wall_s, round(minimum_s, 6) AS minimum_s, tasks, all_present, all_valid, error_count, round(greatest(0, serial_s - wall_s), 6) AS saved_s, round(serial_s / wall_s, 6) AS speedup,
           round(greatest(0, serial_s - wall_s) * 100 / serial_s, 6) AS percent, round(serial_s / wall_s / tasks, 6) AS efficiency, CASE WHEN all_present AND all_valid AND minimum_s >= 10 THEN 'passed' ELSE 'failed' END AS status FROM a""")
def bench_summary(spark, d):
    out = runs.bench_summary(view(spark, d, "bench_tasks"), ["A", "N", "R"], target_s=60, minimum_s=10)
    return _r(out, "serial_s", "wall_s", "minimum_s", "saved_s", "speedup", "percent", "efficiency")


@query("""
    WITH m AS (SELECT run_id, max(worker_s) AS w, sum(worker_s) AS s FROM {bench_tasks} GROUP BY 1),
    x AS (SELECT run_id, concat_ws(',', CASE WHEN abs(wall_s - w) > 0.01 THEN 'wall' END, CASE WHEN abs(serial_s - s) > 0.01 THEN 'serial' END, CASE WHEN abs(saved_s - (s - wall_s)) > 0.01 THEN 'saved' END) AS wrong FROM {bench_stored} JOIN m USING (run_id))
    SELECT * FROM x WHERE wrong <> ''""")
def run_arithmetic(spark, d):
    return _text(runs.arithmetic_errors(view(spark, d, "bench_stored"), view(spark, d, "bench_tasks")), "wrong")


@query("""
    WITH m AS (SELECT run_id, min(worker_s) AS mi, sum(worker_s) AS s FROM {bench_tasks} GROUP BY 1),
    x AS (SELECT run_id, concat_ws(',', CASE WHEN NOT (wall_s > 0 AND peak > 0 AND serial_s > 0 AND saved_s >= 0) THEN 'bounds' END, CASE WHEN abs(serial_s - s) > 0.01 THEN 'serial' END, CASE WHEN abs(saved_s - greatest(0, serial_s - wall_s)) > 0.01 THEN 'saved' END,
          CASE WHEN abs(minimum_s - mi) > 0.01 THEN 'minimum' END, CASE WHEN NOT coalesce(abs(speedup - serial_s / nullif(wall_s, 0)) <= 0.0001, false) THEN 'speedup' END, CASE WHEN abs(percent - saved_s / serial_s * 100) > 0.0001 THEN 'percent' END,
          CASE WHEN NOT coalesce(abs(efficiency - serial_s / nullif(wall_s, 0) / nullif(peak, 0)) <= 0.0001, false) THEN 'efficiency' END) AS wrong FROM {bench_claimed} JOIN m USING (run_id))
    SELECT * FROM x WHERE wrong <> ''""")
def run_evidence(spark, d):
    return _text(runs.evidence_errors(view(spark, d, "bench_claimed"), view(spark, d, "bench_tasks")), "wrong")


@query("""
    WITH s AS (SELECT run_id, start_s + 43200 AS at_s, task_id AS running, CASE WHEN run_id % 5 <> 0 THEN task_id - 1 ELSE task_id END AS completed, CASE WHEN run_id % 11 <> 0 THEN run_id % 7 <> 0 END AS eligible FROM {task_results}),
    e AS (SELECT run_id, count(*) AS n, min(start_s) AS began_s, max(start_s + duration_s) AS end_s FROM {task_results} GROUP BY 1)
    SELECT run_id, bool_or(coalesce(running = n AND completed >= 0 AND completed < n AND at_s >= began_s AND at_s < end_s AND eligible, false)) AS seen FROM s JOIN e USING (run_id) GROUP BY 1""")
def live_sample(spark, d):
    t = view(spark, d, "task_results")
    s = t.selectExpr("run_id", "start_s + 43200 AS at_s", "task_id AS running", "CASE WHEN run_id % 5 <> 0 THEN task_id - 1 ELSE task_id END AS completed", "CASE WHEN run_id % 11 <> 0 THEN run_id % 7 <> 0 END AS eligible")
    return runs.live_sample_seen(s, t)


@query("SELECT realm, host_class, round(quantile_cont(wall_s, 0.5), 6) AS p50, round(quantile_cont(wall_s, 0.9), 6) AS p90, count(*) AS repetitions FROM (SELECT trim(realm) AS realm, run_id % 700 AS host_class, wall_s FROM {bench_runs}) GROUP BY 1, 2 HAVING count(*) >= 3")
def repeat_percentiles(spark, d):
    b = view(spark, d, "bench_runs").select(F.trim("realm").alias("realm"), (F.col("run_id") % 700).alias("host_class"), "wall_s")
    return _r(runs.repeat_percentiles(b, ["realm", "host_class"], "wall_s"), "p50", "p90")


@query("SELECT tool, count(DISTINCT call_id) AS calls, count(*) AS lines FROM {traces} GROUP BY 1")
def unique_calls(spark, d):
    return runs.unique_calls(view(spark, d, "traces"))


_FIRST_CALLS = "f AS (SELECT call_id, arg_min(tool, line_no) AS tool, arg_min(agent, line_no) AS agent FROM {call_lines} GROUP BY 1)"


@query(f"WITH {_FIRST_CALLS} SELECT tool, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, tool LIMIT 20")
def top_tools(spark, d):
    return runs.top_counts(view(spark, d, "call_lines"), "tool", 20)


@query("WITH f AS (SELECT call_id, arg_min(agent, line_no) AS agent FROM {call_lines} WHERE agent IS NOT NULL GROUP BY 1) SELECT agent, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, agent LIMIT 30")
def top_agent_tasks(spark, d):
    return runs.top_counts(view(spark, d, "call_lines").where("agent is not null"), "agent", 30)


_PROFILE = "CASE batch_key WHEN '1-URGENT' THEN 'cpu' WHEN '2-HIGH' THEN 'io' WHEN '3-MEDIUM' THEN 'accelerator' ELSE 'mixed' END"


@query(f"""
    SELECT plan_id, CASE WHEN count(DISTINCT p) = 1 THEN min(p) ELSE 'mixed' END AS profile, bool_or(p = 'accelerator') AS any_accelerator, round(max(CASE WHEN m > 0 THEN m END), 6) AS memory_mb
    FROM (SELECT plan_id, {_PROFILE} AS p, duration_s - 100 AS m FROM {{units}}) GROUP BY 1""")
def plan_profile(spark, d):
    u = view(spark, d, "units").select("plan_id", F.expr(_PROFILE).alias("profile"), (F.col("duration_s") - 100).alias("memory_mb"))
    return _r(runs.plan_profile(u), "memory_mb")


@query("""
    WITH s AS (SELECT suite_id, count(*) AS n, count(CASE WHEN outcome = 'failed' THEN 1 END) AS f, count(CASE WHEN outcome = 'skipped' THEN 1 END) AS k FROM {suite_cases} GROUP BY 1)
    SELECT suite_id, CASE WHEN f = n THEN 'ineligible_failed_or_empty_run' WHEN suite_id % 5 = 0 THEN 'unavailable_mixed_native_workload' WHEN suite_id % 7 = 0 THEN 'unavailable_native_execution_evidence' WHEN suite_id % 3 = 0 THEN 'measured_serial_baseline' WHEN k > 200 THEN 'estimated_sum_of_testcase_durations' ELSE 'unavailable_native_serial_comparison' END AS kind FROM s""")
def native_savings(spark, d):
    s = view(spark, d, "suite_cases").groupBy("suite_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("outcome") == "failed", 1)).alias("f"), F.count(F.when(F.col("outcome") == "skipped", 1)).alias("k"))
    i = F.col("suite_id")
    return s.select("suite_id", runs.native_savings_kind(F.col("f") != F.col("n"), i % 5 != 0, i % 7 != 0, i % 3 == 0, F.col("k") > 200).alias("kind"))


# ---------------------------------------------------------------- evidence and history


@query("""
    SELECT coalesce(e.plan_id, c.plan_id) AS plan_id, coalesce(e.path, c.path) AS path, CASE WHEN e.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'missing' WHEN c.digest IS NULL THEN 'unreadable' WHEN e.digest <> c.digest THEN 'changed' ELSE 'same' END AS state
    FROM {snapshots_expected} e FULL JOIN {snapshots_current} c ON e.plan_id = c.plan_id AND e.path = c.path""")
def snapshot_drift(spark, d):
    return evidence.snapshot_drift(view(spark, d, "snapshots_expected"), view(spark, d, "snapshots_current"))


@query("""
    WITH h AS (SELECT max(event_id) AS head FROM {events}),
    x AS (SELECT event_id, head, max(CASE WHEN event_type IN ('click', 'error') THEN event_id END) OVER later AS touched, max(CASE WHEN event_type = 'error' AND event_id % 97 = 3 THEN event_id END) OVER later AS other
        FROM {events}, h WINDOW later AS (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT event_id AS run_id, event_id = head OR (touched IS NOT NULL AND other IS NULL) AS valid FROM x""")
def evidence_validity(spark, d):
    """Events as a straight history of commits, of which clicks change the docs and errors now and then something else."""
    e = view(spark, d, "events").selectExpr("cast(event_id as string) as commit", "cast(event_id - 1 as string) as parent", "event_id", "event_type")
    head = str(e.agg(F.max("event_id")).first()[0])
    changes = e.where("event_type in ('click', 'error')").selectExpr("commit", "case when event_type = 'error' and event_id % 97 = 3 then 'src/x' else 'docs/y' end as path")
    return evidence.evidence_still_valid(e.select(F.col("event_id").alias("run_id"), "commit"), e.where("event_id > 0").select("commit", "parent"), changes, head)


@query("""
    SELECT path, span_id, hotspot_id, round(wall_s, 6) AS wall_s FROM (
        SELECT s.path, s.span_id, h.hotspot_id, h.wall_s, row_number() OVER (PARTITION BY s.path, s.span_id ORDER BY h.wall_s DESC, h.line, h.hotspot_id) AS r
        FROM {spans} s JOIN {hotspots} h ON h.path = s.path AND h.line BETWEEN s.first_line AND s.last_line) WHERE r = 1""")
def hotspot_match(spark, d):
    return _r(evidence.hotspot_spans(view(spark, d, "spans"), view(spark, d, "hotspots")), "wall_s")


@query("""
    WITH a AS (SELECT suite_id, md5(string_agg(CASE WHEN side = 'serial' THEN case_id END, ',' ORDER BY case_id)) AS serial_set, md5(string_agg(CASE WHEN side = 'parallel' THEN case_id END, ',' ORDER BY case_id)) AS parallel_set FROM {case_sets} GROUP BY 1)
    SELECT *, serial_set = parallel_set AS same FROM a WHERE serial_set IS NOT NULL AND parallel_set IS NOT NULL""")
def baseline_match(spark, d):
    return evidence.baseline_match(view(spark, d, "case_sets"))


@query("""
    SELECT b.suite_id, coalesce(r.eligible AND b.tests = r.tests AND b.passed = r.passed AND b.skipped = 0 AND r.skipped = 0 AND b.case_set = r.case_set, false) AS compatible
    FROM {case_counts} b JOIN {case_counts} r ON b.suite_id = r.suite_id AND b.side = 'serial' AND r.side = 'parallel'""")
def baseline_gate(spark, d):
    c = view(spark, d, "case_counts")
    return evidence.baseline_compatible(c.where("side = 'serial'"), c.where("side = 'parallel'"))


@query("""
    WITH j AS (SELECT s.run_id, bool_and(workers = 1 AND snapshots >= 1 AND declared AND covered AND skipped = 0 AND passed = tests AND case_set IS NOT NULL AND coalesce(r.status, '') = 'succeeded') AS each
               FROM {baseline_suites} s LEFT JOIN {baseline_results} r ON r.run_id = s.run_id AND r.suite_id = s.suite_id GROUP BY 1)
    SELECT run_id, native_pools = 0 AND peak = 1 AND each AS eligible FROM {baseline_runs} JOIN j USING (run_id)""")
def serial_baselines(spark, d):
    return evidence.serial_baselines(view(spark, d, "baseline_runs"), view(spark, d, "baseline_suites"), view(spark, d, "baseline_results"))


@query("""
    WITH s AS (SELECT module, count(*) AS total, count(CASE WHEN status = 'passed' THEN 1 END) AS passed, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'error' THEN 1 END) AS errors, count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped FROM {domain_cases} GROUP BY 1),
    x AS (SELECT coalesce(d.module, s.module) AS module, CASE WHEN d.module IS NULL THEN 'missing' WHEN s.module IS NULL THEN 'unknown' ELSE concat_ws(',', CASE WHEN d.total <> s.total THEN 'total' END, CASE WHEN d.passed <> s.passed THEN 'passed' END, CASE WHEN d.failed <> s.failed THEN 'failed' END,
          CASE WHEN d.errors <> s.errors THEN 'errors' END, CASE WHEN d.skipped <> s.skipped THEN 'skipped' END) END AS wrong FROM {domain_stored} d FULL JOIN s ON d.module = s.module)
    SELECT * FROM x WHERE wrong <> ''""")
def domain_consistency(spark, d):
    return _text(evidence.domain_errors(view(spark, d, "domain_stored"), view(spark, d, "domain_cases")), "wrong")


_SUITE = """
    seen AS (SELECT run_id, suite_id, count(*) AS tests, count(CASE WHEN outcome = 'passed' THEN 1 END) AS passed, count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed, count(CASE WHEN outcome = 'skipped' THEN 1 END) AS skipped, sum(time_s) AS case_s FROM {suite_cases} GROUP BY 1, 2),
    summary AS (SELECT s.run_id, s.suite_id, tests, passed, failed, skipped, case_s, declared_tests = tests AS consistent, case_s <= wall_s * workers + greatest(0.05, wall_s * workers * 0.05) AS timing_plausible,
        declared_tests = tests AND case_s <= wall_s * workers + greatest(0.05, wall_s * workers * 0.05) AND tests > 0 AND failed = 0 AS eligible FROM {suites} s JOIN seen USING (run_id, suite_id))"""


def _suites(spark, d):
    return evidence.suite_summary(view(spark, d, "suite_cases"), view(spark, d, "suites"))


@query(f"WITH {_SUITE} SELECT run_id, suite_id, tests, passed, failed, skipped, round(case_s, 6) AS case_s, consistent, timing_plausible, eligible FROM summary")
def suite_summary(spark, d):
    return _r(_suites(spark, d), "case_s").select("run_id", "suite_id", "tests", "passed", "failed", "skipped", "case_s", "consistent", "timing_plausible", "eligible")


def _report_sql(table: str) -> str:
    return f"""
    r AS (SELECT run_id, count(*) AS suites, sum(tests)::BIGINT AS tests, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, sum(skipped)::BIGINT AS skipped, bool_and(eligible) AS all_eligible,
        count(CASE WHEN fresh THEN 1 END) AS fresh_suites, bool_and(coalesce(fresh, false)) AS fresh, bool_and(consistent) AS consistent, bool_and(coalesce(timing_plausible, false)) AND sum(tests) > 0 AS timing_complete, sum(case_s) AS case_s, bool_and(exclusive) AS exclusive FROM {table} GROUP BY 1),
    x AS (SELECT *, exclusive AND fresh AND consistent AND tests > 0 AND passed > 0 AND failed = 0 AS evidence FROM r)
    SELECT run_id, suites, tests, passed, failed, skipped, all_eligible, fresh_suites, fresh, timing_complete, CASE WHEN exclusive THEN 'exclusive_test_plan' ELSE 'unavailable_mixed_workload' END AS attribution, evidence,
        CASE WHEN evidence AND timing_complete AND case_s > 0 THEN 'fresh_junit_testcase_durations' END AS comparison_kind FROM x"""


_FRESH = "CASE WHEN suite_id % 13 = 5 THEN NULL ELSE suite_id % 11 <> 0 END AS fresh, run_id % 5 <> 0 AS exclusive"


@query(f"WITH {_SUITE}, s AS (SELECT *, {_FRESH} FROM summary), {_report_sql('s')}")
def run_report(spark, d):
    return evidence.run_report(_suites(spark, d).selectExpr("*", *_FRESH.split(", ")))


@query(f"WITH {_report_sql('{attributed_suites}')}")
def report_evidence(spark, d):
    return evidence.run_report(view(spark, d, "attributed_suites"))


@query(f"WITH {_SUITE} SELECT run_id, bool_and(passed = tests AND skipped = 0 AND consistent) AS eligible FROM summary GROUP BY 1")
def baseline_eligible(spark, d):
    return evidence.baseline_eligible(_suites(spark, d))


@query("""
    WITH m AS (SELECT DISTINCT module FROM (SELECT suite_id % 10 AS module FROM {suites} UNION ALL SELECT n_nationkey + 8 FROM {nation}) x),
    c AS (SELECT suite_id % 10 AS module, time_s, CASE WHEN outcome = 'failed' AND time_s > 0.06 THEN 'expected_failure' ELSE outcome END AS outcome FROM {suite_cases}),
    s AS (SELECT module, count(*) AS total, count(CASE WHEN outcome = 'passed' THEN 1 END) AS passed, count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed, count(CASE WHEN outcome = 'skipped' THEN 1 END) AS skipped, count(CASE WHEN outcome = 'expected_failure' THEN 1 END) AS expected_failure, sum(time_s) AS case_s FROM c GROUP BY 1)
    SELECT m.module, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, coalesce(expected_failure, 0) AS expected_failure, round(coalesce(case_s, 0), 6) AS case_s,
        round(coalesce(passed / nullif(total - skipped - expected_failure, 0), 0), 6) AS pass_rate FROM m LEFT JOIN s ON m.module = s.module""")
def domain_rollup(spark, d):
    m = view(spark, d, "suites").select(F.col("module").cast("long")).union(view(spark, d, "nation").select((F.col("n_nationkey") + 8).cast("long"))).distinct().toDF("module")
    c = view(spark, d, "suite_cases").withColumn("outcome", F.expr("CASE WHEN outcome = 'failed' AND time_s > 0.06 THEN 'expected_failure' ELSE outcome END"))
    return _r(evidence.domain_rollup(c, m, F.col("suite_id") % 10), "case_s", "pass_rate")


@query("""
    WITH o AS (SELECT run_id, suite_id, count(*) AS observed FROM {suite_cases} WHERE suite_id % 31 <> 0 GROUP BY 1, 2)
    SELECT coalesce(s.run_id, o.run_id) AS run_id, coalesce(s.suite_id, o.suite_id) AS suite_id, s.declared_tests AS stored, o.observed FROM {suites} s FULL JOIN o ON s.run_id = o.run_id AND s.suite_id = o.suite_id WHERE s.declared_tests IS DISTINCT FROM o.observed""")
def report_consistency(spark, d):
    return evidence.inconsistent_reports(view(spark, d, "suites"), view(spark, d, "suite_cases").where("suite_id % 31 <> 0"), ["run_id", "suite_id"], "declared_tests")


_REALM = "SELECT run_id, lower(trim(realm)) AS realm, generated_at, status, wall_s, serial_s, saved_s FROM {bench_runs}"


def _realms(spark, d):
    none = F.lit(None).cast("string")
    realm = history.realm_of(F.col("realm"), none, none, none)
    return view(spark, d, "bench_runs").withColumn("realm", realm)


@query(f"""
    WITH b AS ({_REALM}) SELECT realm, count(CASE WHEN status = 'passed' THEN 1 END) AS passed_runs, round(sum(CASE WHEN status = 'passed' THEN wall_s ELSE 0 END), 4) AS wall_s, round(sum(CASE WHEN status = 'passed' THEN serial_s ELSE 0 END), 4) AS serial_s, round(sum(CASE WHEN status = 'passed' THEN saved_s ELSE 0 END), 4) AS saved_s FROM b GROUP BY 1""")
def realm_cumulative(spark, d):
    return history.cumulative(_realms(spark, d)).withColumns({c: F.round(c, 4) for c in ("wall_s", "serial_s", "saved_s")})


@query(f"WITH b AS ({_REALM}) SELECT realm, run_id || '@' || realm AS run_key, status, round(wall_s, 6) AS wall_s FROM (SELECT *, row_number() OVER (PARTITION BY realm ORDER BY generated_at DESC, run_id DESC) AS r FROM b) WHERE r = 1")
def latest_per_realm(spark, d):
    out = history.latest(_realms(spark, d)).withColumn("run_key", history.qualified(F.col("run_id").cast("string"), F.col("realm")))
    return _r(out, "wall_s").select("realm", "run_key", "status", "wall_s")


@query(f"WITH b AS ({_REALM}) SELECT realm, count(*) AS runs, count(*) = count(DISTINCT run_id) AS unique_ids, bool_and(abs(saved_s - (serial_s - wall_s)) <= 0.01) AS arithmetic_ok, max(generated_at)::DATE AS newest FROM b GROUP BY 1")
def history_consistency(spark, d):
    return history.consistency(_realms(spark, d)).withColumn("newest", F.col("newest").cast("date"))


_HISTORY = """
    newest AS (SELECT realm, run_id, wall_s + CASE WHEN realm LIKE '%-3' THEN 1 ELSE 0 END AS wall_s, serial_s, saved_s, speedup FROM (SELECT *, row_number() OVER (PARTITION BY realm ORDER BY generated_at DESC, run_id DESC) AS r FROM {bench_history}) WHERE r = 1),
    totals AS (SELECT realm, count(*) + CASE WHEN realm LIKE '%-5' THEN 1 ELSE 0 END AS run_count, sum(wall_s) AS wall_s, sum(serial_s) AS serial_s, sum(saved_s) AS saved_s FROM {bench_history} GROUP BY 1)"""


@query(f"""
    WITH {_HISTORY}, h AS (SELECT h.realm, bool_and(status = 'passed') AS all_passed, count(*) = count(DISTINCT h.run_id) AS unique_ids, bool_and(h.wall_s > 0 AND h.serial_s > 0 AND h.saved_s >= 0 AND abs(h.saved_s - greatest(0, h.serial_s - h.wall_s)) <= 0.01 AND abs(h.speedup - h.serial_s / h.wall_s) <= 0.0001) AS arithmetic_ok,
        count(CASE WHEN h.run_id = w.run_id THEN 1 END) = 1 AND count(CASE WHEN h.run_id = w.run_id AND abs(h.wall_s - w.wall_s) <= 0.01 AND abs(h.serial_s - w.serial_s) <= 0.01 AND abs(h.saved_s - w.saved_s) <= 0.01 AND abs(h.speedup - w.speedup) <= 0.0001 THEN 1 END) = 1 AS current_ok,
        count(*) AS n, sum(h.wall_s) AS sw, sum(h.serial_s) AS ss, sum(h.saved_s) AS sv FROM {{bench_history}} h LEFT JOIN newest w ON w.realm = h.realm GROUP BY 1)
    SELECT h.realm, all_passed, unique_ids, arithmetic_ok, current_ok, run_count = n AND abs(t.wall_s - sw) <= 0.01 AND abs(t.serial_s - ss) <= 0.01 AND abs(t.saved_s - sv) <= 0.01 AS cumulative_ok FROM h JOIN totals t ON t.realm = h.realm""")
def history_evidence(spark, d):
    h = view(spark, d, "bench_history")
    newest = history.latest(h).withColumn("wall_s", F.col("wall_s") + F.col("realm").endswith("-3").cast("int"))
    totals = h.groupBy("realm").agg((F.count("*") + F.col("realm").endswith("-5").cast("int")).alias("run_count"), *[F.sum(c).alias(c) for c in ("wall_s", "serial_s", "saved_s")])
    return history.evidence(h, newest, totals)


@query("""
    SELECT counter, captured_on, last_value(n IGNORE NULLS) OVER w AS filled, CASE WHEN n IS NULL AND last_value(n IGNORE NULLS) OVER w IS NOT NULL THEN lag(captured_on) OVER (PARTITION BY counter ORDER BY captured_on) END AS stale_from_previous,
           last_value(CASE WHEN n IS NOT NULL THEN captured_on END IGNORE NULLS) OVER w AS last_real_at
    FROM {growth} WINDOW w AS (PARTITION BY counter ORDER BY captured_on ROWS UNBOUNDED PRECEDING)""")
def carry_forward(spark, d):
    return history.carry_forward(view(spark, d, "growth"))


@query("""
    WITH m AS (SELECT max(CAST(ts AS DATE)) AS newest FROM {events}),
    old AS (SELECT event_id, value FROM {events}, m WHERE CAST(ts AS DATE) < newest),
    new AS (SELECT event_id, value + 1 AS value FROM {events}, m WHERE CAST(ts AS DATE) >= newest - INTERVAL 1 DAY)
    SELECT * FROM (SELECT * FROM old WHERE event_id NOT IN (SELECT event_id FROM new) UNION ALL SELECT * FROM new) ORDER BY event_id DESC LIMIT 180""")
def keep_last_n(spark, d):
    """The history ends a day before the newest; the batch brings the two newest days anew."""
    e = view(spark, d, "events").select("event_id", "value", F.to_date("ts").alias("day"))
    newest = F.lit(e.agg(F.max("day")).first()[0]).cast("date")
    old, new = e.where(F.col("day") < newest), e.where(F.col("day") >= F.date_sub(newest, 1)).withColumn("value", F.col("value") + 1)
    return history.append_keeping(old.drop("day"), new.drop("day"), "event_id", "event_id")


@query("SELECT event_type AS counter, count(*)::DOUBLE AS value, 2000.0::DOUBLE AS target, round(count(*) / 2000.0::DOUBLE, 6) AS ratio FROM {events} WHERE event_type IN ('click', 'view') GROUP BY 1")
def target_progress(spark, d):
    c = view(spark, d, "events").agg(*[F.count(F.when(F.col("event_type") == t, 1)).alias(t) for t in ("click", "view")])
    return _r(history.target_progress(c, {"click": 2000, "view": 2000}), "ratio")


_CLEAN = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'unknown')"


@query(f"""
    SELECT id, CASE WHEN coalesce(explicit, '') <> '' THEN {_CLEAN.format('explicit')} WHEN lower(system) = 'windows' THEN 'windows_native' WHEN lower(system) IN ('darwin', 'macos') THEN 'macos_native' WHEN lower(system) = 'linux' THEN 'linux_native'
        WHEN coalesce(direct, '') <> '' THEN {_CLEAN.format('direct')} WHEN contains(lower(machine), 'apple') OR contains(lower(machine), 'mac') THEN 'macos_native' WHEN contains(lower(machine), 'windows') THEN 'windows_native' ELSE 'unknown' END AS realm FROM {{machines}}""")
def realm_sources(spark, d):
    m = view(spark, d, "machines")
    return m.select("id", history.realm_of(F.col("explicit"), F.col("system"), F.col("direct"), F.col("machine")).alias("realm"))


@query("SELECT DISTINCT lower(trim(realm)) AS realm FROM {bench_runs}")
def realm_names(spark, d):
    return _realms(spark, d).select("realm").distinct()


# ---------------------------------------------------------------- rules


_BAD = "(effects_assurance = 'unknown' OR (effects_assurance = 'partial' AND (side_effect OR peak > 1)))"
_DIAG = f"""
    pk AS (SELECT plan_id, count(*) % 3 AS peak FROM {{units}} GROUP BY 1), x AS (SELECT * FROM {{units}} JOIN pk USING (plan_id)),
    diag AS (SELECT plan_id, unit_id, 'OPAQUE_OR_INVALID_ATOM' AS code, 'error' AS severity FROM x WHERE parse_assurance IN ('opaque', 'invalid')
        UNION ALL SELECT plan_id, unit_id, 'CONSERVATIVE_PARSE', 'warning' FROM x WHERE parse_assurance = 'conservative'
        UNION ALL SELECT plan_id, unit_id, 'INCOMPLETE_EFFECT_MODEL', 'error' FROM x WHERE {_BAD}
        UNION ALL SELECT plan_id, unit_id, 'PARTIAL_EFFECT_MODEL', 'warning' FROM x WHERE effects_assurance = 'partial' AND NOT {_BAD}
        UNION ALL SELECT plan_id, unit_id, 'NON_EXECUTABLE_CODEGEN', 'error' FROM x WHERE codegen_assurance = 'opaque'
        UNION ALL SELECT plan_id, unit_id, 'NATIVE_DELEGATE_REQUIRED', 'error' FROM x WHERE codegen_assurance = 'native_delegate'
        UNION ALL SELECT plan_id, unit_id, 'UNSAFE_RETRY_CONTRACT', 'error' FROM x WHERE retryable AND idempotent IS DISTINCT FROM true
        UNION ALL SELECT plan_id, unit_id, 'UNSAFE_CACHE_CONTRACT', 'error' FROM x WHERE cacheable AND (idempotent IS DISTINCT FROM true OR NOT deterministic OR side_effect))"""


def _diagnostics(spark, d):
    u = view(spark, d, "units")
    return rules.diagnostics(u, u.groupBy("plan_id").agg((F.count("*") % 3).alias("peak")))


@query(f"WITH {_DIAG} SELECT * FROM diag")
def unit_diagnostics(spark, d):
    return _diagnostics(spark, d)


@query(f"""
    WITH {_DIAG}, y AS (SELECT * FROM {{assured_units}} JOIN pk USING (plan_id))
    SELECT * FROM diag UNION ALL SELECT plan_id, unit_id, 'UNKNOWN_CONTROL_FLOW', 'error' FROM y WHERE control_assurance = 'unknown'
    UNION ALL SELECT plan_id, unit_id, 'UNKNOWN_INTERNAL_PARALLELISM', 'warning' FROM y WHERE internal_kind = 'unknown' AND peak > 1""")
def assured_diagnostics(spark, d):
    u = view(spark, d, "assured_units")
    return rules.diagnostics(u, u.groupBy("plan_id").agg((F.count("*") % 3).alias("peak")))


@query(f"""
    WITH RECURSIVE {_CLOSURE}, pr AS (SELECT DISTINCT plan_id, first, second FROM ({_PAIR}) q),
    ord AS (SELECT DISTINCT plan_id, least(unit_id, ancestor) AS first, greatest(unit_id, ancestor) AS second FROM closure)
    SELECT DISTINCT plan_id, NULL::BIGINT AS unit_id, NULL::BIGINT AS other_id, 'EMPTY_ATOM_PLAN' AS code, 'error' AS severity FROM {{every_plan}} WHERE plan_id NOT IN (SELECT plan_id FROM {{units}})
    UNION ALL SELECT p.plan_id, p.first, p.second, CASE WHEN a.commutative AND b.commutative THEN 'SERIALIZED_REORDERABLE_CONFLICT' ELSE 'UNORDERED_SEMANTIC_CONFLICT' END, CASE WHEN a.commutative AND b.commutative THEN 'warning' ELSE 'error' END
        FROM pr p LEFT JOIN ord ON ord.plan_id = p.plan_id AND ord.first = p.first AND ord.second = p.second JOIN {{units}} a ON a.plan_id = p.plan_id AND a.unit_id = p.first JOIN {{units}} b ON b.plan_id = p.plan_id AND b.unit_id = p.second WHERE ord.first IS NULL
    UNION ALL SELECT DISTINCT c.plan_id, c.unit_id, NULL, 'UNSATISFIABLE_RESOURCE_CLAIM', 'error' FROM {{claims}} c LEFT JOIN {{capacities}} k USING (plan_id, resource) WHERE c.units > coalesce(k.capacity, 1)""")
def plan_diagnostics(spark, d):
    u = view(spark, d, "units")
    pairs = conflicts.access_conflicts(view(spark, d, "accesses")).select("plan_id", "first", "second").distinct()
    pairs = conflicts.reorder_fences(conflicts.with_order(pairs, view(spark, d, "edges")), u, F.col("commutative"))
    return rules.plan_diagnostics(view(spark, d, "every_plan"), u, pairs, hosts.unsatisfiable(view(spark, d, "claims"), view(spark, d, "capacities")))


@query("""
    SELECT unit_id, 'access' AS part, unnest(reads) AS name, 'read' AS mode FROM {coarse_units} UNION ALL SELECT unit_id, 'access', unnest(writes), 'overwrite' FROM {coarse_units}
    UNION ALL SELECT unit_id, 'effect', CASE WHEN contains(r, ':') THEN r ELSE 'logical-resource:' || r END, 'write' FROM (SELECT unit_id, unnest(resources) AS r FROM {coarse_units})
    UNION ALL SELECT unit_id, 'blocker', 'LEGACY_EFFECT_SET_INCOMPLETE', NULL FROM {coarse_units} WHERE kind <> 'read' AND coalesce(len(reads), 0) + coalesce(len(writes), 0) + coalesce(len(resources), 0) = 0""")
def coarse_rows(spark, d):
    t = rules.coarse_rows(view(spark, d, "coarse_units"))
    row = lambda df, part, name, mode: df.select("unit_id", F.lit(part).alias("part"), name.alias("name"), mode.alias("mode"))
    out = row(t["accesses"], "access", F.col("resource"), F.col("mode")).unionByName(row(t["effects"], "effect", F.concat_ws(":", "domain", "key"), F.col("mode")))
    return out.unionByName(row(t["blockers"], "blocker", F.col("blocker"), F.lit(None).cast("string")))


@query(f"""
    WITH {_DIAG}, p AS (SELECT plan_id, bool_or(severity = 'error') AS bad, bool_or(code = 'NATIVE_DELEGATE_REQUIRED') AS nat FROM diag GROUP BY 1)
    SELECT u.plan_id, CASE WHEN NOT coalesce(bad, false) THEN 'direct' WHEN nat THEN 'delegate' ELSE 'blocked' END AS route FROM (SELECT DISTINCT plan_id FROM {{units}}) u LEFT JOIN p USING (plan_id)""")
def plan_routes(spark, d):
    return rules.routes(view(spark, d, "units"), _diagnostics(spark, d))


@query(f"SELECT plan_id, unit_id, round({_DURATION}, 6) AS seconds, duration_s IS NOT NULL AS declared FROM {{units}}")
def effective_durations(spark, d):
    return _r(_timed(spark, d).select("plan_id", "unit_id", F.col("s").alias("seconds"), F.col("duration_s").isNotNull().alias("declared")), "seconds")


_FLAGS = f"""
    f AS (SELECT plan_id, unit_id, {_PROFILE} AS profile, side_effect OR coalesce(idempotent, false) AS effect, unit_id % 3 AS writes, unit_id % 5 AS resources, duration_s / 1000 AS est FROM {{units}}),
    g AS (SELECT *, effect AND writes = 0 AND resources = 0 AS force_serial, coalesce(est < CASE profile WHEN 'cpu' THEN 0.2 WHEN 'io' THEN 0.1 WHEN 'mixed' THEN 0.15 ELSE 0.5 END, false) AS tiny FROM f)"""


def _flags(spark, d):
    u = view(spark, d, "units").withColumn("profile", F.expr(_PROFILE))
    f = rules.unit_flags(F.col("side_effect"), F.col("idempotent"), F.col("unit_id") % 3, F.col("unit_id") % 5, F.col("duration_s") / 1000, F.col("profile"))
    return u.select("plan_id", "unit_id", *[c.alias(n) for n, c in f.items()])


@query(f"WITH {_FLAGS} SELECT plan_id, unit_id, effect AS side_effect, force_serial, tiny FROM g")
def unit_flags(spark, d):
    return _flags(spark, d)


@query(f"""
    WITH {_FLAGS}, c AS (SELECT DISTINCT plan_id, first AS unit_id FROM ({_PAIR}) UNION SELECT DISTINCT plan_id, second FROM ({_PAIR})),
    k AS (SELECT CASE WHEN force_serial THEN 'serial' WHEN tiny THEN 'batch_candidate' WHEN c.unit_id IS NOT NULL OR effect THEN 'conditional' ELSE 'parallel_ready' END AS class FROM g LEFT JOIN c USING (plan_id, unit_id)),
    e AS (SELECT unnest(['serial', 'batch_candidate', 'conditional', 'parallel_ready', 'already_parallel']) AS class)
    SELECT e.class, count(k.class) AS units FROM e LEFT JOIN k ON e.class = k.class GROUP BY 1""".replace("{{", "{").replace("}}", "}"))
def class_counts(spark, d):
    p = conflicts.access_conflicts(view(spark, d, "accesses"))
    hit = dealt(p.select("plan_id", F.explode(F.array("first", "second")).alias("unit_id")), "plan_id", "unit_id").distinct().withColumn("hit", F.lit(True))
    f = _flags(spark, d).join(hit, ["plan_id", "unit_id"], "left")
    k = f.select(rules.unit_class(F.col("force_serial"), F.col("tiny"), F.coalesce("hit", F.lit(False)), F.col("side_effect")).alias("class"))
    every = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("serial", "batch_candidate", "conditional", "parallel_ready", "already_parallel")])).alias("class"))
    return every.join(k.groupBy("class").agg(F.count("*").alias("units")), "class", "left").select("class", F.coalesce("units", F.lit(0)).alias("units"))


_PROMPT_SQL = "CASE WHEN NOT regexp_matches(prompt, '{0}') THEN 'direct' WHEN regexp_matches(prompt, '{1}') OR (regexp_matches(prompt, '{2}') AND regexp_matches(prompt, '{3}')) THEN 'candidate' ELSE 'inspect' END".format(*[p.replace("\\b(?:", "(^|[^\\pL\\pN_])(?:").replace(")\\b", ")([^\\pL\\pN_]|$)") for p in (rules.EXECUTION, rules.PARALLEL, rules.MULTIPLE, rules.LONG)])
SQL["request_class"] = with_views("SELECT origin, id, @@ AS class FROM {prompts}").replace("@@", _PROMPT_SQL)


@query()
def request_class(spark, d):
    return view(spark, d, "prompts").select("origin", "id", rules.request_class(F.col("prompt")).alias("class"))


@query("""
    WITH r AS (SELECT id, CASE WHEN id <= 0 THEN 'id' WHEN NOT regexp_matches(head_sha, '^[0-9a-f]{40}$') THEN 'commit' WHEN head_branch <> 'main' THEN 'branch' WHEN event NOT IN ('click', 'view') THEN 'event' WHEN conclusion <> 'success' THEN 'conclusion' END AS rejected FROM {workflow_runs})
    SELECT id, rejected IS NULL AS trusted, rejected FROM r""".replace("{40}", "@40@"))
def trusted_runs(spark, d):
    r = rules.trusted_run(F.col("id"), F.col("event"), F.col("head_sha"), F.col("head_branch"), F.col("conclusion"), ["click", "view"])
    return view(spark, d, "workflow_runs").select("id", r.isNull().alias("trusted"), r.alias("rejected"))


SQL["trusted_runs"] = SQL["trusted_runs"].replace("@40@", "{40}")


@query("""
    WITH v AS (SELECT *, try_cast(raw AS DOUBLE) AS x, lower(trim(raw)) AS t FROM {raw_numbers}),
    r AS (SELECT *, CASE WHEN raw IS NULL THEN 'null' WHEN t IN ('true', 'false') THEN 'boolean' WHEN x IS NULL THEN 'not_a_number' WHEN isnan(x) OR isinf(x) THEN 'not_finite' WHEN x < 1 OR x > 40 THEN 'out_of_bounds' END AS reason FROM v)
    SELECT field, id, CASE WHEN reason IS NULL THEN x END AS number, reason FROM r""")
def quarantine(spark, d):
    q = rules.quarantine(F.col("raw"), 1, 40)
    return view(spark, d, "raw_numbers").select("field", "id", q["number"].alias("number"), q["reason"].alias("reason"))


@query("""
    WITH g AS (SELECT event_id, value / 10 AS serial_s, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 12 END AS items, (1 + user_id % 8) AS workers FROM {events}),
    w AS (SELECT *, CASE WHEN items > 0 THEN greatest(1, least(workers, items)) ELSE workers END AS w FROM g),
    p AS (SELECT *, serial_s * (0.15::DOUBLE + 0.85::DOUBLE / w) + w * 0.12::DOUBLE + CASE WHEN items > 0 THEN items * 0.002::DOUBLE ELSE w * 0.01::DOUBLE END AS parallel_s FROM w)
    SELECT event_id, round(parallel_s, 9) AS parallel_s, round(greatest(0, serial_s - parallel_s), 9) AS saved_s, round(serial_s / parallel_s, 9) AS speedup, serial_s < 1.0 AS below_threshold FROM p""")
def modelled_gain(spark, d):
    e = view(spark, d, "events").select("event_id", (F.col("value") / 10).alias("s"), F.expr("case when event_id % 3 = 0 then 0 else event_id % 12 end").alias("i"), (1 + F.col("user_id") % 8).alias("w"))
    e = e.withColumn("p", rules.gain(F.col("s"), F.col("i"), F.col("w")))
    out = e.select("event_id", F.col("p").alias("parallel_s"), F.greatest(F.lit(0.0), F.col("s") - F.col("p")).alias("saved_s"), (F.col("s") / F.col("p")).alias("speedup"), (F.col("s") < 1.0).alias("below_threshold"))
    return out.withColumns({c: F.round(c, 9) for c in ("parallel_s", "saved_s", "speedup")})


_TAGS = " UNION ALL ".join(f"SELECT '{t}' AS tag FROM {{traces}} WHERE regexp_matches(lower(input), '{p}')" for t, p in rules.SIGNATURES.items())
SQL["top_tags"] = with_views("SELECT tag, count(*) AS n FROM (@@) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20".replace("@@", "SELECT * FROM {traces}")).replace("SELECT * FROM traces", _TAGS.replace("{traces}", "traces"))


@query()
def top_tags(spark, d):
    t = view(spark, d, "traces").select(F.explode(rules.signatures(F.col("input"))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("SELECT CASE WHEN x = '' THEN '[no-ext]' ELSE x END AS ext, count(*) AS n FROM (SELECT lower(regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1)) AS x FROM {pages}) GROUP BY 1 ORDER BY n DESC, ext LIMIT 30")
def ext_counts(spark, d):
    x = F.lower(F.regexp_extract("url", "[.]([A-Za-z0-9]+)$", 1))
    return view(spark, d, "pages").groupBy(F.when(x == "", "[no-ext]").otherwise(x).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(30)


@query("""
    WITH p AS (SELECT p_partkey - p_partkey % 2 AS id, min(p_name) AS label FROM {part} GROUP BY 1),
    t AS (SELECT id, label, list_has_any(regexp_extract_all(lower(label), '[a-z0-9_-]{3,}'), ['cold', 'steel', 'widget']) AS hinted FROM p)
    SELECT * FROM t ORDER BY hinted DESC, id LIMIT 96""".replace("{3,}", "@3@"))
def hint_candidates(spark, d):
    p = view(spark, d, "part").selectExpr("p_partkey - p_partkey % 2 AS id", "p_name")
    return rules.hint_candidates(p, "p_name", F.lit("cold steel widget"), 96)


SQL["hint_candidates"] = SQL["hint_candidates"].replace("@3@", "{3,}")


# ---------------------------------------------------------------- hosts


@query("""
    WITH d AS (SELECT u.plan_id, u.unit_id, r.resource, r.units FROM {units} u, (VALUES ('worker_slot', 1.0::DOUBLE), ('cores', 2.0::DOUBLE)) r(resource, units))
    SELECT plan_id, unit_id, resource, sum(units) AS units FROM {claims} GROUP BY 1, 2, 3
    UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM {claims} c WHERE c.plan_id = d.plan_id AND c.unit_id = d.unit_id AND c.resource = d.resource)""")
def claim_totals(spark, d):
    return hosts.claim_totals(view(spark, d, "claims"), view(spark, d, "units"), {"worker_slot": 1, "cores": 2})


@query("SELECT c.plan_id, c.unit_id, c.resource, c.units, coalesce(k.capacity, 1) AS capacity FROM {claims} c LEFT JOIN {capacities} k USING (plan_id, resource) WHERE c.units > coalesce(k.capacity, 1)")
def unsatisfiable(spark, d):
    return hosts.unsatisfiable(view(spark, d, "claims"), view(spark, d, "capacities"))


@query("""
    WITH s AS (SELECT count(*) AS sessions, sum(ready)::BIGINT AS ready, sum(running)::BIGINT AS running, min(slots) AS capacity, count(CASE WHEN ready > 0 THEN 1 END) AS waiting FROM {sessions}),
    r AS (SELECT count(*) AS reservations, coalesce(sum(claim), 0) AS claimed FROM {reservations} WHERE session_id IN (SELECT session_id FROM {sessions}))
    SELECT s.*, r.reservations, round(r.claimed, 6) AS claimed, round(CASE WHEN waiting > 0 THEN capacity / waiting ELSE capacity END, 6) AS fair_share FROM s, r""")
def shared_capacity(spark, d):
    return _r(hosts.shared_capacity(view(spark, d, "sessions"), view(spark, d, "reservations")), "claimed", "fair_share")


@query("SELECT session_id, unit_id, round(claim, 6) AS claim FROM {reservations} WHERE session_id NOT IN (SELECT session_id FROM {sessions})")
def orphan_reservations(spark, d):
    return _r(hosts.orphans(view(spark, d, "reservations"), view(spark, d, "sessions")), "claim")


@query("SELECT s.session_id, round(greatest(0, coalesce(CASE WHEN s.session_id % 3 = 0 THEN (s.ready % 100)::DOUBLE / 100 * s.slots END, observed_load) - coalesce(own, 0)), 6) AS external_load FROM {sessions} s LEFT JOIN (SELECT session_id, sum(claim) / 10 AS own FROM {reservations} GROUP BY 1) r USING (session_id)")
def external_load(spark, d):
    r = view(spark, d, "reservations").withColumn("claim", F.col("claim") / 10)
    s = view(spark, d, "sessions").selectExpr("*", "CASE WHEN session_id % 3 = 0 THEN CAST(ready % 100 AS DOUBLE) WHEN session_id % 3 = 1 THEN CAST('NaN' AS DOUBLE) END AS busy_percent", "slots AS logical_cpus")
    return _r(hosts.external_load(s, r), "external_load")


@query("""
    WITH f AS (SELECT plan_id, unit_id, string_agg(pred_id || ':' || kind, ',' ORDER BY pred_id || ':' || kind) AS fr FROM (SELECT DISTINCT * FROM {edges}) GROUP BY 1, 2),
    g AS (SELECT u.plan_id, batch_key, count(*) AS members, count(DISTINCT cwd) AS cwds, count(DISTINCT coalesce(fr, '')) AS frs, bool_or(side_effect) AS eff, bool_or(codegen_assurance <> 'exact_argv') AS inexact, count(DISTINCT retryable) AS re
          FROM {units} u LEFT JOIN f USING (plan_id, unit_id) GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT plan_id, batch_key, members, concat_ws(',', CASE WHEN cwds <> 1 THEN 'MIXED_CWD' END, CASE WHEN frs <> 1 THEN 'MIXED_DEPENDENCY_FRONTIER' END, CASE WHEN re > 1 THEN 'MIXED_RETRY_SEMANTICS' END, CASE WHEN inexact THEN 'NON_EXACT_CODEGEN' END, CASE WHEN eff THEN 'SIDE_EFFECT_BOUNDARY' END) AS blockers FROM g""")
def fusion_groups(spark, d):
    return _text(hosts.fusion_groups(view(spark, d, "units"), hosts.frontier(view(spark, d, "edges"))), "blockers")


@query("""
    WITH g AS (SELECT plan_id, unit_id, 'worker_slot' AS resource, 1.0::DOUBLE AS base, NULL::DOUBLE AS least_units FROM {cost_units} UNION ALL SELECT plan_id, unit_id, 'cpu_core', cores, inner_tokens FROM {cost_units}
        UNION ALL SELECT plan_id, unit_id, 'memory_mb', memory_mb, NULL FROM {cost_units} UNION ALL SELECT plan_id, unit_id, 'accelerator_slot', CASE WHEN profile = 'accelerator' THEN 1.0 END, NULL FROM {cost_units}),
    c AS (SELECT plan_id, unit_id, resource, sum(units) AS claimed FROM {cost_claims} GROUP BY 1, 2, 3),
    x AS (SELECT coalesce(g.plan_id, c.plan_id) AS plan_id, coalesce(g.unit_id, c.unit_id) AS unit_id, coalesce(g.resource, c.resource) AS resource, greatest(coalesce(claimed, base), least_units) AS units
          FROM g FULL JOIN c ON g.plan_id = c.plan_id AND g.unit_id = c.unit_id AND g.resource = c.resource)
    SELECT plan_id, unit_id, resource, round(units, 8) AS units FROM x WHERE units IS NOT NULL""")
def claim_defaults(spark, d):
    return hosts.claims_with_costs(view(spark, d, "cost_claims"), view(spark, d, "cost_units")).withColumn("units", F.round("units", 8))


@query(f"""
    WITH u AS (SELECT plan_id, unit_id, {_DURATION} AS s FROM {{units}}), w AS (SELECT c.plan_id, c.resource, sum(c.units * u.s) AS work FROM {{claims}} c JOIN u ON u.plan_id = c.plan_id AND u.unit_id = c.unit_id GROUP BY 1, 2)
    SELECT w.plan_id, w.resource, round(work / coalesce(k.capacity, 1), 8) AS bound_s FROM w LEFT JOIN {{capacities}} k ON k.plan_id = w.plan_id AND k.resource = w.resource""")
def resource_bounds(spark, d):
    return hosts.resource_bounds(_timed(spark, d), view(spark, d, "claims"), view(spark, d, "capacities"), "s").withColumn("bound_s", F.round("bound_s", 8))


@query("""
    WITH a AS (SELECT session_id FROM {sessions} WHERE ready > 0 OR running > 0), u AS (SELECT 'worker_slot' AS resource, sum(claim) AS used FROM {reservations})
    SELECT c.resource, min(capacity) AS capacity, round(coalesce(max(used), 0), 6) AS used FROM {session_capacities} c JOIN a USING (session_id) LEFT JOIN u ON u.resource = c.resource GROUP BY 1""")
def resource_capacity(spark, d):
    claims = view(spark, d, "reservations").select(F.lit("worker_slot").alias("resource"), F.col("claim").alias("units"))
    return _r(hosts.resource_capacity(view(spark, d, "sessions"), view(spark, d, "session_capacities"), claims), "used")


@query("""
    WITH n AS (SELECT max(ts) AS now_at FROM {events})
    SELECT DISTINCT s.session_id FROM {live_sessions} s JOIN {processes} p ON p.pid = s.pid, n WHERE s.heartbeat_at < n.now_at - INTERVAL 6 HOUR AND (NOT p.alive OR coalesce(s.identity <> p.identity, false))""")
def stale_sessions(spark, d):
    """As of the newest event."""
    now = view(spark, d, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    s = view(spark, d, "live_sessions").withColumn("heartbeat_at", F.col("heartbeat_at").cast("timestamp"))
    return hosts.stale_sessions(s, view(spark, d, "processes"), F.lit(now).cast("timestamp"), 6 * 3600)


@query("""
    SELECT 'category' AS dimension, category AS name, count(*) AS scenarios, sum(len(goals))::BIGINT AS goals FROM {scenarios} GROUP BY 2
    UNION ALL SELECT 'layer', CAST(layer AS VARCHAR), count(*), sum(len(goals))::BIGINT FROM {scenarios} GROUP BY 2
    UNION ALL SELECT 'all', 'all', count(*), sum(len(goals))::BIGINT FROM {scenarios}""")
def catalog_counts(spark, d):
    return hosts.catalog_counts(view(spark, d, "scenarios"))


@query("""
    SELECT s.project, s.scenario FROM {gate_scored} s LEFT JOIN {gate_requirements} r ON r.scenario = s.scenario
    WHERE (coalesce(hint_overrides, true) AND hinted) OR (sources >= coalesce(min_sources, 0) AND file_hits >= coalesce(min_file_hits, 0) AND content_hits >= coalesce(min_content_hits, 0)
        AND project_files >= coalesce(min_project_files, 0) AND (coalesce(len(any_globs), 0) = 0 OR list_has_any(globs_hit, any_globs)))""")
def requirement_gate(spark, d):
    return hosts.requirement_gate(view(spark, d, "gate_scored"), view(spark, d, "gate_requirements")).select("project", "scenario")


# the same water level by bisection-free SQL: the first member, by headroom per weight, that covers the rest
@query("""
    WITH b AS (SELECT *, CASE WHEN weight > 0 THEN greatest(0, cap - floor_units) ELSE 0 END AS h FROM {shares}),
    r AS (SELECT *, h / weight AS k, sum(floor_units) OVER (PARTITION BY grp) AS fl, sum(weight) OVER (PARTITION BY grp) AS wa, sum(h) OVER w AS hs, sum(weight) OVER w AS ws FROM b WINDOW w AS (PARTITION BY grp ORDER BY h / weight, member ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT grp, arg_min((greatest(0, total - fl) - (hs - h)) / (wa - (ws - weight)), k) AS lv FROM r WHERE hs + k * (wa - ws) >= greatest(0, total - fl) GROUP BY 1)
    SELECT r.grp, r.member, round(CASE WHEN fl > total THEN floor_units * total / fl WHEN lv IS NULL THEN floor_units + h ELSE floor_units + least(h, lv * weight) END, 5) AS share FROM r LEFT JOIN l ON r.grp = l.grp""")
def weighted_share(spark, d):
    return hosts.weighted_share(view(spark, d, "shares")).withColumn("share", F.round("share", 5))


_DETECTORS = [("rings", "ECONOMY", "ring$"), ("rings", "STANDARD", "rings?"), ("reds", "ECONOMY", "^red "), ("reds", "PROMO", "RED"), ("any", "PROMO", ".*"), ("steel", "STANDARD", "steel|cold"), ("steel", "ECONOMY", "(blue|small) w.dget"), ("none", "SMALL", "zzz")]


@query(f"""
    WITH d(scenario, source, pattern) AS (VALUES {", ".join(map(repr, _DETECTORS))}),
    x AS (SELECT DISTINCT p_brand AS project, scenario, source, p_name AS value FROM {{part}} JOIN d ON source = p_type AND regexp_matches(p_name, pattern, 'i'))
    SELECT project, scenario, source, value FROM (SELECT *, row_number() OVER (PARTITION BY project, scenario, source ORDER BY value) AS r FROM x) y WHERE r <= 5""")
def detector_hits(spark, d):
    e = view(spark, d, "part").selectExpr("p_brand AS project", "p_type AS source", "p_name AS value")
    return hosts.detector_hits(e, spark.createDataFrame(_DETECTORS, "scenario string, source string, pattern string"))


_WEIGHTS = {"1": 0.16, "2": 0.18, "3": 0.20, "4": 0.20, "5": 0.22}


@query("""
    WITH s AS (SELECT project, sum(CASE source WHEN '1' THEN 0.16 WHEN '2' THEN 0.18 WHEN '5' THEN 0.22 ELSE 0.20 END::DOUBLE + least(0.06, 0.03 * (hits - 1))::DOUBLE) AS x, count(DISTINCT source) AS sources FROM {hits} GROUP BY 1),
    t AS (SELECT project, sources, round(least(0.99, x + CASE WHEN sources >= 3 THEN 0.08 ELSE 0 END), 6) AS score FROM s)
    SELECT project, sources, score, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'exploratory' END AS label FROM t""")
def evidence_score(spark, d):
    return _r(hosts.evidence_score(view(spark, d, "hits"), _WEIGHTS), "score")


@query("SELECT strftime(time_bucket(INTERVAL 5 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) AS n FROM {events} GROUP BY 1")
def capacity_windows(spark, d):
    out = hosts.capacity_windows(view(spark, d, "events"))
    return _r(out, "least", "most").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
