"""Chains, components, reachability and levels against plain searches; long chains and rings in few rounds."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import chains, conflicts, evidence, graph, rules


def closure(links):
    """All (unit, ancestor) pairs of a plan."""
    after = defaultdict(set)
    for u, p in links:
        after[u].add(p)
    out = set()
    for u in list(after):
        todo, seen = list(after[u]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out |= {(u, x) for x in seen}
    return out


@pytest.fixture(scope="module")
def plans():
    """Random plans: sparse ones with chains, dense ones, with and without cycles, rings and loops."""
    rng, out = random.Random(21), {}
    for p in range(28):
        n = rng.randint(1, 14)
        links = {(i, i - 1) for i in range(1, n) if rng.random() < 0.7}
        for _ in range(rng.choice([0, 1, 2, n])):
            a, b = rng.randrange(n), rng.randrange(n)
            if p % 3 or a > b:
                links.add((a, b))
        if p % 5 == 0:
            links |= {(100 + i, 100 + (i + 1) % 5) for i in range(5)}
        out[p] = (sorted({x for link in links for x in link} | set(range(n))), sorted(links))
    return out


@pytest.fixture(scope="module")
def tables(spark, plans):
    units = spark.createDataFrame([(p, u, float(u % 4)) for p, (units, _) in plans.items() for u in units], "plan_id int, unit_id int, duration_s double")
    edges = spark.createDataFrame([(p, u, b, "success") for p, (_, links) in plans.items() for u, b in links], "plan_id int, unit_id int, pred_id int, kind string")
    return units, edges


def test_components(tables, plans):
    got = {(r["plan_id"], r["unit_id"]): r["component"] for r in chains.components(chains.links_of(tables[1])).collect()}
    for p, (units, links) in plans.items():
        far = closure(links)
        for a in units:
            assert ((a, a) in far) == ((p, a) in got)
            for b in units:
                if (a, a) in far and (b, b) in far:
                    assert ((a, b) in far and (b, a) in far) == (got[p, a] == got[p, b]), (p, a, b)


def test_cyclic_edges(tables, plans):
    edges = tables[1]
    old, new = edges.where("(unit_id + pred_id) % 2 = 0"), edges.where("(unit_id + pred_id) % 2 = 1")
    got = {(r["plan_id"], r["unit_id"], r["pred_id"]) for r in graph.cyclic_edges(old, new).collect()}
    assert got == {(p, u, b) for p, (_, links) in plans.items() for far in [closure(links)] for u, b in links if (u + b) % 2 and (b, u) in far}


def test_order_of_all_pairs(spark, tables, plans):
    pairs = [(p, a, b) for p, (units, _) in plans.items() for a in [*units, 999] for b in units if a != b]
    got = {(r["plan_id"], r["first"], r["second"]): (r["forward"], r["backward"]) for r in chains.order_of(spark.createDataFrame(pairs, "plan_id int, first int, second int"), chains.links_of(tables[1])).collect()}
    far = {p: closure(links) for p, (_, links) in plans.items()}
    assert got == {(p, a, b): ((b, a) in far[p], (a, b) in far[p]) for p, a, b in pairs}


def test_reachable(spark, tables, plans):
    rng = random.Random(2)
    seeds = [(p, rng.choice([*units, 77])) for p, (units, _) in plans.items() for _ in range(2) if p % 4]
    got = {(r["plan_id"], r["unit_id"]) for r in graph.with_descendants(spark.createDataFrame(seeds, "plan_id int, unit_id int"), tables[1]).collect()}
    far = {p: closure(links) for p, (_, links) in plans.items()}
    assert got == set(seeds) | {(p, u) for p, s in seeds for u, a in far[p] if a == s}


def test_levels_and_paths(tables, plans):
    units, edges = tables
    level = {(r["plan_id"], r["unit_id"]): r["level"] for r in graph.levels(units, edges).collect()}
    path = {(r["plan_id"], r["unit_id"]): r["path_s"] for r in graph.longest_path(units, edges).collect()}
    for p, (nodes, links) in plans.items():
        far = closure(links)
        cyclic = {a for a, b in far if a == b}
        before, after = defaultdict(list), defaultdict(list)
        for u, b in links:
            before[u].append(b)
            after[b].append(u)

        def longest(u, way, own):
            return own(u) + max((longest(x, way, own) for x in way[u]), default=0)

        for u in nodes:
            below = u in cyclic or any(a == u and b in cyclic for a, b in far)
            assert level[p, u] == (None if below else longest(u, before, lambda x: 1) - 1)
            above = u in cyclic or any(b == u and a in cyclic for a, b in far)
            assert path[p, u] == (None if above else longest(u, after, lambda x: float(x % 4)))


def rounds(monkeypatch):
    seen, cut, counting = [], chains.cut, chains.cut_counting
    monkeypatch.setattr(chains, "cut", lambda df: seen.append(1) or cut(df))
    monkeypatch.setattr(chains, "cut_counting", lambda *x: seen.append(1) or counting(*x))
    return seen


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    n = 100_000
    units = spark.range(n).select(F.lit(1).alias("plan_id"), F.col("id").alias("unit_id"), F.lit(1.0).alias("duration_s"))
    edges = units.where("unit_id > 0").select("plan_id", "unit_id", (F.col("unit_id") - 1).alias("pred_id"), F.lit("success").alias("kind"))
    seen = rounds(monkeypatch)
    assert graph.levels(units, edges).agg(F.max("level"), F.sum((F.col("level") == F.col("unit_id")).cast("int"))).first()[:] == (n - 1, n)
    assert len(seen) < 40
    status = units.withColumn("status", F.when(F.col("unit_id") == 5, "failed").otherwise("pending"))
    del seen[:]
    assert graph.skip_cascade(status, edges).where("status = 'skipped'").count() == n - 6 and len(seen) < 40


def test_a_long_ring_in_few_rounds(spark, monkeypatch):
    n = 100_000
    edges = spark.range(n).select(F.lit(1).alias("plan_id"), F.col("id").alias("unit_id"), ((F.col("id") + 1) % n).alias("pred_id"))
    seen = rounds(monkeypatch)
    assert chains.components(chains.links_of(edges)).groupBy("component").count().collect()[0][:] == (0, n) and len(seen) < 40
    # with a way in and a way out it is no plain ring any more
    more = edges.unionByName(spark.createDataFrame([(1, 7, 200_000), (1, 300_000, 9)], "plan_id int, unit_id long, pred_id long"))
    del seen[:]
    assert chains.components(chains.links_of(more)).groupBy("component").count().collect()[0]["count"] == n and len(seen) < 80


def test_order_in_a_long_chain(spark):
    n = 20_000
    edges = spark.range(1, n).select(F.lit(1).alias("plan_id"), F.col("id").alias("unit_id"), (F.col("id") - 1).alias("pred_id"))
    pairs = spark.createDataFrame([(1, 5, 19_000), (1, 300, 2), (1, 4, 50_000)], "plan_id int, first long, second long")
    got = {r["first"]: (r["forward"], r["backward"]) for r in chains.order_of(pairs, chains.links_of(edges)).collect()}
    assert got == {5: (True, False), 300: (False, True), 4: (False, False)}


def test_a_long_history_of_commits(spark):
    n = 100_000
    parents = spark.range(n - 1).select(F.format_string("c%d", F.col("id") + 1).alias("commit"), F.format_string("c%d", "id").alias("parent"))
    changes = spark.createDataFrame([("c99999", "docs/a"), ("c50000", "src/x"), ("c70000", "docs/b")], "commit string, path string")
    runs = spark.createDataFrame([(1, "c99999"), (2, "c99998"), (3, "c50000"), (4, "c49999"), (5, "c0"), (6, "zz"), (7, None)], "run_id int, commit string")
    got = {r["run_id"]: r["valid"] for r in evidence.evidence_still_valid(runs, parents, changes, "c99999").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_a_branch_with_other_changes(spark):
    parents = spark.createDataFrame([("h", "l"), ("h", "r"), ("l", "b"), ("r", "b"), ("b", "a")], "commit string, parent string")
    runs = spark.createDataFrame([(i, c) for i, c in enumerate("hlrba")], "run_id int, commit string")
    valid = lambda *rows: [r["valid"] for r in evidence.evidence_still_valid(runs, parents, spark.createDataFrame(rows, "commit string, path string"), "h").orderBy("run_id").collect()]
    assert valid(("h", "docs/1"), ("l", "src/1")) == [True, True, True, False, False]
    # where nothing was changed there is nothing to compare
    assert valid(("b", "docs/1")) == [True, False, False, False, True]


def test_classes_of_a_resource_with_many_writers(spark):
    n = 100_000
    many = spark.range(n).select(F.lit("p").alias("plan_id"), F.col("id").alias("unit_id"), F.lit("r").alias("resource"), F.when(F.col("id") % 2 == 0, "overwrite").otherwise("append").alias("mode"), F.lit(True).alias("commutative"))
    got = {(r["first_mode"], r["second_mode"]): (r["first_units"], r["second_units"], r["pairs"]) for r in conflicts.conflict_classes(many).collect()}
    h = n // 2
    assert got == {("append", "overwrite"): (h, h, h * h), ("overwrite", "overwrite"): (h, h, h * (h - 1) // 2)}
    assert conflicts.resource_units(many).first()[2:] == (n, n)


def test_class_pairs_are_the_conflicts(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.randrange(9), f"r{rng.randrange(4)}", rng.choice(["read", "snapshot", "create", "overwrite", "append"]), rng.choice([True, False])) for _ in range(150)]
    a = spark.createDataFrame(rows, "plan_id int, unit_id int, resource string, mode string, commutative boolean")
    cols = ["plan_id", "first", "second", "resource", "first_mode", "second_mode"]
    classes = conflicts.conflict_classes(a)
    got = conflicts.class_pairs(classes, a)
    assert classes.agg(F.sum("pairs")).first()[0] == got.count()
    assert sorted(map(tuple, got.select(cols).distinct().collect())) == sorted(map(tuple, conflicts.access_conflicts(a).select(cols).distinct().collect()))


def test_blocks_cover_spans(spark):
    rng = random.Random(4)
    spans = [(rng.randint(-50, 300), rng.randint(0, 400)) for _ in range(200)] + [(0, 0), (5, 4 - 5), (-8, 8)]
    got = spark.createDataFrame([(i, a, a + n) for i, (a, n) in enumerate(spans)], "i int, a long, b long").select("a", "b", evidence.dyadic(F.col("a"), F.col("b")).alias("x")).collect()
    for a, b, blocks in got:
        covered = sorted(v for level, at in blocks for v in range(at << level, (at + 1) << level))
        assert covered == list(range(a, b + 1)) and len(blocks) <= 2 * max(1, b - a + 1).bit_length()


def test_a_span_of_a_million_lines(spark):
    spans = spark.createDataFrame([("f", 1, 1.0, 1_000_000.0), ("f", 2, 10.0, 12.0), ("g", 3, 0.0, 5.0)], "path string, span_id int, first_line double, last_line double")
    spots = spark.createDataFrame([("f", 7, 999_999.5, 3.0), ("f", 8, 12.0, 9.0), ("f", 9, 12.5, 99.0), ("f", 6, 1_000_001.0, 999.0)], "path string, hotspot_id int, line double, wall_s double")
    assert sorted(map(tuple, evidence.hotspot_spans(spans, spots).collect())) == [("f", 1, 9, 99.0), ("f", 2, 8, 9.0)]
    cut = spans.where("span_id = 1").select(F.explode(evidence.dyadic(F.col("first_line").cast("long"), F.col("last_line").cast("long"))))
    assert cut.count() <= 40


def test_spellings_of_a_path_meet(spark):
    rows = [("p", 1, "/Über/a", "create"), ("p", 2, "/ÜBER", "overwrite"), ("p", 3, "/uber", "overwrite"), ("p", 4, "/STRASSE/x", "overwrite"), ("p", 5, "/straße", "overwrite"), ("p", 6, None, "overwrite")]
    a = spark.createDataFrame([(*r, False) for r in rows], "plan_id string, unit_id int, resource string, mode string, commutative boolean")
    met = conflicts.nested_conflicts(a.withColumn("resource", rules.normal_path(F.col("resource"))))
    assert sorted((r["first"], r["second"]) for r in met.collect()) == [(1, 2), (4, 5)]


def test_small_plans_are_closed_whole(spark, monkeypatch):
    """Plans of few links take no rounds: a handful of intermediate tables, however many plans there are."""
    edges = spark.createDataFrame([(p, u, u // 2) for p in range(40) for u in range(2, 9)] + [(p, 1, 4) for p in range(0, 40, 10)], "plan_id int, unit_id int, pred_id int")
    pairs = spark.createDataFrame([(p, a, b) for p in range(40) for a, b in ((1, 8), (3, 8), (6, 3))], "plan_id int, first int, second int")
    made = []
    monkeypatch.setattr(chains, "cut", lambda df, real=chains.cut: made.append(1) or real(df))
    monkeypatch.setattr(chains, "cut_counting", lambda df, which=None, real=chains.cut_counting: made.append(1) or real(df, which))
    got = {(r["plan_id"], r["first"], r["second"]): (r["forward"], r["backward"]) for r in chains.order_of(pairs, edges).collect()}
    assert len(made) <= 3
    for p in range(40):
        assert got[p, 1, 8] == (True, p % 10 == 0) and got[p, 3, 8] == (False, False) or p % 10 == 0
        assert got[p, 6, 3] == (False, True)


def test_ranges_of_a_chain_are_ranked_alone(spark, monkeypatch):
    """Where ids follow the links, what looks further are the entries of ranges: no round carries all units."""
    links = spark.createDataFrame([(0, i + 1, i) for i in range(300)] + [(1, i, (i + 7) % 50) for i in range(50)], "plan_id int, unit_id int, pred_id int")
    carried, real = [], chains._further
    monkeypatch.setattr(chains, "_further", lambda rows, ahead, sums: carried.append(rows.count()) or real(rows, ahead, sums))
    nodes = chains.ends_of(links).withColumn("n", F.lit(1))
    placed = {(r["plan_id"], r["unit_id"]): r for r in chains.contract(nodes, links, ("n",), parts=4).placed.collect()}
    assert all((placed[0, i]["head"], placed[0, i]["hops"], placed[0, i]["n"]) == (0, i, i) for i in range(301))
    assert all((placed[1, i]["head"], placed[1, i]["ring"]) == (None, 0) for i in range(50))
    assert max(c for c in carried[:-1]) <= 60


def test_large_plans_by_chains(spark, tables, plans, monkeypatch):
    monkeypatch.setattr(chains, "SMALL", 8)
    monkeypatch.setattr(chains, "RANGE", 40)
    pairs = [(p, a, b) for p, (units, _) in list(plans.items())[:12] for a in units for b in units]
    got = {(r["plan_id"], r["first"], r["second"]): (r["forward"], r["backward"]) for r in chains.order_of(spark.createDataFrame(pairs, "plan_id int, first int, second int"), chains.links_of(tables[1])).collect()}
    far = {p: closure(links) for p, (_, links) in plans.items()}
    assert got == {(p, a, b): ((b, a) in far[p], (a, b) in far[p]) for p, a, b in pairs}


def test_parts_without_chains(spark):
    """A graph whose links are all branches or joins has no chain to rank: the parts that rank them have no rows."""
    links = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 3, 1), (0, 3, 2), (0, 4, 1), (0, 4, 2)], "plan_id int, unit_id int, pred_id int")
    placed = chains.contract(chains.ends_of(links), links, parts=3).placed.collect()
    assert sorted((r["unit_id"], r["head"], r["hops"]) for r in placed) == [(i, i, 0) for i in range(5)]
