import random
import re

from pyspark.sql import functions as F

from weftline.operators import chains, conflicts, evidence, graph, history, hosts, rules, runs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_effect_modes_do_not_collapse(spark):
    e = spark.createDataFrame([("p", 1, "fs", "k", "append", False), ("p", 1, "fs", "k", "read", False), ("p", 2, "fs", "k", "read", False)], "plan_id string, unit_id long, domain string, key string, mode string, commutative boolean")
    assert rows(conflicts.effect_conflicts(e), "first", "second") == [(1, 2)]


def test_commutative_appends_are_free(spark):
    a = spark.createDataFrame([("p", 1, "r", "append", True), ("p", 2, "r", "append", True), ("p", 3, "r", "append", False)], "plan_id string, unit_id long, resource string, mode string, commutative boolean")
    assert rows(conflicts.access_conflicts(a), "first", "second") == [(1, 3), (2, 3)]


def test_skip_cascade_runs_down_a_chain(spark):
    u = spark.createDataFrame([("p", "a", "failed"), ("p", "b", "pending"), ("p", "c", "pending"), ("p", "d", "pending")], "plan_id string, unit_id string, status string")
    e = spark.createDataFrame([("p", "b", "a", "success"), ("p", "c", "b", "data"), ("p", "d", "b", "failure")], "plan_id string, unit_id string, pred_id string, kind string")
    assert rows(graph.skip_cascade(u, e), "unit_id", "status") == [("a", "failed"), ("b", "skipped"), ("c", "skipped"), ("d", "pending")]


def test_levels_and_cycles(spark):
    u = spark.createDataFrame([("p", i) for i in range(6)], "plan_id string, unit_id long")
    e = spark.createDataFrame([("p", 1, 0), ("p", 2, 1), ("p", 3, 4), ("p", 4, 3), ("p", 5, 4)], "plan_id string, unit_id long, pred_id long")
    assert [(r["unit_id"], r["level"]) for r in graph.levels(u, e).orderBy("unit_id").collect()] == [(0, 0), (1, 1), (2, 2), (3, None), (4, None), (5, None)]
    closure = graph.ancestors(e)
    assert (3, 3) in rows(closure, "unit_id", "ancestor")
    assert rows(graph.cyclic_edges(closure, e), "unit_id", "pred_id") == [(3, 4), (4, 3)]


def test_touching_intervals_do_not_overlap(spark):
    t = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 5.0), (2, 0.0, 5.0), (2, 4.0, 5.0)], "run_id long, s double, d double")
    assert rows(runs.peak_overlap(t, ["run_id"], "s", "d"), "run_id", "peak") == [(1, 1), (2, 2)]


def test_carry_forward_twice(spark):
    g = spark.createDataFrame([("c", 1, 5), ("c", 2, None), ("c", 3, None), ("c", 4, 7)], "counter string, captured_on int, n int")
    out = [tuple(r) for r in history.carry_forward(g).orderBy("captured_on").collect()]
    assert out == [("c", 1, 5, None, 1), ("c", 2, 5, 1, 1), ("c", 3, 5, 2, 1), ("c", 4, 7, None, 4)]


def test_quarantine(spark):
    q = rules.quarantine(F.col("v"), 0, 10)
    got = spark.createDataFrame([("1",), ("1.0",), ("true",), ("NaN",), ("11",), ("x",), (None,)], "v string").select(q["number"].alias("n"), q["reason"].alias("r")).collect()
    assert [tuple(x) for x in got] == [(1.0, None), (1.0, None), (None, "boolean"), (None, "not_finite"), (None, "out_of_bounds"), (None, "not_a_number"), (None, "null")]


def test_requests_in_two_languages(spark):
    texts = ["hello there", "run the tests", "run the tests in parallel", "请运行测试", "并行运行全部测试", "build every package, it takes hours"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rules.request_class(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == ["direct", "inspect", "candidate", "inspect", "candidate", "candidate"]


def test_inner_workers(spark):
    argvs = [["make", "-j4"], ["/usr/bin/pytest", "-n", "8"], ["jest", "--maxWorkers=2"], ["ninja"], ["echo", "-j4"], ["make", "-j", "0"]]
    got = spark.createDataFrame([(a,) for a in argvs], "a array<string>").select(rules.inner_workers(F.col("a")).alias("w")).collect()
    assert [tuple(r["w"]) for r in got] == [("bounded", 4), ("bounded", 8), ("bounded", 2), ("native_scheduler", None), ("unknown", None), ("native_scheduler", None)]


def test_paths_and_globs(spark):
    got = spark.createDataFrame([("/A//b/./../C",), ("/../x",)], "p string").select(rules.normal_path(F.col("p")).alias("n")).collect()
    assert [r["n"] for r in got] == ["/a/c", "/x"]
    import re

    assert re.match(rules.glob_regex("**/x.py"), "x.py") and re.match(rules.glob_regex("**/x.py"), "a/b/X.py") and not re.match(rules.glob_regex("*.py"), "x.pyc")


def test_traits_and_tools(spark):
    t = rules.command_traits(F.col("c"))
    got = spark.createDataFrame([("git commit -m x",), ("ls",), ("npm install",)], "c string").select(t["side_effect"].alias("s"), t["resources"].alias("r")).collect()
    assert [(r["s"], r["r"]) for r in got] == [(True, ["git:index", "git:refs"]), (False, []), (True, ["dependencies"])]
    names = rules.tool_names(F.lit("custom_tool_call"), F.lit("exec"), F.lit(None).cast("string"), F.lit("tools.read(1); tools.write (2)"))
    assert spark.range(1).select(names.alias("n")).first()["n"] == ["read", "write"]


def refill(total, members):
    """Weighted allocation, refilled round by round."""
    share = {m: f for m, (w, f, c) in members.items()}
    s = sum(share.values())
    if s > total:
        return {m: f * total / s for m, f in share.items()}
    left, open_ = total - s, {m for m, (w, f, c) in members.items() if w > 0 and c > f}
    while left > 1e-12 and open_:
        ws, given = sum(members[m][0] for m in open_), 0.0
        for m in list(open_):
            w, _, c = members[m]
            add = min(left * w / ws, c - share[m])
            share[m] += add
            given += add
            if c - share[m] < 1e-12:
                open_.discard(m)
        left -= given
    return share


def test_weighted_share_equals_refilling(spark):
    r = random.Random(3)
    groups = {g: (r.uniform(0, 40), {m: (r.choice([0.0, 1.0, 2.0, 5.0]), r.uniform(0, 3), r.uniform(0, 9)) for m in range(r.randint(1, 8))}) for g in range(60)}
    data = [(g, m, w, f, c, t) for g, (t, ms) in groups.items() for m, (w, f, c) in ms.items()]
    got = hosts.weighted_share(spark.createDataFrame(data, "grp long, member long, weight double, floor_units double, cap double, total double")).collect()
    for x in got:
        t, ms = groups[x["grp"]]
        assert abs(refill(t, ms)[x["member"]] - x["share"]) < 1e-6


def test_order_of_rows_does_not_matter(spark):
    c = spark.createDataFrame([("s", "c", f"t{i}", "f", i) for i in range(20)], "suite string, classname string, name string, file string, line int")
    a, b = (evidence.case_fingerprint(x, ["suite"]).first()["fingerprint"] for x in (c, c.orderBy(F.desc("line")).repartition(3)))
    assert a == b


def test_same_shape_and_old_ledger(spark):
    a = spark.createDataFrame([("k", ["x", "1"]), ("k", ["x", "2"]), ("j", ["x"]), ("j", ["y", "z"])], "k string, argv array<string>")
    assert rows(hosts.same_shape(a, ["k"]), "k", "same_shape") == [("j", False), ("k", True)]
    old = spark.createDataFrame([(1, "measured"), (2, "measured")], "version int, provenance string")
    assert sorted(r["provenance"] for r in runs.from_old_ledger(old).collect()) == ["legacy", "measured"]


def test_evidence_of_old_commits(spark):
    closure = spark.createDataFrame([("h", "m"), ("h", "b"), ("m", "b")], "commit string, ancestor string")
    changes = spark.createDataFrame([("h", "docs/a"), ("m", "src/x")], "commit string, path string")
    r = spark.createDataFrame([(1, "h"), (2, "m"), (3, "b"), (4, "z")], "run_id int, commit string")
    assert rows(evidence.evidence_still_valid(r, closure, changes, "h"), "run_id", "valid") == [(1, True), (2, True), (3, False), (4, False)]


def test_data_flow_of_nested_files(spark):
    s = "plan_id string, unit_id long, resource string, mode string, commutative boolean"
    a = [
        ("edge", 1, "/o/a", "create"), ("edge", 2, "/o", "read"),
        ("back", 1, "/o", "read"), ("back", 2, "/o/a", "create"),
        ("both", 1, "/a", "create"), ("both", 2, "/a", "read"), ("both", 2, "/b", "create"), ("both", 1, "/b", "snapshot"),
        ("many", 1, "/a", "create"), ("many", 2, "/a", "create"), ("many", 3, "/a", "read"),
        ("name", 1, "/ab", "create"), ("name", 2, "/a", "read"),
    ]
    acc = spark.createDataFrame([(*x, False) for x in a], s)
    closure = spark.createDataFrame([("back", 2, 1), ("many", 3, 1)], "plan_id string, unit_id long, ancestor long")
    got = rows(conflicts.data_flow(acc, closure), "plan_id", "code", "first", "second")
    assert got == [
        ("back", "CONTRADICTORY_DATA_ORDER", 2, 1),
        ("both", "BIDIRECTIONAL_DATA_FLOW", 1, 2),
        ("edge", "DATA_EDGE", 1, 2),
        ("many", "UNORDERED_ARTIFACT_CONFLICT", 1, 2),
        ("many", "UNORDERED_ARTIFACT_CONFLICT", 2, 3),
    ]


def test_fingerprint_counts_repeats_but_not_order(spark):
    r = [("p", "unit", i, "read") for i in range(500)]
    df = spark.createDataFrame(r + [("q", *x[1:]) for x in r] + [("q", "unit", 7, "read")], "plan_id string, part string, a long, t string")
    one, two = ({x["plan_id"]: x["fingerprint"] for x in evidence.fingerprint(d, "plan_id", ["part", "a", "t"]).collect()} for d in (df, df.orderBy(F.desc("a")).repartition(5)))
    assert one == two and one["p"] != one["q"] and len(one["p"]) == 64


def test_claims_from_costs(spark):
    u = spark.createDataFrame([("p", 1, 2.0, None, "cpu", 8.0), ("p", 2, None, 64.0, "accelerator", None)], "plan_id string, unit_id int, cores double, memory_mb double, profile string, inner_tokens double")
    c = spark.createDataFrame([("p", 1, "cpu_core", 3.0), ("p", 1, "cpu_core", 1.0), ("p", 2, "worker_slot", 2.0), ("p", 2, "disk", 1.0)], "plan_id string, unit_id int, resource string, units double")
    assert rows(hosts.claims_with_costs(c, u), "unit_id", "resource", "units") == [(1, "cpu_core", 8.0), (1, "worker_slot", 1.0), (2, "accelerator_slot", 1.0), (2, "disk", 1.0), (2, "memory_mb", 64.0), (2, "worker_slot", 2.0)]


def test_stale_needs_proof(spark):
    s = spark.createDataFrame([("a", 1, "x", 0.0), ("b", 2, "x", 0.0), ("c", 3, "x", 0.0), ("d", 4, None, 0.0), ("e", 5, "x", 90.0)], "session_id string, pid int, identity string, heartbeat_at double")
    p = spark.createDataFrame([(1, False, None), (2, True, "y"), (3, True, "x"), (4, True, "y"), (5, False, None)], "pid int, alive boolean, identity string")
    assert rows(hosts.stale_sessions(s, p, F.lit(100.0)), "session_id") == [("a",), ("b",)]


def test_requirements_may_be_absent_or_overridden(spark):
    scored = spark.createDataFrame([("p", "none", 1, False, []), ("p", "few", 1, False, []), ("q", "few", 1, True, []), ("q", "strict", 1, True, []), ("r", "glob", 3, False, ["b"]), ("s", "glob", 3, False, [])], "project string, scenario string, sources int, hinted boolean, globs_hit array<string>")
    need = spark.createDataFrame([("few", 2, None, None), ("strict", 2, None, False), ("glob", None, ["a", "b"], None)], "scenario string, min_sources int, any_globs array<string>, hint_overrides boolean")
    assert rows(hosts.requirement_gate(scored, need), "project", "scenario") == [("p", "none"), ("q", "few"), ("r", "glob")]


def test_evidence_with_nulls_does_not_pass(spark):
    stored = spark.createDataFrame([(1, 2.0, 4.0, 2.0, 1.0, 2.0, 50.0, 1.0, 2), (2, 0.0, 4.0, 4.0, 1.0, None, 100.0, None, 2)], "run_id int, wall_s double, serial_s double, saved_s double, minimum_s double, speedup double, percent double, efficiency double, peak int")
    tasks = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 1.0), (2, 3.0)], "run_id int, worker_s double")
    assert rows(runs.evidence_errors(stored, tasks), "run_id", "wrong") == [(2, ["bounds", "speedup", "efficiency"])]
    summary = spark.createDataFrame([(1, 1, 1, 1, True, True, 2, 2, 0, "h"), (2, 1, 1, 1, None, True, 2, 2, 0, "h"), (3, 1, 1, 1, True, True, 2, 2, 0, "h")], "run_id int, suite_id int, workers int, snapshots int, declared boolean, covered boolean, tests int, passed int, skipped int, case_set string")
    results = spark.createDataFrame([(1, 1, "succeeded"), (2, 1, "succeeded"), (3, 1, "succeeded"), (3, 2, "succeeded")], "run_id int, suite_id int, status string")
    r = spark.createDataFrame([(i, 0, 1) for i in (1, 2, 3, 4)], "run_id int, native_pools int, peak int")
    assert rows(evidence.serial_baselines(r, summary, results), "run_id", "eligible") == [(1, True), (2, False), (3, False), (4, False)]


def test_views_are_dealt_by_the_size_of_files(spark, monkeypatch):
    from weftline.plans import views

    monkeypatch.setattr(views, "PART_BYTES", 8_000)
    for name in ("accesses", "claims", "task_results"):
        assert views.view(spark, "/root/testdata/sf0.001", name).select(F.spark_partition_id()).distinct().count() > 8


def test_pairs_are_joined_in_parts_that_grow_with_the_files(spark, monkeypatch):
    from weftline.operators import store
    from weftline.plans import catalog

    monkeypatch.setattr(store, "PART_BYTES", 1 << 15)
    for name in ("access_conflicts", "effect_conflicts", "conflict_classes", "unit_conflict_reasons", "nested_conflicts"):
        # the session has four shuffle partitions
        assert catalog.queries()[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 20, name


def test_pairs_of_one_path_lie_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "PIECE", 10, raising=False)
    data = [(f"s{i}", 1, "/a/b") for i in range(40)] + [(f"c{i}", 1, f"/a/b/m/{i}") for i in range(100)] + [("lone", 2, "x"), (None, None, None)]
    paths = spark.createDataFrame(data, "owner string, plan_id long, path string")
    got = conflicts.path_overlaps(paths).withColumn("part", F.spark_partition_id()).collect()
    under = [(p, o, q) for o, p, x in data[:-1] for q, r, y in data[:-1] if p == r and o != q and ((x == y and o < q) or y.startswith(x + "/"))]
    assert sorted((r["plan_id"], r["ancestor"], r["descendant"]) for r in got) == sorted(under) and len(got) == 4780
    most = max(sum(r["part"] == p for r in got) for p in {r["part"] for r in got})
    assert most < len(got) / 4


def folder_accesses(seed):
    """Accesses of three plans of few rows and one of many, with folders, repeats and nulls."""
    r = random.Random(seed)
    path = lambda: "/" + "/".join(r.choice("ab") for _ in range(r.randint(1, 3))) if r.random() < 0.95 else r.choice(["a", "/", "/ab", None])
    modes = ["read", "snapshot", "create", "overwrite", "append"]
    return [(p, r.randint(1, 12), path(), r.choice(modes), r.random() < 0.5) for p, n in (("p", 12), ("q", 20), ("r", 2), ("many", 90)) for _ in range(n)]


ACCESS = "plan_id string, unit_id long, resource string, mode string, commutative boolean"


def nested_and_harmful(a, b):
    """Of two rows (plan_id, unit_id, resource, mode, commutative)."""
    if a[0] != b[0] or a[1] == b[1] or a[2] is None or b[2] is None or not (a[2] == b[2] or a[2].startswith(b[2] + "/") or b[2].startswith(a[2] + "/")):
        return False
    return not (a[3] in ("read", "snapshot") and b[3] in ("read", "snapshot")) and not (a[3] == b[3] == "append" and a[4] and b[4])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_nested_pairs_are_made_where_the_rows_of_a_plan_lie(spark, monkeypatch):
    data = folder_accesses(1)
    want = sorted({(a[0], a[1], b[1], a[2], b[2]) for a in data for b in data if a[1] < b[1] and nested_and_harmful(a, b)})
    acc = spark.createDataFrame(data + [(None, 1, "/a", "create", False), ("p", None, "/a", "create", False)], ACCESS)
    # rows are shuffled by plan and nothing after
    assert exchanges(conflicts.nested_conflicts(acc)) == 1
    for near in (512, 30, 1):
        monkeypatch.setattr(conflicts, "NEAR", near)
        assert sorted(map(tuple, conflicts.nested_conflicts(acc).collect())) == want, near


def test_reasons_of_a_plan_are_found_where_its_rows_lie(spark, monkeypatch):
    data = folder_accesses(2) + [("p", 77, None, "read", False)]
    held = [("p", 1, "l"), ("p", 2, "l"), ("p", 30, "l"), ("q", 5, "l"), ("q", 6, "m"), ("many", 1, "l"), ("many", 9, "l"), ("s", 1, "l"), ("s", 2, "l"), ("s", 3, None)]
    alone = [("p", 3), ("p", 77), ("p", 99), ("q", 1), ("many", 4), ("s", 1), (None, 2)]
    units = {(a[0], a[1]) for a in data}
    acc, ex, serial = spark.createDataFrame(data, ACCESS), spark.createDataFrame(held, "plan_id string, unit_id long, resource string"), spark.createDataFrame(alone, "plan_id string, unit_id long")
    # rows are shuffled by plan and nothing after
    assert exchanges(conflicts.unit_conflict_reasons(acc, ex, serial, nested=True)) == 1
    write = lambda mode: mode not in ("read", "snapshot")
    for nested in (True, False):
        want = {}
        add = lambda p, a, b, why: want.setdefault((p, min(a, b), max(a, b)), set()).add(why)
        for a in data:
            for b in data:
                if a[1] < b[1] and (write(a[3]) or write(b[3])) and nested_and_harmful((*a[:3], "create", False), (*b[:3], "create", False)) and (nested or a[2] == b[2]):
                    add(a[0], a[1], b[1], "write-write" if write(a[3]) and write(b[3]) else "write-read" if write(a[3]) else "read-write")
        for p, u, r in held:
            for q, v, t in held:
                if p == q and u < v and r == t and r is not None:
                    add(p, u, v, "exclusive-resource")
        for p, u in alone:
            for q, v in units:
                if p == q and u != v and (p, u) in units:
                    add(p, u, v, "forced-serial")
        for near in (512, 30, 1):
            monkeypatch.setattr(conflicts, "NEAR", near)
            got = conflicts.unit_conflict_reasons(acc, ex, serial, nested=nested).collect()
            assert len(got) == len(want) and {(r["plan_id"], r["first"], r["second"]): set(r["reasons"]) for r in got} == want, (nested, near)


def test_flow_of_a_plan_is_found_where_its_rows_lie(spark, monkeypatch):
    data = folder_accesses(3) + [("s", u, "/a", m, False) for u, m in ((1, "create"), (2, "read"), (3, "read"), (4, "snapshot"))]
    acc = spark.createDataFrame(data, ACCESS)
    # s: a cycle of three; p: more links than a small plan has
    links = [("s", 2, 1), ("s", 1, 3), ("s", 3, 2), ("q", 7, 3), ("q", 3, 1), ("r", None, 1)] + [("p", u, u - 1) for u in range(2, 12)]
    edges = spark.createDataFrame(links, "plan_id string, unit_id long, pred_id long")
    above = {(p, u): far_above(links, p, u) for p, u in {(a[0], a[1]) for a in data}}
    want = flow_by_hand(data, lambda p, u, a: a in above[p, u])
    # rows, links and what they lead to are shuffled by plan, no pairs
    keys = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", conflicts.data_flow(acc, edges)._jdf.queryExecution().executedPlan().toString())
    assert len(keys) == 3 and all(re.fullmatch(r"plan_id#\d+", k) for k in keys)
    for near, small in ((512, 64), (30, 64), (512, 8), (1, 8)):
        monkeypatch.setattr(conflicts, "NEAR", near)
        monkeypatch.setattr(chains, "SMALL", small)
        assert sorted(map(tuple, conflicts.data_flow(acc, edges).collect())) == want, (near, small)


def far_above(links, plan, unit):
    seen, fresh = set(), {unit}
    while fresh:
        fresh = {a for p, u, a in links if p == plan and u in fresh} - seen
        seen |= fresh
    return seen


def flow_by_hand(data, follows):
    makers, pairs, out = {}, {}, []
    for p, u, r, m, _ in data:
        if m == "create":
            makers.setdefault((p, r), set()).add(u)
    sole = lambda a: a[3] == "create" and len(makers[a[0], a[2]]) == 1
    read = lambda a: a[3] in ("read", "snapshot")
    for a in data:
        for b in data:
            if a[1] < b[1] and nested_and_harmful(a, b):
                ahead, behind, clash = pairs.setdefault((a[0], a[1], b[1]), (set(), set(), set()))
                if sole(a) and read(b):
                    ahead.add(a[2])
                elif sole(b) and read(a):
                    behind.add(b[2])
                else:
                    clash.add(f"{a[3]}/{b[3]} on {a[2]} and {b[2]}")
    for (p, x, y), (ahead, behind, clash) in pairs.items():
        after, before = follows(p, y, x), follows(p, x, y)
        if ahead and behind:
            out.append((p, "BIDIRECTIONAL_DATA_FLOW", x, y, ",".join(sorted(ahead | behind))))
        elif not clash:
            a, b, items, against, along = (x, y, ahead, before, after) if ahead else (y, x, behind, after, before)
            if against or not along:
                out.append((p, "CONTRADICTORY_DATA_ORDER" if against else "DATA_EDGE", a, b, ",".join(sorted(items))))
        if clash and not after and not before:
            out.append((p, "UNORDERED_ARTIFACT_CONFLICT", x, y, "; ".join(sorted(clash))))
    return sorted(out)
