"""Byte ranges, probes of many patterns, plan documents, and operators that no query calls."""

import fnmatch
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, hosts, patterns, rules
from weftline.sources import files, probes, ranges


def test_the_tail_of_a_file_of_five_gigabytes(spark, tmp_path):
    big = tmp_path / "big.log"
    with big.open("wb") as f:
        f.truncate(5 << 30)  # a hole, which takes no disk
        f.seek(5 << 30)
        f.write(b"\nlast but one\nlast \xff line")
    (tmp_path / "small.log").write_text("one\ntwo")
    got = {os.path.basename(r["path"]): (r["text"], r["sampled"]) for r in ranges.tail_sample(spark, str(tmp_path), 24).collect()}
    assert got == {"big.log": ("last � line", 24), "small.log": ("one\ntwo", 7)}
    assert ranges.read_ranges(spark, str(tmp_path), tail=256 * 1024).agg(F.sum(F.octet_length("data"))).first()[0] == 256 * 1024 + 7


def test_blocks_are_the_whole_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    data = {"a": bytes(range(256)) * 5, "sub/b": b"x" * 7, "empty": b""}
    for n, x in data.items():
        (tmp_path / n).write_bytes(x)
    df = ranges.read_ranges(spark, str(tmp_path), block=100)
    assert df.rdd.getNumPartitions() == 14
    parts = {}
    for r in sorted(df.collect(), key=lambda r: (r["path"], r["offset"])):
        parts[os.path.relpath(r["path"], tmp_path)] = parts.get(os.path.relpath(r["path"], tmp_path), b"") + bytes(r["data"])
    assert parts == {n: x for n, x in data.items() if x}
    with pytest.raises(Exception, match="one of tail, head and block"):
        ranges.read_ranges(spark, str(tmp_path), block=1, tail=1).count()
    os.mkdir(tmp_path / "none")
    assert ranges.read_ranges(spark, str(tmp_path / "none"), head=5).count() == 0


def test_head_lines(spark, tmp_path):
    (tmp_path / "a").write_text("\n".join(f"line {i}" for i in range(100)))
    got = ranges.head_lines(spark, str(tmp_path), 3).collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(0, "line 0"), (1, "line 1"), (2, "line 2")]


PATTERNS = [r"import\s+numpy", r"(pytest|unittest)\b", r"^class \w+", r"a.?b", r"[xyz]{3}", r"needs: *\[", r"(?:foo)?bar", r"ſtraße|kelvin", r"x(", r"\d{4}-\d\d", r"end\Z", r"(?i)MAKE", r"qq+rr", r"fo{0}g"]


def test_patterns_are_found_as_one_by_one():
    rng = random.Random(3)
    words = ["import numpy", "PyTest", "unittests", "class A", "a-b", "xyzzy", "needs: [", "bar", "STRASSE", "Kelvin", "Kelvin", "2024-01", "end", "make", "qqqrr", "fg", "fog", "\n", " "]
    known = {i: p for i, p in enumerate(PATTERNS)}
    compiled = {}
    for i, p in known.items():
        try:
            compiled[i] = re.compile(p, re.IGNORECASE | re.MULTILINE)
        except re.error:
            pass
    both = patterns.Patterns(known)
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
        assert both.matching(text) == [i for i, c in compiled.items() if c.search(text)], text
    assert 0 not in both.always and patterns.literals(r"import\s+nump") is not None


def test_files_are_probed_in_one_pass(spark, tmp_path):
    rng = random.Random(7)
    bodies = ["import numpy as np", "def test(): pytest", "class X: pass", "xyz", "bin\0ary import numpy", "", "z" * 600_000 + " import numpy"]
    names = ["a.py", "src/b.py", "src/deep/c.PY", "package.json", "x.min.js", ".env.local", "poetry.lock", "docs/readme.md", "src/Makefile"]
    tree = {}
    for n in names:
        for k in range(3):
            p = f"d{k}/{n}"
            tree[p] = rng.choice(bodies)
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).write_text(tree[p])
    globs = ["**/*.py", "*.py", "**/package.json", "d1/*", "**/[mM]akefile", "*.md", "d?/src/*", "**/a.??"]
    table = [(f"p{i}", rng.choice(globs), rng.choice(PATTERNS)) for i in range(40)] + [("p1", "**/*.md", "xyz"), ("bad", None, "x"), (None, "*", "x")]
    got = sorted((r["probe"], os.path.relpath(r["path"].removeprefix("file:"), tmp_path)) for r in probes.file_hits(spark, str(tmp_path), spark.createDataFrame(table, "probe string, glob string, pattern string"), 3).collect())

    def loop(probe):
        hits = set()
        for name, glob, pattern in table:
            if name != probe or glob is None:
                continue
            try:
                regex = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
            except re.error:
                continue
            for p, text in tree.items():
                low = p.lower()
                skip = low.endswith((".min.js", ".bundle.js", ".map", ".lock")) or os.path.basename(p).startswith(".env") or not 0 < len(text) <= 524_288 or "\0" in text
                path_ok = fnmatch.fnmatchcase(low, glob.lower()) or (glob.startswith("**/") and fnmatch.fnmatchcase(low, glob[3:].lower()))
                if not skip and path_ok and regex.search(text):
                    hits.add(p)
        return sorted(hits)[:3]

    assert got == sorted((n, p) for n in {t[0] for t in table if t[0]} for p in loop(n)) and got


def test_detectors(spark):
    e = [("p", "file", f"src/test_{i}.py") for i in range(8)] + [("p", "tag", "pytest"), ("q", "file", "x.tex"), ("q", "file", None), ("q", "none", "pytest")]
    rules_ = [("tests", "file", r"test_\d"), ("tests", "tag", "pytest|jest"), ("latex", "file", r"\.tex$"), ("bad", "file", "(")]
    got = hosts.detector_hits(spark.createDataFrame(e, "project string, source string, value string"), spark.createDataFrame(rules_, "scenario string, source string, pattern string"))
    assert sorted(map(tuple, got.collect())) == [("p", "tests", "file", f"src/test_{i}.py") for i in range(5)] + [("p", "tests", "tag", "pytest"), ("q", "latex", "file", "x.tex")]


def test_plans_with_semantics_and_broken_documents(spark, tmp_path):
    atoms = [
        {"id": "a", "operation": {"kind": "read", "argv": ["cat"]}, "batch": {"key": "k", "strategy": "argv"}, "assurance": {"parse": "exact", "rank": 2.0, "blockers": ["B"]}},
        {"id": "b", "operation": {"kind": "read"}, "side_effect": True},
        {"id": "c", "operation": {"kind": "build"}, "semantics": {"commutative": True, "cacheable": True, "retryable": False, "reorderable": "proved"}, "cost": {"duration_seconds": 2.5}},
    ]
    (tmp_path / "p.json").write_text(json.dumps({"plan_id": "p", "atoms": atoms, "snapshots": [{"path": "/x", "sha256": "ab", "size_bytes": 3}]}, indent=1))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "worse.json").write_text("[1, ")
    t = files.read_plans(spark, str(tmp_path))
    u = {r["unit_id"]: r for r in t["units"].collect()}
    assert [(u[i]["idempotent"], u[i]["retryable"], u[i]["cacheable"], u[i]["commutative"], u[i]["reorderable"]) for i in "abc"] == [(True, True, True, False, "unknown"), (None, None, False, False, "unknown"), (None, False, True, True, "proved")]
    assert (u["a"]["batch_key"], u["a"]["parse_assurance"], u["a"]["control_assurance"], u["a"]["blockers"], u["b"]["blockers"], u["c"]["duration_s"]) == ("k", "exact", "unknown", ["B"], [], 2.5)
    assert [tuple(r) for r in t["snapshots"].collect()] == [("p", "/x", "ab", 3)]
    assert sorted(os.path.basename(r["file"]) for r in t["broken"].collect()) == ["bad.json", "worse.json"]
    # what was read feeds the operators
    f = hosts.fusion_groups(t["units"], hosts.frontier(t["edges"])).collect()
    assert f == []


def test_traits_name_what_they_hold(spark):
    rows = [("git commit -m x", "/r", None), ("ls", "/r", "mutation"), ("npm install", "/r", None), ("docker compose up", "/r", "read"), (None, "/r", None), ("cp a b", None, None)]
    t = rules.command_traits(F.col("c"), F.col("d"), F.col("k"))
    got = spark.createDataFrame(rows, "c string, d string, k string").select(t["side_effect"].alias("s"), t["resources"].alias("r"), t["reasons"].alias("w")).collect()
    assert [(r["s"], r["r"]) for r in got] == [(True, ["git:index:/r", "git:refs:/r"]), (True, []), (True, ["dependencies:/r"]), (True, ["docker:compose:/r"]), (False, []), (True, [])]
    assert got[0]["w"] == ["mutates the repository index or refs"] and got[1]["w"] == []


def test_newest_files_and_growth(spark, tmp_path):
    f = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "path string, modificationTime int")
    assert [r["path"] for r in files.newest_files(f, 2).collect()] == ["a", "b"]
    (tmp_path / "g.json").write_text(json.dumps({"captured_at": "2024-01-01T00:00:00Z", "stars": 3, "releases": [{"assets": [{"download_count": 4}, {"download_count": None}]}, {"assets": [{"download_count": 6}]}]}, indent=1))
    (tmp_path / "n.json").write_text(json.dumps({"captured_at": "2024-01-02T00:00:00Z", "stars": 4}, indent=1))
    (tmp_path / "bad.json").write_text("{")
    assert sorted((r["stars"], r["downloads"]) for r in files.read_growth(spark, str(tmp_path)).where("stars is not null").collect()) == [(3, 10), (4, 0)]


def test_default_flags_and_candidates(spark):
    got = spark.createDataFrame([(None, "read"), (False, "read"), (None, "build"), (True, "build")], "f boolean, k string").select(rules.default_semantics(F.col("f"), F.col("k")).alias("f")).collect()
    assert [r["f"] for r in got] == [True, False, None, True]


def test_scenarios_and_targets(spark):
    s = spark.createDataFrame([("p", "a", 0.5, False, 2), ("p", "b", 0.9, True, 1), ("p", "c", 0.9, False, 1), ("p", "d", 0.9, False, 3), ("q", "a", 0.1, False, 1)], "project string, scenario string, score double, guardrail boolean, goals int")
    assert [(r["project"], r["scenario"], r["rank"]) for r in hosts.ranked_scenarios(s, 3).orderBy("project", "rank").collect()] == [("p", "d", 1), ("p", "c", 2), ("p", "b", 3), ("q", "a", 1)]
    goals = [("g1", "parallel", "x"), ("g2", "serial", "x"), ("g3", "conditional", None), ("g4", "conditional", "y")]
    t = spark.createDataFrame([("p", "a", 0.45, goals), ("p", "b", 0.44, goals)], "project string, scenario string, score double, goals array<struct<name:string,mode:string,executor:string>>")
    assert sorted(r["goal"] for r in hosts.targets(t).collect()) == ["g1", "g4"]


def test_serialisation_edges(spark):
    pairs = spark.createDataFrame([("p", 1, 2, False), ("p", 2, 3, False), ("p", 1, 3, True)], "plan_id string, first int, second int, ordered boolean")
    levels = spark.createDataFrame([("p", 1, 0), ("p", 2, 0), ("p", 3, -1)], "plan_id string, unit_id int, level int")
    assert sorted(map(tuple, graph.serialisation_edges(pairs, levels).collect())) == [("p", 1, 2), ("p", 3, 2)]


def test_trusted_workflows(spark):
    t = rules.trusted_run(F.col("i"), F.lit("push"), F.lit("a" * 40), F.lit("main"), F.lit("success"), ["push"], F.col("w"), ["ci"])
    assert [r["t"] for r in spark.createDataFrame([(1, "ci"), (1, "other"), (1, None), (0, "ci")], "i int, w string").select(t.alias("t")).collect()] == [None, "workflow", "workflow", "id"]
