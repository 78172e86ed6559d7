"""Work tables over the given tables, as SQL text that Spark and other engines share.

``{name}`` in a definition is a given table or another view. ``view`` gives a DataFrame,
``with_views`` the same definitions as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.store import PART_BYTES, size

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # work plans: a customer is a plan, its orders are units
    "units": """
        SELECT o_custkey AS plan_id, o_orderkey AS unit_id,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
               CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS duration_s,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS commutative,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'read' WHEN '2' THEN 'test' WHEN '3' THEN 'build' WHEN '4' THEN 'network' ELSE 'opaque' END AS kind,
               CASE o_orderkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS idempotent,
               o_orderkey % 2 = 0 AS retryable, o_orderkey % 5 = 0 AS cacheable, o_orderkey % 7 <> 0 AS deterministic,
               CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' WHEN 2 THEN 'declared' ELSE 'unknown' END AS effects_assurance,
               CASE o_orderkey % 9 WHEN 0 THEN 'opaque' WHEN 1 THEN 'conservative' ELSE 'exact' END AS parse_assurance,
               CASE o_orderkey % 11 WHEN 0 THEN 'native_delegate' WHEN 1 THEN 'opaque' ELSE 'exact_argv' END AS codegen_assurance,
               o_orderkey % 6 = 0 AS side_effect, o_orderpriority AS batch_key, o_orderkey % 2 AS cwd, o_orderstatus AS status_code
        FROM {orders}""",
    "edges": """
        SELECT c.plan_id, c.unit_id, p.unit_id AS pred_id,
               CASE c.rn % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'order' WHEN 2 THEN 'data' ELSE 'failure' END AS kind
        FROM {units} c JOIN {units} p ON c.plan_id = p.plan_id AND p.rn = CAST(floor(c.rn / 2) AS BIGINT) WHERE c.rn > 1
        UNION ALL
        SELECT c.plan_id, c.unit_id, p.unit_id, 'order' FROM {units} c JOIN {units} p ON c.plan_id = p.plan_id AND c.rn = 1 AND p.rn = 4
        WHERE c.plan_id % 10 = 3""",
    "acyclic_edges": "SELECT * FROM {edges} WHERE plan_id % 10 <> 3",
    "accesses": """
        SELECT DISTINCT o_custkey AS plan_id, l_orderkey AS unit_id, concat('p', CAST(l_partkey AS VARCHAR(20))) AS resource,
               CASE concat(l_returnflag, l_linestatus) WHEN 'RF' THEN 'read' WHEN 'RO' THEN 'snapshot' WHEN 'NF' THEN 'create' WHEN 'NO' THEN 'overwrite' ELSE 'append' END AS mode,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS commutative
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "file_accesses": """
        SELECT DISTINCT o_custkey AS plan_id, l_orderkey AS unit_id,
               CASE l_linenumber % 3 WHEN 0 THEN concat('/d', CAST(l_suppkey % 9 AS VARCHAR(20))) WHEN 1 THEN concat('/d', CAST(l_suppkey % 9 AS VARCHAR(20)), '/s', CAST(l_partkey % 3 AS VARCHAR(20)))
                    ELSE concat('/d', CAST(l_suppkey % 9 AS VARCHAR(20)), '/s', CAST(l_partkey % 3 AS VARCHAR(20)), '/f', CAST(l_partkey % 11 AS VARCHAR(20))) END AS resource,
               CASE concat(l_returnflag, l_linestatus) WHEN 'RF' THEN 'read' WHEN 'RO' THEN 'snapshot' WHEN 'NF' THEN 'create' WHEN 'NO' THEN 'overwrite' ELSE 'append' END AS mode,
               o_orderpriority IN ('1-URGENT', '2-HIGH') AS commutative
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "assured_units": "SELECT *, CASE unit_id % 8 WHEN 0 THEN 'unknown' ELSE 'exact' END AS control_assurance, CASE unit_id % 10 WHEN 3 THEN 'unknown' ELSE 'bounded' END AS internal_kind FROM {units}",
    "every_plan": "SELECT c_custkey AS plan_id FROM {customer} UNION ALL SELECT -s_suppkey FROM {supplier}",
    "coarse_units": """
        SELECT l_orderkey AS unit_id, CASE l_orderkey % 4 WHEN 0 THEN 'read' ELSE 'build' END AS kind,
               array_agg(DISTINCT concat('/p', CAST(l_partkey AS VARCHAR(20)))) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS reads,
               array_agg(DISTINCT concat('/p', CAST(l_partkey AS VARCHAR(20)))) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'F') AS writes,
               array_agg(DISTINCT concat(CASE l_suppkey % 2 WHEN 0 THEN 'db:x:' ELSE 's' END, CAST(l_suppkey AS VARCHAR(20)))) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS resources
        FROM {lineitem} GROUP BY l_orderkey""",
    "plan_rows": """
        SELECT plan_id, 'unit' AS part, unit_id AS a, CAST(0 AS BIGINT) AS b, kind AS t FROM {units}
        UNION ALL SELECT plan_id, 'edge', unit_id, pred_id, kind FROM {edges}
        UNION ALL SELECT plan_id, 'capacity', CAST(capacity AS BIGINT), CAST(0 AS BIGINT), resource FROM {capacities}""",
    "effects": """
        SELECT DISTINCT o_custkey AS plan_id, l_orderkey AS unit_id, l_returnflag AS domain, l_suppkey AS key,
               CASE l_linestatus WHEN 'F' THEN 'read' ELSE 'write' END AS mode, o_orderpriority IN ('1-URGENT', '2-HIGH') AS commutative
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "paths": """
        SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS owner, n_nationkey AS plan_id, concat('/', r_name, '/', n_name, '/', c_mktsegment, '/', CAST(c_custkey AS VARCHAR(20))) AS path
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))), n_nationkey, concat('/', r_name, '/', n_name)
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "claims": """
        SELECT o_custkey AS plan_id, l_orderkey AS unit_id, CASE l_suppkey % 4 WHEN 0 THEN 'cores' WHEN 1 THEN 'memory' WHEN 2 THEN 'disk' ELSE 'license' END AS resource, sum(l_quantity) AS units
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "capacities": "SELECT DISTINCT plan_id, resource, CAST(100 AS DOUBLE) AS capacity FROM {claims} WHERE resource <> 'license'",
    "cost_claims": "SELECT plan_id, unit_id, CASE resource WHEN 'cores' THEN 'cpu_core' WHEN 'memory' THEN 'memory_mb' ELSE resource END AS resource, units FROM {claims}",
    "cost_units": """
        SELECT plan_id, unit_id, duration_s / 100 AS cores, CASE WHEN unit_id % 3 = 0 THEN duration_s * 10 END AS memory_mb,
               CASE batch_key WHEN '3-MEDIUM' THEN 'accelerator' ELSE 'cpu' END AS profile, CASE WHEN unit_id % 4 = 0 THEN CAST(1 + unit_id % 40 AS DOUBLE) END AS inner_tokens
        FROM {units}""",
    # runs: an order is a run, its lines are tasks that take days
    "task_results": """
        SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS task_id,
               CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'succeeded' END AS status,
               CAST(datediff(CAST(l_shipdate AS DATE), DATE '1990-01-01') AS DOUBLE) * 86400 AS start_s, l_quantity * 86400 AS duration_s, l_suppkey % 4 AS resource_no
        FROM {lineitem}""",
    "savings_events": """
        SELECT o_orderkey AS run_id, o_custkey AS host, CASE o_orderstatus WHEN 'F' THEN 'measured' WHEN 'O' THEN 'estimated' ELSE 'legacy' END AS provenance,
               o_totalprice / 1000 AS saved_s, o_orderdate AS at FROM {orders}""",
    "bench_runs": """
        SELECT o_orderkey AS run_id, concat('  ', c_mktsegment, ' ') AS realm, o_orderdate AS generated_at, CASE o_orderstatus WHEN 'F' THEN 'passed' ELSE 'failed' END AS status,
               o_totalprice / 100 AS wall_s, o_totalprice / 40 AS serial_s, o_totalprice / 40 - o_totalprice / 100 AS saved_s
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "bench_tasks": """
        SELECT l_orderkey AS run_id, l_returnflag AS task_id, sum(l_quantity) AS worker_s, sum(l_quantity) + sum(l_discount) * 10 AS outer_s, count(*) AS iterations
        FROM {lineitem} GROUP BY 1, 2""",
    "bench_stored": """
        SELECT run_id, max(worker_s) + CASE WHEN run_id % 13 = 0 THEN 1 ELSE 0 END AS wall_s, sum(worker_s) AS serial_s, sum(worker_s) - max(worker_s) AS saved_s
        FROM {bench_tasks} GROUP BY 1""",
    "bench_base": """
        SELECT run_id, CASE WHEN run_id % 13 = 0 THEN 0 ELSE max(worker_s) END AS wall_s, sum(worker_s) + CASE WHEN run_id % 17 = 0 THEN 1 ELSE 0 END AS serial_s,
               min(worker_s) + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END AS minimum_s, CASE WHEN run_id % 29 = 0 THEN 0 ELSE 2 END AS peak
        FROM {bench_tasks} GROUP BY run_id""",
    "bench_claimed": """
        SELECT *, serial_s - wall_s AS saved_s, serial_s / nullif(wall_s, 0) + CASE WHEN run_id % 19 = 0 THEN 0.5 ELSE 0 END AS speedup,
               (serial_s - wall_s) / serial_s * 100 + CASE WHEN run_id % 23 = 0 THEN 0.5 ELSE 0 END AS percent, serial_s / nullif(wall_s, 0) / nullif(peak, 0) + CASE WHEN run_id % 31 = 0 THEN 0.5 ELSE 0 END AS efficiency
        FROM {bench_base}""",
    "bench_history": """
        SELECT o_orderkey - CASE WHEN o_orderkey % 4999 = 5 THEN 1 ELSE 0 END AS run_id, concat(lower(c_mktsegment), '-', substr(o_orderpriority, 1, 1)) AS realm, o_orderdate AS generated_at,
               CASE WHEN o_orderkey % 3001 = 4 THEN 'failed' ELSE 'passed' END AS status, o_totalprice / 100 AS wall_s, o_totalprice / 40 AS serial_s,
               o_totalprice / 40 - o_totalprice / 100 + CASE WHEN o_orderkey % 2503 = 9 THEN 1 ELSE 0 END AS saved_s, (o_totalprice / 40) / (o_totalprice / 100) AS speedup
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "growth": """
        SELECT CAST(ts AS DATE) AS captured_on, event_type AS counter, CASE WHEN event_type = 'signup' AND day(ts) % 3 <> 0 THEN NULL ELSE count(*) END AS n
        FROM {events} GROUP BY CAST(ts AS DATE), event_type, day(ts)""",
    "snapshots_expected": "SELECT source AS plan_id, doc_id AS path, md5(text) AS digest FROM {documents} WHERE doc_id % 7 <> 0",
    "snapshots_current": "SELECT source AS plan_id, doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'changed' ELSE md5(text) END AS digest FROM {documents} WHERE doc_id % 5 <> 0",
    "case_sets": """
        SELECT DISTINCT l_orderkey AS suite_id, CASE WHEN l_returnflag = 'N' OR (l_returnflag = 'R' AND l_linestatus = 'F') THEN 'serial' ELSE 'parallel' END AS side, l_partkey % 3 AS case_id
        FROM {lineitem}""",
    "case_counts": """
        SELECT suite_id, side, count(*) AS tests, count(*) - CASE WHEN side = 'serial' AND suite_id % 6 = 0 THEN 1 ELSE 0 END AS passed, CASE WHEN suite_id % 5 = 0 THEN 1 ELSE 0 END AS skipped,
               CASE WHEN suite_id % 43 <> 0 THEN concat(CAST(min(case_id) AS VARCHAR(20)), '-', CAST(max(case_id) AS VARCHAR(20)), '-', CAST(count(*) AS VARCHAR(20))) END AS case_set, suite_id % 8 <> 0 AS eligible
        FROM {case_sets} GROUP BY suite_id, side""",
    "baseline_runs": "SELECT run_id, CASE WHEN run_id % 19 = 0 THEN 1 ELSE 0 END AS native_pools, CASE WHEN run_id % 3 = 0 THEN 2 ELSE 1 END AS peak FROM {task_results} GROUP BY run_id",
    "baseline_suites": """
        SELECT run_id, task_id AS suite_id, CASE WHEN run_id % 7 = 0 THEN 2 ELSE 1 END AS workers, CASE WHEN run_id % 11 = 0 THEN 0 ELSE 1 END AS snapshots, run_id % 5 <> 0 AS declared, run_id % 37 <> 0 AS covered,
               3 AS tests, CASE WHEN run_id % 23 = 0 THEN 2 ELSE 3 END AS passed, CASE WHEN run_id % 29 = 0 THEN 1 ELSE 0 END AS skipped, CASE WHEN run_id % 31 <> 0 THEN 'x' END AS case_set
        FROM {task_results}""",
    "baseline_results": "SELECT run_id, task_id AS suite_id, status FROM {task_results} WHERE NOT (run_id % 17 = 0 AND task_id = 1)",
    "spans": "SELECT user_id AS path, event_id AS span_id, value AS first_line, value + 20 AS last_line FROM {events}",
    "hotspots": "SELECT user_id AS path, event_id AS hotspot_id, value AS line, value * (event_id % 17) AS wall_s FROM {events}",
    "suite_cases": """
        SELECT l_orderkey % 100 AS run_id, l_suppkey AS suite_id, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'passed' END AS outcome, l_tax AS time_s
        FROM {lineitem}""",
    "suites": """
        SELECT run_id, suite_id, count(*) + CASE WHEN suite_id % 7 = 0 THEN 1 ELSE 0 END AS declared_tests, sum(time_s) / 2 AS wall_s, 2 AS workers, suite_id % 10 AS module
        FROM {suite_cases} GROUP BY 1, 2""",
    "attributed_suites": """
        SELECT run_id, suite_id, count(*) AS tests, count(*) - CASE WHEN run_id % 4 = 0 THEN 0 ELSE count(CASE WHEN outcome = 'failed' THEN 1 END) END AS passed, CASE WHEN run_id % 4 = 0 THEN 0 ELSE count(CASE WHEN outcome = 'failed' THEN 1 END) END AS failed, 0 AS skipped,
               sum(time_s) AS case_s, true AS timing_complete, NOT (run_id % 12 = 8 AND suite_id % 10 = 3) AS timing_plausible, NOT (run_id % 16 = 4 AND suite_id % 10 = 1) AS consistent, run_id % 4 = 0 AS eligible, NOT (run_id % 20 = 12 AND suite_id % 10 = 7) AS fresh, run_id % 24 <> 0 AS exclusive
        FROM {suite_cases} GROUP BY run_id, suite_id""",
    "machines": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN concat(' ', p_name, '!') WHEN p_partkey % 7 = 1 THEN '' END AS explicit, CASE p_partkey % 5 WHEN 0 THEN 'Windows' WHEN 1 THEN 'Darwin' WHEN 2 THEN 'linux' WHEN 3 THEN 'plan9' END AS system,
               CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' / box') WHEN p_partkey % 33 = 1 THEN '..' END AS direct, CASE p_partkey % 4 WHEN 0 THEN 'Apple M1' WHEN 1 THEN 'a Windows box' ELSE p_name END AS machine
        FROM {part}""",
    "domain_cases": "SELECT suite_id % 100 AS module, CASE WHEN outcome = 'failed' AND time_s > 0.045 THEN 'error' ELSE outcome END AS status FROM {suite_cases}",
    "domain_stored": """
        SELECT module, count(*) + CASE WHEN module % 9 = 0 THEN 1 ELSE 0 END AS total, count(CASE WHEN status = 'passed' THEN 1 END) AS passed, count(CASE WHEN status IN ('failed', 'error') THEN 1 END) - count(CASE WHEN status = 'error' AND module % 5 <> 0 THEN 1 END) AS failed,
               count(CASE WHEN status = 'error' THEN 1 END) AS errors, count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped
        FROM {domain_cases} WHERE module % 7 <> 0 GROUP BY module UNION ALL SELECT -1, 1, 1, 0, 0, 0""",
    "workflow_runs": """
        SELECT event_id AS id, event_type AS event, concat(md5(CAST(event_id AS VARCHAR(20))), substr(md5(event_type), 1, CASE WHEN event_id % 9 = 0 THEN 7 ELSE 8 END)) AS head_sha,
               CASE WHEN event_id % 4 = 0 THEN 'dev' ELSE 'main' END AS head_branch, CASE WHEN event_id % 5 = 0 THEN 'failure' ELSE 'success' END AS conclusion, user_id
        FROM {events}""",
    "hits": "SELECT o_custkey AS project, substr(o_orderpriority, 1, 1) AS source, count(*) AS hits FROM {orders} GROUP BY 1, 2",
    "gate_scored": """
        SELECT o_custkey AS project, substr(o_orderpriority, 1, 1) AS scenario, count(DISTINCT o_orderstatus) AS sources, count(*) AS file_hits, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS content_hits,
               o_custkey % 50 AS project_files, array_agg(DISTINCT o_orderstatus) AS globs_hit, o_custkey % 9 = 0 AS hinted
        FROM {orders} GROUP BY o_custkey, substr(o_orderpriority, 1, 1)""",
    "gate_requirements": """
        SELECT substr(o_orderpriority, 1, 1) AS scenario, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 2 END AS min_sources, CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN 3 END AS min_file_hits,
               CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 1 END AS min_content_hits, CASE WHEN substr(o_orderpriority, 1, 1) <> '3' THEN 10 END AS min_project_files,
               array_agg(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '4') AS any_globs, CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN false END AS hint_overrides
        FROM {orders} WHERE substr(o_orderpriority, 1, 1) <> '5' GROUP BY substr(o_orderpriority, 1, 1)""",
    "scenarios": "SELECT c_custkey AS scenario, c_mktsegment AS category, c_nationkey AS layer, array_agg(DISTINCT substr(o_orderpriority, 1, 1)) AS goals FROM {customer} JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey",
    "session_capacities": "SELECT session_id, 'worker_slot' AS resource, CAST(slots AS DOUBLE) AS capacity FROM {sessions} UNION ALL SELECT session_id, 'cpu_core', CAST(slots * 2 AS DOUBLE) FROM {sessions} WHERE session_id % 2 = 0",
    "live_sessions": "SELECT user_id AS session_id, user_id + 1000 AS pid, CASE WHEN user_id % 4 <> 0 THEN 'a' END AS identity, max(ts) AS heartbeat_at FROM {events} GROUP BY user_id",
    "processes": "SELECT DISTINCT user_id + 1000 AS pid, user_id % 3 <> 0 AS alive, CASE WHEN user_id % 5 = 0 THEN 'b' ELSE 'a' END AS identity FROM {events} WHERE user_id % 7 <> 0",
    "call_lines": "SELECT event_id % 5000 AS call_id, event_id AS line_no, concat(event_type, '.', CAST(user_id % 40 AS VARCHAR(20))) AS tool, CASE WHEN event_type = 'error' THEN concat('agent', CAST(user_id AS VARCHAR(20))) END AS agent FROM {events}",
    "shares": "SELECT c_nationkey AS grp, c_custkey AS member, CAST(1 + c_custkey % 5 AS DOUBLE) AS weight, CAST(1 AS DOUBLE) AS floor_units, 1 + abs(c_acctbal) / 1000 AS cap, CAST(count(*) OVER (PARTITION BY c_nationkey) * 3 AS DOUBLE) AS total FROM {customer}",
    "sessions": "SELECT user_id AS session_id, 4 + user_id % 5 AS slots, count(CASE WHEN event_type = 'click' THEN 1 END) AS ready, count(CASE WHEN event_type = 'view' THEN 1 END) AS running, max(value) / 50 AS observed_load FROM {events} GROUP BY user_id",
    "reservations": "SELECT CASE WHEN event_id % 50 = 0 THEN -user_id - 1 ELSE user_id END AS session_id, event_id AS unit_id, CASE WHEN value / 100 < 3 THEN value / 100 ELSE 3 END AS claim FROM {events} WHERE event_type = 'purchase'",
    "fn_effects": "SELECT DISTINCT o_custkey AS module, l_orderkey AS fn, l_returnflag AS effect FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "prompts": "SELECT 'd' AS origin, doc_id AS id, text AS prompt FROM {documents} UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM {conversations}",
    "raw_numbers": "SELECT 'tax' AS field, CAST(l_orderkey AS VARCHAR(20)) AS id, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) AS raw FROM {lineitem} UNION ALL SELECT 'name', CAST(p_partkey AS VARCHAR(20)), p_name FROM {part} UNION ALL SELECT 'bool', CAST(event_id AS VARCHAR(20)), CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'NaN' END FROM {events}",
    "traces": "SELECT event_id % 5000 AS call_id, event_type AS tool, concat('rg ', event_type, CASE WHEN event_id % 3 = 0 THEN ' | pytest -q' WHEN event_id % 3 = 1 THEN ' && git status' ELSE ' docker build' END) AS input, user_id FROM {events}",
}

# spellings in which engines differ
_OTHER = {r"datediff\(CAST\(l_shipdate AS DATE\), DATE '1990-01-01'\)": "date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))"}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: the key that lineitem and orders are dealt by where they meet
BY_ORDER = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view of them. Where lines meet their orders or are numbered in them, they are dealt by order into as many parts
    as their files ask for, so that a task holds as much of a large table as of a small one; what is grouped by unit stays there."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {n: view(spark, sf_dir, n) for n in _needs(VIEWS[name])}
    dealt = BY_ORDER.keys() & needs.keys()
    if len(dealt) == 2 or name == "task_results":
        parts = sum(size(needs[n]) for n in dealt) // PART_BYTES + 1
        needs |= {n: needs[n].repartition(parts, BY_ORDER[n]) for n in dealt}
    return spark.sql(VIEWS[name], **needs)


def with_views(sql: str, recursive: bool = False) -> str:
    """``sql`` with the views it names, in front as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    ctes = []
    for n in order:
        text = VIEWS[n]
        for a, b in _OTHER.items():
            text = re.sub(a, b, text)
        ctes.append(f"{n} AS ({plain(text)})")
    body = plain(sql).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = True, "," + body[len("WITH RECURSIVE") :]
    elif body.upper().startswith("WITH"):
        body = "," + body[len("WITH") :]
    if body.startswith(",") and not ctes:
        body = body[1:]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" + body) if ctes or body[:1] != "S" else body
