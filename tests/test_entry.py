"""The entry file with parts of the library out of reach."""

import os
import subprocess
import sys

import duckdb

from weftline.plans import catalog
from weftline.plans.views import TABLES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(code: str) -> list[str]:
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


def test_a_missing_dependency_costs_its_own_queries_only():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    got = names(code)
    assert set(catalog.queries()) <= set(got) and not [n for n in got if n.startswith("op") and n[2].isdigit() or n == "pipeline"]


def test_all_names():
    assert set(catalog.queries()) <= set(names("import __spark_entry__ as e; print(*e.queries())"))


def test_first_query_on_the_larger_tables(spark):
    con = duckdb.connect()
    d = "/root/testdata/sf0.01"
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    r = con.execute(catalog.oracle_sql()["access_conflicts"])
    cols = [x[0] for x in r.description]
    got = [tuple(x[c] for c in cols) for x in catalog.queries()["access_conflicts"](spark, d).collect()]
    assert sorted(got) == sorted(r.fetchall()) and len(got) > 400
