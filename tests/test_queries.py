"""Every registered query with SQL, on the smallest tables, against DuckDB."""

import duckdb
import pytest

from weftline.plans import catalog
from weftline.plans.views import TABLES

D = "/root/testdata/sf0.001"
SOME = sorted(catalog.oracle_sql())


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else str(x) if x is not None and not isinstance(x, (int, bool)) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    r = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = [tuple(x[names.index(c)] for c in cols) for x in r.fetchall()]
    assert plain([tuple(x[c] for c in cols) for x in df.collect()]) == plain(want)
