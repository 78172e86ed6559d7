"""Running values in two passes against one window, with one key that holds nearly all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import graph, history, hosts, runs, scan


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 20 else rng.choice(["a", "b", None]), i, rng.randint(0, 40), rng.choice([None, 1, 2, 3, 5])) for i in range(4000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, id int, at int, v int")


def folds():
    return [scan.total("s", F.col("v")), scan.place("n"), scan.largest("m", F.col("v")), scan.last_known("l", F.col("v")), scan.row_before("b", F.col("v"))]


@pytest.mark.parametrize("parts", [1, 2, 16])
def test_running_is_one_window(skewed, parts):
    order = [F.col("at"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("k", "id", F.sum("v").over(upto), F.row_number().over(w), F.max("v").over(upto), F.last("v", ignorenulls=True).over(upto), F.lag("v").over(w))
    got = scan.running(skewed, ["k"], order, folds(), parts).select("k", "id", "s", "n", "m", "l", "b")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_part_holds_twice_the_mean(skewed):
    one = skewed.withColumn("k", F.lit("only"))
    sizes = [r["count"] for r in scan.laid_out(one, ["k"], [F.col("at"), F.col("id")], 16).groupBy(scan.PART).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16


def test_equal_rows_with_a_tie_spread(spark):
    same = spark.range(3200).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    sizes = [r["count"] for r in scan.laid_out(same, ["k"], [F.col("v")], 8, F.monotonically_increasing_id()).groupBy(scan.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 800
    got = scan.running(same, ["k"], [F.col("v")], [scan.total("s", F.col("v"))], 8, F.monotonically_increasing_id())
    assert sorted(r["s"] for r in got.collect()) == [2 * i for i in range(1, 3201)]


def test_empty_table_and_several_keys(spark):
    t = spark.createDataFrame([], "a int, b string, v int")
    assert scan.running(t, ["a", "b"], [F.col("v")], [scan.total("s", F.col("v"))], 4).count() == 0
    rows = [(i % 3 if i % 5 else None, "x" if i % 2 else None, i) for i in range(300)]
    t = spark.createDataFrame(rows, "a int, b string, v int")
    got = {(r["a"], r["b"], r["v"]): r["s"] for r in scan.running(t, ["a", "b"], [F.col("v")], [scan.total("s", F.col("v"))], 8).collect()}
    for a, b, v in rows:
        assert got[a, b, v] == sum(x for p, q, x in rows if (p, q) == (a, b) and x <= v)


def test_operators_in_many_parts_are_the_same(spark):
    rng = random.Random(9)
    tasks = [("r" if i % 9 else f"s{i}", float(rng.randint(0, 300)), float(rng.randint(1, 30))) for i in range(500)]
    t = spark.createDataFrame(tasks, "run_id string, start_s double, duration_s double")
    peaks = {r["run_id"]: r["peak"] for r in runs.peak_overlap(t, ["run_id"], "start_s", "duration_s", parts=7).collect()}
    for run in {x[0] for x in tasks}:
        mine = [x for x in tasks if x[0] == run]
        assert peaks[run] == max(sum(s <= a < s + d for _, s, d in mine) for _, a, _ in mine)
    grown = [("c", i, rng.choice([None, i])) for i in range(400)] + [("d", 1, None), ("d", 2, 5)]
    got = {(r[0], r[1]): tuple(r)[2:] for r in history.carry_forward(spark.createDataFrame(grown, "counter string, captured_on int, n int"), parts=9).collect()}
    value = at = None
    for c, i, n in grown[:400]:
        value, at = (n, i) if n is not None else (value, at)
        assert got[c, i] == (value, i - 1 if n is None and value is not None else None, at)
    assert got["d", 1] == (None, None, None) and got["d", 2] == (5, None, 2)
    units = spark.createDataFrame([("p", i, "pending", rng.choice([None, float(i % 7)])) for i in range(300)], "plan_id string, unit_id int, status string, duration_s double")
    none = spark.createDataFrame([], "plan_id string, unit_id int, pred_id int")
    placed = sorted(graph.ready_order(units, none, "duration_s", parts=5).join(units, ["plan_id", "unit_id"]).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in placed] == list(range(1, 301)) and placed == sorted(placed, key=lambda r: (r["duration_s"] is None, -(r["duration_s"] or 0), r["unit_id"]))


def test_shares_of_one_large_group(spark):
    rng = random.Random(11)
    rows = [("g", i, rng.choice([0.0, 1.0, 2.0, 5.0]), rng.uniform(0, 3), rng.uniform(0, 9), 700.0) for i in range(300)]
    df = spark.createDataFrame(rows, "grp string, member long, weight double, floor_units double, cap double, total double")
    many, one = ({r["member"]: r["share"] for r in hosts.weighted_share(df, parts=p).collect()} for p in (8, 1))
    assert all(abs(many[m] - one[m]) < 1e-9 for m in one)
    assert abs(sum(many.values()) - min(700.0, sum(max(f, c) if w else f for _, _, w, f, c, _ in rows))) < 1e-6


def test_percentiles_of_one_large_group(spark):
    rng = random.Random(13)
    rows = [("g", rng.choice([None, 1.0, 2.5, rng.random()])) for _ in range(801)] + [("few", 1.0)] * 2 + [("nulls", None)] * 4
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in runs.repeat_percentiles(df, ["k"], "v", parts=6).collect()}
    want = df.where("k = 'g'").agg(F.percentile("v", 0.5), F.percentile("v", 0.9)).first()
    assert set(got) == {"g", "nulls"} and got["nulls"]["p50"] is None and got["g"]["repetitions"] == 801
    assert abs(got["g"]["p50"] - want[0]) < 1e-12 and abs(got["g"]["p90"] - want[1]) < 1e-12


def test_last_rows(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, None, "n")], "realm string, generated_at int, run_id string")
    assert sorted(((r["realm"], r["run_id"]) for r in history.latest(t).collect()), key=str) == [("a", "y"), (None, "n")]
    assert sorted(((r["realm"], r["run_id"]) for r in history.last_per_key(t, "realm", "run_id").collect()), key=str) == [("a", "z"), (None, "n")]
