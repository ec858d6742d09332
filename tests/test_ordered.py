"""Ordered and nearest-in-time computations against brute force."""

import glob
import os
import random
import subprocess
import sys
import time
from bisect import bisect_right
from datetime import timedelta

import pytest
from clinic import T0
from pyspark.sql import functions as F

from wardframe.operators import cells
from wardframe.operators.folds import contiguous_folds, exact_holdout
from wardframe.operators.nearest import CELL_MICROS, interval_join, nearest_values
from wardframe.operators.ordered import exact_quantiles, first_rows, ranked, row_index, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, with many ties in the order."""
    r = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else r.randrange(20), r.randrange(40) if i % 11 else None) for i in range(900)]
    return rows, spark.createDataFrame(rows, "id long, key long, x int")


def expected_rank(rows, dense, descending):
    out = {}
    for i, key, x in rows:
        group = [v for _, k, v in rows if k == key]
        if x is None:
            before = [] if descending else [v for v in group if v is not None]
        else:
            before = [v for v in group if (v is None if descending else False) or
                      (v is not None and (v > x if descending else v < x))]
        out[i] = 1 + len(set(before) if dense else before)
    return out


@pytest.mark.parametrize("dense,descending", [(False, False), (True, True)])
def test_ranked(skewed, dense, descending):
    rows, df = skewed
    got = ranked(df, ["key"], "x", "r", dense, descending).collect()
    assert len(got) == len(rows)
    assert {r.id: r.r for r in got} == expected_rank(rows, dense, descending)


def test_running_totals_carry_over_slices(spark, skewed):
    rows, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_totals(df, [F.col("id").asc()], {"before": F.col("id")}, ["key"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sums, expected = {}, {}
    for i, key, _ in rows:
        expected[i] = sums.get(key, 0)
        sums[key] = expected[i] + i
    assert {r.id: r.before for r in got} == expected


def test_row_index(skewed):
    rows, df = skewed
    got = row_index(df, [F.col("id").desc()]).collect()
    assert {r.id: r.row_idx for r in got} == {i: len(rows) - 1 - i for i, _, _ in rows}


def test_first_rows(skewed):
    rows, df = skewed
    got = {r.key: r.id for r in first_rows(df, ["key"], ["id"]).collect()}
    assert got == {k: min(i for i, key, _ in rows if key == k) for _, k, _ in rows}


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v) if v else None, 5.0) for v in (1, 2, 4, 9, None)], "a double, b double")
    rows = {r.variable: (r.q0, r.q1, r.q2) for r in exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75]).collect()}
    assert rows == {"a": (1.75, 3.0, 5.25), "b": (5.0, 5.0, 5.0)}


def test_fold_sizes(spark):
    folds = contiguous_folds(spark.range(23), [F.col("id").asc()], 10).orderBy("id").collect()
    assert [r.fold for r in folds] == [f for f, n in enumerate([3] * 3 + [2] * 7) for _ in range(n)]


def test_holdout_is_exact_and_seeded(spark):
    one = {r.id for r in exact_holdout(spark.range(101), "id", 0.3, 7).collect() if r.is_test}
    two = {r.id for r in exact_holdout(spark.range(101), "id", 0.3, 8).collect() if r.is_test}
    assert len(one) == len(two) == 31 and one != two


def make_events(seed, n, keys):
    r = random.Random(seed)
    return [
        (0 if i % 3 == 0 else r.randrange(keys), r.choice("ab"), T0 + timedelta(minutes=r.randrange(4000)),
         float(r.randrange(50)) if i % 7 else None)
        for i in range(n)
    ]


def test_nearest_equals_brute_force(spark):
    events = make_events(1, 600, 12)
    anchors = [(k, k * 100 + j, T0 + timedelta(minutes=1000 * j)) for k in range(14) for j in range(4)]
    ev = spark.createDataFrame(events, "key long, item string, time timestamp_ntz, value double")
    an = spark.createDataFrame(anchors, "key long, id long, at timestamp_ntz")
    day = F.expr("interval '10' hour")
    span = timedelta(hours=10)
    got = nearest_values(
        an, ev, ["key"], "at", {"a": "a", "b": "b"}, (F.col("at") - day, F.col("at") + day), presence=True
    ).collect()
    assert len(got) == len(anchors)
    for row in got:
        for item in "ab":
            near = [(abs(t - row["at"]), v) for k, i, t, v in events if k == row["key"] and i == item and abs(t - row["at"]) <= span]
            assert row[f"has_{item}"] == bool(near)
            best = [v for d, v in near if d == min(near)[0] and v is not None] if near else []
            if near:
                closest = min(d for d, _ in near)
                best = [v for d, v in near if d == closest and v is not None]
            assert row[item] == (max(best) if best else None)


def test_interval_join_equals_brute_force(spark):
    events = make_events(2, 400, 10)
    anchors = [(k, k * 100 + j, T0 + timedelta(minutes=1300 * j)) for k in range(12) for j in range(3)]
    ev = spark.createDataFrame(events, "key long, item string, time timestamp_ntz, value double")
    an = spark.createDataFrame(anchors, "key long, id long, at timestamp_ntz")
    day = F.expr("interval '24' hour")
    got = interval_join(an, ev, ["key"], F.col("at") - day, F.col("at") + day, "time").collect()
    expected = []
    for k, i, at in anchors:
        hits = [(i, t, v) for key, _, t, v in events if key == k and abs(t - at) <= timedelta(hours=24)]
        expected += hits or [(i, None, None)]
    assert sorted(map(str, ((r.id, r.time, r.value) for r in got))) == sorted(map(str, expected))


def dense_day(n):
    """Key 0 has a third of all rows on one day, many of them at one instant."""
    r = random.Random(9)
    day = [(0, "a", T0 + timedelta(seconds=r.randrange(3000) * 20), float(r.randrange(90)) if i % 5 else None) for i in range(n)]
    day += [(0, "a", T0 + timedelta(hours=5), float(i % 40)) for i in range(n // 2)]
    day += [(0, "a", None, 1.0)] * 30
    return day + make_events(10, n, 40)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 40)


def test_dense_day_is_divided(spark, small_cells):
    events = dense_day(600)
    ev = spark.createDataFrame(events, "key long, item string, time timestamp_ntz, value double")
    dense = cells.dense_cells(ev, ["key", "item"], "time", CELL_MICROS)
    spread = cells.with_cell(ev, ["key", "item"], "time", CELL_MICROS, dense, "cell")
    # the rows of one instant stay together, all others are spread
    others = spread.where(F.col("time").isNull() | (F.col("time") != F.lit(T0 + timedelta(hours=5))))
    sizes = [r["count"] for r in others.groupBy("key", "item", "cell").count().collect()]
    assert max(sizes) <= 3 * 40 < 600
    # cells of a key follow each other without overlap
    ends = sorted(
        (r.key, r.item, r.lo, r.hi, r.cell)
        for r in spread.where("time IS NOT NULL").groupBy("key", "item", "cell").agg(F.min("time").alias("lo"), F.max("time").alias("hi")).collect()
    )
    assert all(a[3] < b[2] and a[4] < b[4] for a, b in zip(ends, ends[1:]) if a[:2] == b[:2])
    even = ev.where("key > 0")
    assert cells.dense_cells(even, ["key", "item"], "time", CELL_MICROS, 10_000) is None
    assert cells.dense_cells(even.limit(0), ["key", "item"], "time", CELL_MICROS) is None


def test_nearest_on_a_dense_day(spark, small_cells):
    events = dense_day(600)
    anchors = [(k, k * 100 + j, T0 + timedelta(minutes=97 * j)) for k in range(3) for j in range(40)]
    anchors += [(0, 9000, T0 + timedelta(hours=5)), (0, 9001, T0 - timedelta(days=9)), (0, 9002, T0 + timedelta(days=90))]
    ev = spark.createDataFrame(events, "key long, item string, time timestamp_ntz, value double")
    an = spark.createDataFrame(anchors, "key long, id long, at timestamp_ntz")
    got = {r.id: r for r in nearest_values(an, ev, ["key"], "at", {"a": "a"}, presence=True).collect()}
    for k, i, at in anchors:
        near = [(abs(t - at), v) for key, item, t, v in events if key == k and item == "a" and t is not None]
        closest = min(d for d, _ in near)
        best = [v for d, v in near if d == closest and v is not None]
        assert got[i].has_a and got[i].a == (max(best) if best else None)


def test_interval_join_on_a_dense_day(spark, small_cells):
    events = dense_day(300)
    anchors = [(k, k * 100 + j, T0 + timedelta(minutes=131 * j)) for k in range(3) for j in range(9)] * 2
    ev = spark.createDataFrame(events, "key long, item string, time timestamp_ntz, value double")
    an = spark.createDataFrame([*anchors, (0, 7, None)], "key long, id long, at timestamp_ntz")
    low, high = F.col("at") - F.expr("interval '7' hour"), F.col("at") + F.expr("interval '30' hour")
    got = interval_join(an, ev, ["key"], low, high, "time").collect()
    expected = [(7, None, None)]
    for k, i, at in anchors:
        hits = [
            (i, t, v) for key, _, t, v in events
            if key == k and t is not None and at - timedelta(hours=7) <= t <= at + timedelta(hours=30)
        ]
        expected += hits or [(i, None, None)]
    assert sorted(map(str, ((r.id, r.time, r.value) for r in got))) == sorted(map(str, expected))


def test_bisect_of_running_totals(spark):
    """Counts below a value, keyed by nothing: a global running total."""
    values = sorted(random.Random(3).sample(range(1000), 200))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = running_totals(df, [F.col("v").asc()], {"n": F.lit(1)}).collect()
    assert all(r.n == bisect_right(values, r.v) - 1 for r in got)


def test_anchor_without_a_time_ties_all_events(spark):
    ev = spark.createDataFrame(
        [(1, "a", T0 + timedelta(hours=i), v) for i, v in enumerate((5.0, 9.0, 1.0))] + [(2, "b", T0, 3.0)],
        "key long, item string, time timestamp_ntz, value double",
    )
    an = spark.createDataFrame([(1, 10, None), (1, 11, T0), (2, 12, None), (3, 13, None)], "key long, id long, at timestamp_ntz")
    got = {r.id: (r.a, r.has_a) for r in nearest_values(an, ev, ["key"], "at", {"a": "a"}, presence=True).collect()}
    assert got == {10: (9.0, True), 11: (5.0, True), 12: (None, False), 13: (None, False)}
    hour = F.expr("interval '1' hour")
    inside = nearest_values(an, ev, ["key"], "at", {"a": "a"}, (F.col("at") - hour, F.col("at") + hour), presence=True)
    assert {r.id: (r.a, r.has_a) for r in inside.collect()}[10] == (None, False)


def test_one_key_with_a_third_of_the_rows(spark):
    """Neighbours far away are carried across cells of time."""
    events = [(k, "a", T0 + timedelta(hours=7 * i), float(i)) for k, n in ((0, 2000), (1, 20), (2, 3)) for i in range(n)]
    ev = spark.createDataFrame(events, "key long, item string, time timestamp_ntz, value double")
    anchors = [(k, 100 * k + j, T0 + timedelta(days=d)) for k in range(3) for j, d in enumerate((-400, 0.3, 290, 900))]
    an = spark.createDataFrame(anchors, "key long, id long, at timestamp_ntz")
    got = {r.id: r.a for r in nearest_values(an, ev, ["key"], "at", {"a": "a"}).collect()}
    for k, i, at in anchors:
        assert got[i] == max((-abs(t - at), v) for key, _, t, v in events if key == k)[1]


def test_scratch_tables_go_with_the_application(tmp_path):
    code = (
        "import glob\n"
        "from wardframe.session import local_session, pin\n"
        f"spark = local_session(1, spark__checkpoint__dir='{tmp_path}')\n"
        "assert pin(spark.range(5)).count() == 5\n"
        f"assert glob.glob('{tmp_path}/**/*.parquet', recursive=True)\n"
        "spark.stop()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    # the JVM ends a moment after its driver
    for _ in range(50):
        left = glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)
        if not left:
            break
        time.sleep(0.2)
    assert left == []


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_slices_are_sized_by_rows(spark, monkeypatch, partitions):
    from wardframe.operators import ordered

    monkeypatch.setattr(ordered, "SLICE_ROWS", 500)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(5000).selectExpr("id", "pmod(id * 7919, 5003) AS x")
        sizes = [r["count"] for r in ordered.sliced(rows, ["x"]).groupBy(ordered.SLICE).count().collect()]
        assert len(sizes) == 10 and max(sizes) < 1500
        numbered, n = ordered.numbered_rows(rows, [F.col("x").desc()], "i")
        got = [r.x for r in numbered.orderBy("i").collect()]
        assert n == 5000 and got == sorted(got, reverse=True)
        assert [r.i for r in numbered.orderBy("i").collect()] == list(range(5000))
        # the written rows only meet a broadcast table of sizes
        above = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_an_anchor_is_dealt_out_once_whatever_the_items(spark, tmp_path):
    from wardframe.operators import nearest

    anchors = spark.range(50).selectExpr("id key", "timestamp_ntz '2100-01-01' a", "repeat('x', 50) note")
    ev = spark.range(200).selectExpr(
        "id % 50 key", "cast(id % 7 as int) item", "timestamp_ntz '2100-01-01' + make_interval(0,0,0,0, cast(id % 9 as int) - 4) time",
        "cast(id as double) value")
    items = [*range(40)]
    near = nearest._neighbours(anchors, ev, ["key"], F.col("a"), items)
    assert near.count() == 50 and {len(r.near) for r in near.collect()} == {40}
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    # the items multiply no row and a time-ordered run is sorted once
    assert "Window" not in plan and "explode" not in plan and plan.count("Sort ") == 1


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_of_the_search_change_nothing(spark, monkeypatch, block):
    from wardframe.operators import nearest

    monkeypatch.setattr(nearest, "RUN_ROWS", 40)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
    at = "timestamp_ntz '2100-01-01' + make_interval(0,0,0,0, {})"
    # a null key, a null time, equal times, equal anchors and a null value
    anchors = spark.range(90).selectExpr("if(id % 9 = 8, null, id % 9) key", f"{at.format('cast(id % 5 as int)')} a", "id % 2 note")
    ev = spark.range(300).selectExpr(
        "if(id % 11 = 10, null, id % 11) key", "cast(id % 3 as int) item",
        f"if(id % 17 = 0, null, {at.format('cast(id % 13 as int) - 4')}) time", "if(id % 19 = 0, null, cast(id % 23 as double)) value")
    got = nearest_values(anchors, ev, ["key"], "a", {"x": 0, "y": 2, "z": 9}, presence=True).collect()
    known, rows = ev.collect(), set()
    for r in {tuple(r) for r in anchors.collect()}:
        out = []
        for item in (0, 2, 9):
            own = [e for e in known if e.key == r[0] and e.item == item]
            gaps = [abs((e.time - r[1]).total_seconds()) if e.time else 1e18 for e in own]
            best = [e.value for e, g in zip(own, gaps, strict=True) if g == min(gaps)]
            out.append((max((v for v in best if v is not None), default=None), bool(own)))
        rows.add((*r, *[v for v, _ in out], *[h for _, h in out]))
    assert len(got) == len(rows) and {tuple(r) for r in got} == rows
