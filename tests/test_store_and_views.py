"""Bucketed tables, the graph of views, and sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardframe.operators import sketches
from wardframe.operators.nearest import nearest_values
from wardframe.plans.views import View, ViewGraph
from wardframe.sources.store import event_store


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_tables_meet_without_a_shuffle(spark):
    rows = spark.range(2000).selectExpr("id % 50 AS subject_id", "cast(id % 7 as int) AS hadm_id", "id AS value", "timestamp_ntz '2024-01-01' AS charttime")
    stored = event_store({"a": rows, "b": rows.withColumnRenamed("value", "other"), "c": rows.select("value")}, ["subject_id", "hadm_id"], 4)
    per = stored["a"].groupBy("subject_id", "hadm_id", "value").count()
    assert shuffles(per) == 0 and per.count() == 2000
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = stored["a"].join(stored["b"], ["subject_id", "hadm_id"])
        assert shuffles(both) == 0
        assert both.count() == rows.join(rows.withColumnRenamed("value", "other"), ["subject_id"]).where("value % 7 = other % 7").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert stored["c"].count() == 2000


def test_equal_times_give_the_largest_value_across_cells(spark):
    at = dt.datetime(2024, 1, 10)
    events = [(1, "x", at - dt.timedelta(days=3), v) for v in (2.0, 9.0, None)] + [(1, "y", at + dt.timedelta(days=3), v) for v in (4.0, None, 7.0)]
    anchors = spark.createDataFrame([(1, at)], "k int, at timestamp_ntz")
    frame = spark.createDataFrame(events, "k int, item string, time timestamp_ntz, value double")
    row = nearest_values(anchors, frame, ["k"], "at", {"x": "x", "y": "y"}).first()
    assert (row.x, row.y) == (9.0, 7.0)


def plain_views():
    return {
        "top": View(("sums", "names"), lambda t: t["sums"].join(t["names"], "k", "left").select("k", "total", "name", "n")),
        "sums": View(("rows", "counts"), lambda t: t["rows"].groupBy("k").agg(F.sum("v").alias("total")).join(t["counts"], "k")),
        "counts": View(("rows",), lambda t: t["rows"].groupBy("k").agg(F.count("*").alias("n"))),
    }


def test_refresh_equals_rebuild(spark):
    draw = random.Random(4)
    first = [(draw.randrange(40), draw.randrange(9)) for _ in range(200)]
    # key 3 loses its rows, keys 50 and 51 are new, some old keys get more
    later = [r for r in first if r[0] != 3] + [(50, 1), (51, 2), (5, 100), (6, 100)]
    names = spark.createDataFrame([(k, f"n{k}") for k in range(0, 60, 2)], "k int, name string")
    old, new = (spark.createDataFrame(rows, "k int, v int") for rows in (first, later))
    graph = ViewGraph(plain_views(), ["k"], buckets=8)
    assert graph.order == ["counts", "sums", "top"]
    graph.build({"rows": old, "names": names})
    before = dict(graph.current["top"])
    touched = spark.createDataFrame([(k,) for k in (3, 50, 51, 5, 6, 5, 99)], "k int")
    assert graph.refresh({"rows": new, "names": names}, ["rows"], touched) == ["counts", "sums", "top"]
    whole = ViewGraph(plain_views(), ["k"], buckets=3)
    whole.build({"rows": new, "names": names})
    for name in graph.order:
        assert sorted(graph.read(name, spark).collect(), key=repr) == sorted(whole.read(name, spark).collect(), key=repr)
    # buckets that no touched key falls into stay where they were
    kept = {b for held in before.values() for b in held} & {b for v, held in graph.current["top"].items() if v in before for b in held}
    assert kept and sum(len(held) for held in graph.current["top"].values()) == 8
    assert graph.refresh({"rows": new, "names": names}, ["names"], touched) == ["top"]


def test_views_that_read_each_other_are_refused():
    with pytest.raises(ValueError, match="read each other"):
        ViewGraph({"a": View(("b",), None), "b": View(("a",), None)}, ["k"])


def test_merged_sketches_equal_the_sketch_of_all_rows_within_the_bound(spark):
    rows = spark.range(30000).selectExpr("id % 5 AS part", "cast(pmod(id * 7919, 30011) as double) AS x", "if(id % 3 = 0, null, cast(id % 100 as double)) AS y")
    parts = sketches.column_sketches(rows, ["x", "y"], ["part"])
    assert parts.count() == 10
    found = {r.variable: r for r in sketches.sketched_distincts(sketches.sketched_quantiles(sketches.merged_sketches(parts), [0.25, 0.5])).collect()}
    assert (found["x"].n, found["y"].n) == (30000, 20000)
    assert abs(found["x"].q0 / 30011 - 0.25) <= sketches.KLL_ERROR and abs(found["x"].q1 / 30011 - 0.5) <= sketches.KLL_ERROR
    assert abs(found["x"].n_distinct - 30000) <= sketches.HLL_ERROR * 30000 and found["y"].n_distinct == 100


def test_service_rank_within_the_stay_and_skipped_nulls(spark):
    from wardframe.operators.cohort import latest_service

    day = dt.datetime(2024, 1, 10)
    stays = spark.createDataFrame([(1, 10, day), (1, 11, day + dt.timedelta(days=2)), (2, 20, day)], "hadm_id long, icustay_id long, intime timestamp_ntz")
    moves = [(1, "MED", day), (1, "CSURG", day + dt.timedelta(days=1)), (1, "NMED", day + dt.timedelta(days=1)), (1, "VSURG", day + dt.timedelta(days=9)), (2, "MED", day + dt.timedelta(hours=12))]
    services = spark.createDataFrame(moves, "hadm_id long, curr_service string, transfertime timestamp_ntz")
    own = {(r.icustay_id, r.curr_service, r.surgical) for r in latest_service(stays, services, "left", partition_by="icustay_id").collect()}
    # at exactly the reach a transfer is not seen yet
    assert own == {(10, "MED", 0), (11, "CSURG", 1), (11, "NMED", 0), (20, None, 0)}
    assert {r.icustay_id for r in latest_service(stays, services, partition_by="icustay_id").collect()} == {10, 11}
    with pytest.raises(ValueError, match="hadm_id or icustay_id"):
        latest_service(stays, services, partition_by="subject_id")
    anchors = spark.createDataFrame([(1, day)], "k int, at timestamp_ntz")
    events = [(1, "x", day + dt.timedelta(hours=1), None), (1, "x", day - dt.timedelta(hours=3), 5.0)]
    frame = spark.createDataFrame(events, "k int, item string, time timestamp_ntz, value double")
    assert nearest_values(anchors, frame, ["k"], "at", {"x": "x"}).first().x is None
    assert nearest_values(anchors, frame, ["k"], "at", {"x": "x"}, skip_null=True).first().x == 5.0
