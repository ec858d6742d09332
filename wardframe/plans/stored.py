"""Queries through files, stores, views, reports and whole code lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardframe.functions.codes import UNITS_TO_SI
from wardframe.operators import prep, tableone
from wardframe.plans import clinical
from wardframe.plans import standins as st
from wardframe.plans.queries import query, rounded
from wardframe.plans.views import View, ViewGraph
from wardframe.session import shared_dir
from wardframe.sources.csv import number, read_csv, read_named_csv, write_csv
from wardframe.sources.registry import materialize
from wardframe.sources.store import event_store

SUPPLIER = "s_suppkey long, s_name string, s_acctbal double"


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _written(spark, sf) -> str:
    path = _scratch(spark)
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")
    write_csv(suppliers, path, [F.col("s_suppkey").asc()])
    return path


@query
def csv_indexed(spark, sf):
    """A table written as CSV with its row index and read back with types."""
    return read_csv(spark, _written(spark, sf), SUPPLIER)


@query
def csv_named(spark, sf):
    """The same file with columns named by the caller; text cells to numbers."""
    rows = read_named_csv(spark, _written(spark, sf), ["i", "key", "name", "balance"])
    return rows.select(number("key").cast("long").alias("key"), "name", F.round(number("balance"), 2).alias("balance"))


@query
def view_replaced(spark, sf):
    """A materialized view, dropped and created again with other rows."""
    path, name = _scratch(spark), f"nations_{uuid.uuid4().hex}"
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    materialize(nations, name, path)
    materialize(nations.where("n_regionkey = 1").select("n_nationkey", "n_name"), name, path)
    return spark.sql(f"SELECT * FROM {name}")


def _report(spark, sf):
    rows = prep.fill_zero(st.model_table(spark, sf), ["toxic"])
    report = tableone.table_one(rows, [*st.DOC_FEATURES, "toxic", "site"], ["toxic", "site"], "label")
    return report


@query
def report_by_label(spark, sf):
    """Report headings picked by their label."""
    picked = tableone.pick_rows(_report(spark, sf), ["digit_share (median [IQR])", "toxic (n (%))"])
    return picked.select("row_idx", "features", "missing")


@query
def report_by_position(spark, sf):
    """Report rows picked by their position."""
    return tableone.rows_at(_report(spark, sf), [0, 2, 4]).select("row_idx", "features", "missing", "group_0", "group_1")


@query
def tableone_rows(spark, sf):
    """The whole report but its tests, which kruskal_h and chi2_stat cover."""
    return _report(spark, sf).drop("pval", "test")


@query
def si_units(spark, sf):
    """Creatinine, bilirubin, urea and temperature in SI units."""
    values = st.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[
        F.col(c).cast("double").alias(n)
        for n, c in (("creatinine", "l_tax"), ("bilirubin", "l_discount"), ("urea", "l_quantity"), ("temperature", "l_quantity"))
    ])
    return rounded(prep.convert_units(values, UNITS_TO_SI), *UNITS_TO_SI)


@query
def renal_replacement_codes(spark, sf):
    """Every renal code of every source, each on a stay of its own."""
    return clinical.renal_replacement(st.renal_lines(spark, sf))


# --- the bucketed store and the graph of views ------------------------------------------

ADMISSION = ["subject_id", "hadm_id"]
BUCKETS = 8
NEW_EVENTS = "2024-01-25"


@query
def labs_from_store(spark, sf):
    """Labs nearest to entry, read from tables bucketed by admission."""
    tables = event_store(st.event_tables(spark, sf), ADMISSION, BUCKETS)
    return clinical.labs_around_intime(tables, st.EVENT_LABS)


def _lab_counts(t):
    return t["labevents"].groupBy(*ADMISSION).agg(F.count("*").alias("n_labs"), F.max("charttime").alias("last_lab"))


#: Declared from the last to the first.
STAY_VIEWS = {
    "summary": View(("stay_labs", "lab_counts"), lambda t: t["stay_labs"].join(t["lab_counts"], ADMISSION, "left")),
    "lab_counts": View(("labevents",), _lab_counts),
    "stay_labs": View(("icustays", "admissions", "labevents"), lambda t: clinical.labs_around_intime(t, st.EVENT_LABS)),
}


@query
def views_refreshed(spark, sf):
    """Views built on early events, then refreshed for the admissions that
    later stays and labs touch."""
    now = st.event_tables(spark, sf)
    late = {"icustays": F.col("intime") >= NEW_EVENTS, "labevents": F.col("charttime") >= NEW_EVENTS}
    graph = ViewGraph(STAY_VIEWS, ADMISSION)
    graph.build(now | {n: now[n].where(~rows) for n, rows in late.items()})
    touched = [now[n].where(rows).select(*ADMISSION) for n, rows in late.items()]
    graph.refresh(now, late, touched[0].unionByName(touched[1]))
    return graph.read("summary", spark)
