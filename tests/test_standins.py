"""The cohort queries over small star-schema tables of their own."""

from datetime import datetime, timedelta

import pytest

from wardframe.operators import cohort as co
from wardframe.plans import clinical, queries
from wardframe.plans import standins as st

DAY = datetime(1996, 3, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("star")
    rows = {
        "customer": [(c, f"c{c}", 1, 9000.0 + c, "BUILDING") for c in range(300)],
        "part": [(p, f"p{p}", "b", "t", 5, 1.0) for p in range(600)],
        "orders": [
            (o, o, "FOP"[o % 3], 90_000.0 + 5_000 * (o % 40), DAY + timedelta(days=o % 50), ("1-URGENT", "5-LOW")[o % 2])
            for o in range(300)
        ],
        # an order and an admission share a number, and so do diagnoses
        "lineitem": [
            (o, 500 + (o * 7 + n) % 12, (o * 3 + n) % 40, n, 10.0 + (o + 9 * n) % 35, 900.0, 0.01 * (n % 10), 0.01 * (o % 9),
             "RAN"[(o + n) % 3], "OF"[o % 2], DAY + timedelta(days=o % 50 + n))
            for o in range(320) for n in range(1, 6)
        ],
    }
    for name, own in rows.items():
        spark.createDataFrame(own, st.SCHEMAS[name]).write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_tables_of_some_admissions_hold_these_alone(spark, folder):
    whole = st.clinical_tables(spark, folder)
    ids = whole["icustays"].where("icustay_id % 7 = 0").select("hadm_id").distinct()
    some = st.clinical_tables(spark, folder, ids)
    for name in ("icustays", "labevents", "chartevents", "microbiologyevents", "inputevents_mv"):
        want = whole[name].join(ids, "hadm_id", "left_semi").select(*whole[name].columns)
        assert sorted(map(str, some[name].collect())) == sorted(map(str, want.collect())) != []


def test_final_cohort_asks_for_its_own_admissions(spark, folder):
    tables, asked = st.clinical_tables(spark, folder), []

    def of_admissions(ids):
        asked.extend(r.hadm_id for r in ids.collect())
        return st.clinical_tables(spark, folder, ids)

    tables["diagnoses_icd"] = tables["labevents"].selectExpr("hadm_id", "1 seq_num", "'2020' icd9_code").where("hadm_id % 3 = 1")
    whole = clinical.final_cohort(tables).collect()
    some = clinical.final_cohort(tables, of_admissions).collect()
    assert sorted(map(str, some)) == sorted(map(str, whole)) != []
    assert set(asked) == {r.hadm_id for r in whole} and len(asked) < tables["icustays"].select("hadm_id").distinct().count()


def test_star_searches_the_charts_of_its_cohort(spark, folder, monkeypatch):
    seen, search = [], clinical.nearest_charts

    def nearest_charts(t, *rest):
        seen.append({n: {r.icustay_id for r in df.collect()} for n, df in t.items()})
        return search(t, *rest)

    kinds = st.order_diagnoses(spark, folder).selectExpr("hadm_id * 10 + 1 AS hadm_id", "1 seq_num", "'2020' icd9_code").distinct()
    monkeypatch.setattr(st, "order_diagnoses", lambda *_: kinds)
    monkeypatch.setattr(clinical, "nearest_charts", nearest_charts)
    ids = {r.icustay_id for r in queries._star(spark, folder).select("icustay_id").collect()}
    cohort = co.apply_exclusions(queries._cohort(spark, folder), queries.APPLIED)
    assert ids == {r.icustay_id for r in cohort.collect()} and 0 < len(ids) < 300
    assert seen == [{"icustays": ids, "chartevents": ids}]
