"""One fixture per semantic trap of the clinical queries."""

from datetime import timedelta

import pytest
from clinic import T0, admission, at, chart, clinic, lab, stay

from wardframe.functions.codes import MALIGNANCY_TYPES
from wardframe.operators import cohort as co
from wardframe.operators.flags import culture_flag
from wardframe.plans import clinical


def labs(spark, rows, **stays):
    t = clinic(spark, icustays=[stay(100, **stays)], labevents=rows, admissions=[admission()])
    return clinical.labs_around_intime(t).collect()


def test_equal_distance_takes_the_largest(spark):
    assert labs(spark, [lab(-1, 5.0), lab(1, 9.0)])[0].creatinine == 9.0


def test_capped_value_keeps_its_rank(spark):
    assert labs(spark, [lab(1, 200.0), lab(2, 3.0)])[0].creatinine is None


def test_stay_without_labs_keeps_a_row(spark):
    (row,) = labs(spark, [])
    assert all(row[label] is None for label in clinical.LAB_LABELS)


def test_window_edge_is_inside(spark):
    edge = lab(0, 4.0) | {"charttime": T0 + timedelta(hours=24)}
    past = lab(0, 5.0, item=50813) | {"charttime": T0 + timedelta(hours=24, microseconds=1)}
    (row,) = labs(spark, [edge, past])
    assert (row.creatinine, row.lactate) == (4.0, None)


def test_zero_and_unlisted_results_are_ignored(spark):
    (row,) = labs(spark, [lab(1, 0.0), lab(2, 7.0), lab(1, 3.0, item=1)])
    assert row.creatinine == 7.0


def test_mortality_flags(spark):
    for death, expected in ((None, (0, 0, 0)), (48.0, (1, 1, 1)), (49.0, (0, 1, 1)), (24 * 31.0, (0, 0, 0))):
        t = clinic(spark, icustays=[stay(100)], admissions=[admission(death=death)])
        row = clinical.labs_around_intime(t).first()
        assert (row.mort_icu, row.mort_hosp, row.mort_30) == expected


def test_long_form_ranks_by_distance_to_admission(spark):
    # admission lies 5 hours before entry: -3h beats +1h, and ties give two rows
    t = clinic(
        spark, icustays=[stay(100), stay(101, hadm=11)], admissions=[admission(), admission(hadm=11)],
        labevents=[lab(-3, 2.0), lab(1, 9.0), lab(-7, 4.0), lab(-6, 1.0, item=50813)],
    )
    rows = clinical.labs_by_admission_distance(t).orderBy("icustay_id", "charttime").collect()
    assert [(r.icustay_id, r.charttime, r.creatinine, r.lactate) for r in rows] == [
        (100, at(-7), 4.0, None), (100, at(-6), None, 1.0), (100, at(-3), 2.0, None), (101, None, None, None),
    ]


def test_long_form_without_admission_keeps_every_lab(spark):
    t = clinic(spark, icustays=[stay(100)], labevents=[lab(-3, 2.0), lab(1, 9.0), lab(30, 1.0)])
    rows = clinical.labs_by_admission_distance(t).orderBy("charttime").collect()
    assert [(r.charttime, r.creatinine) for r in rows] == [(at(-3), 2.0), (at(1), 9.0)]


def test_vitals_take_the_largest_over_items(spark):
    charts = [chart(223761, 1, num=98.0), chart(223761, 9, num=105.0), chart(678, -3, num=99.0)]
    t = clinic(spark, icustays=[stay(100), stay(101)], chartevents=charts)
    rows = clinical.nearest_vitals(t).collect()
    assert [(r.icustay_id, r.temperature, r.heart_rate) for r in rows] == [(100, 99.0, None)]


def test_liver_has_a_row_per_item_and_no_time_limit(spark):
    charts = [chart(769, 900, num=50.0), chart(220587, 1, num=None), chart(770, 2, num=7.0)]
    t = clinic(spark, icustays=[stay(100)], chartevents=charts)
    rows = {r.itemid: (r.ast, r.alt) for r in clinical.nearest_liver(t).collect()}
    assert rows == {769: (50.0, None), 220587: (None, None), 770: (None, 7.0)}
    assert clinical.best_per_stay(clinical.nearest_liver(t), "ast").first().ast == 50.0


def rrt(spark, **rows):
    t = clinic(spark, **rows)
    return {r.icustay_id: r.rrt for r in clinical.renal_replacement(t).collect()}


def test_renal_replacement_text_rules(spark):
    stays = [stay(i) for i in range(100, 107)] + [stay(107, source="metavision")]
    charts = [
        chart(152, value="any", stay_id=100),
        chart(229, value="Dialysis Line", stay_id=101),
        chart(229, value="PICC", stay_id=102),
        chart(7949, value="x", stay_id=103),  # scanned, but no rule counts it
        chart(582, value="CAVH Start", stay_id=104, error=1),
        chart(582, value="CAVH Start", stay_id=105, error=0),
        chart(152, value=None, stay_id=106),
        chart(152, value="any", stay_id=107),
    ]
    assert rrt(spark, icustays=stays, chartevents=charts) == {
        100: 1, 101: 1, 102: 0, 103: 0, 104: 0, 105: 1, 106: 0, 107: 0,
    }


def test_renal_replacement_other_sources(spark):
    stays = [stay(i, source="metavision") for i in range(100, 108)]
    rows = dict(
        inputevents_cv=[dict(icustay_id=100, itemid=40788, amount=1.0)],
        outputevents=[dict(icustay_id=101, itemid=40386, value=2.0)],
        chartevents=[chart(226499, num=5.0, stay_id=102), chart(226499, num=5.0, error=1, stay_id=103)],
        inputevents_mv=[dict(icustay_id=104, itemid=227536, amount=1.0), dict(icustay_id=107, itemid=227536, amount=0.0)],
        datetimeevents=[dict(icustay_id=105, itemid=225318)],
        procedureevents_mv=[dict(icustay_id=106, itemid=225441)],
    )
    assert rrt(spark, icustays=stays, **rows) == {
        100: 1, 101: 1, 102: 1, 103: 0, 104: 1, 105: 1, 106: 1, 107: 0,
    }


def test_renal_replacement_rate(spark):
    t = clinic(
        spark,
        icustays=[stay(100), stay(101, intime=90), stay(102, subject=2, hadm=11), stay(103, subject=3, hadm=12)],
        patients=[dict(subject_id=s, dob=at(-24 * 3650)) for s in (1, 2)] + [dict(subject_id=3, dob=at(-24))],
        admissions=[admission(), admission(hadm=11, subject=2), admission(hadm=12, subject=3)],
        procedureevents_mv=[dict(icustay_id=101, itemid=225441), dict(icustay_id=102, itemid=225441)],
    )
    flags = clinical.renal_replacement(t)
    assert tuple(clinical.renal_replacement_rate(t, flags).first()) == (3, 2, pytest.approx(200 / 3))
    assert tuple(clinical.renal_replacement_rate(t, flags, True).first()) == (2, 1, 50.0)


def transfer(hours, service="MED", hadm=10):
    return dict(hadm_id=hadm, curr_service=service, transfertime=at(hours))


def services(spark, stays, moves, how):
    t = clinic(spark, icustays=stays, services=moves)
    rows = co.latest_service(t["icustays"], t["services"], how).collect()
    return sorted((r.icustay_id, r.curr_service, r.surgical) for r in rows)


def test_service_rank_runs_over_the_admission(spark):
    # the second transfer is visible to the later stay only
    stays = [stay(100), stay(101, intime=100, outtime=120)]
    moves = [transfer(1, "CSURG"), transfer(90, "ORTHO")]
    assert services(spark, stays, moves, "inner") == [(101, "ORTHO", 1)]
    assert services(spark, stays, moves, "left") == [(101, "ORTHO", 1)]


def test_stay_without_transfer_displaces_its_siblings(spark):
    stays = [stay(100), stay(101, intime=100, outtime=120)]
    moves = [transfer(90, "MED")]
    assert services(spark, stays, moves, "inner") == [(101, "MED", 0)]
    assert services(spark, stays, moves, "left") == [(100, None, 0)]


def test_service_ties_and_the_open_edge(spark):
    moves = [transfer(3, "MED"), transfer(3, "NSURG"), transfer(12, "ORTHO")]
    assert services(spark, [stay(100)], moves, "inner") == [(100, "MED", 0), (100, "NSURG", 1)]


def diagnosis(code, seq, hadm=10):
    return dict(hadm_id=hadm, seq_num=seq, icd9_code=code)


def test_phenotype(spark):
    t = clinic(
        spark,
        diagnoses_icd=[
            diagnosis("20280", 3), diagnosis("20300", 1),  # primary beats secondary
            diagnosis("20300", 2, 11), diagnosis("23872", 3, 11),  # alphabetical last wins
            diagnosis("2000", 2, 12), diagnosis("020", 1, 12), diagnosis(None, 1, 13), diagnosis("23871", 1, 14),
        ],
    )
    rows = co.phenotype(t["diagnoses_icd"], MALIGNANCY_TYPES).collect()
    assert sorted(map(tuple, rows)) == [(10, 1, "myeloma"), (11, 2, "myeloma"), (12, 2, "lymphoma")]


def test_dictionary_keeps_a_row_per_code(spark):
    t = clinic(
        spark,
        diagnoses_icd=[diagnosis("20280", 1), diagnosis("20300", 2), diagnosis("20410", 3), diagnosis("None", 4)],
        d_icd_diagnoses=[dict(icd9_code=c, short_title=c) for c in ("20280", "20300", "None")],
    )
    coded = co.dictionary_diagnoses(t["diagnoses_icd"], t["d_icd_diagnoses"], clinical.MALIGNANCY_PREFIXES)
    assert sorted((r.icd9_code, r.hm) for r in coded.collect()) == [("20280", 1), ("20300", 1), ("None", 0)]


def test_culture_flag_is_raised_by_an_empty_culture(spark):
    rows = [
        dict(subject_id=1, hadm_id=10, spec_type_desc="BLOOD CULTURE"),
        dict(subject_id=1, hadm_id=11, spec_type_desc="BLOOD CULTURE", org_itemid=80002),
        dict(subject_id=1, hadm_id=12, spec_type_desc="URINE"),
    ]
    t = clinic(spark, microbiologyevents=rows)
    flags = culture_flag(t["microbiologyevents"], ["hadm_id"], "BLOOD CULTURE", "p")
    assert sorted(map(tuple, flags.collect())) == [(10, 1), (11, 0)]


@pytest.fixture(scope="module")
def ward(spark):
    """Five subjects, of which the first has two stays."""
    return clinic(
        spark,
        icustays=[
            stay(100), stay(101, intime=60, outtime=90), stay(102, 20, 2, unit="SICU"), stay(103, 30, 3),
            stay(104, 40, 4, outtime=12), stay(105, 50, 5),
        ],
        patients=[dict(subject_id=s, gender="M", dob=at(-24 * 365.242 * a)) for s, a in
                  ((1, 50), (2, 50), (3, 10), (4, 50), (5, 50))],
        admissions=[admission(10 * s, s) for s in range(1, 6)],
        services=[transfer(1, "MED", 10 * s) for s in range(1, 5)] + [transfer(1, "CSURG", 50)],
        diagnoses_icd=[diagnosis("20280", 1, 10 * s) for s in range(1, 6)] + [diagnosis("20300", 2, 10)],
        d_icd_diagnoses=[dict(icd9_code="20280", short_title="s", long_title="l"), dict(icd9_code="20300")],
        labevents=[lab(1, 3.0), lab(2, 8.0, 51006)],
        chartevents=[chart(769, num=40.0), chart(220045, num=80.0), chart(152, value="x")],
        inputevents_mv=[dict(subject_id=1, hadm_id=10, icustay_id=100, itemid=225168, amount=1.0)],
        inputevents_cv=[dict(subject_id=1, hadm_id=10, icustay_id=100, itemid=30006, amount=2.0)],
        sofa=[dict(subject_id=1, hadm_id=10, icustay_id=100, sofa=7)],
        vasopressordurations=[dict(icustay_id=100, duration_hours=0.0)],
        ventdurations=[dict(icustay_id=100, duration_hours=3.0)],
        bloodgasfirstdayarterial=[dict(icustay_id=100, ph=7.3), dict(icustay_id=100, ph=7.4, lactate=2.0)],
        elixhauser_quan=[dict(hadm_id=10, hypertension=1, peptic_ulcer=0)],
        microbiologyevents=[dict(subject_id=1, hadm_id=10, spec_type_desc="BLOOD CULTURE")],
    )


def test_final_cohort(ward):
    rows = {r.icustay_id: r for r in clinical.final_cohort(ward).collect()}
    # short stays and surgical service are flagged but not applied here
    assert sorted(rows) == [100, 104, 105]
    first = rows[100]
    assert (first.creatinine, first.bun, first.ast, first.heart_rate, first.rrt, first.sofa) == (3.0, 8.0, 40.0, 80.0, 1, 7)
    assert (first.rbc_1, first.platelet_1, first.vasopressor_1, first.ventilation_1) == (1, 1, 0, 1)
    assert (first.abg_ph, first.abg_lactate, first.hypertension, first.p_blood_culture_1) == (7.4, 2.0, 1, 1)
    assert (first.hm_indicator, first.d_type) == (1, "lymphoma")
    assert first.age == pytest.approx(50) and first.icu_length_of_stay == pytest.approx(2)
    assert rows[105].rrt == 0 and rows[105].rbc_1 is None


def test_view_cohort_fans_out_by_code(ward):
    rows = clinical.view_cohort(ward).collect()
    assert sorted((r.icustay_id, r.icd9_code) for r in rows) == [
        (100, "20280"), (100, "20300"), (101, "20280"), (101, "20300"), (103, "20280"),
    ]


def test_long_cohort_applies_no_exclusion(ward):
    rows = clinical.long_cohort(ward).collect()
    assert {r.icustay_id for r in rows} == {100, 101, 102, 103, 104, 105}
    assert {(r.icustay_id, r.exclusion_los) for r in rows} >= {(100, 0), (101, 1), (104, 1)}
    assert all(r.lab_test_rank == 1 for r in rows)


def test_attrition_counts_in_turn(ward):
    names = ["exclusion_1st_care_unit", "exclusion_age", "exclusion_first_stay"]
    rows = co.attrition(clinical.select_cohort(ward), names).orderBy("step").collect()
    assert [r.rows_left for r in rows] == [6, 5, 4, 3]
