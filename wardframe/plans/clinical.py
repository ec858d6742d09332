"""The cohort queries over clinical event tables.

Every function takes ``t``, a mapping from table name to DataFrame (see
``wardframe.sources.registry``), and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.functions import codes
from wardframe.functions.codemap import capped, differs, label_of
from wardframe.functions.times import days, hours, years
from wardframe.operators import cohort as co
from wardframe.operators.flags import (
    FlagSource, any_event_flag, culture_flag, duration_flag, event_rate, intake_flag, text_rules,
)
from wardframe.operators.nearest import nearest_rows, nearest_values
from wardframe.operators.ordered import first_rows
from wardframe.session import pin

Tables = Mapping[str, DataFrame]
KEYS = list(co.STAY_KEYS)
LAB_LABELS = list(dict.fromkeys(label for label, _ in codes.LAB_CODES.values()))


def lab_events(labs: DataFrame, lab_codes: Mapping[int, tuple[str, float]]) -> DataFrame:
    """Positive results of listed codes as (label, time, capped value)."""
    item, value = F.col("itemid"), F.col("valuenum")
    return labs.where(item.isin(*lab_codes) & (value > 0)).select(
        "subject_id",
        "hadm_id",
        label_of(item, {c: label for c, (label, _) in lab_codes.items()}).alias("item"),
        F.col("charttime").alias("time"),
        capped(item, value, {c: cap for c, (_, cap) in lab_codes.items()}).alias("value"),
    )


def labs_around_intime(
    t: Tables, lab_codes: Mapping[int, tuple[str, float]] = codes.LAB_CODES, span_hours: int = 24,
    skip_null: bool = False,
) -> DataFrame:
    """One row per stay: mortality flags and each lab nearest to ``intime``
    within the span.  A stay without labs keeps a row of NULLs.  A value above
    its cap holds its rank and yields NULL, unless ``skip_null`` is set."""
    stays = co.mortality_flags(t["icustays"].select(*KEYS, "intime", "outtime"), t["admissions"])
    labels = list(dict.fromkeys(label for label, _ in lab_codes.values()))
    intime = F.col("intime")
    wide = nearest_values(
        stays,
        lab_events(t["labevents"], lab_codes),
        ["subject_id", "hadm_id"],
        "intime",
        {label: label for label in labels},
        (intime - hours(span_hours), intime + hours(span_hours)),
        skip_null=skip_null,
    )
    return wide.select(*KEYS, "mort_icu", "mort_hosp", "mort_30", *labels)


def labs_by_admission_distance(
    t: Tables, lab_codes: Mapping[int, tuple[str, float]] = codes.LAB_CODES, span_hours: int = 24
) -> DataFrame:
    """Long form: labs around ``intime`` ranked by distance to admission, one
    row per stay and chart time holding a first rank."""
    stays = co.mortality_flags(
        t["icustays"].select(*KEYS, "intime", "outtime"), t["admissions"], "admittime"
    )
    labels = list(dict.fromkeys(label for label, _ in lab_codes.values()))
    intime = F.col("intime")
    rows = nearest_rows(
        stays,
        lab_events(t["labevents"], lab_codes),
        ["subject_id", "hadm_id"],
        "admittime",
        (intime - hours(span_hours), intime + hours(span_hours)),
        {label: label for label in labels},
    )
    return rows.select(
        F.lit(1).cast("long").alias("lab_test_rank"), *KEYS,
        "mort_icu", "mort_hosp", "mort_30", "charttime", *labels,
    )


def _chart_events(charts: DataFrame, items: Sequence[int], keys: Sequence[str]) -> DataFrame:
    return charts.where(F.col("itemid").isin(*items)).select(
        *keys, F.col("itemid").alias("item"), F.col("charttime").alias("time"), F.col("valuenum").alias("value")
    )


def nearest_charts(t: Tables, groups: Mapping[str, Sequence[int]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per stay and charted item ``i<item>``, the value nearest to ``intime``
    over the whole stay, and whether there is one (``has_i<item>``)."""
    items = list(chain.from_iterable(groups.values()))
    return nearest_values(
        t["icustays"].select(*keys, "intime"),
        _chart_events(t["chartevents"], items, keys),
        keys,
        "intime",
        {f"i{item}": item for item in items},
        presence=True,
    )


def largest_of(groups: Mapping[str, Sequence[int]]) -> list:
    """The largest of the nearest values of each group's items."""
    return [F.array_max(F.array(*[f"i{i}" for i in items])).alias(n) for n, items in groups.items()]


def nearest_vitals(
    t: Tables, vitals: Mapping[str, Sequence[int]] = codes.VITAL_CODES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Nearest value per charted item, then the largest over the items of a
    vital sign; stays without any listed item have no row."""
    near = nearest_charts(t, vitals, keys)
    charted = " OR ".join(f"has_i{i}" for i in chain.from_iterable(vitals.values()))
    return near.where(charted).select(*keys, *largest_of(vitals))


def nearest_liver(
    t: Tables, enzymes: Mapping[str, Sequence[int]] = codes.LIVER_CODES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Nearest value per charted item over the whole stay, one row per item,
    with one column per enzyme."""
    near = nearest_charts(t, enzymes, keys)
    rows = [
        f"CASE WHEN has_i{i} THEN named_struct('itemid', {i}, "
        + ", ".join(f"'{n}', {f'i{i}' if i in members else 'CAST(NULL AS DOUBLE)'}" for n, members in enzymes.items())
        + ") END"
        for i in chain.from_iterable(enzymes.values())
    ]
    charted = F.expr(f"explode(filter(array({', '.join(rows)}), r -> r IS NOT NULL))")
    return near.select(*keys, charted.alias("r")).select(*keys, "r.*")


def best_per_stay(liver: DataFrame, enzyme: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return liver.where(F.col(enzyme).isNotNull()).groupBy(*keys).agg(F.max(enzyme).alias(enzyme))


def renal_replacement(t: Tables) -> DataFrame:
    """Renal replacement per stay from seven event sources."""
    item = F.col("itemid")
    old_items = [i for items, _ in codes.RRT_TEXT_RULES for i in items]
    not_error = differs(F.col("error"), 1)
    old_text = item.isin(*old_items) & text_rules(item, F.col("value"), codes.RRT_TEXT_RULES)
    sources = [
        FlagSource(t["chartevents"], old_text & not_error, F.col("dbsource") == "carevue"),
        FlagSource(t["inputevents_cv"], item.isin(*codes.RRT_INTAKE_OLD) & (F.col("amount") > 0)),
        FlagSource(t["outputevents"], item.isin(*codes.RRT_OUTPUT_OLD) & (F.col("value") > 0)),
        FlagSource(t["chartevents"], item.isin(*codes.RRT_CHART_NEW) & (F.col("valuenum") > 0) & not_error),
        FlagSource(t["inputevents_mv"], item.isin(*codes.RRT_INTAKE_NEW) & (F.col("amount") > 0)),
        FlagSource(t["datetimeevents"], item.isin(*codes.RRT_DATES_NEW)),
        FlagSource(t["procedureevents_mv"], item.isin(*codes.RRT_PROCEDURES_NEW)),
    ]
    return any_event_flag(t["icustays"], sources, "icustay_id", "rrt", KEYS)


def renal_replacement_rate(t: Tables, rrt: DataFrame, first_stay_only: bool = False) -> DataFrame:
    """Share of stays (or first stays) older than one year with the flag."""
    stays = t["icustays"].select(*KEYS, "intime").join(t["patients"].select("subject_id", "dob"), "subject_id")
    grown = stays.where(F.col("dob") < F.col("intime") - years(1))
    known = grown.join(t["admissions"].select("hadm_id"), "hadm_id", "left_semi")
    flagged = known.join(rrt.select("icustay_id", "rrt"), "icustay_id")
    if first_stay_only:
        flagged = first_rows(flagged, ["subject_id"], ["intime", "icustay_id"])
    return event_rate(flagged, "rrt")


def _treatment_features(t: Tables, red_cell_name: str) -> list[tuple[DataFrame, list[str]]]:
    mv, cv = t["inputevents_mv"], t["inputevents_cv"]
    return [
        (t["sofa"].select(*KEYS, "sofa"), KEYS),
        (culture_flag(t["microbiologyevents"], ["subject_id", "hadm_id"], "BLOOD CULTURE", "p_blood_culture_1"),
         ["subject_id", "hadm_id"]),
        (intake_flag([(mv, codes.RED_CELLS[0]), (cv, codes.RED_CELLS[1])], KEYS, red_cell_name), KEYS),
        (intake_flag([(mv, codes.PLATELETS[0]), (cv, codes.PLATELETS[1])], KEYS, "platelet_1"), KEYS),
        (duration_flag(t["vasopressordurations"], ["icustay_id"], "vasopressor_1"), ["icustay_id"]),
        (duration_flag(t["ventdurations"], ["icustay_id"], "ventilation_1"), ["icustay_id"]),
    ]


EVENT_KEYS = {
    "icustay_id": (
        "chartevents", "inputevents_mv", "inputevents_cv", "outputevents", "datetimeevents",
        "procedureevents_mv", "sofa", "vasopressordurations", "ventdurations", "bloodgasfirstdayarterial",
    ),
    "hadm_id": ("admissions", "labevents", "microbiologyevents", "elixhauser_quan"),
}


def _cohort_tables(t: Tables, cohort: DataFrame) -> Tables:
    """The tables reduced to the cohort before any event is aggregated; how the
    ids reach the events is left to the optimiser."""
    small = {"icustays": t["icustays"].join(cohort.select(*KEYS).distinct(), KEYS, "left_semi")}
    for key, names in EVENT_KEYS.items():
        ids = cohort.select(key).distinct()
        small |= {n: t[n].join(ids, key, "left_semi") for n in names if n in t}
    return {**t, **small}


def first_day_gas(t: Tables) -> DataFrame:
    return t["bloodgasfirstdayarterial"].groupBy("icustay_id").agg(
        *[F.max(c).alias(f"abg_{c}") for c in codes.BLOOD_GAS]
    )


def select_cohort(t: Tables) -> DataFrame:
    """Stays with a malignancy, with every exclusion flagged (final preset)."""
    frame = co.stay_frame(t["icustays"], t["patients"])
    service = co.latest_service(t["icustays"], t["services"]).select("icustay_id", "surgical")
    kinds = co.phenotype(t["diagnoses_icd"], codes.MALIGNANCY_TYPES)
    joined = frame.join(service, "icustay_id").join(kinds, "hadm_id")
    return co.flag_exclusions(joined, co.exclusion_rules(min_days=1, min_age=16))


def final_cohort(t: Tables, of_admissions: Callable[[DataFrame], Tables] | None = None) -> DataFrame:
    """The wide feature table: labs, enzymes, vitals, treatments, blood gas,
    comorbidities, demographics and diagnosis type of the cohort's stays.

    Tables that are joins themselves may be made from the cohort's admissions
    alone: ``of_admissions`` gets their ids and returns the tables with at least
    the rows of these admissions.
    """
    applied = ["exclusion_1st_care_unit", "exclusion_age", "exclusion_first_stay"]
    # the cohort is read by every feature below, so it is written once
    cohort = pin(co.apply_exclusions(select_cohort(t), applied))
    if of_admissions is not None:
        t = of_admissions(cohort.select("hadm_id").distinct())
    t = _cohort_tables(t, cohort)
    # vital signs and enzymes come from one pass over the charts
    charted = {**codes.VITAL_CODES, **codes.LIVER_CODES}
    features = [
        (labs_around_intime(t), KEYS),
        (nearest_charts(t, charted).select(*KEYS, *largest_of(charted)), KEYS),
        (renal_replacement(t), KEYS),
        *_treatment_features(t, "rbc_1"),
        (first_day_gas(t), ["icustay_id"]),
        (t["elixhauser_quan"].select("hadm_id", *codes.COMORBIDITIES), ["hadm_id"]),
    ]
    return co.star_join(cohort, features).select(
        *KEYS, "mort_icu", "mort_hosp", "mort_30", *LAB_LABELS,
        "ast", "alt", "rrt", "sofa",
        "p_blood_culture_1", "rbc_1", "platelet_1", "vasopressor_1", "ventilation_1",
        "heart_rate", "respiration", "arterial_bp_mean", "arterial_bp_systolic", "arterial_bp_diastolic",
        "temperature", *[f"abg_{c}" for c in codes.BLOOD_GAS], *codes.COMORBIDITIES,
        "age", "gender", "icu_length_of_stay", "hm_indicator", "d_type",
    )


MALIGNANCY_PREFIXES = tuple(chain.from_iterable(p for p, _ in codes.MALIGNANCY_TYPES.values()))


def _dictionary_cohort(t: Tables, titles: Sequence[str], min_days: float, min_age: float) -> DataFrame:
    frame = co.stay_frame(t["icustays"], t["patients"])
    service = co.latest_service(t["icustays"], t["services"], "left").select("icustay_id", "surgical")
    coded = co.dictionary_diagnoses(t["diagnoses_icd"], t["d_icd_diagnoses"], MALIGNANCY_PREFIXES, titles)
    hits = coded.where(F.col("hm") == 1).drop("hm")
    joined = frame.join(service, "icustay_id").join(hits, "hadm_id")
    return co.flag_exclusions(joined, co.exclusion_rules(min_days, min_age))


def view_cohort(t: Tables) -> DataFrame:
    """The earlier cohort view: one row per stay and matching diagnosis code,
    non-surgical stays of at least a day."""
    applied = ["exclusion_1st_care_unit", "exclusion_los", "exclusion_age", "exclusion_surgical"]
    cohort = pin(co.apply_exclusions(_dictionary_cohort(t, (), min_days=1, min_age=1), applied))
    t = _cohort_tables(t, cohort)
    features = [
        (nearest_charts(t, codes.LIVER_CODES).select(*KEYS, *largest_of(codes.LIVER_CODES)), KEYS),
        (renal_replacement(t), KEYS),
        *_treatment_features(t, "rcb_1"),
    ]
    return co.star_join(cohort, features).select(
        *KEYS, "ast", "alt", "rrt", "sofa", "p_blood_culture_1", "rcb_1", "platelet_1",
        "vasopressor_1", "ventilation_1", "age", "gender", "icu_length_of_stay", "icd9_code",
    )


def long_cohort(t: Tables) -> DataFrame:
    """Long form: labs per chart time with diagnosis titles and all exclusion
    flags computed, none applied."""
    joined = _dictionary_cohort(t, ("short_title", "long_title"), min_days=2, min_age=16)
    flags = [r.name for r in co.exclusion_rules(2, 16)]
    labs = labs_by_admission_distance(t)
    return joined.join(labs, KEYS).select(
        *labs.columns, "age", "gender", "icustay_id_order", "icu_length_of_stay", "icd9_code",
        F.col("short_title").alias("icd9_name"), F.col("long_title").alias("icd9_descr"), *flags,
    )
