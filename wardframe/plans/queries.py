"""The registered queries: every operator over the whole stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.functions.codemap import capped, differs, flag, is_surgical, label_of, prefix_match
from wardframe.functions.times import date_years_between, hours, seconds_between
from wardframe.operators import cohort as co
from wardframe.operators import boosting, folds, metrics, models, prep, profile, sketches, tableone, validate
from wardframe.operators.flags import (
    FlagSource, any_event_flag, culture_flag, duration_flag, event_rate, ids_with, intake_flag, text_rules,
)
from wardframe.operators.fits import Fit
from wardframe.operators.nearest import interval_join
from wardframe.operators.ordered import exact_quantiles, first_rows, long_values, ranked, row_index
from wardframe.operators.penalised import L1Logistic
from wardframe.plans import clinical
from wardframe.plans import standins as st
from wardframe.session import pin
from wardframe.sources.csv import reindex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- projections, predicates, code maps -------------------------------------


@query
def code_filter(spark, sf):
    """Code set and positive value, both pushed to the scan."""
    items = st.table(spark, sf, "lineitem")
    kept = items.where(F.col("l_linenumber").isin(1, 3, 5) & (F.col("l_quantity") > 25))
    return kept.groupBy(F.col("l_linenumber").alias("itemid")).agg(
        F.count("*").alias("n"), F.max("l_quantity").alias("max_value"), F.min("l_quantity").alias("min_value")
    )


@query
def label_map_cap(spark, sf):
    """Item codes to labels, values above the item's cap to NULL."""
    codes = st.EVENT_LABS
    labs = st.event_labs(spark, sf).select(
        label_of(F.col("itemid"), {c: label for c, (label, _) in codes.items()}).alias("label"),
        capped(F.col("itemid"), F.col("valuenum"), {c: cap for c, (_, cap) in codes.items()}).alias("v"),
    )
    return labs.groupBy("label").agg(F.count("*").alias("n"), F.count("v").alias("n_kept"), F.max("v").alias("max_v"))


@query
def suffix_like(spark, sf):
    moves = st.order_services(spark, sf).withColumn("surgical", is_surgical(F.col("curr_service")))
    return moves.groupBy("curr_service", "surgical").agg(F.count("*").alias("n"))


@query
def prefix_phenotype(spark, sf):
    """Three-character prefix or whole code, not flagged for the text 'None'."""
    code = F.col("icd9_code")
    hit = flag((code != "None") & prefix_match(code, ("200", "201", "202"), ("2387",)))
    return st.order_diagnoses(spark, sf).groupBy(code, hit.alias("hm")).agg(F.count("*").alias("n"))


@query
def null_safe_neq(spark, sf):
    kept = st.line_charts(spark, sf).where(differs(F.col("error"), 1))
    return kept.groupBy("error").agg(F.count("*").alias("n"))


@query
def reindexed_columns(spark, sf):
    """Column subset in which a missing column is all NULL."""
    columns = ["c_custkey", "c_acctbal", "absent"]
    return reindex(st.table(spark, sf, "customer"), columns)


@query
def time_between(spark, sf):
    """Seconds, whole-date years and a shifted timestamp per stay."""
    stays = st.order_stays(spark, sf).join(st.order_patients(spark, sf), "subject_id")
    return stays.select(
        "icustay_id",
        F.abs(seconds_between(F.col("intime"), F.col("outtime"))).alias("seconds"),
        date_years_between(F.col("intime"), F.col("dob")).alias("years"),
        (F.col("intime") + hours(12)).alias("shifted"),
    )


# --- joins, nearest measurements, ranks ----------------------------------------


@query
def interval_left_join(spark, sf):
    """Stays with the labs of their admission within 24 hours of entry."""
    stays = st.event_stays(spark, sf)
    labs = st.event_labs(spark, sf).where(F.col("valuenum") > 0)
    low, high = F.col("intime") - hours(24), F.col("intime") + hours(24)
    joined = interval_join(stays, labs, ["subject_id", "hadm_id"], low, high, "charttime")
    return joined.select("subject_id", "hadm_id", "icustay_id", "charttime", "itemid", "valuenum")


@query
def interval_repeated_anchors(spark, sf):
    """Stays fanned out by their diagnoses: every copy keeps its labs, or its
    one empty row."""
    copies = F.explode(F.sequence(F.lit(0), F.pmod("icustay_id", F.lit(3)).cast("int")))
    stays = st.event_stays(spark, sf).select("*", copies.alias("_copy")).drop("_copy")
    labs = st.event_labs(spark, sf).where((F.col("valuenum") > 0) & (F.pmod("subject_id", F.lit(5)) > 1))
    low, high = F.col("intime") - hours(24), F.col("intime") + hours(24)
    joined = interval_join(stays, labs, ["subject_id", "hadm_id"], low, high, "charttime")
    return joined.select("subject_id", "hadm_id", "icustay_id", "charttime", "itemid", "valuenum")


LINE_LIVER = {"ast": (4, 5), "alt": (6, 7)}
LINE_VITALS = {"temperature": (1, 2), "respiration": (3, 4, 5), "heart_rate": (6, 7)}
LINE_CHARTS = {"all": (1, 2, 3, 4, 5, 6, 7)}


def _line_tables(spark, sf):
    return {"icustays": st.order_stays(spark, sf), "chartevents": st.line_charts(spark, sf)}


@query
def nearest_liver(spark, sf):
    return clinical.nearest_liver(_line_tables(spark, sf), LINE_LIVER, ["icustay_id"])


@query
def liver_per_stay(spark, sf):
    liver = clinical.nearest_liver(_line_tables(spark, sf), LINE_LIVER, ["icustay_id"])
    return clinical.best_per_stay(liver, "ast", ["icustay_id"])


@query
def nearest_vitals(spark, sf):
    return clinical.nearest_vitals(_line_tables(spark, sf), LINE_VITALS, ["icustay_id"])


@query
def labs_24h_pivot(spark, sf):
    return clinical.labs_around_intime(st.event_tables(spark, sf), st.EVENT_LABS)


@query
def labs_skip_null(spark, sf):
    """The same, but a value above its cap gives way to the next one."""
    return clinical.labs_around_intime(st.event_tables(spark, sf), st.EVENT_LABS, skip_null=True)


@query
def labs_long_ranked(spark, sf):
    return clinical.labs_by_admission_distance(st.event_tables(spark, sf), st.EVENT_LABS)


@query
def stay_order_rank(spark, sf):
    stays = st.order_stays(spark, sf).select("subject_id", "icustay_id", "intime")
    return ranked(stays, ["subject_id"], "intime", "icustay_id_order")


@query
def dense_rank_by_day(spark, sf):
    charts = st.line_charts(spark, sf).select("icustay_id", "charttime", "valuenum")
    return ranked(charts, ["icustay_id"], "charttime", "d_rank", dense=True, descending=True)


@query
def latest_service(spark, sf):
    return co.latest_service(st.order_stays(spark, sf), st.order_services(spark, sf), "inner")


@query
def latest_service_left(spark, sf):
    return co.latest_service(st.order_stays(spark, sf), st.order_services(spark, sf), "left")


@query
def latest_service_per_stay(spark, sf):
    """The rank within the stay: no sibling displaces another."""
    return co.latest_service(st.order_stays(spark, sf), st.order_services(spark, sf), "left", partition_by="icustay_id")


@query
def first_row_number(spark, sf):
    stays = st.event_stays(spark, sf).select("subject_id", "icustay_id", "intime")
    return first_rows(stays, ["subject_id"], ["intime", "icustay_id"])


@query
def arg_min_rows(spark, sf):
    charts = st.line_charts(spark, sf).select("icustay_id", "itemid", "charttime")
    return co.arg_min_rows(charts, ["icustay_id"], "itemid")


# --- flags -----------------------------------------------------------------------


@query
def mortality_flags(spark, sf):
    flagged = co.mortality_flags(st.event_stays(spark, sf), st.event_admissions(spark, sf))
    return flagged.select("icustay_id", "mort_icu", "mort_hosp", "mort_30")


@query
def mortality_flags_admission(spark, sf):
    flagged = co.mortality_flags(st.event_stays(spark, sf), st.event_admissions(spark, sf), "admittime")
    return flagged.select("icustay_id", "mort_icu", "mort_hosp", "mort_30")


LINE_RULES = (((1, 2), None), ((3,), ("R",)), ((4,), ("A", "N")))


def _rrt_flags(spark, sf):
    charts, item = st.line_charts(spark, sf), F.col("itemid")
    old, new = st.line_intake(spark, sf, "F"), st.line_intake(spark, sf, "O")
    not_error = differs(F.col("error"), 1)
    sources = [
        FlagSource(
            charts,
            item.isin(1, 2, 3, 4) & text_rules(item, F.col("value"), LINE_RULES) & not_error & (F.col("valuenum") > 48),
            F.col("dbsource") == "carevue",
        ),
        FlagSource(old, item.isin(5, 6) & (F.col("amount") > 20)),
        FlagSource(new, item.isin(7) & (F.col("amount") > 22)),
        FlagSource(charts, item.isin(6, 7) & (F.col("valuenum") > 47) & not_error),
        FlagSource(st.line_durations(spark, sf, "R"), F.col("duration_hours") > 3.5),
    ]
    return any_event_flag(
        st.order_stays(spark, sf), sources, "icustay_id", "rrt", ["subject_id", "hadm_id", "icustay_id"]
    )


@query
def multi_source_flag(spark, sf):
    return _rrt_flags(spark, sf)


@query
def rate_query(spark, sf):
    return rounded(event_rate(_rrt_flags(spark, sf), "rrt"), "percent_hits")


@query
def text_value_rules(spark, sf):
    rule = flag(text_rules(F.col("itemid"), F.col("value"), LINE_RULES))
    charts = st.line_charts(spark, sf).withColumn("hit", rule)
    return charts.groupBy("itemid", "value", "hit").agg(F.count("*").alias("n"))


@query
def distinct_hit_ids(spark, sf):
    return ids_with(st.line_intake(spark, sf, "F"), F.col("amount") > 20, "icustay_id", "rrt")


@query
def union_intake_flag(spark, sf):
    systems = [(st.line_intake(spark, sf, "O"), (1, 2)), (st.line_intake(spark, sf, "F"), (3,))]
    return intake_flag(systems, ["icustay_id"], "rbc_1")


@query
def culture_flags(spark, sf):
    return culture_flag(st.line_cultures(spark, sf), ["hadm_id"], "BLOOD CULTURE", "p_blood_culture_1")


@query
def duration_flags(spark, sf):
    return duration_flag(st.line_durations(spark, sf, "A"), ["icustay_id"], "vasopressor_1")


def _gases(spark, sf):
    return clinical.first_day_gas({"bloodgasfirstdayarterial": st.line_gases(spark, sf)})


@query
def first_day_max(spark, sf):
    return _gases(spark, sf)


# --- cohort ------------------------------------------------------------------------


@query
def phenotype_primary_secondary(spark, sf):
    return co.phenotype(st.order_diagnoses(spark, sf), st.ORDER_TYPES)


@query
def dictionary_join_fanout(spark, sf):
    coded = co.dictionary_diagnoses(
        st.order_diagnoses(spark, sf), st.part_dictionary(spark, sf), clinical.MALIGNANCY_PREFIXES, ("short_title",)
    )
    stays = st.order_stays(spark, sf).select("icustay_id", "hadm_id")
    return stays.join(coded.where(F.col("hm") == 1), "hadm_id")


def _cohort(spark, sf):
    stays = st.order_stays(spark, sf)
    frame = co.stay_frame(stays, st.order_patients(spark, sf))
    service = co.latest_service(stays, st.order_services(spark, sf)).select("icustay_id", "surgical")
    kinds = co.phenotype(st.order_diagnoses(spark, sf), st.ORDER_TYPES)
    joined = frame.join(service, "icustay_id").join(kinds, "hadm_id")
    return co.flag_exclusions(joined, co.exclusion_rules(min_days=1, min_age=16))


APPLIED = ["exclusion_1st_care_unit", "exclusion_age", "exclusion_first_stay"]


@query
def cohort_exclusions(spark, sf):
    return rounded(_cohort(spark, sf).drop("intime", "first_careunit"), "icu_length_of_stay", "age")


@query
def cohort_attrition(spark, sf):
    return co.attrition(_cohort(spark, sf), APPLIED)


def _star(spark, sf):
    # read by the features below, so it is written once
    cohort = pin(co.apply_exclusions(_cohort(spark, sf), APPLIED))
    ids = cohort.select("icustay_id").distinct()
    lines = {n: t.join(ids, "icustay_id", "left_semi") for n, t in _line_tables(spark, sf).items()}
    systems = [(st.line_intake(spark, sf, "O"), (1, 2)), (st.line_intake(spark, sf, "F"), (3,))]
    one = ["icustay_id"]
    charts = clinical.nearest_charts(lines, LINE_CHARTS, one)
    features = [
        (charts.select(*one, *clinical.largest_of(LINE_LIVER), *clinical.largest_of(LINE_VITALS)), one),
        (_rrt_flags(spark, sf).select("icustay_id", "rrt"), one),
        (st.order_scores(spark, sf), one),
        (culture_flag(st.line_cultures(spark, sf), ["hadm_id"], "BLOOD CULTURE", "p_blood_culture_1"), ["hadm_id"]),
        (intake_flag(systems, one, "rbc_1"), one),
        (duration_flag(st.line_durations(spark, sf, "A"), one, "vasopressor_1"), one),
        (_gases(spark, sf), one),
    ]
    return co.star_join(cohort, features)


@query
def star_features(spark, sf):
    wide = _star(spark, sf).select(
        "subject_id", "hadm_id", "icustay_id", "hm_indicator", "d_type", "ast", "alt", "rrt", "sofa",
        "p_blood_culture_1", "rbc_1", "vasopressor_1", *LINE_VITALS, "abg_ph", "abg_lactate",
        "age", "gender", "icu_length_of_stay",
    )
    return rounded(wide, "age", "icu_length_of_stay")


@query
def renal_replacement(spark, sf):
    """The seven-source flag with the full code lists."""
    return clinical.renal_replacement(st.clinical_tables(spark, sf))


@query
def renal_replacement_rate(spark, sf):
    t = st.clinical_tables(spark, sf)
    rrt = clinical.renal_replacement(t)
    return rounded(clinical.renal_replacement_rate(t, rrt, first_stay_only=True), "percent_hits")


@query
def final_cohort(spark, sf):
    """The wide feature table of the final cohort, all features."""
    wide = clinical.final_cohort(st.clinical_tables(spark, sf), lambda ids: st.clinical_tables(spark, sf, ids))
    return rounded(wide, "age", "icu_length_of_stay")


@query
def view_cohort(spark, sf):
    """The earlier cohort view, a row per stay and diagnosis code."""
    return rounded(clinical.view_cohort(st.clinical_tables(spark, sf)), "age", "icu_length_of_stay")


@query
def long_cohort(spark, sf):
    """Labs by chart time with diagnosis titles and exclusion flags."""
    return rounded(clinical.long_cohort(st.clinical_tables(spark, sf)), "age", "icu_length_of_stay")


# --- profiles and preparation ----------------------------------------------------


@query
def profile_counts(spark, sf):
    return profile.non_null_counts(st.doc_features(spark, sf), list(st.DOC_FEATURES))


@query
def distinct_ids(spark, sf):
    return profile.distinct_with_null(st.line_charts(spark, sf), ["icustay_id", "itemid", "error"])


@query
def frame_shape(spark, sf):
    return profile.shape(st.doc_features(spark, sf))


@query
def group_sizes(spark, sf):
    return profile.group_sizes(co.phenotype(st.order_diagnoses(spark, sf), st.ORDER_TYPES), "hm_indicator")


@query
def missing_pct(spark, sf):
    return rounded(profile.missing_pct(st.doc_features(spark, sf), list(st.DOC_FEATURES)), "missing_pct")


DOC_UNITS = {
    "A": {"n_chars": (0.001, 0.0), "mean_word": (1 / 1.8, -32.0)},
    "B": {"mean_word": (1 / 1.8, -32.0)},
}


@query
def unit_convert(spark, sf):
    """Linear conversions that differ by site."""
    site = F.when(F.col("lang") == "en", "A").otherwise("B")
    sites = st.doc_features(spark, sf).withColumn("site", site)
    converted = prep.convert_units_by_site(sites, DOC_UNITS)
    return rounded(converted.select("doc_id", "site", "n_chars", "mean_word"), "n_chars", "mean_word")


@query
def recode_text(spark, sf):
    patients = prep.recode(st.order_patients(spark, sf), "gender", prep.GENDER_CODES)
    return patients.select("subject_id", "gender")


@query
def onehot_fill(spark, sf):
    levels = {"leukemia": "leukemia", "lymphoma": "lymphoma", "myeloma": "myeloma"}
    kinds = co.phenotype(st.order_diagnoses(spark, sf), st.ORDER_TYPES)
    stays = st.order_stays(spark, sf).select("icustay_id", "hadm_id").join(kinds, "hadm_id", "left")
    hot = prep.one_hot(stays, "d_type", levels)
    return prep.fill_zero(hot, ["hm_indicator"]).select("icustay_id", "hm_indicator", *levels)


GAPPY = ["digit_share", "upper_share", "punct_share"]


@query
def median_impute(spark, sf):
    filled = prep.fill_median(pin(st.doc_features(spark, sf)), GAPPY)
    return rounded(filled.select("doc_id", *GAPPY), *GAPPY)


@query
def dropna_any(spark, sf):
    return prep.drop_incomplete(st.model_table(spark, sf), GAPPY).select("doc_id", "site", "label")


@query
def pooled_sites(spark, sf):
    """Two sites appended by column name; one of them lacks a column."""
    rows = st.model_table(spark, sf).drop("site")
    a = rows.where(F.col("lang") == "en").select("doc_id", "label", "n_chars", "n_words")
    b = rows.where(F.col("lang") != "en").select("n_chars", "doc_id", "label")
    return prep.pool_sites({"A": a, "B": b})


@query
def column_quantiles(spark, sf):
    quantiles = exact_quantiles(
        st.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], [0.25, 0.5, 0.75]
    )
    return rounded(quantiles, "q0", "q1", "q2")


@query
def sketch_bounds(spark, sf):
    """Sketches per flag and number of the lines, merged: are quantiles and distinct
    counts within the stated errors of the exact ones?"""
    lines = st.table(spark, sf, "lineitem")
    columns, probs = ["l_quantity", "l_extendedprice", "l_tax"], [0.1, 0.5, 0.9]
    found = sketches.merged_sketches(sketches.column_sketches(lines, columns, ["l_returnflag", "l_linenumber"]))
    marked = pin(sketches.sketched_distincts(sketches.sketched_quantiles(found, probs)))
    values = long_values(lines, columns).join(F.broadcast(marked.select("variable", "q0", "q1", "q2")), "variable")
    # a quantile stands for all ranks of its value
    ranks = [x for i in range(3) for x in (
        F.avg((F.col("value") < F.col(f"q{i}")).cast("int")).alias(f"low{i}"), F.avg((F.col("value") <= F.col(f"q{i}")).cast("int")).alias(f"high{i}"))]
    exact = values.groupBy("variable").agg(F.count_distinct("value").alias("exact"), *ranks)
    near = [(F.col(f"low{i}") <= p + sketches.KLL_ERROR) & (F.col(f"high{i}") >= p - sketches.KLL_ERROR) for i, p in enumerate(probs)]
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= sketches.HLL_ERROR * F.col("exact")
    return marked.join(exact, "variable").select(
        "variable", "n", F.col("exact").alias("n_distinct"), (near[0] & near[1] & near[2]).alias("ranks_hold"), close.alias("counts_hold"))


@query
def head_rows(spark, sf):
    """The first five rows of the model table by key."""
    return st.model_table(spark, sf).select("doc_id", "site", "label").orderBy("doc_id").limit(5)


# --- folds and metrics -------------------------------------------------------------


@query
def kfold_contiguous(spark, sf):
    rows = st.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return folds.contiguous_folds(rows, [F.col("o_custkey").asc(), F.col("o_orderkey").asc()], 10)


@query
def kfold_hashed(spark, sf):
    return folds.shuffled_folds(st.table(spark, sf, "documents").select("doc_id"), "doc_id", 10, 422)


@query
def holdout_exact(spark, sf):
    return folds.exact_holdout(st.table(spark, sf, "documents").select("doc_id"), "doc_id", 0.3, 59)


@query
def shuffle_rows(spark, sf):
    """The shuffled order as a row index."""
    rows = st.table(spark, sf, "documents").select("doc_id")
    return row_index(rows, folds.shuffle_key("doc_id", 7))


def _scores(spark, sf):
    """A deterministic score with ties: line items priced against a returned
    flag, one fold per line number."""
    return st.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("fold"),
        F.col("l_quantity").alias("score"),
        flag(F.col("l_quantity") > 30).alias("prediction"),
        flag((F.col("l_returnflag") == "R") | (F.col("l_quantity") + F.col("l_discount") * 300 > 45)).alias("label"),
    )


@query
def roc_curve(spark, sf):
    return rounded(metrics.roc_points(_scores(spark, sf), "score", "label"), "fpr", "tpr")


@query
def auc_scores(spark, sf):
    return rounded(metrics.auc(_scores(spark, sf), "score", "label", ["fold"]), "auc")


@query
def auc_hard_labels(spark, sf):
    return rounded(metrics.auc_of_labels(_scores(spark, sf), "prediction", "label", ["fold"]), "auc")


@query
def accuracy_by_fold(spark, sf):
    return rounded(metrics.accuracy(_scores(spark, sf), "prediction", "label", ["fold"]), "accuracy")


@query
def cross_validated_auc(spark, sf):
    per_fold = metrics.auc(_scores(spark, sf), "score", "label", ["fold"])
    return rounded(metrics.score_summary(per_fold, "auc"), "mean", "std", "low", "high", "best")


# --- descriptive tables ---------------------------------------------------------------


def _lines_by_outcome(spark, sf):
    return st.table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.when(F.col("l_discount") > 0.01, F.col("l_tax")).alias("tax"),
        "l_returnflag", "l_linenumber",
        flag(F.col("l_linestatus") == "F").alias("outcome"),
    )


LINE_CONTINUOUS = ["l_quantity", "l_extendedprice", "tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linenumber"]


@query
def tableone_continuous(spark, sf):
    table = tableone.continuous_quartiles(_lines_by_outcome(spark, sf), LINE_CONTINUOUS, "outcome")
    return rounded(table, "q1", "median", "q3")


@query
def tableone_categorical(spark, sf):
    counts = tableone.level_counts(_lines_by_outcome(spark, sf), LINE_CATEGORICAL, "outcome")
    return rounded(tableone.level_shares(counts, "outcome"), "pct")


@query
def kruskal_h(spark, sf):
    table = tableone.kruskal_wallis(_lines_by_outcome(spark, sf), LINE_CONTINUOUS, "outcome")
    return table.select("variable", F.round("statistic", 4).alias("h"), F.col("df").cast("int").alias("df"))


@query
def chi2_stat(spark, sf):
    rows = _lines_by_outcome(spark, sf).withColumn("returned", flag(F.col("l_returnflag") == "R"))
    counts = tableone.level_counts(rows, [*LINE_CATEGORICAL, "returned"], "outcome")
    table = tableone.chi_squared(counts, "outcome", [0, 1])
    return table.select(
        "variable", F.round("statistic", 4).alias("chi2"), "df", F.round("min_expected", 4).alias("min_expected")
    )


@query
def tableone_report(spark, sf):
    """The whole descriptive report over the model table, with p-values."""
    rows = prep.fill_zero(st.model_table(spark, sf), ["toxic"])
    return tableone.table_one(rows, [*st.DOC_FEATURES, "toxic", "site"], ["toxic", "site"], "label")


@query
def tableone_pvalues(spark, sf):
    """The p-values of the report's tests."""
    rows = _lines_by_outcome(spark, sf).withColumn("returned", flag(F.col("l_returnflag") == "R"))
    report = tableone.table_one(rows, [*LINE_CONTINUOUS, "returned"], ["returned"], "outcome")
    return rounded(report.where(F.col("test").isNotNull()).select("features", "pval", "test"), "pval")


# --- models ----------------------------------------------------------------------------

# The studies' folds, seeds and settings of the trees.
FOLDS = 10
HOLDOUT_SEEDS = range(1, 100)
REPEAT_SEEDS = range(100, 200)
SWEEP_SEEDS = range(300, 500)
MODEL_COLUMNS = [*st.DOC_FEATURES, "toxic"]


def _scaled(spark, sf):
    return prep.convert_units(pin(st.model_table(spark, sf)), {"n_chars": (0.001, 0.0), "n_words": (0.001, 0.0)})


def _prepared(spark, sf):
    """Complete rows: the gaps filled by the columns' medians."""
    return prep.fill_median(_scaled(spark, sf), GAPPY)


def _folded(rows):
    """The rows with their contiguous fold, and the fits of all folds."""
    folded = pin(folds.contiguous_folds(rows, [F.col("doc_id").asc()], FOLDS))
    return folded, F.array("fold"), [Fit(f, tags={"fold": f}) for f in range(FOLDS)]


def _logistic(rows, fits, folds=None):
    return L1Logistic(rows, MODEL_COLUMNS, "doc_id", "label", fits, folds)


def _boosted(rows, fits, params, folds=None):
    """Trees take the rows as they are: a missing value has its own side."""
    return boosting.boosted(rows, MODEL_COLUMNS, "doc_id", "label", fits, params, folds)


@query
def l1_logistic_odds(spark, sf):
    return _logistic(_prepared(spark, sf), [Fit()]).odds().drop("intercept")


@query
def l1_logistic_accuracy(spark, sf):
    rows, fold, fits = _folded(_prepared(spark, sf))
    return validate.accuracy_report(_logistic(rows, fits, fold).scores(), ["fold"])


@query
def gbt_cv_auc(spark, sf):
    rows, fold, fits = _folded(_scaled(spark, sf))
    return validate.auc_report(_boosted(rows, fits, boosting.SITE_A, fold).scores(), ["fold"], hard=True)


@query
def gbt_split_importance(spark, sf):
    model = _boosted(_scaled(spark, sf), [Fit()], boosting.SITE_A)
    return boosting.split_counts(model.nodes(), MODEL_COLUMNS)


def _site_scores(spark, sf):
    """Scores of site B by a model of site A."""
    rows = pin(_prepared(spark, sf))
    return _logistic(rows, [Fit(1)], F.array(flag(F.col("site") == "B"))).scores()


@query
def external_validation(spark, sf):
    """Fit on site A, exact AUC on site B."""
    return metrics.auc(_site_scores(spark, sf), "score", "label")


@query
def repeated_external(spark, sf):
    scores = pin(_site_scores(spark, sf))
    tested = validate.holdout_rows(scores, "key", HOLDOUT_SEEDS, 0.2)
    return validate.auc_report(tested, ["seed"])


@query
def pooled_cv(spark, sf):
    rows, fold, fits = _folded(_scaled(spark, sf))
    return validate.auc_report(_boosted(rows, fits, boosting.POOLED, fold).scores(), ["fold"])


@query
def repeated_holdout(spark, sf):
    """The 99 holdouts, all grown together."""
    rows = pin(_scaled(spark, sf))
    fold, fits = validate.repeated_holdouts(rows, "doc_id", HOLDOUT_SEEDS, 0.3)
    return validate.auc_report(_boosted(rows, fits, boosting.SITE_A, fold).scores(), ["seed"], hard=True)


@query
def repeated_cv(spark, sf):
    """Ten shuffled folds under each of 100 seeds."""
    rows = pin(_scaled(spark, sf))
    fold, fits = validate.repeated_folds(rows, "doc_id", REPEAT_SEEDS, FOLDS)
    return validate.repeated_report(_boosted(rows, fits, boosting.SITE_B_FOLDS, fold).scores())


@query
def seed_sweep(spark, sf):
    """Ten shuffled folds under each of 200 seeds."""
    rows = pin(_scaled(spark, sf))
    fold, fits = validate.repeated_folds(rows, "doc_id", SWEEP_SEEDS, FOLDS)
    return validate.sweep_report(_boosted(rows, fits, boosting.SWEEP, fold).scores())


@query
def odds_pvalue_report(spark, sf):
    """Odds ratios beside the p-values of both sites' descriptive tables."""
    rows = pin(_prepared(spark, sf))
    odds = _logistic(rows, [Fit()]).odds()
    tables = {
        s.lower(): tableone.table_one(rows.where(F.col("site") == s), MODEL_COLUMNS, ["toxic"], "label") for s in "AB"
    }
    return models.odds_report(odds, tables)
