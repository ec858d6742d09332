"""Cohort selection: stay order, services, diagnoses, exclusions, assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.functions.codemap import flag, is_surgical, prefix_match
from wardframe.functions.times import days, days_between, hours, years_between
from wardframe.operators.ordered import ranked

STAY_KEYS = ("subject_id", "hadm_id", "icustay_id")


def stay_frame(stays: DataFrame, patients: DataFrame) -> DataFrame:
    """Stays of known patients with length of stay, age and stay order."""
    joined = stays.join(patients.select("subject_id", "gender", "dob"), "subject_id")
    ordered = ranked(joined, ["subject_id"], "intime", "icustay_id_order")
    intime, outtime = F.col("intime"), F.col("outtime")
    return ordered.select(
        *STAY_KEYS,
        "first_careunit",
        "gender",
        "intime",
        days_between(outtime, intime).alias("icu_length_of_stay"),
        years_between(intime, F.col("dob")).alias("age"),
        "icustay_id_order",
    )


def latest_service(
    stays: DataFrame, services: DataFrame, how: str = "inner", within_hours: int = 12, partition_by: str = "hadm_id"
) -> DataFrame:
    """Rows (stay, service) holding the admission's latest transfer before
    ``intime + within_hours``; ties are kept.

    The rank runs over the admission, not the stay, with NULLs first.  So only
    the admission's latest visible transfer survives, together with the stays
    that see it, and in a ``left`` join a stay that sees no transfer displaces
    its siblings.  Both follow from aggregates per admission, without building
    the stay-service pairs.  ``partition_by="icustay_id"`` ranks within the stay
    instead: every stay has the latest transfer that it sees itself.
    """
    if partition_by == "icustay_id":
        return _latest_per_stay(stays, services, how, within_hours)
    if partition_by != "hadm_id":
        raise ValueError("the service rank runs over hadm_id or icustay_id")
    reach = stays.select("hadm_id", "icustay_id", (F.col("intime") + hours(within_hours)).alias("_reach"))
    visible_to = reach.groupBy("hadm_id").agg(F.max("_reach").alias("_last_reach"))
    moves = services.select("hadm_id", "curr_service", "transfertime")
    move = F.col("transfertime")
    edges = moves.join(visible_to, "hadm_id").groupBy("hadm_id").agg(
        F.max(F.when(move < F.col("_last_reach"), move)).alias("_latest"), F.min(move).alias("_first")
    )
    per_stay = reach.join(edges, "hadm_id", "left")
    alone = F.coalesce(F.col("_first") >= F.col("_reach"), F.lit(True))
    winners = per_stay.where(F.col("_latest") < F.col("_reach"))
    if how == "left":
        lonely = per_stay.where(alone)
        crowded = lonely.select("hadm_id").distinct()
        winners = winners.join(crowded, "hadm_id", "left_anti")
    final = moves.select("hadm_id", "curr_service", F.col("transfertime").alias("_latest"))
    rows = winners.join(final, ["hadm_id", "_latest"]).select(
        "hadm_id", "icustay_id", "curr_service", F.col("_latest").alias("transfertime")
    )
    if how == "left":
        rows = rows.unionByName(lonely.select("hadm_id", "icustay_id"), allowMissingColumns=True)
    return rows.withColumn("surgical", is_surgical(F.col("curr_service")))


def _latest_per_stay(stays: DataFrame, services: DataFrame, how: str, within_hours: int) -> DataFrame:
    """Stays and transfers of an admission become one run in time; the last
    transfer before a stay's reach is the one that the stay sees."""
    moves = services.select("hadm_id", "curr_service", "transfertime").where(F.col("transfertime").isNotNull())
    reach = stays.select("hadm_id", "icustay_id", (F.col("intime") + hours(within_hours)).alias("_t"))
    run = reach.withColumn("_kind", F.lit(0)).unionByName(
        moves.select("hadm_id", F.col("transfertime").alias("_t"), F.col("transfertime").alias("_seen")).distinct().withColumn("_kind", F.lit(1)),
        allowMissingColumns=True,
    )
    # at equal times the stay comes first, as it sees only what lies before
    before = Window.partitionBy("hadm_id").orderBy(F.col("_t").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = run.withColumn("_latest", F.last("_seen", ignorenulls=True).over(before)).where("_kind = 0")
    final = moves.withColumnRenamed("transfertime", "_latest")
    rows = placed.select("hadm_id", "icustay_id", "_latest").join(final, ["hadm_id", "_latest"], how)
    return rows.select(
        "hadm_id", "icustay_id", "curr_service", F.col("_latest").alias("transfertime"), is_surgical(F.col("curr_service")).alias("surgical")
    )


def mortality_flags(
    stays: DataFrame, admissions: DataFrame, thirty_days_from: str = "intime"
) -> DataFrame:
    """Stays with death inside the stay, the admission and 30 days; the
    admission columns stay for later use.  Every stay is kept."""
    joined = stays.join(
        admissions.select("subject_id", "hadm_id", "admittime", "dischtime", "deathtime"),
        ["subject_id", "hadm_id"],
        "left",
    )
    death, start = F.col("deathtime"), F.col(thirty_days_from)
    return joined.select(
        *stays.columns,
        "admittime",
        flag(death.between(F.col("intime"), F.col("outtime"))).alias("mort_icu"),
        flag(death.between(F.col("admittime"), F.col("dischtime"))).alias("mort_hosp"),
        flag(death.between(start, start + days(30))).alias("mort_30"),
    )


def diagnosis_type(code: Column, types: Mapping[str, tuple]) -> Column:
    column = None
    for name, (prefixes, whole) in types.items():
        hit = prefix_match(code, prefixes, whole)
        column = F.when(hit, name) if column is None else column.when(hit, name)
    return column


def phenotype(diagnoses: DataFrame, types: Mapping[str, tuple]) -> DataFrame:
    """Per admission, whether a listed diagnosis is primary (1) or only
    secondary (2), and its type; the alphabetically last type wins a tie."""
    code, seq = F.col("icd9_code"), F.col("seq_num")
    kind = diagnosis_type(code, types)
    indicator = F.when(kind.isNotNull() & (seq == 1), 1).when(kind.isNotNull() & (seq != 1), 2)
    hits = diagnoses.select("hadm_id", indicator.alias("i"), kind.alias("t")).where(F.col("i").isNotNull())
    best = hits.groupBy("hadm_id").agg(F.max(F.struct((-F.col("i")).alias("neg"), F.col("t"))).alias("b"))
    return best.select("hadm_id", (-F.col("b.neg")).alias("hm_indicator"), F.col("b.t").alias("d_type"))


def arg_min_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows whose ``value`` equals the minimum of their group."""
    lowest = df.groupBy(*keys).agg(F.min(value).alias(value))
    return df.join(lowest, [*keys, value])


def dictionary_diagnoses(
    diagnoses: DataFrame, dictionary: DataFrame, prefixes: Sequence[str], titles: Sequence[str] = ()
) -> DataFrame:
    """Diagnoses known to the dictionary with the flag ``hm``; one row per
    code, so an admission can appear several times."""
    code = F.col("icd9_code")
    hit = flag((code != "None") & prefix_match(code, prefixes))
    return diagnoses.select("hadm_id", "icd9_code").join(
        dictionary.select("icd9_code", *titles), "icd9_code"
    ).select("hadm_id", "icd9_code", *titles, hit.alias("hm"))


@dataclass(frozen=True)
class Rule:
    """An exclusion: the flag ``name`` is 1 where ``excluded`` holds."""

    name: str
    excluded: Column


def exclusion_rules(min_days: float, min_age: float, care_unit: str = "MICU") -> list[Rule]:
    return [
        # a missing care unit is excluded too
        Rule("exclusion_1st_care_unit", ~F.col("first_careunit").eqNullSafe(care_unit)),
        Rule("exclusion_los", F.col("icu_length_of_stay") < min_days),
        Rule("exclusion_age", F.col("age") < min_age),
        Rule("exclusion_first_stay", F.col("icustay_id_order") != 1),
        Rule("exclusion_surgical", F.col("surgical") == 1),
    ]


def flag_exclusions(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.select("*", *[flag(r.excluded).alias(r.name) for r in rules])


def apply_exclusions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows that no named exclusion hits.  Which flags are computed and which
    are applied are separate choices."""
    return df.where(reduce(lambda a, b: a & b, [F.col(n) == 0 for n in names]))


def attrition(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows left after each exclusion in turn, counted in one pass."""
    kept, columns = F.lit(True), [F.count("*").alias("_0")]
    for i, name in enumerate(names, 1):
        kept = kept & (F.col(name) == 0)
        columns.append(F.count(F.when(kept, 1)).alias(f"_{i}"))
    steps = [
        F.struct(F.lit(i).cast("long").alias("step"), F.lit(label).alias("rule"), F.col(f"_{i}").alias("rows_left"))
        for i, label in enumerate(["all", *names])
    ]
    return df.agg(*columns).select(F.explode(F.array(*steps)).alias("s")).select("s.*")


def star_join(base: DataFrame, features: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left join of per-key feature tables to the base rows."""
    return reduce(lambda df, f: df.join(f[0], list(f[1]), "left"), features, base)
