"""Schemas of the clinical tables and readers for them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_KEYS = "subject_id long, hadm_id long, icustay_id long"
_INTAKE = f"{_KEYS}, itemid int, amount double"

# Table -> column definitions.  Diagnosis codes stay strings: they carry
# leading zeros and are matched by prefix.
SCHEMAS: dict[str, str] = {
    "icustays": f"{_KEYS}, first_careunit string, dbsource string, intime timestamp_ntz, outtime timestamp_ntz",
    "patients": "subject_id long, gender string, dob timestamp_ntz",
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
    "deathtime timestamp_ntz",
    "services": "hadm_id long, curr_service string, transfertime timestamp_ntz",
    "diagnoses_icd": "hadm_id long, seq_num int, icd9_code string",
    "d_icd_diagnoses": "icd9_code string, short_title string, long_title string",
    "labevents": "subject_id long, hadm_id long, itemid int, charttime timestamp_ntz, valuenum double",
    "chartevents": f"{_KEYS}, itemid int, charttime timestamp_ntz, value string, valuenum double, error int",
    "inputevents_mv": _INTAKE,
    "inputevents_cv": _INTAKE,
    "outputevents": "icustay_id long, itemid int, value double",
    "datetimeevents": "icustay_id long, itemid int",
    "procedureevents_mv": "icustay_id long, itemid int",
    "microbiologyevents": "subject_id long, hadm_id long, spec_type_desc string, org_itemid int, ab_itemid int",
    "sofa": f"{_KEYS}, sofa int",
    "vasopressordurations": "icustay_id long, duration_hours double",
    "ventdurations": "icustay_id long, duration_hours double",
    "bloodgasfirstdayarterial": "icustay_id long, ph double, pco2 double, po2 double, bicarbonate double, "
    "baseexcess double, spo2 double, lactate double",
    "elixhauser_quan": "hadm_id long, hypertension int, congestive_heart_failure int, cardiac_arrhythmias int, "
    "chronic_pulmonary int, depression int, diabetes_uncomplicated int, hypothyroidism int, renal_failure int, "
    "rheumatoid_arthritis int, liver_disease int, peptic_ulcer int",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def read_tables(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """The registered tables at the given paths, with their declared types."""
    reader = {
        name: spark.read.format(fmt).schema(schema(name)) for name in paths
    }
    if fmt == "csv":
        reader = {name: r.option("header", True) for name, r in reader.items()}
    return {name: reader[name].load(path) for name, path in paths.items()}


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A table or ``(query) alias`` of a SQL database, read in parallel ranges
    of ``column``.  The driver jar and the login are the caller's."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column is not None and bounds is not None:
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def materialize(df: DataFrame, name: str, path: str) -> DataFrame:
    """Write ``df`` anew and register it under ``name``, as a materialized
    view is dropped and created again."""
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.createOrReplaceTempView(name)
    return stored
