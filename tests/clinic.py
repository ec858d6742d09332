"""Small clinical tables for tests."""

from datetime import datetime, timedelta

from wardframe.sources.registry import SCHEMAS, schema

T0 = datetime(2100, 1, 1, 12)


def at(hours: float) -> datetime:
    return T0 + timedelta(hours=hours)


def clinic(spark, **rows):
    """All registered tables, empty unless rows are given (as dicts)."""
    tables = {}
    for name in SCHEMAS:
        names = schema(name).fieldNames()
        data = [tuple(r.get(n) for n in names) for r in rows.get(name, [])]
        tables[name] = spark.createDataFrame(data, schema(name))
    return tables


def stay(stay_id, hadm=10, subject=1, intime=0.0, outtime=48.0, unit="MICU", source="carevue"):
    return dict(
        subject_id=subject, hadm_id=hadm, icustay_id=stay_id, first_careunit=unit, dbsource=source,
        intime=at(intime), outtime=at(outtime),
    )


def lab(hours, value, item=50912, hadm=10, subject=1):
    return dict(subject_id=subject, hadm_id=hadm, itemid=item, charttime=at(hours), valuenum=value)


def chart(item, hours=1.0, value=None, num=None, error=None, stay_id=100, hadm=10, subject=1):
    return dict(
        subject_id=subject, hadm_id=hadm, icustay_id=stay_id, itemid=item, charttime=at(hours), value=value,
        valuenum=num, error=error,
    )


def admission(hadm=10, subject=1, start=-5.0, end=100.0, death=None):
    return dict(
        subject_id=subject, hadm_id=hadm, admittime=at(start), dischtime=at(end),
        deathtime=None if death is None else at(death),
    )
