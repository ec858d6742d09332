"""Columns built from code maps."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_of(item: Column, labels: Mapping[int, str]) -> Column:
    """Label of an item code, NULL for an unknown code."""
    by_label: dict[str, list[int]] = {}
    for code, label in labels.items():
        by_label.setdefault(label, []).append(code)
    column = None
    for label, codes in by_label.items():
        hit = item.isin(*codes)
        column = F.when(hit, label) if column is None else column.when(hit, label)
    return column


def capped(item: Column, value: Column, caps: Mapping[int, float]) -> Column:
    """``value``, or NULL where it exceeds the cap of its item."""
    by_cap: dict[float, list[int]] = {}
    for code, cap in caps.items():
        by_cap.setdefault(float(cap), []).append(code)
    column = None
    for cap, codes in by_cap.items():
        over = item.isin(*codes) & (value > cap)
        empty = F.lit(None).cast("double")
        column = F.when(over, empty) if column is None else column.when(over, empty)
    return column.otherwise(value)


def prefix_match(code: Column, prefixes: Iterable[str], whole: Iterable[str] = ()) -> Column:
    """First three characters in ``prefixes``, or the code itself in ``whole``."""
    tests = []
    if prefixes := list(prefixes):
        tests.append(F.substring(code, 1, 3).isin(*prefixes))
    if whole := list(whole):
        tests.append(code.isin(*whole))
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is NULL)."""
    return F.when(condition, 1).otherwise(0)


def differs(column: Column, value) -> Column:
    """IS DISTINCT FROM."""
    return ~column.eqNullSafe(F.lit(value))


def is_surgical(service: Column) -> Column:
    return flag(service.endswith("SURG") | (service == "ORTHO"))
