"""0/1 flags per stay or admission from one or many event sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.functions.codemap import flag


@dataclass(frozen=True)
class FlagSource:
    """Events that raise a flag: those of ``events`` meeting ``condition``.

    ``only_where`` restricts the source to stays meeting a condition on the
    stay's own columns.
    """

    events: DataFrame
    condition: Column
    only_where: Column | None = None


def text_rules(item: Column, value: Column, rules) -> Column:
    """Any rule (items, texts) holds; texts None means any non-null text."""
    tests = [
        item.isin(*items) & (value.isNotNull() if texts is None else value.isin(*texts))
        for items, texts in rules
    ]
    return reduce(lambda a, b: a | b, tests)


def any_event_flag(
    stays: DataFrame, sources: Sequence[FlagSource], key: str, name: str, keep: Sequence[str]
) -> DataFrame:
    """1 for stays with a hit in any source, else 0; every stay is kept.

    The hits of all sources are reduced to one row per stay before a single
    join, instead of one join per source, and a table that serves several
    sources is read once.
    """
    numbers = range(len(sources))
    by_table: dict[int, list[int]] = {}
    for i, source in enumerate(sources):
        by_table.setdefault(id(source.events), []).append(i)
    parts = []
    for mine in by_table.values():
        wanted = reduce(lambda a, b: a | b, [sources[i].condition for i in mine])
        hits = [(flag(sources[i].condition) if i in mine else F.lit(0)).alias(f"_hit{i}") for i in numbers]
        parts.append(sources[mine[0]].events.where(wanted).select(key, *hits))
    per_stay = reduce(DataFrame.unionByName, parts).groupBy(key).agg(
        *[F.max(f"_hit{i}").alias(f"_hit{i}") for i in numbers]
    )
    raised = []
    for i, source in enumerate(sources):
        hit = F.col(f"_hit{i}") == 1
        raised.append(hit if source.only_where is None else hit & source.only_where)
    any_hit = reduce(lambda a, b: a | b, raised)
    return stays.join(per_stay, key, "left").select(*keep, flag(any_hit).alias(name))


def ids_with(events: DataFrame, condition: Column, key: str, name: str) -> DataFrame:
    """Distinct ids of the matching events, with the constant flag 1."""
    return events.where(condition).select(key).distinct().withColumn(name, F.lit(1))


def max_flag(events: DataFrame, keys: Sequence[str], condition: Column, name: str) -> DataFrame:
    """1 per group when any row meets the condition, else 0."""
    return events.groupBy(*keys).agg(F.max(flag(condition)).alias(name))


def intake_flag(systems: Sequence[tuple[DataFrame, Sequence[int]]], keys: Sequence[str], name: str) -> DataFrame:
    """Groups with a positive amount of a listed item in any intake system."""
    parts = [
        events.where(F.col("itemid").isin(*codes) & (F.col("amount") > 0)).select(*keys, "itemid")
        for events, codes in systems
    ]
    return max_flag(reduce(DataFrame.unionByName, parts), keys, F.col("itemid") > 0, name)


def culture_flag(cultures: DataFrame, keys: Sequence[str], specimen: str, name: str) -> DataFrame:
    """1 when a culture of the specimen has neither organism nor antibiotic.

    The rule is kept as the source data set defines it, although its name
    there says the opposite.
    """
    empty = F.col("org_itemid").isNull() & F.col("ab_itemid").isNull()
    return max_flag(cultures.where(F.col("spec_type_desc") == specimen), keys, empty, name)


def duration_flag(durations: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return max_flag(durations, keys, F.col("duration_hours") > 0, name)


def event_rate(flags: DataFrame, name: str) -> DataFrame:
    """Observations, hits and percentage of hits."""
    hit = F.sum(flag(F.col(name) == 1))
    return flags.agg(
        F.count("*").alias("numobs"),
        F.sum(name).cast("long").alias("num_hits"),
        (hit * F.lit(100.0).cast("double") / F.count("*")).alias("percent_hits"),
    )
