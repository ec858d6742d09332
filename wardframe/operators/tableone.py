"""Grouped descriptive tables with significance tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.functions.pvalues import chi2_tail, fisher_two_sided
from wardframe.operators.ordered import long_values, null_safe_join, quantile_rows, row_index, running_totals
from wardframe.session import pin

#: Outcomes that a report may have as columns, at most.
MAX_GROUPS = "spark.sql.pivotMaxValues"


def outcome_levels(df: DataFrame, groupby: str) -> list:
    """Distinct non-null outcomes, one column each in the report.  More than
    the session lets a pivot have are refused; the tests and the tables with
    outcomes as rows take any number."""
    most = int(df.sparkSession.conf.get(MAX_GROUPS))
    found = df.select(groupby).where(F.col(groupby).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{groupby} has more than {most} values ({MAX_GROUPS}), too many for columns")
    return sorted(r[0] for r in found)


def value_counts(df: DataFrame, columns: Sequence[str], groupby: str) -> DataFrame:
    """Rows per variable, distinct value and outcome, without missing values."""
    long = long_values(df.where(F.col(groupby).isNotNull()), columns, [groupby])
    return long.groupBy("variable", "value", groupby).agg(F.count("*").alias("n"))


def _kruskal(counts: DataFrame, groupby: str) -> DataFrame:
    """Kruskal-Wallis H per variable, corrected for ties; outcomes are rows."""
    values = counts.groupBy("variable", "value").agg(F.sum("n").alias("m"))
    m = F.col("m").cast("double")
    placed = running_totals(values, [F.col("value").asc()], {"below": F.col("m")}, ["variable"])
    sizes = placed.groupBy("variable").agg(F.sum(m).alias("N"), F.sum(m * m * m - m).alias("ties"))
    midranks = placed.select("variable", "value", (F.col("below") + (m + 1) / 2).alias("midrank"))
    # a sum per variable and outcome, then one row per variable
    sums = counts.join(midranks, ["variable", "value"]).groupBy("variable", groupby).agg(
        F.sum(F.col("n") * F.col("midrank")).alias("R"), F.sum("n").cast("double").alias("size")
    )
    squares = sums.groupBy("variable").agg(
        F.sum(F.col("R") * F.col("R") / F.col("size")).alias("squares"), F.count("*").alias("groups")
    )
    big, groups = F.col("N"), F.col("groups")
    raw = F.lit(12.0) / (big * (big + 1)) * F.col("squares") - (big + 1) * 3
    spread = F.lit(1.0) - F.col("ties") / (big * big * big - big)
    usable = (big > 1) & (groups > 1) & (spread > 0)
    return squares.join(sizes, "variable").select(
        "variable", F.when(usable, raw / spread).alias("statistic"), (groups - 1).cast("int").alias("df")
    )


def kruskal_wallis(df: DataFrame, columns: Sequence[str], groupby: str) -> DataFrame:
    """H statistic and degrees of freedom per variable."""
    return _kruskal(pin(value_counts(df, columns, groupby)), groupby)


def continuous_quartiles(df: DataFrame, columns: Sequence[str], groupby: str) -> DataFrame:
    """Median and quartiles per variable and outcome."""
    return _quartiles(value_counts(df, columns, groupby), groupby)


def _quartiles(counts: DataFrame, groupby: str) -> DataFrame:
    group = ["variable", groupby]
    rows = running_totals(counts, [F.col("value").asc()], {"before": F.col("n")}, group)
    return quantile_rows(rows, group, "value", "n", "before", [0.25, 0.5, 0.75]).select(
        *group, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )


def level_counts(df: DataFrame, columns: Sequence[str], groupby: str) -> DataFrame:
    """Rows per variable, level and outcome, without missing values."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns]
    )
    long = df.where(F.col(groupby).isNotNull()).select(groupby, F.explode(pairs).alias("p"))
    return (
        long.select(groupby, "p.*").where(F.col("level").isNotNull())
        .groupBy("variable", "level", groupby).agg(F.count("*").alias("n"))
    )


def level_shares(counts: DataFrame, groupby: str) -> DataFrame:
    """Counts with their percentage of the outcome's non-missing rows."""
    totals = counts.groupBy("variable", groupby).agg(F.sum("n").alias("_total"))
    return null_safe_join(counts, totals, ["variable", groupby], "inner").select(
        "variable", "level", groupby, "n", (F.col("n") * F.lit(100.0) / F.col("_total")).alias("pct")
    )


def chi_squared(counts: DataFrame, groupby: str, levels: Sequence = (), correct: bool = True) -> DataFrame:
    """Chi-squared test of independence per variable; outcomes are rows.

    Where ``levels`` names two outcomes, 2x2 tables get the continuity
    correction when ``correct``, and their four cells are returned.  The
    smallest expected count is that of the rarest level and outcome.
    """
    n = F.col("n").cast("double")
    rows = counts.groupBy("variable", "level").agg(F.sum(n).alias("R"))
    columns = counts.groupBy("variable", groupby).agg(F.sum(n).alias("C"))
    by_row = rows.groupBy("variable").agg(
        F.count("*").alias("n_levels"), F.sum("R").alias("N"), F.min("R").alias("least_row"),
        F.min("level").alias("first"), F.max("level").alias("last"),
    )
    by_column = columns.groupBy("variable").agg(
        F.count("*").alias("n_outcomes"), F.min("C").alias("least_column"), F.product("C").alias("across")
    )
    cells = null_safe_join(counts.join(rows, ["variable", "level"]), columns, ["variable", groupby], "inner")
    cells = cells.join(by_row.select("variable", "first", "last"), "variable")
    pair = list(levels) if len(levels) == 2 else []
    corners = {
        name: F.sum(F.when((F.col("level") == F.col(end)) & (F.col(groupby) == v), F.col("n")).otherwise(0))
        for name, (end, v) in zip("abcd", [(end, v) for end in ("first", "last") for v in pair])
    }
    shares = cells.groupBy("variable").agg(
        F.sum(n * n / (F.col("R") * F.col("C"))).alias("share"), *[c.alias(f"_{name}") for name, c in corners.items()]
    )
    stats = by_row.join(by_column, "variable").join(shares, "variable")
    plain = F.greatest(F.col("N") * (F.col("share") - 1), F.lit(0.0))
    statistic = plain
    shown = [F.lit(None).cast("long").alias(c) for c in "abcd"]
    if pair:
        square = F.col("n_levels") == 2
        shown = [F.when(square, F.col(f"_{c}")).alias(c) for c in "abcd"]
        if correct:
            # doubles: products of counts leave the integer range at scale
            a, b, c, d = (F.col(f"_{x}").cast("double") for x in "abcd")
            gap = F.greatest(F.abs(a * d - b * c) - F.col("N") / 2, F.lit(0.0))
            margins = (a + b) * (c + d) * F.col("across")
            full = square & (F.col("n_outcomes") == 2)
            statistic = F.when(full, F.col("N") * gap * gap / margins).otherwise(plain)
    dof = (F.col("n_levels") - 1) * (F.col("n_outcomes") - 1)
    return stats.select(
        "variable", F.when(dof > 0, statistic).alias("statistic"), dof.cast("int").alias("df"),
        (F.col("least_row") * F.col("least_column") / F.col("N")).alias("min_expected"), *shown,
    )


def _test_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "variable string, pval double, test string")


def continuous_tests(counts: DataFrame, groupby: str) -> DataFrame:
    """p-value per variable; the driver sees one row per variable."""
    stats = _kruskal(counts, groupby).collect()
    rows = [(r["variable"], chi2_tail(r["statistic"], r["df"]), "Kruskal-Wallis") for r in stats]
    return _test_table(counts.sparkSession, rows)


def categorical_tests(counts: DataFrame, groupby: str, levels: Sequence) -> DataFrame:
    """Chi-squared, or for a 2x2 table with a small expected count the exact
    test; other tables with a small expected count carry a warning.  The
    driver sees one row per variable."""
    rows = []
    for r in chi_squared(counts, groupby, levels).collect():
        small = r["min_expected"] is not None and r["min_expected"] < 5
        if small and r["a"] is not None:
            rows.append((r["variable"], fisher_two_sided(r["a"], r["b"], r["c"], r["d"]), "Fisher's exact"))
        else:
            name = "Chi-squared (warning: expected count < 5)" if small else "Chi-squared"
            rows.append((r["variable"], chi2_tail(r["statistic"], r["df"]), name))
    return _test_table(counts.sparkSession, rows)


def table_one(
    df: DataFrame, columns: Sequence[str], categorical: Sequence[str], groupby: str
) -> DataFrame:
    """The descriptive report.

    One row per continuous variable (median [Q1,Q3] per outcome) and, per
    categorical variable, a heading row and one row per level (n (%) per
    outcome).  Headings carry the missing count, p-value and test; ``row_idx``
    holds the report order.
    """
    continuous = [c for c in columns if c not in categorical]
    categorical = [c for c in columns if c in categorical]
    # the report reads the rows several times, so they are written once
    df = pin(df.where(F.col(groupby).isNotNull()).select(groupby, *columns))
    levels = outcome_levels(df, groupby)
    position = {c: i for i, c in enumerate([*continuous, *categorical])}
    missing = df.agg(
        *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in columns]
    )
    heads = missing.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("long").alias("missing")) for c in position])
        ).alias("m")
    ).select("m.*")
    sizes = df.groupBy(groupby).agg(F.count("*").alias("n"))
    parts = [
        sizes.groupBy().agg(
            *[F.max(F.when(F.col(groupby) == v, F.col("n").cast("string"))).alias(f"group_{v}") for v in levels]
        ).select(
            F.lit(-1).alias("_pos"), F.lit("").alias("variable"), F.lit("n").alias("features"),
            F.lit("").alias("level"), *[f"group_{v}" for v in levels],
        )
    ]
    tests = []
    place = F.element_at(F.create_map(*[F.lit(x) for kv in position.items() for x in kv]), F.col("variable"))

    def per_outcome(text: Column) -> list[Column]:
        return [F.max(F.when(F.col(groupby) == v, text)).alias(f"group_{v}") for v in levels]

    if continuous:
        values = pin(value_counts(df, continuous, groupby))
        text = F.format_string("%.2f [%.2f,%.2f]", "median", "q1", "q3")
        rows = _quartiles(values, groupby).groupBy("variable").agg(*per_outcome(text))
        parts.append(
            rows.select(
                place.alias("_pos"), "variable", F.concat("variable", F.lit(" (median [IQR])")).alias("features"),
                F.lit("").alias("level"), *[f"group_{v}" for v in levels],
            )
        )
        tests.append(continuous_tests(values, groupby))
    if categorical:
        counts = pin(level_counts(df, categorical, groupby))
        text = F.format_string("%d (%.2f)", "n", "pct")
        rows = level_shares(counts, groupby).groupBy("variable", "level").agg(*per_outcome(text))
        title = F.concat("variable", F.lit(" (n (%))")).alias("features")
        groups = [f"group_{v}" for v in levels]
        parts.append(rows.select(place.alias("_pos"), "variable", title, "level", *groups))
        # the heading row comes before the levels and has no counts of its own
        parts.append(
            heads.where(F.col("variable").isin(*categorical)).select(
                place.alias("_pos"), "variable", title, F.lit("").alias("level"),
                *[F.lit("").alias(g) for g in groups],
            )
        )
        tests.append(categorical_tests(counts, groupby, levels))
    body = parts[0]
    for part in parts[1:]:
        body = body.unionByName(part)
    result = tests[0] if len(tests) == 1 else tests[0].unionByName(tests[1])
    # a row per variable of the call
    notes = F.broadcast(heads.join(F.broadcast(result), "variable", "left"))
    heading = F.col("level") == ""
    report = (
        body.join(notes, "variable", "left")
        .select(
            "_pos", "features", "level", *[f"group_{v}" for v in levels],
            F.when(heading, F.col("missing")).alias("missing"),
            F.when(heading, F.col("pval")).alias("pval"),
            F.when(heading, F.col("test")).alias("test"),
        )
    )
    numbered = row_index(report, [F.col("_pos").asc(), F.col("level").asc()])
    return numbered.select("row_idx", *report.columns).drop("_pos").orderBy("row_idx")


def pick_rows(report: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Heading rows of the report with the given labels, in report order."""
    return report.where(F.col("features").isin(*labels) & (F.col("level") == "")).orderBy("row_idx")


def rows_at(report: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Report rows by position, in report order."""
    return report.where(F.col("row_idx").isin(*positions)).orderBy("row_idx")
