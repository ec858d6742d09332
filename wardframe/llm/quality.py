"""Quality rules whose cutoffs are chosen under a risk bound.

Every rule compares a count with a cutoff.  For each stratum (language) and
each cutoff of a fixed grid, the labelled good documents are the holdout: n of
them passed the base rules and the cutoff would reject k.  The cutoff may be
used only if its exact (Clopper-Pearson) upper bound on the false-rejection
rate stays below the rule's share of ``risk``, which is the binomial test
P(Bin(n, share) <= k) <= delta / tests, corrected for all tests made
(Bonferroni).  The strictest such cutoff is taken; without one the rule is off
in that stratum.  So with probability 1 - delta no stratum loses more than
``risk`` of its good documents.

Only DataFrame and SQL functions are used.  Defined results: a null text has
no words and fails the base rules; a null language is a stratum of its own;
a document labelled more than once is good if any label says so; repeated rows
are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.session import pin

RISK = 0.05
DELTA = 0.05
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Rejects where ``left`` exceeds cutoff times ``right`` (both SQL over the
    counts); cutoffs run from strict to lenient."""

    name: str
    left: str
    right: str
    cutoffs: tuple[int, ...]

    def rejects(self, cutoff: Column) -> Column:
        return F.expr(self.left) > cutoff * F.expr(self.right)


RULES = (
    Rule("symbols", "100 * n_symbols", "n_words", (2, 5, 10, 20, 40, 80)),
    Rule("dup_lines", "100 * n_dup_lines", "n_lines", (5, 10, 20, 30, 40, 60)),
    Rule("repeat_words", "100 * n_repeat_words", "n_words", (2, 5, 8, 12, 16)),
    Rule("long_words", "word_chars", "n_words", (7, 8, 9, 10, 12, 16)),
    Rule("loud", "100 * n_loud", "word_chars", (2, 5, 10, 20, 40, 60)),
)


def _windows(words: str) -> str:
    at = ", ".join(f"{words}[i + {k}]" for k in range(WINDOW))
    return f"transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64({at}))"


#: Words inside windows that occur at least twice.  A one-element array around
#: a value binds it to a name, so it is computed once.  Only a text with an
#: equal pair sorts its windows.
REPEAT_WORDS = f"""
CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE
transform(array({_windows("w")}), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
  transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), p ->
    transform(array(sort_array(transform(
        filter(p, (e, k) -> e.x <=> get(p, k - 1).x OR e.x <=> get(p, k + 1).x), e -> e.i))), s ->
      aggregate(transform(s, (e, k) -> least({WINDOW}, coalesce(get(s, k + 1) - e, {WINDOW}))), 0L, (a, n) -> a + n)
    )[0])[0] END)[0] END
"""

COUNTS = rf"""
transform(array(array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')), w -> struct(
  CAST(size(w) AS long) AS n_words,
  CAST(length(array_join(w, '')) AS long) AS word_chars,
  {REPEAT_WORDS} AS n_repeat_words))[0]
"""

LINES = r"""
transform(array(filter(split(text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')), l -> struct(
  CAST(size(l) AS long) AS n_lines,
  CAST(size(l) - size(array_distinct(l)) AS long) AS n_dup_lines))[0]
"""


def _without(pattern: str) -> str:
    return rf"CAST(length(text) - length(regexp_replace(text, '{pattern}', '')) AS long)"


def counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    texts = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = texts.select(
        "row", F.expr(COUNTS).alias("c"), F.expr(LINES).alias("l"),
        F.expr(_without("[#*$%&|<>]")).alias("n_symbols"), F.expr(_without("!")).alias("n_loud"),
    )
    failed = f"c.n_words < {MIN_WORDS} OR 100 * c.n_repeat_words > {MAX_REPEAT_PERCENT} * c.n_words"
    return read.select("row", "c.*", "l.*", "n_symbols", "n_loud", F.expr(failed).alias("base_failed"))


def _tail(n: str, k: str, share: float) -> Column:
    """log P(Bin(n, share) <= k) by adding terms in logarithms."""
    # double literals: a decimal quotient would keep six digits only
    odds = f"ln({share}D / (1 - {share}D))"
    step = f"a.t + ln(({n} - j + 1) / j) + {odds}"
    add = f"greatest(a.s, {step}) + ln(1 + exp(-abs(a.s - ({step}))))"
    start = f"{n} * ln(1 - {share}D)"
    return F.expr(
        f"CASE WHEN {k} = 0 THEN {start} ELSE aggregate(sequence(1L, {k}), struct({start} AS t, {start} AS s), "
        f"(a, j) -> struct({step} AS t, {add} AS s), a -> a.s) END"
    )


def cutoffs(counted: DataFrame, good: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the chosen cutoff of every rule (null: off).

    ``counted`` has a ``row`` struct with ``doc_id`` and ``stratum``; ``good``
    has the ids of the labelled good documents, once each.
    """
    held = counted.where("NOT base_failed").join(good, F.col("row.doc_id") == good["good_id"], "left_semi")
    grid = [(rule, c) for rule in RULES for c in rule.cutoffs]
    per = held.groupBy(F.col("row")[stratum].alias("stratum")).agg(
        F.count("*").alias("n"),
        *[F.count_if(rule.rejects(F.lit(c))).alias(f"{rule.name}_{c}") for rule, c in grid],
    )
    tests = per.agg((F.count("*") * len(grid)).alias("tests"))
    share = risk / len(RULES)
    cells = F.explode(F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule.name}_{c}").alias("k"))
        for rule, c in grid
    ]))
    # one row: the number of tests
    tested = per.select("stratum", "n", cells.alias("t")).select("stratum", "n", "t.*").join(F.broadcast(tests))
    passed = tested.where(F.col("k") <= F.col("n") * share).where(
        _tail("n", "k", share) <= F.log(F.lit(delta) / F.col("tests"))
    )
    return passed.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == rule.name, F.col("cutoff"))).alias(f"cut_{rule.name}") for rule in RULES]
    )


def judge(
    docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang", text_col: str = "text",
    risk: float = RISK, delta: float = DELTA,
) -> DataFrame:
    """``row`` (the ``keep`` columns, which hold doc_id and the stratum), the
    counts, ``base_failed``, ``kept`` and the cutoffs that applied."""
    counted = pin(counts(docs, keep, text_col))
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("good_id")).agg(
        F.max("quality").alias("q")
    ).where("q = 1").select("good_id")
    # one row per stratum; read from a table, so its size is known to the join
    chosen = pin(cutoffs(counted, good, stratum, risk, delta))
    judged = counted.join(chosen, F.col("row")[stratum].eqNullSafe(F.col("stratum")), "left")
    rejected = reduce(or_, [F.coalesce(rule.rejects(F.col(f"cut_{rule.name}")), F.lit(False)) for rule in RULES])
    return judged.drop("stratum").withColumn("kept", ~F.col("base_failed") & ~rejected)
