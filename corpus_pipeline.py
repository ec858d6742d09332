"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows its predecessor kept and is written as Parquet
before the next one reads it, so stages may rely on stored input.  Until the last stage rows keep the columns of
``documents``, extra ones included; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.llm.common import id_or_least, table
from wardframe.llm.linedup import dedup_lines
from wardframe.llm.packing import packed_documents
from wardframe.llm.quality import judge
from wardframe.llm.queries import WORD_VOCABULARY, vocabulary
from wardframe.llm.simhash import representatives, text_digest
from wardframe.llm.substring import remove_repeats
from wardframe.session import pin


def _set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the names by column."""
    names = {c: f"{c}__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(done: DataFrame, names: dict[str, str], text: Column) -> DataFrame:
    """The columns of ``documents`` with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*[new.get(c, F.col(own)).alias(c) for c, own in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = judge(docs, table(spark, sf_dir, "labels"), docs.columns)
    return judged.where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay only in the document with the largest id."""
    aside, names = _set_aside(docs)
    done = dedup_lines(aside, names["doc_id"], names["text"])
    return _restored(done, names, F.col(names["text"]))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (a
    missing id is the smallest); of rows of the group that share this id the one
    with the smallest text stays, a missing text being the smallest.  Rows that
    share an id but no group do not touch each other."""
    found = representatives(docs, shingle=3, distance=3)
    aside, names = _set_aside(docs)
    text = F.col(names["text"])
    keyed = aside.withColumn("key", id_or_least(F.col(names["doc_id"]))).withColumn("own", text_digest(names["text"]))
    same = (keyed["key"] == found["id"]) & (keyed["own"] == found["digest"])
    kept = keyed.join(found, same)
    row = F.struct(*[F.col(own).alias(c) for c, own in names.items()])
    order = F.struct(text.isNotNull(), text)
    return kept.groupBy("part").agg(F.min_by(row, order).alias("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; a text that loses nothing
    stays as it is, another one becomes its kept words joined by one blank."""
    aside, names = _set_aside(docs)
    done = remove_repeats(aside, names["doc_id"], names["text"], stored=True)
    return _restored(done, names, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(names["text"])))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its training sequence."""
    return packed_documents(docs, vocabulary(WORD_VOCABULARY), stored=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Hash groups, tokenizers and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
