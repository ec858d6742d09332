"""The registered queries of the subpackage: each applies one operator with
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Public tokenizer files: byte-level for counts, with word ends for encoding.
COUNT_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
MAX_TOKENS = 1024


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_counts(spark, sf):
    from wardframe.llm.tokens import token_counts

    counts = token_counts(table(spark, sf, "documents"), vocabulary(COUNT_VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


@query
def op10_line_dedup(spark, sf):
    from wardframe.llm.linedup import dedup_lines

    done = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op2_quality_rules(spark, sf):
    from wardframe.llm.quality import judge

    judged = judge(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id", "lang"])
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: Its texts hold control strings of the template.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op4_chat_formatting(spark, sf):
    from wardframe.llm.chat import format_chats, read_back

    chats = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_chats(chats.unionByName(probe)))


@query
def op8_license_scan(spark, sf):
    from wardframe.llm.licenses import labelled, scan

    return labelled(scan(table(spark, sf, "documents"))).withColumnRenamed("id", "doc_id")


@query
def op1_simhash(spark, sf):
    from wardframe.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents"), shingle=3, distance=3)


@query
def op9_bpe_encoding(spark, sf):
    from wardframe.llm.wordbpe import encode

    done = encode(table(spark, sf, "documents"), vocabulary(WORD_VOCABULARY), stored=True)
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_best_fit_packing(spark, sf):
    from wardframe.llm.packing import packed_documents

    return packed_documents(table(spark, sf, "documents"), vocabulary(WORD_VOCABULARY), stored=True)


@query
def op3_substring_dedup(spark, sf):
    from wardframe.llm.substring import remove_repeats

    done = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), keep_text=False, stored=True)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_nn_descent(spark, sf):
    from wardframe.llm.nndescent import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))


@query
def op11_hard_negatives(spark, sf):
    from wardframe.llm.hardneg import hard_negatives

    vectors = table(spark, sf, "embeddings")
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), anchor=F.col("vec_id") % 100 == 0)


@query
def op12_exact_dedup(spark, sf):
    from wardframe.llm.exactdedup import exact_duplicates, normal

    return exact_duplicates(table(spark, sf, "documents"), carry={"text_sha256": F.sha2(normal("text"), 256)})


@query
def op13_merkle_manifest(spark, sf):
    """Every fifth row, by the checksum of its id, has its text lower-cased
    before its root is folded again."""
    from wardframe.llm.licenses import UPPER
    from wardframe.llm.merkle import manifest

    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = {"text": F.translate("text", UPPER, UPPER.lower())}
    return manifest(table(spark, sf, "documents"), altered=lowered, where=tampered)
