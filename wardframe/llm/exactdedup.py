"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Texts are compared without the characters ``[\\x20\\x09-\\x0D]``.

1. Every text leaves its length and the hash of its first characters.  Lengths
   that occur once are settled; of the others, so are prefixes that occur once
   at their length.
2. What survives is marked in a bitmap of ``2 ** SLOT_BITS`` slots of (length,
   prefix hash).  Its size is fixed, so it may be broadcast whatever the
   input, and texts are never shuffled.  A chance hit costs one more full hash
   and decides nothing.
3. Only texts in a marked slot are hashed whole.  Equal hashes (SHA-256) form
   a group.

Of a group the row with the most code points in its original text stays, then
the smallest id.  A group's result is joined back to its rows; the groups that
hold more than one ``HOT``-th of all rows are at most ``HOT`` in number, so
these are broadcast and no task gets such a group.

Defined results: a null text is an empty one, and all texts without other
characters are equal; a null id is the smallest; of rows that agree in id and
number of code points exactly one stays; columns of other names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.session import pin

BLANKS = " \t\n\x0b\x0c\r"
PREFIX = 64
SLOT_BITS = 26
HOT = 1000


def normal(text: str) -> Column:
    """The text without ASCII white space."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _head(text: Column) -> list[Column]:
    return [F.length(text).alias("size"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("head")]


def _slot() -> Column:
    return F.pmod(F.xxhash64("size", "head"), F.lit(1 << SLOT_BITS)) + 1


def survivors(heads: DataFrame) -> DataFrame:
    """(size, head, n) of the prefixes that several rows of (size, head) share,
    length by length."""
    per_head = pin(heads.groupBy("size", "head").agg(F.count("*").alias("n")))
    lengths = per_head.groupBy("size").agg(F.sum("n").alias("rows")).where("rows > 1")
    return per_head.where("n > 1").join(lengths, "size", "left_semi")


def marked_slots(shared: DataFrame) -> DataFrame:
    """(bucket, bitmap): at most ``2 ** (SLOT_BITS - 15)`` rows of 4 KB."""
    return shared.select(_slot().alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )


def _is_marked() -> Column:
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def full_hashes(docs: DataFrame, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    """(row, id, chars, full, carry): one written row per row of ``docs``;
    ``full`` is null where the length or the prefix settled that the text
    stands alone."""
    own = normal(text_col)
    bitmap = pin(marked_slots(survivors(docs.select(*_head(own)))))
    rows = docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"), own.alias("own"),
        F.struct(F.lit(0).alias("_"), *[value.alias(name) for name, value in carry.items()]).alias("carry"),
    )
    rows = rows.select("*", *_head(F.col("own"))).withColumn("slot", _slot())
    rows = rows.withColumn("bucket", F.bitmap_bucket_number("slot")).join(F.broadcast(bitmap), "bucket", "left")
    full = F.when(_is_marked(), F.sha2("own", 256))
    return pin(rows.select(F.monotonically_increasing_id().alias("row"), "id", "chars", full.alias("full"), "carry"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """(id_col, keep_id, group_size, kept) for every row, and the ``carry``
    expressions over the columns of ``docs``."""
    carry = carry or {}
    rows = full_hashes(docs, id_col, text_col, carry)
    first = F.struct((-F.col("chars")).alias("chars"), "id", "row")
    groups = rows.where("full IS NOT NULL").groupBy("full").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    groups = pin(groups.where("n > 1").select("full", "n", F.col("first.id").alias("keep"), F.col("first.row").alias("stays")))
    bound = F.lit(rows.count() / HOT)
    hot, others = groups.where(F.col("n") > bound), groups.where(F.col("n") <= bound)
    # the hot groups are fewer than HOT by their definition
    near = rows.where("full IS NOT NULL").join(F.broadcast(hot), "full", "left")
    cold = near.where("stays IS NULL").drop(*[c for c in groups.columns if c != "full"]).join(others, "full", "left")
    alone = rows.where("full IS NULL")
    done = near.where("stays IS NOT NULL").unionByName(cold).unionByName(alone, allowMissingColumns=True)
    single = F.col("stays").isNull()
    return done.select(
        F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("stays"))).alias("kept"),
        *[F.col("carry")[name].alias(name) for name in carry],
    )
