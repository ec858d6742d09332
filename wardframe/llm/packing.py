"""Best-fit packing by sums of squares.

A piece goes where the squared counts of open bins per residual gap become
smallest: into an open bin, or into a new one, whichever leaves the least sum.
That keeps gaps of every size in stock and so lets later pieces fill bins to
the brim.  Pieces are dealt at random to groups of about ``GROUP_PIECES``, and
each group is packed in one task, largest pieces first; only lengths are held.
Bins that a group could not fill are pieces again in the next round, which
packs the rests of many groups together until one group takes them all.  A
round goes on with less than half of the last one's pieces or else is the last.

Defined results: a null text is an empty one and still gives one piece, the
closing id; only documents longer than a sequence are cut; rows that repeat an
id are documents of their own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.llm.common import tidy_group
from wardframe.llm.wordbpe import encode
from wardframe.session import pin

SEQUENCE_TOKENS = 4096
END_ID = 1
GROUP_PIECES = 8192


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every item, placed in the order given."""
    count = np.zeros(capacity + 1)
    open_bins: dict[int, list[int]] = {}
    bins, offsets, made = [], [], 0
    for size in sizes:
        held = count[size:capacity]
        # half the change of the sum; a filled bin has no gap that counts
        change = np.where(held > 0, count[: capacity - size] - held + 1, np.inf)
        if len(change) and held[0] > 0:
            change[0] = 0.5 - held[0]
        best = int(change.argmin()) if len(change) else 0
        if not len(change) or change[best] > count[capacity - size] + 0.5:
            at, gap, made = made, capacity, made + 1
        else:
            gap = size + best
            at = open_bins[gap].pop()
            count[gap] -= 1
        if gap > size:
            open_bins.setdefault(gap - size, []).append(at)
            count[gap - size] += 1
        bins.append(at)
        offsets.append(capacity - gap)
    return bins, offsets


def pieces_of(tokens: DataFrame, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids): documents closed with ``end_id`` and cut
    only where they are longer than a sequence."""
    closing = "".join(f"{b:02X}" for b in int(end_id).to_bytes(4, "little"))
    whole = tokens.select("id", F.concat("ids", F.unhex(F.lit(closing))).alias("ids"))
    n = F.expr("octet_length(ids) DIV 4")
    cut = whole.select("id", "ids", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(octet_length(ids) DIV 4 - 1) DIV {capacity}"))).alias("piece"))
    start = F.col("piece") * capacity
    length = F.least(F.lit(capacity).cast("long"), F.col("n") - start)
    own = F.expr(f"substring(ids, CAST(piece * {4 * capacity} + 1 AS int), {4 * capacity})")
    return cut.select("id", F.col("piece").cast("int").alias("piece"), start.alias("start"), length.alias("length"), own.alias("ids"))


def _packed(items: DataFrame, groups: int, capacity: int, round_no: int) -> DataFrame:
    """(item, bin, offset, fill): every group of items packed by itself."""

    def fill(rows: pa.Table) -> pa.Table:
        length, item = rows.column("length").to_numpy(), rows.column("item").to_numpy()
        order = np.lexsort((item, -length))
        bins, offsets = sum_of_squares(length[order].tolist(), capacity)
        bins = np.array(bins, np.int64)
        # a bin is named after its first item, which no other bin holds
        first = np.unique(bins, return_index=True)[1]
        filled = np.bincount(bins, weights=length[order]).astype(np.int64)
        return pa.table({
            "item": item[order], "bin": item[order][first[bins]], "offset": np.array(offsets, np.int64),
            "fill": filled[bins],
        })

    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(tidy_group(fill), "item long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with ``length``) plus ``sequence_id`` and ``offset``."""
    named = pin(pieces.withColumn("item", F.monotonically_increasing_id()))
    open_items = named.where(F.col("length") < capacity).select("item", "length")
    left, placed, round_no = open_items.count(), None, 0
    while left:
        groups = -(-left // group_pieces)
        own = pin(_packed(open_items, groups, capacity, round_no))
        if placed is None:
            placed = own.select("item", "bin", "offset")
        else:
            moved = own.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
            placed = pin(placed.join(moved, "bin", "left").select(
                "item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
            ))
        if groups == 1:
            break
        rest = own.where(F.col("fill") < capacity).groupBy(F.col("bin").alias("item")).agg(F.max("fill").alias("length"))
        open_items, before = pin(rest), left
        left, round_no = open_items.count(), round_no + 1
        if 2 * left > before:
            break
    full = named.where(F.col("length") == capacity).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed is None:
        return full.drop("item")
    shared = named.where(F.col("length") < capacity).join(placed, "item").withColumnRenamed("bin", "sequence_id")
    return shared.select(*full.columns).unionByName(full).drop("item")


def packed_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, stored: bool = False,
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id,
    offset."""
    tokens = encode(docs, vocabulary, id_col, text_col, decode=False, stored=stored).withColumnRenamed(id_col, "id")
    cut = pieces_of(tokens, capacity, end_id).select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut, capacity).withColumnRenamed("id", id_col)
