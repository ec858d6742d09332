"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into ``distance // 2 + 1`` segments, fewer
than plain block permutation needs: of ``distance`` differing bits at most one
falls into some segment.  Every segment is indexed once per bit with that bit
replaced by a wildcard, so two segments that differ in at most one bit share a
variant.  Fingerprints that share a variant are joined and verified.  Equal
fingerprints are one row throughout.

Near copies can fill a variant with many fingerprints.  In such a crowded
variant no pairs are made.  Its fingerprints are linked through common
neighbours instead: two fingerprints differ in at most three bits exactly if
one bit replaced by a wildcard and at most one flip on either side make them
equal, so grouping by these keys gives links to one member of each group, a
number that grows with the fingerprints and not with their pairs.  The groups
formed by one flip alone are merged first; a crowded variant whose members all
fell into one component needs nothing more.

Defined results: words are lower-cased in A-Z; a text with fewer words than a
shingle is one shingle; a null or empty text has fingerprint 0 and is linked
like any other; a null id is the smallest id; rows that share an id keep their
own fingerprints and belong to the component of the smallest id among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardframe.llm.common import bounded_batches, id_back, id_or_least, raw, slices, tidy, words_of
from wardframe.llm.components import components
from wardframe.session import pin

BITS = 64
SEED = 42
SLICE_BYTES = 1 << 20
#: Fingerprints of a variant that are compared pair by pair.
CROWD = 64
LANES = np.uint64(0x0101010101010101)


def _hashes(array: pa.Array) -> np.ndarray:
    data, offsets = raw(array)
    data, at, digest = bytes(data), offsets.tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(array))


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes of each run; ``starts`` has one entry
    per run, none of them empty."""
    ends = np.append(starts[1:], len(hashes))
    sizes = ends - starts
    # a byte lane counts to 255, so longer runs are added up in blocks
    blocks = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    block_starts = np.repeat(starts, blocks) + 255 * within
    out = np.zeros(len(starts), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & LANES, block_starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def text_fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """Unsigned fingerprints of whole texts."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    words, at = words_of(low)
    sizes = np.diff(at)
    out = np.zeros(len(sizes), np.uint64)
    blank = pa.scalar(" ")
    many = np.flatnonzero(sizes >= shingle)
    if len(many):
        n = len(words) - shingle + 1
        joined = pc.binary_join_element_wise(*[words.slice(k, n) for k in range(shingle)], blank)
        runs = sizes[many] - shingle + 1
        starts = np.concatenate([[0], np.cumsum(runs)[:-1]])
        rows = np.arange(runs.sum()) + np.repeat(at[many] - starts, runs)
        out[many] = majority(_hashes(joined.take(pa.array(rows))), starts)
    for i in np.flatnonzero((sizes > 0) & (sizes < shingle)):
        text = " ".join(words.slice(at[i], sizes[i]).to_pylist())
        out[i] = xxhash.xxh64_intdigest(text.encode(), SEED)
    return out


def text_digest(text_col: str) -> Column:
    """Tells the texts under one id apart."""
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, digest: bool = False) -> DataFrame:
    """(id, fp) per row, with ``digest`` the text's digest as well; fp has the
    64 bits as a signed number."""
    extra = ["digest"] if digest else []

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                fp = text_fingerprints(part.column(1), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), *part.columns[2:]], names=["id", "fp", *extra])

    bounded_batches(docs.sparkSession)
    sent = docs.select(
        id_or_least(F.col(id_col)).alias("id"), F.col(text_col).alias("text"), *[text_digest(text_col).alias(c) for c in extra]
    )
    return sent.mapInArrow(tidy(made), ", ".join(f"{c} long" for c in ["id", "fp", *extra]))


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, bit, first, value): one row per segment and wildcard bit; ``first``
    marks the first bit of a segment."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    keys = []
    for i in range(n):
        width = edges[i + 1] - edges[i]
        mask = ((1 << width) - 1) << edges[i]
        for bit in range(edges[i], edges[i + 1]):
            left = mask & ~(1 << bit)
            signed = left - (1 << BITS) if left >> (BITS - 1) else left
            keys.append(F.struct(F.lit(bit).alias("bit"), F.lit(bit == edges[i]).alias("first"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")


def _flips(fps: DataFrame) -> DataFrame:
    """(fp, key): the fingerprint itself and with every one bit flipped."""
    masks = [0, *[1 << b if b < BITS - 1 else -(1 << b) for b in range(BITS)]]
    flips = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks]))
    return fps.select("fp", flips.alias("key"))


def _stars(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): every member of a group linked to the group's least member."""
    least = keyed.groupBy(*keys).agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last")
    return keyed.join(pin(least.drop("last")), keys).where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, distance: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps`` that join exactly
    those within ``distance`` bits, directly or through others."""
    if distance > 3:
        raise ValueError("crowded variants are resolved for at most three bits")
    close = variants(fps, distance)
    counted = pin(close.groupBy("bit", "value").agg(F.count("*").alias("n")).where("n > 1"))
    # shared variants grow with the data: one plan, never a broadcast, at every size
    shared = pin(close.join(counted.hint("merge"), ["bit", "value"]))
    cold = shared.where(F.col("n") <= crowd)
    left = cold.select("bit", "value", "first", F.col("fp").alias("a"))
    right = cold.select("bit", "value", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # equal segments share every variant; only the first one may report them
    own = F.expr("shiftrightunsigned(a ^ b, bit) & 1 = 1 OR first")
    near = left.join(right, ["bit", "value"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & own
    ).select("a", "b").distinct()
    hot = pin(shared.where(F.col("n") > crowd).select("bit", "value", "fp"))
    if hot.isEmpty():
        return near
    return near.unionByName(crowded_links(hot, distance))


def crowded_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links for the members of crowded variants (bit, value, fp)."""
    members = pin(hot.select("fp").distinct())
    first = _flips(members)
    if distance < 2:
        # one flip on one side only
        first = first.join(members.select(F.col("fp").alias("key")), "key", "left_semi")
    direct = pin(_stars(first, ["key"]))
    if distance < 3:
        return direct
    # variants whose members are not yet in one component
    merged = pin(components(direct))
    placed = hot.join(merged, hot["fp"] == merged["node"], "left").select(
        "bit", "value", "fp", F.coalesce("component", "fp").alias("part")
    )
    mixed = placed.groupBy("bit", "value").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    rest = pin(placed.join(pin(mixed.select("bit", "value")), ["bit", "value"]).select("fp").distinct())
    if rest.isEmpty():
        return direct
    wild = F.explode(F.array(*[
        F.struct(F.lit(b).alias("wild"), F.col("key").bitwiseAND(F.lit(~(1 << b) if b < BITS - 1 else (1 << b) - 1)).alias("rest"))
        for b in range(BITS)
    ]))
    keyed = _flips(rest).select("fp", wild.alias("w")).select("fp", "w.wild", "w.rest").distinct()
    return direct.unionByName(_stars(keyed, ["wild", "rest"])).distinct()


def _parts(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, least, part): every fingerprint with its least id and its group."""
    per_fp = pin(rows.groupBy("fp").agg(F.min("id").alias("least")))
    near = links(per_fp.select("fp"), distance)
    groups = pin(components(near))
    return per_fp.join(groups, per_fp["fp"] == groups["node"], "left").select(
        per_fp["fp"], "least", F.coalesce("component", per_fp["fp"]).alias("part")
    )


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3,
) -> DataFrame:
    """(id, digest, part): per group of near copies the smallest id and the
    digests of the texts that this id has in the group."""
    rows = pin(fingerprints(docs, id_col, text_col, shingle, digest=True))
    parts = pin(_parts(rows, distance))
    first = parts.groupBy("part").agg(F.min("least").alias("id"))
    chosen = parts.join(first, "part").where("least = id").select("fp", "id", "part")
    return pin(rows.join(chosen, ["fp", "id"]).select("id", "digest", "part").distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3,
) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.  Only
    fingerprints link: rows that share an id are rows of their own, and an id
    that stands in two groups does not join them."""
    rows = pin(fingerprints(docs, id_col, text_col, shingle))
    joined = _parts(rows, distance)
    named = pin(joined.select("fp", "part").join(
        joined.groupBy("part").agg(F.min("least").alias("component_id")), "part"
    ).select("fp", "component_id"))
    tail = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(
        id_back(F.col("id")).alias(id_col), tail.alias("fingerprint"), id_back(F.col("component_id")).alias("component_id")
    )
