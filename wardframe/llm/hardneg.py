"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

1. Rows are sorted by label and by their place on a Hilbert curve through the
   dimensions of largest variance, and written as Parquet blocks of ``BLOCK``
   rows.  A block's zone map holds the least and the greatest label and, per
   dimension, the least and the greatest component.
2. An anchor's scores in a block lie between two numbers that interval
   arithmetic gives from the zone map alone.  Anchors of ``SPAN`` neighbouring
   blocks form a group; tiles of one group and ``ZONES`` zone maps decide which
   blocks the group's windows must read.
3. Positives: an anchor's fifth best score in its own block bounds its window
   from below, and blocks of its label whose upper bound reaches it are read.
4. Negatives: each positive opens a window of scores; blocks that hold another
   label and whose bounds meet a window are read.

The bounds are exact (whole numbers), so a block that is left out holds no
result.  The stated anchors are compared with all blocks, through tiles and
never row by row; blocks, groups and tiles are bounded in rows whatever label or
copy is frequent.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors are filled up with zeros; a null id is
the smallest and no anchor by a predicate on it; rows that share an id are rows of
their own, and an anchor is not its own positive but its copies are.  Scores
have to fit 63 bits, else the operator raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.llm.common import bounded_batches, id_back, id_or_least, tidy
from wardframe.session import pin

SCALE = 256
BLOCK = 256
SPAN = 64
ZONES = 4096
CURVE_DIMS = 12
CURVE_BITS = 5
BLOCK_ROW = (
    "part long, block long, label_min long, label_max long, lo binary, hi binary, ids binary, labels binary, anchors binary, q binary"
)
ANCHOR_ROW = "span long, row long, id long, label long, q binary, floor long"
GROUP_ROW = "span long, rows binary, ids binary, labels binary, q binary, low binary, high binary, slots binary, positives binary"
HIT = "span long, row long, slot long, anchor_id long, positive_id long, other_id long, score long"
NONE = np.iinfo(np.int64).min


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of coordinates below ``2 ** bits``) on a
    Hilbert curve: neighbours on the curve are neighbours in the grid."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            # a cell in the upper half turns the first axis over, one in the lower half swaps it with axis i
            upper = (x[i] & bit) != 0
            swap = np.where(upper, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, np.uint64(0)) ^ swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


def usable_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, anchor: Column) -> DataFrame:
    """(id, label, q, anchor) of the rows that take part, written."""
    v = F.col("v")
    fine = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        id_or_least(F.col(id_col)).alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    return pin(rows.where(fine).select("id", "label", q.alias("q"), "anchor"))


class Shape:
    """What the whole table says about its components: how many there are,
    which of them the curve runs through, and how wide the numbers get."""

    def __init__(self, rows: DataFrame):
        per = rows.select(F.posexplode("q").alias("dim", "x")).groupBy("dim").agg(
            F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
        )
        # one row per dimension
        found = sorted(per.collect())
        self.dims = len(found)
        square = sum(max(abs(r.low), abs(r.high)) ** 2 for r in found)
        if square >= 2**63:
            raise ValueError("scores of these vectors do not fit 63 bits")
        # sums below 2 ** 53 are exact in doubles, whose products are fast
        self.work = np.float64 if square < 2**53 else np.int64
        wide = sorted(found, key=lambda r: (-r.std, r.dim))[:CURVE_DIMS]
        self.curve = np.array([r.dim for r in wide], np.int64)
        self.centre, self.width = np.array([r.mean for r in wide]), np.array([4 * r.std or 1.0 for r in wide])

    def matrix(self, q: pa.Array) -> np.ndarray:
        q = pa.concat_arrays(q.chunks) if isinstance(q, pa.ChunkedArray) else q
        sizes = np.diff(q.offsets.to_numpy())
        flat = q.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(sizes), self.dims), np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def keys(self, matrix: np.ndarray) -> np.ndarray:
        if not self.dims:
            return np.zeros(len(matrix), np.int64)
        at = (matrix[:, self.curve] - self.centre) / self.width + 0.5
        return hilbert(np.clip(at * 2**CURVE_BITS, 0, 2**CURVE_BITS - 1).astype(np.int64), CURVE_BITS)

    def packed(self, values: np.ndarray) -> bytes:
        small = np.int32 if self.work is np.float64 else np.int64
        return values.astype(small).tobytes()

    def unpacked(self, data: bytes) -> np.ndarray:
        small = np.int32 if self.work is np.float64 else np.int64
        return np.frombuffer(data, small).reshape(-1, self.dims).astype(self.work)

    def bounds(self, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of every anchor in every zone."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def curve_blocks(rows: DataFrame, shape: Shape) -> DataFrame:
    """Blocks of ``BLOCK`` rows in the order of label and Hilbert curve, written
    with their zone maps."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pa.array(shape.keys(shape.matrix(batch.column(2))))
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=["id", "label", "q", "anchor", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, n, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= BLOCK:
                whole = pa.concat_batches(held)
                yield block(part, n, whole.slice(0, BLOCK))
                held, size, n = [whole.slice(BLOCK)], size - BLOCK, n + 1
        if size:
            yield block(part, n, pa.concat_batches(held))

    def block(part: int, n: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        # by id, so that the first of equal scores is the one with the smallest id
        batch = batch.take(pc.sort_indices(batch.column(0)))
        q, labels = shape.matrix(batch.column(2)), batch.column(1).to_numpy()
        values = [
            part, (part << 24) + n, int(labels.min()), int(labels.max()), shape.packed(q.min(axis=0)), shape.packed(q.max(axis=0)),
            batch.column(0).to_numpy().tobytes(), labels.tobytes(),
            batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), shape.packed(q),
        ]
        return pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in BLOCK_ROW.split(", ")], values, strict=True))])

    by = ["label", "key", "id"]
    ranged = rows.mapInArrow(tidy(keyed), "id long, label long, q array<long>, anchor boolean, key long")
    return pin(pin(ranged).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(tidy(cut), BLOCK_ROW))


def first_hits(scores: np.ndarray, fits: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``keep`` best fitting columns; equal scores
    keep the order of the columns."""
    order = np.argsort(-scores, axis=1, kind="stable")
    some = np.take_along_axis(fits, order, 1)
    row, place = np.nonzero(some & (np.cumsum(some, axis=1) <= keep))
    return row, order[row, place]


def anchors_of(blocks: DataFrame, shape: Shape, positives: int) -> DataFrame:
    """(span, row, id, label, q, floor): the anchors; ``floor`` is the score of
    the last of ``positives`` rows of the label in the anchor's own block."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
                if not len(at):
                    continue
                ids, labels, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), shape.unpacked(r["q"])
                scores = q[at] @ q.T
                fits = labels[at][:, None] == labels[None, :]
                fits[np.arange(len(at)), at] = False
                row, column = first_hits(scores, fits, positives)
                for i, own in enumerate(at.tolist()):
                    best = scores[i, column[row == i]]
                    floor = int(best[-1]) if len(best) == positives else None
                    out.append({
                        "span": r["block"] // SPAN, "row": r["block"] * BLOCK + own, "id": int(ids[own]), "label": int(labels[own]),
                        "q": shape.packed(q[own]), "floor": floor,
                    })
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("span", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("q", pa.binary()),
                        ("floor", pa.int64())])
    slim = blocks.where(F.hex("anchors").contains("1")).select("block", "ids", "labels", "anchors", "q")
    return pin(slim.mapInArrow(tidy(found), ANCHOR_ROW))


def _grouped(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per span with its anchors and their windows.  ``windows`` has
    (span, row, slot, positive, low, high)."""
    both = anchors.select("span", "row", "id", "label", "q").join(windows, ["span", "row"])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row", "ascending"), ("slot", "ascending")])
        columns = {c: rows.column(c).to_numpy() for c in ("row", "id", "label", "low", "high", "slot", "positive")}
        names = ("rows", "ids", "labels", "low", "high", "slots", "positives")
        packed = {n: [v.astype(np.int64).tobytes()] for n, v in zip(names, columns.values(), strict=True)}
        packed["q"] = [b"".join(rows.column("q").to_pylist())]
        return pa.table({"span": [rows.column("span")[0].as_py()], **{
            n: pa.array(packed[n], pa.binary()) for n in ("rows", "ids", "labels", "q", "low", "high", "slots", "positives")}})

    return pin(both.groupBy("span").applyInArrow(pack, GROUP_ROW))


def blocks_to_read(groups: DataFrame, blocks: DataFrame, shape: Shape, same: bool) -> DataFrame:
    """(span, block): by their zone maps, the blocks that a group's windows
    must read.  ``same`` asks for the anchors' labels, else for others."""
    zones = blocks.select("block", "label_min", "label_max", "lo", "hi")
    numbered = Window.partitionBy("part").orderBy("block")
    chunk = F.floor((F.row_number().over(numbered) - 1) / ZONES)
    keyed = pin(blocks.select("part", "block", chunk.alias("chunk")))
    # one row per ZONES blocks, numbered from 0
    chunks = pin(keyed.select("part", "chunk").distinct().withColumn("c", F.row_number().over(Window.orderBy("part", "chunk")) - 1))
    n_chunks = chunks.count()
    tiles = zones.join(keyed.join(chunks, ["part", "chunk"]).select("block", "c"), "block")
    tiles = pin(tiles.groupBy("c").agg(F.collect_list(F.struct("block", "label_min", "label_max", "lo", "hi")).alias("zones")))
    pairs = groups.select("span", "labels", "q", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_chunks - 1)))).alias("c"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("span", "labels", "q", "low", "high")}
                zone = batch.column("zones")[i].as_py()
                labels, low, high = (np.frombuffer(r[c], np.int64) for c in ("labels", "low", "high"))
                first, last = (np.array([z[c] for z in zone]) for c in ("label_min", "label_max"))
                lo, hi = (shape.unpacked(b"".join(z[c] for z in zone)) for c in ("lo", "hi"))
                least, greatest = shape.bounds(shape.unpacked(r["q"]), lo, hi)
                meets = (greatest >= low[:, None]) & (least <= high[:, None])
                if same:
                    meets &= (first <= labels[:, None]) & (labels[:, None] <= last)
                else:
                    meets &= (first != labels[:, None]) | (labels[:, None] != last)
                read = np.array([z["block"] for z in zone])[meets.any(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(read), r["span"])), pa.array(read)], names=["span", "block"])

    return pin(pairs.join(tiles, "c").mapInArrow(tidy(decide), "span long, block long"))


def read_blocks(groups: DataFrame, blocks: DataFrame, wanted: DataFrame, shape: Shape, same: bool, keep: int) -> DataFrame:
    """HIT rows: the first ``keep`` fitting rows of every window."""
    # a block goes beside a group's anchors as one row, so a task holds few of them at a time
    slim = blocks.select("block", "ids", "labels", "q")
    renamed = groups.select("span", "rows", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("q").alias("a_q"),
                            "low", "high", "slots", "positives")
    pairs = wanted.join(renamed, "span").join(slim, "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                rows, a_ids, a_labels, low, high, slots, positives = (
                    np.frombuffer(r[c], np.int64) for c in ("rows", "a_ids", "a_labels", "low", "high", "slots", "positives"))
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                scores = shape.unpacked(r["a_q"]) @ shape.unpacked(r["q"]).T
                fits = (scores >= low[:, None]) & (scores <= high[:, None])
                alike = a_labels[:, None] == labels[None, :]
                fits &= alike if same else ~alike
                if same:
                    own = np.flatnonzero(rows // BLOCK == r["block"])
                    fits[own, rows[own] % BLOCK] = False
                row, column = first_hits(scores, fits, keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), r["span"])), pa.array(rows[row]), pa.array(slots[row]), pa.array(a_ids[row]),
                     pa.array(positives[row]), pa.array(ids[column]), pa.array(scores[row, column].astype(np.int64))],
                    names=[c.split()[0] for c in HIT.split(", ")],
                )

    hits = pairs.mapInArrow(tidy(compare), HIT)
    order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "other_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    anchor: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for the rows where ``anchor`` holds (every one by default)
    and each of their first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent
    of the positive's."""
    bounded_batches(vectors.sparkSession)
    rows = usable_rows(vectors, id_col, label_col, vector_col, scale, F.lit(True) if anchor is None else anchor)
    shape = Shape(rows)
    blocks = curve_blocks(rows, shape)
    anchors = anchors_of(blocks, shape, positives)
    every = np.iinfo(np.int64).max
    open_ended = anchors.select(
        "span", "row", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("positive"),
        F.coalesce("floor", F.lit(NONE)).alias("low"), F.lit(int(every)).alias("high"),
    )
    groups = _grouped(anchors, open_ended)
    near = pin(read_blocks(groups, blocks, blocks_to_read(groups, blocks, shape, True), shape, True, positives))
    # 100 * score between low * positive and high * positive, in whole numbers; none below a negative one
    score = F.col("score").cast("decimal(38,0)")
    windows = near.select(
        "span", "row", F.col("rank").cast("long").alias("slot"), F.col("other_id").alias("positive"), F.col("score").alias("found"),
        F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"),
    ).where("low <= high")
    groups = _grouped(anchors, windows.drop("found"))
    hits = read_blocks(groups, blocks, blocks_to_read(groups, blocks, shape, False), shape, False, negatives)
    done = hits.join(windows.select("row", "slot", F.col("found").alias("positive_score")), ["row", "slot"])
    return done.select(
        id_back(F.col("anchor_id")).alias("anchor_id"), id_back(F.col("positive_id")).alias("positive_id"), "rank",
        id_back(F.col("other_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
