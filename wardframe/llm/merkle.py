"""Merkle manifest of a dataset, with proofs by an octopus multiproof.

A row is a leaf: the SHA-256 of its columns.  Per source the leaves, ordered by
id, form a tree of ``fanout`` children a node; the subroots, ordered by source,
form a tree above them whose root stands for the dataset.

1. Leaves are range-sorted by source and id and written in partitions of about
   ``LEAF_ROWS`` rows.  A partition holds one segment of every source it
   touches; places inside a source follow from the segment sizes alone.
2. Both trees are built level by level, one aggregate of at most ``fanout``
   digests a node.
3. The proofs of a partition share nearly all their nodes.  From its segments
   follows which nodes its proofs need and its own leaves cannot give: at
   each level the brothers left and right of its range.  This union is
   fetched by one join, each node once a partition.
4. A partition derives the interior nodes from its leaves and the fetched
   nodes, and expands and folds every single proof from them.

Defined results: null values are leaves as ``-``; a null id or source comes
first; rows that share an id are ordered by their digest, so equal rows may
stand for one another; columns that are not named do not matter; an empty table
has no rows.  A row with a null id is never altered by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardframe.llm.common import tidy_group
from wardframe.operators.ordered import null_safe_join, numbered_rows
from wardframe.session import pin

FANOUT = 16
LEAF_ROWS = 16384
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree number of the tree over the subroots.
TOP = -1
HEX = 64
AUX = "part long, kind string, tree long, level int, idx long, begin long, n long, total long, digest string"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each ``-`` or its byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]), 256)


def sorted_leaves(
    docs: DataFrame, columns: Sequence[str], source: str, order: str, altered: dict[str, Column], where: Column
) -> DataFrame:
    """(part, pos, source, id, leaf, other): the leaves in range partitions;
    ``other`` is the leaf of the altered row."""
    other = F.when(where, leaf_digest([altered.get(c, F.col(c)) for c in columns]))
    rows = pin(docs.select(
        F.col(source).alias("source"), F.col(order).alias("id"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        other.alias("other"), F.monotonically_increasing_id().alias("tie"),
    ))
    parts = max(1, -(-rows.count() // LEAF_ROWS))
    by = ["source", "id", "leaf", "tie"]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie")
    # the number of a row within its partition follows the sort
    at = F.monotonically_increasing_id()
    return pin(ranged.select(F.spark_partition_id().cast("long").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("pos"), *ranged.columns))


def segments_of(leaves: DataFrame) -> DataFrame:
    """(part, source, tree, begin, n, idx, total): the run of a source in a
    partition, where it begins there and within its source."""
    runs = pin(leaves.groupBy("part", "source").agg(F.min("pos").alias("begin"), F.count("*").alias("n")))
    names, _ = numbered_rows(runs.select("source").distinct(), [F.col("source").asc_nulls_first()], "tree")
    placed = null_safe_join(runs, names, ["source"], "inner")
    # a source has one row per partition here
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return pin(placed.select(
        "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("idx"), F.sum("n").over(whole).alias("total")
    ))


def levels_of(nodes: DataFrame, height: int, fanout: int) -> list[DataFrame]:
    """The levels of all trees above (tree, idx, total, digest)."""
    out = [nodes]
    for _ in range(height):
        below = out[-1].where("total > 1")
        children = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        run = F.concat_ws("", F.transform(children, lambda c: c["digest"]))
        up = below.groupBy("tree", F.expr(f"idx div {fanout}").alias("up")).agg(
            F.max("total").alias("total"), F.sha2(run, 256).alias("digest")
        )
        out.append(pin(up.select("tree", F.col("up").alias("idx"), F.expr(f"(total + {fanout - 1}) div {fanout}").alias("total"), "digest")))
    return out


def height_of(total: int, fanout: int) -> int:
    height = 0
    while total > 1:
        total, height = -(-total // fanout), height + 1
    return height


def missing_nodes(segments: DataFrame, height: int, fanout: int) -> DataFrame:
    """(part, tree, level, idx): the nodes that the proofs of a partition's
    segments (part, tree, idx, n, total) need beside what their own leaves
    give.  At every level these lie left and right of the segment's range, at
    most ``fanout - 1`` on either side."""
    if not height:
        return segments.select("part", "tree", F.lit(0).alias("level"), "idx").limit(0)
    spans = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(fanout**k).cast("long").alias("span")) for k in range(height)])
    each = segments.select("*", F.explode(spans).alias("s")).select("*", "s.*")
    each = each.selectExpr(
        "part", "tree", "level", "idx div span AS low", "(idx + n - 1) div span AS high", "(total + span - 1) div span AS width"
    ).where("width > 1")
    ends = each.selectExpr(
        "part", "tree", "level", f"low div {fanout} * {fanout} AS left", "low", "high",
        f"least((high div {fanout} + 1) * {fanout}, width) AS right",
    )
    wanted = (
        "concat(if(left < low, sequence(left, low - 1), array()), if(high + 1 < right, sequence(high + 1, right - 1), array()))"
    )
    return ends.selectExpr("part", "tree", "level", f"explode({wanted}) AS idx")


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class _Tree:
    """What one partition knows of one tree: per level the runs of brothers on
    the paths of its own range, as joined digests."""

    def __init__(self, begin: int, digests: list[bytes], total: int, fetched: dict[tuple[int, int], bytes], fanout: int):
        self.runs: list[dict[int, bytes]] = []
        self.fanout = fanout
        level = 0
        while total > 1:
            end = begin + len(digests)
            own: dict[int, bytes] = {}
            for up in range(begin // fanout, (end - 1) // fanout + 1):
                low, high = up * fanout, min((up + 1) * fanout, total)
                left = [fetched[level, i] for i in range(low, min(high, begin))]
                inside = digests[max(low, begin) - begin : min(high, end) - begin]
                right = [fetched[level, i] for i in range(max(low, end), high)]
                own[up] = b"".join([*left, *inside, *right])
            self.runs.append(own)
            digests = [_sha(run) for run in own.values()]
            begin, total, level = begin // fanout, -(-total // fanout), level + 1
        self.root = digests[0]

    def path(self, idx: int) -> list[tuple[bytes, bytes]]:
        """Per level what stands left and right of the node on the way up."""
        out = []
        for own in self.runs:
            run, at = own[idx // self.fanout], idx % self.fanout
            out.append((run[: HEX * at], run[HEX * (at + 1) :]))
            idx //= self.fanout
        return out


def _proofs(fanout: int):
    """The proofs of one partition from its leaves and its fetched nodes."""

    def expand(leaves: pa.Table, aux: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        own = [x.encode() for x in leaves.column("leaf").to_pylist()]
        given = [x and x.encode() for x in leaves.column("other").to_pylist()]
        fetched: dict[int, dict[tuple[int, int], bytes]] = {}
        parts = []
        for r in aux.to_pylist():
            if r["kind"] == "node":
                fetched.setdefault(r["tree"], {})[r["level"], r["idx"]] = r["digest"].encode()
            else:
                parts.append(r)
        parts.sort(key=lambda r: r["begin"])
        trees = [
            _Tree(r["idx"], own[r["begin"] : r["begin"] + r["n"]], r["total"], fetched.get(r["tree"], {}), fanout)
            for r in parts if r["tree"] != TOP
        ]
        sources = [r for r in parts if r["tree"] != TOP]
        above = next(r for r in parts if r["tree"] == TOP)
        # the subroots of a partition's sources are neighbours in the upper tree
        top = _Tree(above["idx"], [t.root for t in trees], above["total"], fetched.get(TOP, {}), fanout)
        subroots, proofs, folded = [], [], []
        for r, tree in zip(sources, trees, strict=True):
            upper = top.path(r["tree"])
            for i in range(r["n"]):
                path = tree.path(r["idx"] + i) + upper
                proofs.append(_sha(b"".join([x for both in path for x in both])).decode())
                at = given[r["begin"] + i] or own[r["begin"] + i]
                for left, right in path:
                    at = _sha(left + at + right)
                folded.append(at.decode())
                subroots.append(tree.root.decode())
        root = top.root.decode()
        return pa.table({
            "id": leaves.column("id"), "leaf": leaves.column("leaf"), "subroot": pa.array(subroots, pa.string()),
            "root": pa.array([root] * len(own), pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
        })

    return expand


def manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, source: str = "source", order: str = "doc_id",
    altered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT,
) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) for
    every row.  Where ``where`` holds, the folded root starts from the row with
    its ``altered`` columns, and ``verified`` tells whether it still is the root."""
    leaves = sorted_leaves(docs, columns, source, order, altered or {}, F.lit(False) if where is None else where)
    segments = segments_of(leaves)
    most, sources = segments.agg(F.max("total"), F.max("tree")).first()
    heights = height_of(most or 0, fanout), height_of((sources or 0) + 1, fanout)
    placed = null_safe_join(leaves, segments.select("part", "source", "tree", "begin", "idx", "total"), ["part", "source"], "inner")
    bottom = levels_of(pin(placed.select(
        "tree", (F.col("idx") + F.col("pos") - F.col("begin")).alias("idx"), "total", F.col("leaf").alias("digest")
    )), heights[0], fanout)
    subroots = None
    for level in bottom:
        done = level.where("total = 1").select(F.col("tree").alias("idx"), "digest")
        subroots = done if subroots is None else subroots.unionByName(done)
    upper = levels_of(pin(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), "idx", F.lit((sources or 0) + 1).cast("long").alias("total"), "digest"
    )), heights[1], fanout)
    nodes = None
    for k in range(max(heights) + 1):
        for tree in (bottom, upper):
            if k < len(tree):
                level = tree[k].select("tree", F.lit(k).alias("level"), "idx", "digest")
                nodes = level if nodes is None else nodes.unionByName(level)
    # a partition's sources are neighbours, so they are one segment above
    above = segments.groupBy("part").agg(F.min("tree").alias("idx"), F.count("*").alias("n")).select(
        "part", F.lit(TOP).cast("long").alias("tree"), "idx", "n", F.lit((sources or 0) + 1).cast("long").alias("total")
    )
    wanted = missing_nodes(segments, heights[0], fanout).unionByName(missing_nodes(above, heights[1], fanout))
    fetched = pin(wanted).join(nodes, ["tree", "level", "idx"])
    aux = segments.select("part", F.lit("run").alias("kind"), "tree", "begin", "idx", "n", "total").unionByName(
        above.withColumn("kind", F.lit("run")).withColumn("begin", F.lit(-1).cast("long"))
    ).unionByName(fetched.withColumn("kind", F.lit("node")), allowMissingColumns=True)
    aux = aux.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in AUX.split(", ")])
    kind = leaves.schema["id"].dataType.simpleString()
    done = leaves.groupBy("part").cogroup(aux.groupBy("part")).applyInArrow(
        tidy_group(_proofs(fanout)),
        f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", order)
