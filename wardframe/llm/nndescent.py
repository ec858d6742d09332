"""Embedding near-dedup by NN-descent.

Every distinct vector keeps a list of its nearest vectors.  The first lists
come from small groups of vectors that fall on the same side of random
hyperplanes.  A round then compares, at every vector, its neighbours and
reverse neighbours with each other (neighbours of neighbours) and keeps the
best; rounds end when few lists still change.  Links are the pairs at or above
the threshold.

A list all of whose entries are links is saturated: more may lie beyond it.
Saturated vectors descend again, with lists of the nearest other link
components (one vector of each); the links found there merge components, and
this goes on until no component finds another one.  Then all vectors of a
component are compared block by block, so groups of any size get all their
links while no task holds more than two blocks and no pairs are written.  A
bounded number of vectors (``audit``) is compared with all others; as long as
too small a share of their links was found, taken vector by vector, lists are
doubled and refined further, and the operator fails if that does not help.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; equal vectors are one node with a count; shorter
vectors are filled up with zeros; a null id is the smallest id and kept as
null; rows that share an id are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardframe.llm.common import id_back, id_or_least
from wardframe.llm.components import components
from wardframe.session import pin

THRESHOLD = 0.9
LIST = 8
GROUP = 48
PLANES = 4
BLOCK = 512
AUDIT = 512
MIN_RECALL = 0.97
MAX_ROUNDS = 6
MAX_AUDITS = 3
#: Members by which a component is tried beside the others of a hyperplane group.
TRIED = 4
PAIR = "a long, b long, sim double"
BEYOND = "a long, pa long, b long, pb long, sim double"


def unit(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    # the largest component first, so that no square overflows or vanishes
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _best(ids: np.ndarray, vectors: np.ndarray, keep: int, floor: np.ndarray | None = None) -> pa.Table:
    """Each row's ``keep`` most similar rows of the group, above its floor."""
    sims = np.clip(vectors @ vectors.T, -1, 1)
    np.fill_diagonal(sims, -2)
    keep = min(keep, len(ids) - 1)
    if keep < 1:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    at = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    sim = np.take_along_axis(sims, at, 1)
    good = sim > (-2 if floor is None else floor[:, None])
    return pa.table({"a": np.repeat(ids, good.sum(1)), "b": ids[at][good], "sim": sim[good]})


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with its vector or null, and one node per
    distinct usable vector with its count and least id."""
    v = F.col("v")
    usable = (
        v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(id_or_least(F.col(id_col)).alias("id"), F.col(vector_col).alias("v"))
    rows = rows.select("id", F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    counted = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    return rows, pin(counted.withColumn("node", F.monotonically_increasing_id()))


def hyperplane_codes(nodes: DataFrame, total: int, dims: int, seed: int) -> DataFrame:
    """(node, v, plane, code): the signs of every vector, so that ``total``
    vectors would form groups of about ``GROUP``."""
    bits = max(1, int(np.ceil(np.log2(max(2, total / GROUP)))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dims, PLANES * bits))
        for batch in batches:
            signs = unit(batch.column(1), dims) @ planes > 0
            codes = signs.reshape(-1, PLANES, bits) @ (1 << np.arange(bits))
            for k in range(PLANES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(codes), k)), pa.array(codes[:, k])],
                    names=["node", "v", "plane", "code"],
                )

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select("node", "v").mapInArrow(coded, f"node long, v {kind}, plane long, code long")


def first_lists(nodes: DataFrame, total: int, dims: int, keep: int, seed: int) -> DataFrame:
    """Neighbours within groups of vectors with equal hyperplane signs."""
    keyed = hyperplane_codes(nodes, total, dims, seed)
    sizes = pin(keyed.groupBy("plane", "code").agg(F.count("*").alias("n")))
    part = F.pmod(F.xxhash64("node", "plane", F.lit(seed)), F.ceil(F.col("n") / (2 * GROUP)))
    grouped = keyed.join(sizes, ["plane", "code"]).select("node", "v", "plane", "code", part.alias("part"))

    def near(rows: pa.Table) -> pa.Table:
        return _best(rows.column("node").to_numpy(), unit(rows.column("v"), dims), keep)

    return grouped.groupBy("plane", "code", "part").applyInArrow(near, PAIR)


def _top(pairs: DataFrame, by: str, keep: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("sim").desc(), "a", "b")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def refine(graph: DataFrame, nodes: DataFrame, dims: int, keep: int) -> tuple[DataFrame, int]:
    """One round: (new graph, number of entries that changed)."""
    fresh = graph.where("new")
    both = _top(graph, "a", keep).select(F.col("a").alias("w"), F.col("b").alias("u")).unionByName(
        _top(graph, "b", keep).select(F.col("b").alias("w"), F.col("a").alias("u"))
    ).distinct()
    active = fresh.select(F.col("a").alias("w")).unionByName(fresh.select(F.col("b").alias("w"))).distinct()
    floors = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least")).select(
        F.col("a").alias("u"), F.when(F.col("n") >= keep, F.col("least")).otherwise(-2.0).alias("floor")
    )
    info = nodes.select(F.col("node").alias("u"), "v").join(floors, "u", "left").select(
        "u", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor")
    )
    local = both.join(active, "w", "left_semi").join(info, "u")

    def near(rows: pa.Table) -> pa.Table:
        return _best(rows.column("u").to_numpy(), unit(rows.column("v"), dims), keep, rows.column("floor").to_numpy())

    found = local.groupBy("w").applyInArrow(near, PAIR)
    merged = graph.select("a", "b", "sim", F.lit(False).alias("new")).unionByName(found.withColumn("new", F.lit(True)))
    single = merged.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    out = pin(_top(single, "a", keep))
    return out, out.where("new").count()


def _best_beyond(rows: pa.Table, dims: int, keep: int) -> pa.Table:
    """Each row's most similar row of every other component in the group, the
    ``keep`` best of them, above the row's floor."""
    rows = rows.sort_by("part")
    ids, parts = rows.column("u").to_numpy(), rows.column("part").to_numpy()
    vectors = unit(rows.column("v"), dims)
    floor = rows.column("floor").to_numpy() if "floor" in rows.column_names else np.full(len(ids), -2.0)
    sims = np.clip(vectors @ vectors.T, -1, 1)
    sims[parts[:, None] == parts[None, :]] = -2
    starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
    ends = np.append(starts[1:], len(parts))
    at = np.stack([i + sims[:, i:j].argmax(axis=1) for i, j in zip(starts, ends, strict=True)], axis=1)
    sim = np.take_along_axis(sims, at, 1)
    keep = min(keep, len(starts))
    top = np.argpartition(-sim, keep - 1, axis=1)[:, :keep]
    at, sim = np.take_along_axis(at, top, 1), np.take_along_axis(sim, top, 1)
    good = sim > floor[:, None]
    a, b = np.repeat(np.arange(len(ids)), good.sum(1)), at[good]
    return pa.table({"a": ids[a], "pa": parts[a], "b": ids[b], "pb": parts[b], "sim": sim[good]})


def _top_beyond(pairs: DataFrame, by: str, other: str, keep: int) -> DataFrame:
    """The best pair of every ``by`` with each component of the other side, the
    ``keep`` best of these.  A component's pairs are aggregated, so it does not
    matter how many of its vectors share a neighbour."""
    own, rest = f"p{by}", f"p{other}"
    best = pairs.groupBy(by, own, rest).agg(F.max("sim").alias("sim"), F.max_by(other, "sim").alias(other))
    order = Window.partitionBy(by).orderBy(F.col("sim").desc(), other)
    return best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def links_beyond(placed: DataFrame, inner: DataFrame, parts: int, dims: int, keep: int, seed: int, threshold: float) -> DataFrame:
    """(a, b): links between vectors of different components, for the vectors
    (node, v, part) and their lists ``inner`` within the components."""
    total = placed.count()
    info = placed.select(F.col("node").alias("u"), "v", "part")
    tried = []
    # few groups for the components as wholes, many for their single vectors
    for n, use in ((parts * TRIED, seed), (total, seed + 1)):
        codes = hyperplane_codes(placed, n, dims, use).join(placed.select("node", "part"), "node")
        draw = F.xxhash64("node", "plane", F.lit(use))
        one = codes.groupBy("plane", "code", "part", F.pmod("node", F.lit(TRIED)).alias("_t")).agg(F.min_by("node", draw).alias("u"))
        one = pin(one.select((F.col("plane") + PLANES * len(tried)).alias("plane"), "code", "u"))
        sizes = pin(one.groupBy("plane", "code").agg(F.count("*").alias("n")))
        part = F.pmod(F.xxhash64("u", "plane", F.lit(use)), F.ceil(F.col("n") / (2 * GROUP)))
        tried.append(one.join(sizes, ["plane", "code"]).select("u", "plane", "code", part.alias("slot")))
    grouped = reduce(DataFrame.unionByName, tried).join(info, "u")

    def near(rows: pa.Table) -> pa.Table:
        return _best_beyond(rows, dims, keep)

    start = grouped.groupBy("plane", "code", "slot").applyInArrow(near, BEYOND)
    graph = pin(_top_beyond(start, "a", "b", keep).withColumn("new", F.lit(True)))
    for _ in range(MAX_ROUNDS):
        fresh = graph.where("new")
        active = fresh.select(F.col("a").alias("w")).unionByName(fresh.select(F.col("b").alias("w"))).distinct()
        around = graph.select(F.col("a").alias("w"), F.col("b").alias("u")).unionByName(
            _top_beyond(graph, "b", "a", keep).select(F.col("b").alias("w"), F.col("a").alias("u"))
        ).unionByName(inner.select(F.col("a").alias("w"), F.col("b").alias("u"))).distinct()
        floors = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least")).select(
            F.col("a").alias("u"), F.when(F.col("n") >= keep, F.col("least")).otherwise(-2.0).alias("floor")
        )
        known = info.join(floors, "u", "left").select("u", "v", "part", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        found = around.join(active, "w", "left_semi").join(known, "u").groupBy("w").applyInArrow(near, BEYOND)
        old = graph.select("a", "b", F.lit(True).alias("old"))
        merged = _top_beyond(graph.drop("new").unionByName(found), "a", "b", keep).join(old, ["a", "b"], "left")
        graph = pin(merged.select("a", "pa", "b", "pb", "sim", F.col("old").isNull().alias("new")))
        if graph.where("new").count() <= 0.01 * total * keep:
            break
    return pin(graph.where(F.col("sim") >= threshold).select("a", "b"))


def joined_groups(
    links: list[DataFrame], graph: DataFrame, nodes: DataFrame, dims: int, keep: int, seed: int, threshold: float,
) -> DataFrame:
    """(node, component) by the links, to which those are added that lie beyond
    saturated lists."""
    near = graph.where(F.col("sim") >= threshold)
    full = pin(near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= keep).select(F.col("a").alias("node")))
    inner = pin(near.join(full, near["a"] == full["node"], "left_semi").join(
        full.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
    while True:
        groups = pin(components(reduce(DataFrame.unionByName, links)))
        placed = pin(nodes.select("node", "v").join(full, "node", "left_semi").join(
            groups.select("node", F.col("component").alias("part")), "node"))
        parts = placed.select("part").distinct().count()
        if parts < 2:
            return groups
        found = links_beyond(placed, inner, parts, dims, keep, seed, threshold)
        if found.isEmpty():
            return groups
        links.append(found)
        seed += 1


def complete(groups: DataFrame, nodes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(node, n): for all members of the components (node, component), how many
    vectors of the component are links, copies counted."""
    sizes = pin(groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    members = groups.join(sizes, "component").join(nodes.select("node", "v", "m"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # a member meets every block of its component; the pair of blocks names the task
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = spread.select(
        "component", "node", "v", "m", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def count(rows: pa.Table) -> pa.Table:
        node, own, m = (rows.column(c).to_numpy() for c in ("node", "own", "m"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        vectors = unit(rows.column("v"), dims)
        linked = vectors @ vectors.T >= threshold
        np.fill_diagonal(linked, False)
        if i != j:
            # pairs within one block are counted by that block's own task
            linked &= own[:, None] != own[None, :]
        return pa.table({"node": node, "n": linked.astype(np.int64) @ m})

    counts = paired.groupBy("component", "i", "j").applyInArrow(count, "node long, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("n"))


def audit_links(nodes: DataFrame, queries: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(a, b): the queries' links among all nodes.  The queries are a bounded
    number of rows."""
    held = queries.toArrow()
    ids, matrix = held.column("node").to_numpy(), unit(held.column("v"), dims)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = unit(batch.column(1), dims) @ matrix.T
            at, q = np.nonzero(sims >= threshold)
            own = batch.column(0).to_numpy()[at]
            other = own != ids[q]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][other]), pa.array(own[other])], names=["a", "b"])

    return nodes.select("node", "v").mapInArrow(compare, "a long, b long")


def _descend(nodes: DataFrame, total: int, dims: int, keep: int, seed: int, graph: DataFrame | None) -> DataFrame:
    start = first_lists(nodes, total, dims, keep, seed).withColumn("new", F.lit(True))
    if graph is not None:
        start = start.unionByName(graph.withColumn("new", F.lit(True)))
    single = start.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("new").alias("new"))
    graph = pin(_top(single, "a", keep))
    for _ in range(MAX_ROUNDS):
        graph, changed = refine(graph, nodes, dims, keep)
        if changed <= 0.01 * total * keep:
            break
    return graph


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``."""
    rows, nodes = nodes_of(vectors, id_col, vector_col)
    total, dims = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    # no usable vector: no links
    links, keep, graph = [nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)], LIST, None
    queries = pin(nodes.orderBy(F.xxhash64("node")).limit(AUDIT).select("node", "v")) if total else None
    groups = None
    for attempt in range(MAX_AUDITS if total and total > 1 else 0):
        graph = _descend(nodes, total, dims, keep, attempt, graph)
        links.append(graph.where(F.col("sim") >= threshold).select("a", "b"))
        groups = joined_groups(links, graph, nodes, dims, keep, attempt, threshold)
        if not attempt:
            true = pin(audit_links(nodes, queries, dims, threshold))
        ends = true
        for end in ("a", "b"):
            ends = ends.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        # every audited vector counts the same, however many links it has
        shares = ends.groupBy("a").agg((F.count_if(F.col("ca") == F.col("cb")) / F.count("*")).alias("share"))
        recall = shares.agg(F.avg("share")).first()[0]
        if recall is None or recall >= MIN_RECALL:
            break
        keep *= 2
    else:
        if groups is not None:
            raise RuntimeError(f"lists of {keep // 2} found a share of {recall:.3f} of the audited vectors' links")
    if groups is None:
        groups = components(links[0])
    elif links:
        # what the audit found beside the lists is a link as well
        groups = pin(components(reduce(DataFrame.unionByName, [*links, true])))
    counts = complete(groups, nodes, dims or 1, threshold)
    least = groups.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    placed = nodes.join(groups, "node", "left").join(least, "component", "left").join(counts, "node", "left")
    info = placed.select(
        F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("first", "least").alias("first")
    )
    done = rows.join(info, rows["v"] == info["w"], "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component")
    )
    return done.select(
        id_back(F.col("id")).alias(id_col), "n_links", id_back(F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
