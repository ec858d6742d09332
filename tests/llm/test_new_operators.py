"""Hard negatives, exact dedup and the Merkle manifest against plain versions."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from helpers import EDGE_TEXTS, document_frame, lower_az
from pyspark.sql import functions as F

from wardframe.llm import exactdedup, hardneg, merkle

VECTORS = "vec_id long, embedding array<float>, label int, score double, row long, span string"


def plain_negatives(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    own = [
        (-(2**63) if i is None else i, label, [math.floor(256 * x) for x in v], is_anchor(i))
        for i, v, label, *_ in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, label, q, anchor) in enumerate(own):
        if not anchor:
            continue
        scores = [(-sum(a * b for a, b in zip(q, r[2], strict=False)), r[0], r[1], n) for n, r in enumerate(own)]
        for ps, p, _, _ in sorted(s for s in scores if s[2] == label and s[3] != at)[:positives]:
            near = sorted(s for s in scores if s[2] != label and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives]
            out += [(i, p, n + 1, s[1], -ps, -s[0]) for n, s in enumerate(near)]
    return sorted(out)


def mined(frame, **kw):
    rows = hardneg.hard_negatives(frame, anchor=F.col("vec_id") % 3 == 0, **kw).collect()
    return sorted(tuple(-(2**63) if v is None else v for v in r) for r in rows)


@pytest.mark.parametrize("sizes", [(256, 64, 4096), (4, 2, 3)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "SPAN", "ZONES"), sizes, strict=True):
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((3, 6))
    rows = [(i, (centres[i % 3] + 0.4 * rng.standard_normal(6)).tolist(), int(rng.integers(4)), 1.0, 2, "s") for i in range(60)]
    rows += [
        (60, None, 1, 1.0, 2, "s"), (63, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1, 1.0, 2, "s"), (66, [float("nan")] * 6, 2, 1.0, 2, "s"),
        (69, [float("inf")] * 6, 2, 1.0, 2, "s"), (72, [1.0] * 6, None, 1.0, 2, "s"), (75, [], 1, 1.0, 2, "s"), (78, [0.0] * 6, 1, 1.0, 2, "s"),
        (81, [-1.0, 0.5], 3, 1.0, 2, "s"), (None, [0.3] * 6, 1, 1.0, 2, "s"), (None, [0.3] * 6, 2, 1.0, 2, "s"),
        (84, [-0.5] * 6, 9, 1.0, 2, "s"), (87, [0.5] * 6, 9, 1.0, 2, "s"),
    ]
    # equal rows, rows that share an id, and copies that fill several blocks
    rows += [(3, [0.7] * 6, 1, 1.0, 2, "s")] * 2 + [(90 + i, [0.7] * 6, 1 + i % 2, 1.0, 2, "s") for i in range(20)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    # components are floats in the table
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label, *_ in rows]
    assert mined(frame) == plain_negatives(plain, lambda i: i is not None and i % 3 == 0)
    few = {"positives": 2, "negatives": 3, "low": 50, "high": 95}
    assert mined(frame, **few) == plain_negatives(plain, lambda i: i is not None and i % 3 == 0, 2, 3, 50, 95)


def test_hard_negatives_of_empty_tables(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    alone = spark.createDataFrame([(1, [1.0], 1, 1.0, 2, "s"), (2, None, 1, 1.0, 2, "s")], VECTORS)
    assert hardneg.hard_negatives(alone).collect() == []


def test_wide_components(spark):
    rows = [(i, [1e5 * (i + 1), -3e6], i % 2) for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(frame) == plain_negatives(rows, lambda i: i % 3 == 0)
    with pytest.raises(ValueError, match="63 bits"):
        hardneg.hard_negatives(spark.createDataFrame([(1, [1e12], 1)], "vec_id long, embedding array<double>, label int"))


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    monkeypatch.setattr(hardneg, "SPAN", 1)
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    rows = [(i, (centres[i % 8] + 0.02 * rng.standard_normal(8)).tolist(), i % 8) for i in range(800)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = hardneg.usable_rows(vectors, "vec_id", "label", "embedding", 256, F.col("vec_id") % 100 == 0)
    shape = hardneg.Shape(usable)
    blocks = hardneg.curve_blocks(usable, shape)
    anchors = hardneg.anchors_of(blocks, shape, 5)
    windows = anchors.selectExpr("span", "row", "0L AS slot", "0L AS positive", "coalesce(floor, 0L) AS low", "9223372036854775807L AS high")
    groups = hardneg._grouped(anchors, windows)
    everything = groups.count() * blocks.count()
    assert 0 < hardneg.blocks_to_read(groups, blocks, shape, True).count() < everything / 4
    # nothing of another label is as near as an anchor's own block
    assert hardneg.blocks_to_read(groups, blocks, shape, False).count() < everything / 4


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array([*product(range(1 << bits), repeat=dims)])
    keys = hardneg.hilbert(cells, bits)
    assert sorted(keys.tolist()) == [*range(len(cells))]
    along = cells[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


BLANK = re.compile(r"[\x20\x09-\x0D]")


def plain_groups(rows):
    own = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        own[BLANK.sub("", text or "")].append((-len(text or ""), -(2**63) if i is None else i, n))
    out = []
    for text, group in own.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        keep = min(group)
        out += [(i, keep[1], len(group), (chars, i, n) == keep, digest) for chars, i, n in group]
    return sorted(out)


def found_groups(frame):
    done = exactdedup.exact_duplicates(frame, carry={"text_sha256": F.sha2(exactdedup.normal("text"), 256)})
    assert done.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(tuple(-(2**63) if v is None else v for v in r) for r in done.collect())


@pytest.mark.parametrize("bits,hot,prefix", [(26, 1000, 64), (15, 3, 2), (16, 1, 1)])
def test_exact_duplicates(spark, monkeypatch, bits, hot, prefix):
    for name, value in (("SLOT_BITS", bits), ("HOT", hot), ("PREFIX", prefix)):
        monkeypatch.setattr(exactdedup, name, value)
    texts = [
        *EDGE_TEXTS, "a b", "ab", " a\tb", "a b", "a b", "É x", "Éx", "é x", "\x0b\x0c\r", "ab c", "abd", "x" * 70 + "y", "x" * 70 + "z",
        *["copy of a text"] * 20, *["copy  of a text"] * 3,
    ]
    ids = [*range(len(texts) - 8), None, None, 3, 3, 3, 4, 4, None]
    frame = document_frame(spark, texts, ids).repartition(3)
    assert found_groups(frame) == plain_groups([*zip(ids, texts, strict=True)])


def test_exact_duplicates_of_small_tables(spark):
    for texts in ([], ["one"], [None], ["", None, " "], ["a", "b", "cc"]):
        assert found_groups(document_frame(spark, texts)) == plain_groups([*enumerate(texts)])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def plain_path(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        low = at // fanout * fanout
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + fanout])))
        at //= fanout
    return out


def plain_manifest(rows, fanout=16):
    """Of rows (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(((row[0] is not None, row[0] or 0, plain_leaf(row)), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([k[2] for k, _ in sorted(by[s], key=lambda x: x[0])], fanout) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources], fanout)
    out = []
    for n, s in enumerate(sources):
        for at, (key, row) in enumerate(sorted(by[s], key=lambda x: x[0])):
            path = plain_path(trees[s], at, fanout) + plain_path(top, n, fanout)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            fold = plain_leaf((*row[:4], lower_az(row[4]))) if bad else key[2]
            for left, right in path:
                fold = sha(left + fold + right)
            root = top[-1][0]
            out.append((row[0], key[2], trees[s][-1][0], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=repr)


LEAVES = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long, pos long"


def found_manifest(spark, rows, fanout=16):
    frame = spark.createDataFrame([(*r, "l", 1, 2) for r in rows], LEAVES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    done = merkle.manifest(
        frame.repartition(3), altered={"text": F.translate("text", upper, upper.lower())},
        where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout=fanout,
    )
    return sorted((tuple(r) for r in done.collect()), key=repr)


def leaf_rows(sizes):
    rows = [(1000 * k + i, s, "en" if i % 3 else None, i, f"Text {i} É") for k, (s, n) in enumerate(sizes) for i in range(n)]
    return [r for n, r in enumerate(rows) if n % 2] + rows[::2]


@pytest.mark.parametrize("leaf_rows_each", [7, 40, 16384])
@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest(spark, monkeypatch, leaf_rows_each, fanout):
    monkeypatch.setattr(merkle, "LEAF_ROWS", leaf_rows_each)
    rows = leaf_rows([(None, 3), ("", 1), ("a", 33), ("Z", 16), ("é", 17), ("zz", 1), *[(f"s{i:02}", 2) for i in range(20)]])
    rows += [(5, "a", "en", 4, None), (None, "a", "en", 4, "No Id"), (None, None, None, None, None), (1, "a", "x", 1, "One"), (1, "a", "x", 1, "One")]
    assert found_manifest(spark, rows, fanout) == plain_manifest(rows, fanout)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 3, "Abc")], [(10, None, None, None, None)], [(4, "s", "en", 0, "")] * 3])
def test_manifest_of_small_tables(spark, rows):
    assert found_manifest(spark, rows) == plain_manifest(rows)


def test_multiproof_fetches_only_what_leaves_cannot_give(spark):
    # leaves 20 to 39 of 300: brothers 16-19 and 40-47, then nodes 0 and 3-15 of level 1, then 1 of level 2
    segment = spark.createDataFrame([(0, 7, 20, 20, 300)], "part long, tree long, idx long, n long, total long")
    got = {(r.level, r.idx) for r in merkle.missing_nodes(segment, merkle.height_of(300, 16), 16).collect()}
    want = {(0, i) for i in [*range(16, 20), *range(40, 48)]} | {(1, i) for i in [0, *range(3, 16)]} | {(2, 1)}
    assert got == want
    whole = spark.createDataFrame([(0, 7, 0, 300, 300)], "part long, tree long, idx long, n long, total long")
    assert merkle.missing_nodes(whole, 3, 16).count() == 0
