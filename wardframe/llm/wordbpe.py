"""BPE encoding and decoding through a table of distinct words.

1. Texts are split into words; a block of documents sends every word it holds
   once, grouped by a hash bucket of the word.
2. A bucket holds all blocks' mentions of its words, so each distinct word is
   encoded exactly once, and its ids go back to the blocks that asked.
3. A block's documents, as positions in the block's word list, meet the ids of
   that list and are put together by position.  Decoding takes the piece of
   every id from the id-to-piece table once per word.

Words are cut at ASCII white space, which the tokenizer drops and across which
neither its normalizer nor its pattern nor a special string reaches.  Blocks
are bounded by bytes, except that a document is never divided; buckets follow
the size of the input.  Blocks must come out alike whenever a task is repeated,
so ``docs`` is written first, unless ``stored`` says that it only reads the
files of a table.  A block's key holds a digest of its words: if they ever
differed, the job would fail instead of mixing ids.

Defined results: a null text is an empty one with no ids and an empty decoded
text; repeated rows are encoded one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.llm.common import bounded_batches, raw, row_blocks, tidy, tidy_group, words_of
from wardframe.session import pin

BLOCK_BYTES = 12 << 20
BUCKET_BYTES = 16 << 20
BATCH_CHARS = 1 << 17
#: Documents that are put together at once.
CHUNK_DOCS = 256


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").reshape(-1)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """The runs ``picks`` of ``values``, one after the other."""
    own = sizes[picks]
    before = np.cumsum(own) - own
    return values[np.repeat(starts[picks] - before, own) + np.arange(own.sum())]


class Block:
    """Documents whose texts are about BLOCK_BYTES together."""

    def __init__(self, key: str, ids: pa.Array, texts: pa.Array, buckets: int):
        self.ids = ids
        words, self.ends = words_of(texts)
        coded = words.dictionary_encode()
        data, at = raw(coded.dictionary)
        data, at = bytes(data), at.tolist()
        own = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in own), np.int64, len(own))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        self.indices = place[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)
        self.buckets, cuts = np.unique(bucket[order], return_index=True)
        listed = [own[i] for i in order.tolist()]
        self.lists = [b" ".join(listed[a:b]) for a, b in zip(cuts, np.append(cuts, len(own))[1:], strict=True)]
        self.key = f"{key}:{xxhash.xxh64_hexdigest(b' '.join(self.lists))}"


def blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[Block]:
    """Blocks of (id, text) rows, keyed by the place in the scan."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for n, rows in enumerate(row_blocks(batches, 1, BLOCK_BYTES)):
        yield Block(f"{part}:{n}", rows.column(0), rows.column(1), buckets)


def _tokenizer(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoded(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words, and the number of ids of each word."""
    ids, sizes, batch, held = [], [], [], 0
    for i, word in enumerate(words):
        batch.append(word)
        held += len(word)
        if held >= BATCH_CHARS or i == len(words) - 1:
            for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(len(ids[-1]))
            batch, held = [], 0
    return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array(sizes, np.int64)


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True,
    stored: bool = False,
) -> DataFrame:
    """(id_col, ids, decoded): the ids of every whole text as little-endian
    unsigned 32-bit numbers, and the text that they decode to."""
    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bounded_batches(docs.sparkSession)
    if not stored:
        sent = pin(sent)
    total = sent.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // BUCKET_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, buckets):
            n = len(block.lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.buckets, pa.int64()), pa.array([block.key] * n, pa.string()),
                 pa.array(block.lists, pa.binary()).cast(pa.string())],
                names=["bucket", "block", "words"],
            )

    def answered(rows: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(vocabulary)
        lists = rows.column("words").combine_chunks()
        words, ends = words_of(lists)
        coded = words.dictionary_encode()
        ids, sizes = encoded(tokenizer, coded.dictionary.to_pylist())
        starts = np.cumsum(sizes) - sizes
        picks = coded.indices.to_numpy()
        out_sizes, out_ids = [], []
        for a, b in zip(ends, ends[1:], strict=False):
            out_sizes.append(packed(sizes[picks[a:b]]))
            out_ids.append(packed(gathered(ids, starts, sizes, picks[a:b])))
        return pa.table({
            "block": rows.column("block"), "bucket": rows.column("bucket"),
            "sizes": pa.array(out_sizes, pa.binary()), "ids": pa.array(out_ids, pa.binary()),
        })

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, buckets):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.key]), pa.ListArray.from_arrays([0, len(block.ids)], block.ids),
                 pa.array([packed(block.ends)], pa.binary()), pa.array([packed(block.indices)], pa.binary())],
                names=["block", "row_ids", "ends", "indices"],
            )

    def placed(content: pa.Table, answers: pa.Table) -> pa.Table:
        if content.num_rows != 1:
            raise RuntimeError("a block of documents did not come out alike when it was read again")
        order = np.argsort(answers.column("bucket").to_numpy()).tolist() if answers.num_rows else []
        sizes = np.concatenate([np.zeros(0, np.int64), *[unpacked(answers.column("sizes")[i].as_py()) for i in order]]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *[unpacked(answers.column("ids")[i].as_py()) for i in order]]).astype(np.uint32)
        starts = np.cumsum(sizes) - sizes
        ends = unpacked(content.column("ends")[0].as_py()).astype(np.int64)
        indices = unpacked(content.column("indices")[0].as_py()).astype(np.int64)
        if len(indices) and indices.max() >= len(sizes):
            raise RuntimeError("a block of documents did not come out alike when it was read again")
        if decode:
            pieces = _pieces(vocabulary)
            per_word = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(ids))), pieces.take(pa.array(ids.astype(np.int64))))
            said = pc.binary_join(per_word, pa.scalar(" ", pa.large_string()))
        out_ids, out_text = [], []
        for a in range(0, len(ends) - 1, CHUNK_DOCS):
            at = ends[a : a + CHUNK_DOCS + 1]
            own = indices[at[0] : at[-1]]
            tokens = np.concatenate([[0], np.cumsum(sizes[own])])[at - at[0]]
            flat = gathered(ids, starts, sizes, own).astype("<u4")
            out_ids.append(pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(at) - 1, [None, pa.py_buffer(4 * tokens), pa.py_buffer(flat)]))
            if decode:
                # words without a piece leave no blank
                some = sizes[own] > 0
                places = np.concatenate([[0], np.cumsum(some)])[at - at[0]]
                lists = pa.LargeListArray.from_arrays(pa.array(places), said.take(pa.array(own[some])))
                out_text.append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())))
        row_ids = content.column("row_ids").combine_chunks().flatten()
        columns = {"id": row_ids, "ids": pa.chunked_array(out_ids, pa.large_binary()).cast(pa.binary())}
        if decode:
            columns["decoded"] = pa.chunked_array(out_text, pa.large_string()).cast(pa.string())
        return pa.table(columns)

    asked = sent.mapInArrow(tidy(wanted), "bucket long, block string, words string")
    answers = asked.groupBy("bucket").applyInArrow(tidy_group(answered), "block string, bucket long, sizes binary, ids binary")
    kept = sent.mapInArrow(tidy(content), f"block string, row_ids array<{kind}>, ends binary, indices binary")
    out = f"id {kind}, ids binary" + (", decoded string" if decode else "")
    done = kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_group(placed), out)
    return done.withColumnRenamed("id", id_col)


def _pieces(vocabulary: str) -> pa.Array:
    """The id-to-piece table: the piece of id i is entry i."""
    pieces = _tokenizer(vocabulary).get_vocab(with_added_tokens=True)
    table: list[str | None] = [None] * (max(pieces.values()) + 1)
    for piece, i in pieces.items():
        table[i] = piece
    return pa.array(table, pa.large_string())
