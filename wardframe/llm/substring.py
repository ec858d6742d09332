"""Substring dedup by level-wise doubling.

Level by level, only windows repeated at one length are extended to twice that
length.  The first level is thinned without loss: of the half-length windows
inside a window only the one with the smallest hash, its anchor, is asked for,
and equal windows have equal anchors.  A window whose anchor stands alone
cannot repeat.  At the last length a window is removed where its words also
start earlier: in a smaller document, or before in the same one.  Doubling
ends at the asked length, or before if no candidates survive.

Documents travel in blocks bounded by bytes.  A block asks for each distinct
hash once, with its first place, however often the window stands in it; hash
buckets compare the blocks' first places and answer with those that repeat
elsewhere (on the last level: earlier elsewhere).  So a window that stands in
every document costs one entry a block.  Hashes have 96 bits between blocks and
64 bits inside one.

Defined results: a null or short text has no windows and loses nothing; a null
id is the smallest; rows that share an id share their places, so neither is
earlier than the other; repeats inside one text count; other columns are kept,
except that one named like a result column gives way to it.  Blocks have to come out alike whenever a task is repeated, so
``docs`` is written first, unless ``stored`` says that it only reads the files
of a table; a digest in the block's key guards that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.llm.common import bounded_batches, id_or_least, mixed, plain_columns, raw, row_blocks, tidy, tidy_group, words_of
from wardframe.llm.wordbpe import packed, unpacked
from wardframe.session import pin

WINDOW = 20
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
ASK = "bucket long, block string, high binary, low binary, more binary, docs binary, starts binary, places binary"


def _sequence(values: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hash of every ``length`` consecutive values, by repeated doubling."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, size, out = values, 1, None
    # an array, because only arrays wrap around silently
    covered, weight, left = 0, np.array([factor]), length
    while left:
        if left & 1:
            part = done[covered : covered + n]
            out = part.copy() if out is None else out * weight + part
            covered += size
        left >>= 1
        if left:
            done = done[: len(done) - size] * weight + done[size:]
            weight, size = weight * weight, size * 2
    return mixed(out)


class Words:
    """The words of a block as hashes, and where its documents begin."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        self.ids = ids
        self.words, self.ends = words_of(texts)
        coded = self.words.dictionary_encode()
        data, at = raw(coded.dictionary)
        data, at, n = bytes(data), at.tolist(), len(coded.dictionary)
        own = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(at, at[1:], strict=False)), np.uint64, n)
        self.hashes = own[coded.indices.to_numpy()] if n else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.ends))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the windows that lie in one document."""
        hashes = _sequence(self.hashes, length, FACTORS[0])
        inside = np.flatnonzero(self.doc[: len(hashes)] == self.doc[length - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        return inside, hashes

    def more(self, length: int) -> np.ndarray:
        """32 further hash bits of every window."""
        return (_sequence(mixed(self.hashes), length, FACTORS[1]) >> np.uint64(32)).astype(np.uint32)

    def starts(self, places: np.ndarray) -> np.ndarray:
        return places - self.ends[self.doc[places]]

    def firsts(self, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes of ``places``; for each its earliest place and
        how many documents or starts hold it."""
        order = np.lexsort((self.starts(places), self.ids[self.doc[places]], hashes[places]))
        own = hashes[places[order]]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        return own[new], places[order[new]], np.diff(np.append(new, len(own)))


def anchors(inside: np.ndarray, half: np.ndarray, length: int) -> np.ndarray:
    """For every window of ``length`` at ``inside``: the place of its smallest
    half-length hash, the first one if there are several."""
    best, at = half[inside].copy(), inside.copy()
    for k in range(1, length - length // 2 + 1):
        own = half[inside + k]
        less = own < best
        best[less], at[less] = own[less], inside[less] + k
    return at


def ask_rows(words: Words, key: str, places: np.ndarray, hashes: np.ndarray, more: np.ndarray, buckets: int) -> pa.RecordBatch:
    """What a block asks: its distinct hashes by bucket, with first places."""
    own, first, _ = words.firsts(places, hashes)
    bucket = (mixed(own) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, cuts = np.unique(bucket[order], return_index=True)
    columns: list[list[bytes]] = [[] for _ in range(6)]
    for a, b in zip(cuts, np.append(cuts, len(own))[1:], strict=True):
        rows = order[a:b]
        at = first[rows]
        docs = words.ids[words.doc[at]]
        values = (own[rows] >> np.uint64(32), own[rows], more[at], None, words.starts(at), at)
        for column, value in zip(columns, values, strict=True):
            column.append(_wide(docs) if value is None else packed(value.astype(np.uint64) & np.uint64(0xFFFFFFFF)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([key] * len(ids), pa.string()), *[pa.array(c, pa.binary()) for c in columns]],
        names=["bucket", "block", "high", "low", "more", "docs", "starts", "places"],
    )


def _wide(ids: np.ndarray) -> bytes:
    """64-bit ids as two packed halves."""
    both = ids.view(np.uint64)
    return packed(np.concatenate([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)]))


def _unwide(data: bytes) -> np.ndarray:
    high, low = unpacked(data).astype(np.uint64).reshape(2, -1)
    return ((high << np.uint64(32)) | low).view(np.int64)


def _answers(last: bool):
    """Per bucket: the asked places whose hash other blocks hold too (on the
    last level: hold earlier)."""

    def compare(rows: pa.Table) -> pa.Table:
        read = {c: [x.as_py() for x in rows.column(c)] for c in ("high", "low", "more", "docs", "starts", "places")}
        parts = [
            [unpacked(read["high"][i]).astype(np.uint64) << np.uint64(32) | unpacked(read["low"][i]), unpacked(read["more"][i]),
             _unwide(read["docs"][i]), unpacked(read["starts"][i])]
            for i in range(rows.num_rows)
        ]
        sizes = [len(p[1]) for p in parts]
        hashes, more, docs, starts = (np.concatenate([p[k] for p in parts]) for k in range(4))
        order = np.lexsort((starts, docs, more, hashes))
        h, m, d, s = hashes[order], more[order], docs[order], starts[order]
        new = np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1]))
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        if last:
            wanted = (d != d[head[group]]) | (s != s[head[group]])
        else:
            wanted = np.diff(np.append(head, len(h)))[group] > 1
        hit = np.zeros(len(hashes), bool)
        hit[order[wanted]] = True
        blocks, out, at = [], [], 0
        for i, size in enumerate(sizes):
            own = hit[at : at + size]
            at += size
            if own.any():
                blocks.append(rows.column("block")[i].as_py())
                out.append(packed(unpacked(read["places"][i])[own]))
        return pa.table({"block": pa.array(blocks, pa.string()), "places": pa.array(out, pa.binary())})

    return compare


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(key, rows) of blocks; the first two columns are id and text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for n, rows in enumerate(row_blocks(batches, 1, BLOCK_BYTES)):
        data, at = raw(rows.column(1).fill_null(""))
        digest = xxhash.xxh64(data[at[0] : at[-1]])
        digest.update(at - at[0])
        yield f"{part}:{n}:{digest.hexdigest()}", rows


def _compressed(texts: pa.Array) -> pa.Array:
    out = [None if t is None else len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True)
           for t in texts.cast(pa.binary()).to_pylist()]
    return pa.array(out, pa.binary())


def _restored(texts: pa.Array) -> pa.Array:
    out = [t and pa.decompress(t[8:], int.from_bytes(t[:8], "little"), codec="zstd", asbytes=True)
           for t in texts.to_pylist()]
    return pa.array(out, pa.binary()).cast(pa.string())


def _repeated(words: Words, length: int, answered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside, hashes, flag per place): windows held elsewhere or twice here."""
    inside, hashes = words.windows(length)
    own, _, count = words.firsts(inside, hashes)
    known = np.union1d(own[count > 1], hashes[answered])
    flag = np.zeros(len(hashes), bool)
    flag[inside] = np.isin(hashes[inside], known)
    return inside, hashes, flag


def _joined(table: pa.Table) -> np.ndarray:
    parts = [unpacked(x.as_py()) for x in table.column("places")]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True,
    stored: bool = False,
) -> DataFrame:
    """``docs`` (without ``text_col`` unless ``keep_text``) plus ``n_words``,
    ``n_removed`` and ``kept_text``, the words that no earlier text holds,
    joined by one space."""
    if window < 2:
        raise ValueError("a window has two words at least")
    bounded_batches(docs.sparkSession)
    if not stored:
        docs = pin(docs)
    lengths = [window]
    while lengths[0] % 2 == 0 and lengths[0] > 10:
        lengths.insert(0, lengths[0] // 2)
    thinned = len(lengths) > 1
    plain = docs.select(id_or_least(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // BUCKET_BYTES)

    def first_ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _blocks(batches):
            words = Words(rows.column(0).to_numpy(), rows.column(1))
            inside, hashes = words.windows(lengths[0])
            if thinned:
                inside = np.unique(anchors(words.windows(lengths[1])[0], hashes, lengths[1]))
            yield ask_rows(words, key, inside, hashes, words.more(lengths[0]), buckets)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _blocks(batches):
            columns = [pa.array([key] * rows.num_rows, pa.string()), pa.array(np.arange(rows.num_rows)),
                       rows.column(0), _compressed(rows.column(1)), *rows.columns[2:]]
            names = ["block", "ord", "id", "text", *rows.schema.names[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def block_words(content: pa.Table) -> tuple[pa.Table, Words]:
        if not content.num_rows:
            raise RuntimeError("a block of documents did not come out alike when it was read again")
        content = content.sort_by("ord")
        texts = _restored(pa.concat_arrays(content.column("text").chunks))
        return content, Words(content.column("id").to_numpy(), texts)

    def next_ask(level: int):
        def ask(content: pa.Table, answers: pa.Table) -> pa.Table:
            content, words = block_words(content)
            length, double = lengths[level - 1], lengths[level]
            inside, hashes, flag = _repeated(words, length, _joined(answers))
            twice, longer = words.windows(double)
            if thinned and level == 1:
                candidates = twice[flag[anchors(twice, hashes, double)]]
            else:
                candidates = twice[flag[twice] & flag[twice + length]]
            key = content.column("block")[0].as_py()
            return pa.Table.from_batches([ask_rows(words, key, candidates, longer, words.more(double), buckets)])

        return ask

    def finish(content: pa.Table, answers: pa.Table) -> pa.Table:
        content, words = block_words(content)
        inside, hashes = words.windows(window)
        own, first, _ = words.firsts(inside, hashes)
        group = np.searchsorted(own, hashes[inside])
        ids, starts = words.ids[words.doc], words.starts(inside)
        later = (ids[inside] != ids[first[group]]) | (starts != words.starts(first[group]))
        earlier_elsewhere = np.isin(hashes[inside], hashes[_joined(answers)])
        removed = inside[later | earlier_elsewhere]
        change = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(change, removed, 1)
        np.add.at(change, removed + window, -1)
        keep = np.cumsum(change[:-1]) == 0
        before = np.concatenate([[0], np.cumsum(keep)])
        n_words, n_kept = np.diff(words.ends), np.diff(before[words.ends])
        kept = words.words.filter(pa.array(keep))
        lists = pa.ListArray.from_arrays(pa.array(before[words.ends], pa.int32()), kept)
        texts = {"text": _restored(pa.concat_arrays(content.column("text").chunks))} if keep_text else {}
        return pa.table(texts | {
            "rest": content.column("rest"), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_words - n_kept, pa.int64()), "kept_text": pc.binary_join(lists, " "),
        })

    def moved(rows: DataFrame, rest: str = "") -> DataFrame:
        return rows.mapInArrow(tidy(sent), "block string, ord long, id long, text binary" + rest)

    asks = plain.mapInArrow(tidy(first_ask), ASK)
    for level in range(1, len(lengths)):
        answers = asks.groupBy("bucket").applyInArrow(tidy_group(_answers(False)), "block string, places binary")
        asks = moved(plain).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_group(next_ask(level)), ASK)
    answers = asks.groupBy("bucket").applyInArrow(tidy_group(_answers(True)), "block string, places binary")
    others = [c for c in plain_columns(docs, ["n_words", "n_removed", "kept_text"]) if c != text_col]
    row = F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    rest = docs.select(id_or_least(F.col(id_col)).alias("id"), F.col(text_col).alias("text"), row.alias("rest"))
    kind = rest.schema["rest"].dataType.simpleString()
    made = ("text string, " if keep_text else "") + f"rest {kind}, n_words long, n_removed long, kept_text string"
    done = moved(rest, f", rest {kind}").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy_group(finish), made)
    back = [
        F.col("text").alias(c) if c == text_col else F.col("rest")[f"c{others.index(c)}"].alias(c)
        for c in docs.columns if c in others or (keep_text and c == text_col)
    ]
    return done.select(*back, "n_words", "n_removed", "kept_text")
