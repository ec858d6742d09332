"""Token counts by batch encoding in Arrow functions.

Texts are cut at safe boundaries into units, so a very long text is never
encoded in one piece; the distinct units of a slice of rows are encoded in
batches of about equal bytes, and only their lengths are kept.

Boundaries are places that the pre-tokenizer's pattern never matches across:

* before white space that follows a printable ASCII character;
* before a blank that a printable ASCII character follows, as a word takes the
  one blank before it and a run of white space leaves its last blank to the
  word; but not where an added token may begin, which ends the run instead;
* between an ASCII letter and an ASCII digit;
* before ideographic punctuation that follows an ideograph or hiragana, so
  that texts without blanks are cut as well.

What is left between two boundaries is about one word of the pattern.

Defined results: a null text is an empty one with zero tokens; repeated rows
are counted one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.llm.common import bounded_batches, raw, slices, tidy

SLICE_BYTES = 16 << 20
BATCH_BYTES = 1 << 19


# Ideographic comma and full stop; full-width exclamation mark,
# comma, colon, semicolon and question mark, in UTF-8.
PUNCTUATION = ["\u3001", "\u3002", "\uff01", "\uff0c", "\uff1a", "\uff1b", "\uff1f"]


def _ideographic(data: np.ndarray) -> np.ndarray:
    """Positions of ideographic punctuation after a letter of three bytes."""
    at = np.flatnonzero((data[3:-2] == 0xE3) | (data[3:-2] == 0xEF)) + 3
    code = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
    marks = [int.from_bytes(mark.encode(), "big") for mark in PUNCTUATION]
    # U+5000 to U+8FFF are ideographs, U+3041 to U+307F hiragana
    lead, second, third = data[at - 3], data[at - 2], data[at - 1]
    letter = ((lead >= 0xE5) & (lead <= 0xE8)) | ((lead == 0xE3) & (second == 0x81) & (third > 0x80))
    return at[np.isin(code, marks) & letter]


def safe_cuts(data: np.ndarray, starts: bytes = b"", begins: np.ndarray | None = None) -> np.ndarray:
    """Positions before which a text may be cut; ``starts`` are the first
    bytes of added tokens.  ``data`` may hold many texts, which begin at
    ``begins``: a text's last blank is not followed by the next text."""
    if len(data) < 2:
        return np.empty(0, np.int64)
    printable = (data > 0x20) & (data < 0x7F)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    lower = data | 0x20
    letter, digit = (lower >= 0x61) & (lower <= 0x7A), (data >= 0x30) & (data <= 0x39)
    cut = np.zeros(len(data), bool)
    cut[1:] = printable[:-1] & white[1:]
    cut[1:] |= (letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:])
    opens = printable & ~np.isin(data, np.frombuffer(starts, np.uint8))
    if begins is not None:
        opens[begins[begins < len(data)]] = False
    cut[:-1] |= (data[:-1] == 0x20) & opens[1:]
    cut[_ideographic(data)] = True
    return np.flatnonzero(cut)


def unit_lengths(tokenizer, units: list[str], sizes: np.ndarray) -> np.ndarray:
    """Tokens of every unit, encoded in batches of about BATCH_BYTES by their
    ``sizes`` in bytes."""
    # a batch ends with the unit that crosses a multiple of the batch's bytes
    crossed = np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES)) + 1
    out = []
    for begin, end in zip([0, *crossed.tolist()], [*crossed.tolist(), len(units)]):
        out += [len(e) for e in tokenizer.encode_batch_fast(units[begin:end], add_special_tokens=False)]
    return np.array(out, np.int64)


def _slice_counts(tokenizer, starts: bytes, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every text of a slice."""
    data, offsets = raw(texts.fill_null(""))
    first, last = offsets[0], offsets[-1]
    sizes = np.diff(offsets)
    cuts = safe_cuts(np.frombuffer(data, np.uint8)[first:last], starts, offsets - first) + first
    edges = np.unique(np.concatenate([offsets, cuts])).astype(np.int32)
    if len(edges) < 2:
        return sizes, np.zeros(len(sizes), np.int64)
    units = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))
    coded = units.dictionary_encode()
    sizes_of_units = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
    lengths = unit_lengths(tokenizer, coded.dictionary.to_pylist(), sizes_of_units)
    before = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy()])])
    at = np.searchsorted(edges, offsets)
    return sizes, np.diff(before[at])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every whole text, with the byte-level
    tokenizer file ``vocabulary``, without added special tokens."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = tokenizer.get_added_tokens_decoder().values()
        starts = bytes(sorted({t.content.encode()[0] for t in added if t.content}))
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                sizes, tokens = _slice_counts(tokenizer, starts, part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                    names=["id", "n_bytes", "n_tokens"],
                )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return sent.mapInArrow(tidy(counts), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
