"""Token counts, BPE, SimHash, substring and line dedup against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE_TEXTS, classes, document_frame, fingerprint, kept_words, long_text, plain_lines, words
from tokenizers import Tokenizer

from wardframe.llm.linedup import SortedRuns, dedup_lines, line_keys
from wardframe.llm.packing import packed_documents
from wardframe.llm.queries import COUNT_VOCABULARY, WORD_VOCABULARY, vocabulary
from wardframe.llm.simhash import links, near_duplicates
from wardframe.llm.substring import remove_repeats
from wardframe.llm.tokens import safe_cuts, token_counts
from wardframe.llm.wordbpe import encode


@pytest.fixture(scope="module")
def docs(spark):
    return document_frame(spark, EDGE_TEXTS).repartition(3).cache()


def test_token_counts(docs):
    plain = Tokenizer.from_file(vocabulary(COUNT_VOCABULARY))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, vocabulary(COUNT_VOCABULARY)).collect()}
    assert got == {i: (len((t or "").encode()), len(plain.encode(t or "").ids)) for i, t in enumerate(EDGE_TEXTS)}


def test_safe_cuts_keep_tokens():
    plain = Tokenizer.from_file(vocabulary(COUNT_VOCABULARY))
    for text in ("a  b c\n d", " lead", "trail ", "é à  ü", "it 's <|endoftext|> 12 3", "a  b \t c"):
        data = text.encode()
        edges = [0, *safe_cuts(np.frombuffer(data, np.uint8)).tolist(), len(data)]
        parts = [data[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)]
        assert sum((plain.encode(p).ids for p in parts), []) == plain.encode(text).ids


def test_token_counts_of_texts_without_blanks_and_of_runs(spark):
    """Units end at letters and digits, lines and ideographic punctuation too."""
    r = random.Random(4)
    bits = ["a", "b ", "  ", " ", "\n", "\t", "\r\n", "12", "x9", "'s", "'ll", "<|endoftext|>", "\u3002", "\u3001", "\uff0c"]
    bits += ["\u6f22\u5b57", "\u304b\u306a", "\u30ab", "\u30fb", "\u00e9", "\u00a0", "\u3000", "<", "|", ">", "!!", "\x0b", "\x1f", "\u0663"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["  <|endoftext|>", "a \n <|endoftext|>b", "tail  ", "next", "\u6f22\u5b57\u3002" * 20_000, "ab12" * 20_000]
    plain = Tokenizer.from_file(vocabulary(COUNT_VOCABULARY))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {q.doc_id: (q.n_bytes, q.n_tokens) for q in token_counts(frame, vocabulary(COUNT_VOCABULARY)).collect()}
    assert got == {i: (len(t.encode()), len(plain.encode(t).ids)) for i, t in enumerate(texts)}
    for text in texts[-2:]:
        edges = [0, *safe_cuts(np.frombuffer(text.encode(), np.uint8), b"<").tolist(), len(text.encode())]
        assert max(np.diff(edges)) < 20


def test_encode_and_decode(docs):
    plain = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    plain.no_truncation()
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in encode(docs, vocabulary(WORD_VOCABULARY)).collect()}
    for i, text in enumerate(EDGE_TEXTS):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (np.array(ids, "<u4").tobytes(), plain.decode(ids, skip_special_tokens=False))


def test_simhash_groups(docs):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    own = {i: fingerprint(t) for i, t in enumerate(EDGE_TEXTS)}
    near = [(a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() <= 3]
    part = classes(own, near)
    assert found == {i: (f"{own[i]:016x}", part[i]) for i in own}
    assert part[10] == part[9] == 8 and part[2] == 0


def test_an_id_in_two_groups_does_not_join_them(spark):
    a, b = long_text(1, 40), long_text(2, 40)
    rows = near_duplicates(document_frame(spark, [a, a, b, b], [2, 5, 5, 9])).collect()
    own = {fingerprint(t): t for t in (a, b)}
    got = sorted((r.doc_id, own[int(r.fingerprint, 16)] == a, r.component_id) for r in rows)
    assert got == [(2, True, 2), (5, False, 5), (5, True, 2), (9, False, 5)]


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("crowd", [2, 64])
def test_crowded_variants_join_the_same_groups(spark, distance, crowd):
    from wardframe.llm.components import components

    rng = np.random.default_rng(distance)
    centres = rng.integers(-(2**63), 2**63 - 1, 6)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(25):
            flips = rng.choice(64, int(rng.integers(1, 8)), replace=False)
            values.add(int(np.int64(c) ^ np.bitwise_xor.reduce(np.int64(1) << flips.astype(np.int64))))
    values = sorted(values)
    near = [(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.component for r in components(links(frame, distance, crowd)).collect()}
    assert got == {k: v for k, v in classes(values, near).items() if any(k in pair for pair in near)}


@pytest.mark.parametrize("window", [7, 20, 40, 80])
def test_substrings(spark, window):
    texts = [" ".join(words(t)[:2000]) if t else t for t in EDGE_TEXTS]
    got = {r.doc_id: r for r in remove_repeats(document_frame(spark, texts).repartition(3), window=window).collect()}
    for i, own in kept_words(texts, window).items():
        assert (got[i].n_words, got[i].n_removed) == (len(words(texts[i])), len(words(texts[i])) - len(own))
        assert got[i].kept_text == " ".join(own) and got[i].text == texts[i] and got[i].block == "b"


def test_substrings_of_rows_that_share_an_id(spark):
    text = " ".join(map(str, range(30)))
    got = remove_repeats(document_frame(spark, [text, text, text], [1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 30), (1, 30)]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, docs, batches):
    got = dedup_lines(docs, batches=batches)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect())
    assert rows == sorted(plain_lines(EDGE_TEXTS, range(len(EDGE_TEXTS))))
    assert sum(r[2] for r in rows) == 6


def test_runs_are_sorted_compacted_and_settled(spark):
    line = "a line that many documents hold"
    docs = document_frame(spark, [line] * 12)
    runs = SortedRuns(spark, need=3, fanout=2)
    lines = line_keys(docs, "doc_id", "text", 20)
    for low in (8, 4, 0):
        runs.add(lines.where(f"id >= {low} AND id < {low + 4}"))
    # the first batch settles the key, so the others store nothing
    assert [r.n_docs for r in runs.totals().collect()] == [4]
    assert [len(level) for level in runs.levels] == [1, 1]


def test_empty_tables(spark):
    empty = document_frame(spark, [])
    assert token_counts(empty, vocabulary(COUNT_VOCABULARY)).count() == 0
    assert encode(empty, vocabulary(WORD_VOCABULARY)).count() == 0
    assert near_duplicates(empty).count() == 0
    assert remove_repeats(empty).count() == 0
    assert dedup_lines(empty).count() == 0


@pytest.mark.parametrize("texts", [[long_text(5, 50)], ["one"], ["one", "two words"], ["", ""], [None, None], [None, " \n"]])
def test_tables_without_repeats_or_words(spark, texts):
    frame = document_frame(spark, texts)
    plain = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    plain.no_truncation()
    got = {r.doc_id: (r.text, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(frame).collect()}
    assert got == {i: (t, len(words(t)), 0, " ".join(words(t))) for i, t in enumerate(texts)}
    coded = {r.doc_id: (bytes(r.ids), r.decoded) for r in encode(frame, vocabulary(WORD_VOCABULARY)).collect()}
    pieces = {r.doc_id: r.length for r in packed_documents(frame, vocabulary(WORD_VOCABULARY)).collect()}
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        assert coded[i] == (np.array(ids, "<u4").tobytes(), plain.decode(ids, skip_special_tokens=False))
        assert pieces[i] == len(ids) + 1


def test_rows_without_an_id(spark):
    texts = [None, "", long_text(5, 50), long_text(5, 50)]
    frame = document_frame(spark, texts, [None] * 4)
    assert token_counts(frame, vocabulary(COUNT_VOCABULARY)).where("doc_id IS NULL").count() == 4
    assert encode(frame, vocabulary(WORD_VOCABULARY)).where("doc_id IS NULL").count() == 4
    assert packed_documents(frame, vocabulary(WORD_VOCABULARY)).where("doc_id IS NULL").count() == 4
    assert near_duplicates(frame).where("doc_id IS NULL AND component_id IS NULL").count() == 4
    assert dedup_lines(frame).where("doc_id IS NULL").count() == 4


def test_digest_columns(spark, tmp_path):
    from wardframe.llm.queries import QUERIES

    document_frame(spark, EDGE_TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in plain_lines(EDGE_TEXTS, range(len(EDGE_TEXTS)))}
    assert {r.doc_id: r.kept_sha256 for r in rows} == want
    counts = Counter(type(r.n_lines) for r in rows)
    assert counts == {int: len(EDGE_TEXTS)}


def test_blocks_do_not_depend_on_batches():
    import pyarrow as pa

    from wardframe.llm.common import row_blocks

    texts = ["x" * n for n in (5, 3, 0, 9, 20, 1, 1, 1, 8, 2)]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + size])], names=["t"]) for i in range(0, 10, size)]
        got = [[len(t) for t in rows.column(0).to_pylist()] for rows in row_blocks(iter(batches), 0, 10)]
        assert got == [[5, 3, 0], [9], [20], [1, 1, 1], [8, 2]]
