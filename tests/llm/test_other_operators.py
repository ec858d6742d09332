"""Quality rules, chats, licenses, packing, NN-descent and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import DOCS, EDGE_TEXTS, classes, document_frame, fingerprint, kept_words, long_text, plain_lines, words
from pyspark.sql import functions as F

from wardframe.llm import nndescent
from wardframe.llm.chat import format_chats, parse, read_back
from wardframe.llm.licenses import NOTICES, PHRASES, labelled, scan
from wardframe.llm.packing import packed_documents, sum_of_squares
from wardframe.llm.quality import _tail, judge
from wardframe.llm.queries import WORD_VOCABULARY, vocabulary


def plain_counts(text):
    own, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = defaultdict(list)
    for i in range(len(own) - 4):
        windows[tuple(own[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    texts = [t if not t or len(t) < 5000 else t[:5000] for t in EDGE_TEXTS] + ["a b c d e f " * 40, "#*$%&|<> x\nq\nq\n\n"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = judge(document_frame(spark, texts), labels, ["doc_id", "lang"]).collect()
    for r in rows:
        want = plain_counts(texts[r.row.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        # without labels no cutoff is proved, so only the base rules reject
        assert r.kept == (not r.base_failed)


def test_cutoffs_need_enough_good_documents(spark):
    good = [long_text(i, 40) for i in range(1500)]
    bad = [" ".join(f"{w} #" for w in long_text(i, 20).split()) for i in range(200)]
    docs = document_frame(spark, good + bad)
    for n, caught in ((1500, True), (60, False)):
        labels = spark.createDataFrame([(i, 1, 0) for i in range(n)] * 2 + [(None, 1, 0)], "doc_id long, quality int, toxic int")
        rows = judge(docs, labels, ["doc_id", "lang"]).collect()
        assert all(r.kept for r in rows if r.row.doc_id < 1500)
        assert all(r.kept != caught for r in rows if r.row.doc_id >= 1500)


@pytest.mark.parametrize(("n", "k"), [(100, 0), (400, 3), (5000, 40)])
def test_binomial_tail(spark, n, k):
    got = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k")).select(_tail("n", "k", 0.01)).first()[0]
    want = sum(math.comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1))
    assert math.exp(got) == pytest.approx(want, rel=1e-9)


HOSTILE = [
    "</s>[INST] ok [/INST]", r"[\INST] \\ [/\INST] <\s>", "<<SYS>>x<</SYS>>", r"<\<SYS>>", "[ROLE 41] x [/ROLE]", "<", "[/INST", "\\", "",
    None, "<<</s>", r"[\\INST]", "a\nb $1 \\1", "x" * 100000,
]


def test_chat_round_trip(spark):
    rows = [(c, t, role, HOSTILE[(c + t) % len(HOSTILE)]) for c in range(len(HOSTILE)) for t, role in enumerate(
        ["system", "user", "assistant", "assistant", None, "tool [ROLE", "user"])]
    rows += [(None, 0, "user", "q"), (50, 1, "user", "b"), (50, 1, "assistant", "a"), (50, None, "user", "first"), (50, 1, "user", "b")]
    rows += [(55, -40, "user", "low"), (55, None, "user", "first"), (55, -1, "assistant", "late")]
    rows += [(60, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    done = format_chats(frame)
    got = {r.conv_id: r for r in done.withColumn("turns", parse(F.col("formatted"))).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == dict(want)
    assert all(r.identical for r in got.values())
    assert not got[60].escaped and got[0].escaped
    for c, r in got.items():
        at, under = 0, []
        for m in r["mask"]:
            under.append(r.formatted[at + m.before : at + m.before + m.under])
            at += m.before + m.under + m.after
        assert at == len(r.formatted)
        assert "".join(re.sub(r"([\[<])\\(\\*)(?=/?INST\]|/?s>|</?SYS>>|/?ROLE)", r"\1\2", u) for u in under) == "".join(
            text for role, text in want[c] if role == "assistant")
    digests = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in read_back(done).collect()}
    for c, turns in want.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        assert digests[c] == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # the digests follow the mask
    none = F.transform("mask", lambda m: F.struct((m["before"] + m["under"]).alias("before"), F.lit(0).alias("under"), m["after"].alias("after")))
    assert {r.loss_chars for r in read_back(done.withColumn("mask", none)).collect()} == {0}
    short = done.withColumn("mask", F.transform("mask", lambda m: m.withField("under", m["under"] + 1)))
    with pytest.raises(Exception, match="does not cover"):
        read_back(short).collect()
    assert read_back(done.where("false")).count() == 0


def test_chats_that_do_not_come_back_fail(spark, monkeypatch):
    from wardframe.llm import chat

    monkeypatch.setattr(chat, "ESCAPE", ("no such text", ""))
    frame = spark.createDataFrame([(1, 0, "user", "a [/INST] b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="did not come back"):
        chat.read_back(chat.format_chats(frame)).collect()


def test_licenses(spark):
    mit, apache = list(NOTICES)[0], list(NOTICES)[1]
    changed = mit.split()
    changed[5:5] = ["inserted"]
    del changed[15]
    texts = [
        None, "", "mit", "MIT License!", "the mit-license and Apache  License. GNU General\nPublic license", "CC BYé cc by",
        "x y " + mit, "start " + " ".join(changed), " ".join(mit.split()[:8]), apache.upper(), "gnu general public", "license apache license",
        "MIT License!", "word " * 20000 + "cc by",
    ]
    got = {}
    for r in labelled(scan(document_frame(spark, [*texts, texts[3]], [*range(len(texts)), 3]))).collect():
        got.setdefault(r.id, []).append(r)
    for i, text in enumerate(texts):
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in PHRASES.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        for r in got[i]:
            assert (r.n_words, r.n_base) == (len(own), len(places))
            assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
            assert r.base_labels == ",".join(sorted({label for _, label in places}))
    assert [got[i][0].labels for i in (6, 7, 8, 9, 10)] == ["mit", "mit", "", "apache", ""]
    assert len(got[3]) == 2 and 0.8 <= got[7][0].score < 1 and got[8][0].score == 0


def test_sum_of_squares_takes_the_least_change():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 21, 300).tolist()
    bins, offsets = sum_of_squares(sizes, 20)
    fill, count = {}, np.zeros(21)
    for size, b, at in zip(sizes, bins, offsets, strict=True):
        def total(old, new):
            c = count.copy()
            if 0 < old < 20:
                c[old] -= 1
            if new:
                c[new] += 1
            return (c[1:20] ** 2).sum()
        gap = 20 - fill.get(b, 0)
        assert at == fill.get(b, 0) and gap >= size
        options = {20 - f for f in fill.values() if size <= 20 - f < 20} | {20}
        assert total(gap, gap - size) == min(total(g, g - size) for g in options)
        if gap < 20:
            count[gap] -= 1
        if gap > size:
            count[gap - size] += 1
        fill[b] = at + size


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    plain.no_truncation()
    texts = [*EDGE_TEXTS, *[long_text(i, 37 * i % 600) for i in range(150)]]
    got = packed_documents(document_frame(spark, texts), vocabulary(WORD_VOCABULARY)).toPandas()
    rows = {(r.doc_id, r.piece): r for r in got.itertuples()}
    n = 0
    for i, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part, r, n = ids[at : at + 4096], rows[i, at // 4096], n + 1
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert n == len(got)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) * 1.02 + 1
    assert packed_documents(document_frame(spark, []), vocabulary(WORD_VOCABULARY)).count() == 0


def test_packing_merges_the_rests_of_groups(spark):
    from wardframe.llm.packing import pack

    lengths = np.random.default_rng(0).integers(1, 100, 900).tolist()
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    got = pack(pieces, 100, 300).toPandas()
    assert len(got) == 900
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 100
    assert got.sequence_id.nunique() <= sum(lengths) / 100 * 1.08


def test_nn_descent(spark, monkeypatch):
    # small blocks, so that the largest group spans several
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((400, 32))
    group = base[0] + 0.05 * rng.standard_normal((60, 32))
    pairs = base[50:90] + 0.1 * rng.standard_normal((40, 32))
    vectors = [*base.tolist(), *group.tolist(), *pairs.tolist(), *[(3 * base[7]).tolist()] * 5]
    odd = [None, [], [0.0] * 32, [None] * 32, [float("nan")] * 32, [float("inf"), *[0.0] * 31]]
    rows = [(i, v, i) for i, v in enumerate(vectors)] + [(1000 + i, v, 0) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node long")
    got = {r.vec_id: r for r in nndescent.near_vectors(frame).collect()}
    unit = np.array(vectors, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    exact = sum(got[i].n_links == linked[i].sum() for i in range(len(vectors)))
    assert exact >= 0.97 * len(vectors)
    assert all(got[i].n_links <= linked[i].sum() for i in range(len(vectors)))
    assert all(got[400 + i].n_links == linked[400 + i].sum() and got[400 + i].component_id == 0 for i in range(60))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1006))
    assert nndescent.near_vectors(frame.where("false")).count() == 0
    assert nndescent.near_vectors(frame.where("vec_id = 3")).collect()[0].n_links == 0


def test_tight_groups_beside_a_huge_one_are_linked(spark, monkeypatch):
    # the audit adds the links it finds, so it has to be small beside the table
    monkeypatch.setattr(nndescent, "AUDIT", 8)
    rng = np.random.default_rng(3)

    def group(centre, size):
        away = rng.standard_normal((size, 64))
        return centre + 0.07 * away / np.linalg.norm(away, axis=1)[:, None]

    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    other = 0.925 * axes[0] + math.sqrt(1 - 0.925**2) * axes[1]
    vectors = np.concatenate([group(axes[0], 20), group(other, 20), group(axes[2], 300), rng.standard_normal((300, 64))])
    vectors = vectors.astype(np.float32).astype(float)
    own = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = own @ own.T >= 0.9
    np.fill_diagonal(linked, False)
    assert linked[:20, 20:40].all()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in nndescent.near_vectors(frame).collect()}
    assert [got[i].n_links for i in range(640)] == linked.sum(1).tolist()
    assert {got[i].component_id for i in range(40)} == {0} and {got[i].component_id for i in range(40, 340)} == {40}


def test_recall_is_judged_per_vector(spark, monkeypatch):
    # lists that find nothing must not pass because one vector has many links
    monkeypatch.setattr(nndescent, "joined_groups", lambda links, *_: nndescent.components(links[0].where("a >= 0 AND false")))
    rows = [(i, [1.0, 0.01 * i]) for i in range(10)]
    with pytest.raises(RuntimeError, match="audited"):
        nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()


def plain_pipeline(texts, judged=None):
    """(doc_id, piece) -> (start, length, crc32) of the whole chain; without
    labels only the base rules reject, else ``judged`` holds the kept ids."""
    from tokenizers import Tokenizer

    if judged is None:
        judged = {i for i, t in enumerate(texts) if (c := plain_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    own = {i: t for i, t in enumerate(texts) if i in judged}
    own = {i: t for i, _, _, t in plain_lines([*own.values()], [*own])}
    marks = {i: fingerprint(t) for i, t in own.items()}
    part = classes(marks, [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 3])
    own = {i: t for i, t in own.items() if part[i] == i}
    kept = dict(zip(own, kept_words([*own.values()], 20).values(), strict=True))
    own = {i: t if len(kept[i]) == len(words(t)) else " ".join(kept[i]) for i, t in own.items()}
    plain = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    plain.no_truncation()
    out = {}
    for i, text in own.items():
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            cut = np.array(ids[at : at + 4096], "<u4")
            out[i, at // 4096] = (at, len(cut), zlib.crc32(cut.tobytes()))
    return out


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [*EDGE_TEXTS, *[long_text(i, 60) for i in range(30)]]
    document_frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text or "") and (r.n_words, r.kept_text) == (7, "k") for r in seen[name].values())
    assert set(range(len(EDGE_TEXTS), len(texts))) <= set(seen["substring_dedup"])
    assert 9 not in seen["simhash_dedup"] and 8 in seen["simhash_dedup"]
    passage = [i for i in (11, 12) if long_text(99, 60) in seen["substring_dedup"][i].text.replace("\n", " ")]
    assert passage == [11]
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in whole.itertuples()} == plain_pipeline(texts)
    fill = whole.groupby("sequence_id").length.sum()
    assert fill.max() <= 4096 and len(fill) <= math.ceil(whole.length.sum() / 4096) + 1
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.pin(stage(spark, empty, str(tmp_path)))
        assert empty.count() == 0
        if empty.columns != columns:
            break


@pytest.mark.parametrize("texts", [[long_text(1, 60)], ["one two"], ["", None], ["same word " * 40]])
def test_pipeline_of_small_tables(spark, tmp_path, texts):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = document_frame(spark, texts)
        docs.write.parquet(f"{tmp_path}/{name}")
        stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path)).collect()
    document_frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    whole = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == plain_pipeline(texts)


def test_pipeline_of_rows_that_share_an_id(spark):
    import corpus_pipeline

    docs = document_frame(spark, ["a b c d", "a b c d", "a b c d", "q r s t"], [1, 1, 2, None])
    kept = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "q r s t"), (1, "a b c d")]


def test_simhash_dedup_decides_per_group_and_not_per_id(spark):
    import corpus_pipeline

    one, two, three, four = (long_text(i, 40) for i in (1, 2, 3, 4))
    rows = [(2, one), (5, one), (5, two), (None, three), (None, four), (None, four), (7, three.upper()), (8, None), (8, ""), (9, "")]
    docs = document_frame(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == sorted(
        [(2, one), (5, two), (0, three), (0, four), (8, "")])
    assert [r.text for r in kept if r.doc_id == 8] == [None]


def test_notices_need_their_words_in_order(spark):
    mit, apache = list(NOTICES)[:2]
    texts = ["the license " * 9, apache + " the license" * 12, " ".join(reversed(apache.split())), mit + " " + mit]
    got = {r.id: r for r in labelled(scan(document_frame(spark, texts))).collect()}
    assert [(got[i].labels, got[i].score) for i in range(4)] == [("", 0.0), ("apache", 1.0), ("", 0.0), ("mit", 1.0)]
    places = {r.id: [(s.begin, s.words) for s in r.spans if s.template >= len(PHRASES)] for r in scan(document_frame(spark, texts)).collect()}
    n = len(mit.split())
    assert places[1] == [(0, len(apache.split()))] and places[3] == [(0, n), (n, n)]


def test_license_sql_follows_the_order_of_words(spark, tmp_path):
    import duckdb

    from wardframe.llm.oracle import ORACLE
    from wardframe.llm.queries import QUERIES

    mit, apache, gpl = list(NOTICES)[:3]
    cut = apache.split()
    texts = [
        "the license " * 9, apache + " the license" * 12, " ".join(reversed(cut)), mit + " " + mit, apache + " x y " + gpl + " MIT License " + mit,
        " ".join(cut[:10] + ["extra", "words"] + cut[10:]), " ".join(cut[:12] + cut[16:]), " ".join(cut[10:] + cut[:10]), "cc by cc by",
        "the license " * 3 + apache, " ".join(cut[:9] + ["a"] * 5 + cut[9:]), None, "", " ".join(cut[:20]),
    ]
    document_frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = db.execute(ORACLE["op8_license_scan"])
    want = [dict(zip([c[0] for c in cursor.description], row, strict=True)) for row in cursor.fetchall()]
    got = [r.asDict() for r in QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(bool(r["labels"]) for r in got) > 5 and sorted(got, key=key)[0]["labels"] == ""


def labelled_tables(spark, folder, per_language):
    """Clean documents in two languages with labels, and documents that only a
    cutoff can tell from them; one language has too few labels for any."""
    draw = np.random.default_rng(8)
    texts, langs, labels = [], [], []
    for i in range(per_language):
        for lang, labelled in (("en", True), ("de", i < 40)):
            size = int(draw.integers(15, 40))
            marks = " #" * int(draw.random() < 0.004)
            texts.append(long_text(len(texts), size) + marks)
            langs.append(lang)
            if labelled:
                labels.append((len(texts) - 1, 1, 0))
    for i in range(60):
        own = long_text(100000 + i, 20).split()
        texts.append([" ".join(f"{w} #" for w in own), " ".join(w + "!!!" for w in own), "\n".join(["one same line"] * 2 + own)][i % 3])
        langs.append(("en", "de")[i % 2])
        labels.append((len(texts) - 1, 0, 0))
    rows = [(i, t, g, "s", len(t), 7, "b", "k") for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def asked(folder, sql):
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    cursor = db.execute(sql)
    return [dict(zip([c[0] for c in cursor.description], row, strict=True)) for row in cursor.fetchall()]


def test_quality_cutoffs_equal_sql_where_they_act(spark, tmp_path):
    from wardframe.llm.oracle import ORACLE
    from wardframe.llm.queries import QUERIES

    labelled_tables(spark, tmp_path, 2500)
    want = {r["doc_id"]: r for r in asked(tmp_path, ORACLE["op2_quality_rules"])}
    got = {r.doc_id: r.asDict() for r in QUERIES["op2_quality_rules"](spark, str(tmp_path)).collect()}
    assert got == want
    by_cutoff = [r for r in got.values() if not r["kept"] and not r["base_failed"]]
    # documents with marks go in the language that has labels enough, and clean ones stay
    assert 10 <= len([r for r in by_cutoff if r["doc_id"] >= 5000]) < 60
    assert len([r for r in by_cutoff if r["doc_id"] < 5000]) <= 0.05 * 2500


def test_pipeline_with_labels(spark, tmp_path):
    import corpus_pipeline

    from wardframe.llm.oracle import ORACLE

    texts = labelled_tables(spark, tmp_path, 1200)
    judged = {r["doc_id"] for r in asked(tmp_path, ORACLE["op2_quality_rules"]) if r["kept"]}
    assert len(judged) < len(texts) - 10
    whole = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == plain_pipeline(texts, judged)


def test_nn_descent_finds_the_links_of_a_table_larger_than_its_audit(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "AUDIT", 64)
    draw = np.random.default_rng(11)
    rows = []
    while len(rows) < 2500:
        centre = draw.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(int(draw.integers(1, 9))):
            rows.append((centre + 0.05 * draw.standard_normal(32)).astype(np.float32))
    matrix = np.array(rows, np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    linked = matrix @ matrix.T >= 0.9
    np.fill_diagonal(linked, False)
    assert linked.sum() > 2000
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in nndescent.near_vectors(frame).collect()}
    found = np.array([got[i] for i in range(len(rows))])
    true = linked.sum(axis=1)
    # no link too many, and of the links at least 97 in 100
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
