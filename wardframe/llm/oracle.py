"""DuckDB SQL for the queries that SQL can express on whole tables."""

from wardframe.llm.licenses import NOTICES

ORACLE: dict[str, str] = {}

ORACLE["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), f AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (l.doc_id < f.last_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.last_doc IS NULL OR l.doc_id >= f.last_doc), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY l.doc_id
"""

ORACLE["op4_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, regexp_matches(text, '[\[<]\\*(/?INST\]|/?s>|</?SYS>>|/?ROLE)') AS clash,
         len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|/?s>|</?SYS>>|/?ROLE)')) AS extra,
         CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                   ELSE 16 + 2 * strlen(role) END AS marks
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + marks + extra) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_GRID = {
    "symbols": ("100 * n_symbols", "n_words", (2, 5, 10, 20, 40, 80)),
    "dup_lines": ("100 * n_dup_lines", "n_lines", (5, 10, 20, 30, 40, 60)),
    "repeat_words": ("100 * n_repeat_words", "n_words", (2, 5, 8, 12, 16)),
    "long_words": ("word_chars", "n_words", (7, 8, 9, 10, 12, 16)),
    "loud": ("100 * n_loud", "word_chars", (2, 5, 10, 20, 40, 60)),
}
_CELLS = ", ".join(f"('{r}', {c})" for r, (_, _, cuts) in _GRID.items() for c in cuts)
_REJECTS = " ".join(f"WHEN '{r}' THEN {left} > cutoff * {right}" for r, (left, right, _) in _GRID.items())

ORACLE["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), v AS (
  SELECT r, i, list_slice(ws, i, i + 4) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), s AS (
  SELECT r, i FROM v QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM s, (SELECT unnest(range(5)) AS j) GROUP BY r
), ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), c AS (
  SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '!')) AS n_loud,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)
), grid AS (
  SELECT * FROM (VALUES {_CELLS}) AS g(rule, cutoff)
), held AS (
  SELECT * FROM c WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), k AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (CASE rule {_REJECTS} END) AS k
  FROM held, grid GROUP BY lang, rule, cutoff
), p AS (
  SELECT lang, rule, cutoff, sum(exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END
           - CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END
           + j * ln(0.01) + (n - j) * ln(0.99))) AS tail, any_value(k) <= any_value(n) * 0.01 AS few
  FROM (SELECT *, unnest(range(k + 1)) AS j FROM k) GROUP BY lang, rule, cutoff
), cut AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM p
  WHERE few AND tail <= 0.05 / (SELECT count(*) FROM k) GROUP BY lang, rule
), verdict AS (
  SELECT c.*, EXISTS (SELECT 1 FROM cut WHERE cut.lang IS NOT DISTINCT FROM c.lang AND CASE rule {_REJECTS} END) AS bad
  FROM c
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM verdict
"""

ORACLE["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)
), again AS (
  SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM again, (SELECT unnest(range(20)) AS j)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_TEMPLATES = ", ".join(
    f"({i}, '{text}', '{label}', {i < 4})"
    for i, (text, label) in enumerate([
        ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
        *NOTICES.items(),
    ])
)

# A notice's hits are taken one by one: each ends its longest chain, in which
# both positions grow and the diagonal moves by three at most from hit to hit.
ORACLE["op8_license_scan"] = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), t AS (
  SELECT id, string_split(text, ' ') AS ws, label, phrase FROM (VALUES {_TEMPLATES}) AS x(id, text, label, phrase)
), g AS (
  SELECT id, label, phrase, n, p, ws[p + 1] AS one, ws[p + 2] AS two
  FROM (SELECT *, len(ws) - 1 AS n, unnest(range(len(ws) - 1)) AS p FROM t)
), b AS (
  SELECT r, i, ws[i + 1] AS one, ws[i + 2] AS two FROM (SELECT r, ws, unnest(range(len(ws) - 1)) AS i FROM d)
), hit AS (
  SELECT r, id, label, phrase, n, CAST(i AS INTEGER) AS pos, CAST(p AS INTEGER) AS tpos, i - p AS diagonal FROM b JOIN g USING (one, two)
), places AS (
  SELECT r, label, diagonal AS place FROM hit WHERE phrase GROUP BY r, id, label, n, diagonal HAVING count(*) = n
), v AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, id ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS opens
  FROM (SELECT DISTINCT r, id, diagonal FROM hit WHERE NOT phrase)
), runs AS (
  SELECT r, id, diagonal, sum(opens) OVER (PARTITION BY r, id ORDER BY diagonal) AS run FROM v
), h AS (
  SELECT r, id, run, label, n, pos, tpos, row_number() OVER (PARTITION BY r, id, run ORDER BY pos, tpos) AS i
  FROM hit JOIN runs USING (r, id, diagonal)
  WHERE (r, id, run) IN (SELECT (r, id, run) FROM hit JOIN runs USING (r, id, diagonal)
                         GROUP BY r, id, run, n HAVING count(DISTINCT tpos) >= 0.8 * n)
), chain AS (
  SELECT DISTINCT r, id, run, label, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(pos INTEGER, tpos INTEGER, start INTEGER, size INTEGER)[]) AS recent,
         CAST([] AS STRUCT(start INTEGER, words INTEGER, cover DOUBLE)[]) AS spans
  FROM h
  UNION ALL
  SELECT r, id, run, label, i, list_append(near, own), CASE
      WHEN own.size / n < 0.8 THEN spans
      WHEN len(spans) = 0 OR own.start >= spans[-1].start + spans[-1].words THEN list_append(spans, span)
      WHEN span.cover > spans[-1].cover OR span.cover = spans[-1].cover AND span.words < spans[-1].words
        THEN list_append(spans[:-2], span)
      ELSE spans END
  FROM (
    SELECT *, struct_pack(start := own.start, words := CAST(own.pos - own.start + 2 AS INTEGER), cover := CAST(own.size / n AS DOUBLE)) AS span
    FROM (
      SELECT *, struct_pack(pos := pos, tpos := tpos, start := coalesce(best.start, pos), size := CAST(coalesce(best.size, 0) + 1 AS INTEGER)) AS own
      FROM (
        SELECT *, list_max(list_transform(list_filter(near, lambda x: x.pos < pos AND x.tpos < tpos
                   AND abs(pos - tpos - x.pos + x.tpos) <= 3 AND pos - x.start + 2 <= 2 * (n + 1)),
                   lambda x: struct_pack(size := x.size, start := x.start))) AS best
        FROM (
          SELECT c.r, c.id, c.run, c.label, h.i, h.n, h.pos, h.tpos, c.spans, list_filter(c.recent, lambda x: x.pos >= h.pos - h.n - 3) AS near
          FROM chain c JOIN h ON h.r = c.r AND h.id = c.id AND h.run = c.run AND h.i = c.i + 1))))
), notices AS (
  SELECT r, label, unnest(spans).cover AS cover FROM chain
  QUALIFY row_number() OVER (PARTITION BY r, id, run ORDER BY i DESC) = 1
), found AS (
  SELECT r, label, place, 1.0::DOUBLE AS cover FROM places UNION ALL SELECT r, label, NULL, cover FROM notices
), per AS (
  SELECT r, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (place IS NOT NULL)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score
  FROM found GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN per USING (r)
"""

ORACLE["op11_hard_negatives"] = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""

ORACLE["op12_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS own
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY own ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY own) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(own) AS text_sha256 FROM g
"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _level(below: str) -> str:
    """The parents of the nodes (tree, idx, digest, total) that have brothers."""
    return f"""SELECT tree, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest,
      (max(total) + 15) // 16 AS total FROM {below} WHERE total > 1 GROUP BY tree, idx // 16"""


def _path(top: int) -> str:
    """Brothers left and right of every node that has any, per level."""
    return " UNION ALL ".join(
        f"""SELECT tree, {k} AS level, idx,
      coalesce(string_agg(digest, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(digest, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM n{k} WHERE total > 1""" for k in range(top))


def _merkle(height: int) -> str:
    """Trees of up to 16 ** height leaves a source and sources; a row's CRC-32 comes bit by bit."""
    levels = ", ".join(f"n{k} AS ({_level(f'n{k - 1}')})" for k in range(1, height + 1))
    nodes = " UNION ALL ".join(f"SELECT tree, digest FROM n{k} WHERE total = 1" for k in range(height + 1))
    upper = ", ".join(f"u{k} AS ({_level(f'u{k - 1}')})" for k in range(1, height + 1))
    roots = " UNION ALL ".join(f"SELECT digest FROM u{k} WHERE total = 1" for k in range(height + 1))
    folds, last = [], "f0"
    for k in range(2 * height):
        below, tree, at = ("below", "tree", f"idx // {16**k}") if k < height else ("above", "0", f"tree // {16**(k - height)}")
        folds.append(f"""f{k + 1} AS (
  SELECT f.* REPLACE (coalesce(sha256(b.l || f.fold || b.r), f.fold) AS fold, f.proof || coalesce(b.l || b.r, '') AS proof)
  FROM {last} f LEFT JOIN {below} b ON b.tree = f.{tree} AND b.level = {k % height} AND b.idx = f.{at})"""
                     .replace("f.0", "0"))
        last = f"f{k + 1}"
    return rf"""
WITH c AS (
  SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)),
           lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, CAST(3988292384 AS BIGINT)) ELSE b // 2 END)) AS crc
  FROM documents
), l AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 5 = 0 THEN
           {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other,
         dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS total
  FROM c
), n0 AS (SELECT tree, idx, leaf AS digest, total FROM l), {levels}, s AS ({nodes}),
u0 AS (SELECT 0 AS tree, tree AS idx, digest, (SELECT count(*) FROM s) AS total FROM s), {upper}, root AS ({roots}),
below AS ({_path(height)}), above AS ({_path(height).replace('FROM n', 'FROM u')}),
f0 AS (SELECT doc_id, leaf, tree, idx, coalesce(other, leaf) AS fold, '' AS proof FROM l), {', '.join(folds)}
SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
       fold = root.digest AS verified
FROM {last} JOIN s USING (tree), root
"""


ORACLE["op13_merkle_manifest"] = _merkle(6)
