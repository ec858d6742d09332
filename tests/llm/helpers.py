"""Hand-made rows and plain versions of the operators' contracts."""

import re
from collections import defaultdict

import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, block string, kept_text string"


def words(text):
    return WS.findall(text or "")


def document_frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 7, "b", "k") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def long_text(seed, n):
    return " ".join(f"w{seed}x{(i * 7919 + seed) % 104729}" for i in range(n))


PASSAGE = long_text(99, 60)
EDGE_TEXTS = [
    None, "", " \n\t", "one", "Two words", "A b c d", "a B c D", "É é   　 x\ty\nz",
    long_text(1, 30000), long_text(1, 30000), long_text(1, 30000).upper(),
    long_text(2, 50) + "\n" + PASSAGE, PASSAGE + " " + long_text(3, 40), "x " * 500, "same line that is long enough\n" * 3,
    "Same line that is long enough \nother", "  same line that is long enough\nmore <|endoftext|> it's  two  blanks",
]


def lower_az(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def fingerprint(text, n=3):
    own = [w.encode() for w in words(lower_az(text))]
    shingles = [b" ".join(own[i : i + n]) for i in range(max(1, len(own) - n + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {v: find(v) for v in values}


def kept_words(texts, window):
    first, gone = {}, defaultdict(set)
    for i, text in enumerate(texts):
        own = words(text)
        for p in range(len(own) - window + 1):
            if tuple(own[p : p + window]) in first:
                gone[i] |= set(range(p, p + window))
            first.setdefault(tuple(own[p : p + window]), (i, p))
    return {i: [w for p, w in enumerate(words(t)) if p not in gone[i]] for i, t in enumerate(texts)}


def plain_lines(texts, ids):
    keys = [[lower_az(line).strip(" \t\n\r\x0b\x0c") for line in (t or "").split("\n")] for t in texts]
    held = defaultdict(list)
    for i, own in zip(ids, keys, strict=True):
        for k in set(own):
            held[k].append(i)
    out = []
    for i, text, own in zip(ids, texts, keys, strict=True):
        stays = [line for line, k in zip((text or "").split("\n"), own, strict=True)
                 if len(k) < 20 or len(held[k]) < 3 or i == max(held[k])]
        out.append((i, len(own), len(own) - len(stays), "\n".join(stays)))
    return out
