"""License scans by diagonal voting.

All rolling k-word hashes of the documents are joined with the positions of
the same k words in the templates.  A match votes for its diagonal (document
position minus template position); words inserted or left out only shift the
diagonal a little, so neighbouring diagonals are merged before a span is
verified.  A phrase is found where every one of its k-grams votes for one
diagonal.  A notice is found where matches of the merged diagonals, in the
order of the document and of the notice, cover enough of its k-grams inside a
span of about its length; neighbours in this order lie on neighbouring
diagonals, and every k-gram of the notice counts once.

Only DataFrame and SQL functions are used.  A match is verified at the join by
comparing the words themselves.  The templates are a parameter; their k-grams
are broadcast after their number is checked.

Defined results: words are runs of digits, a-z and non-ASCII characters after
A-Z are lower-cased; a null or empty text has none and gets empty labels, null
positions and score 0; rows that repeat an id and text give equal rows; rows
that share only the id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2
MAX_GRAMS = 100_000
#: Words by which neighbouring diagonals may differ to be merged.
MAX_SHIFT = 3
#: Share of a notice's k-grams that have to be found.
MIN_COVER = 0.8

#: Phrases whose places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening words of public license notices, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under a creative commons attribution": "cc-by",
}

NO_WORD = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Every text votes once for this entry, at its number of words.
END = -1


def lower_az(text: str) -> Column:
    """A-Z lower-cased; an ASCII text takes the fast way."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """(hash, template, tpos, gram, n_grams): one row per k-gram position."""
    rows = [(i, text) for i, text in enumerate([*phrases, *notices])]
    if sum(len(text.split()) for _, text in rows) > MAX_GRAMS:
        raise ValueError(f"templates of more than {MAX_GRAMS} words are not broadcast")
    if any(len(text.split()) < k for _, text in rows):
        raise ValueError(f"a template needs {k} words")
    words = spark.createDataFrame(rows, "template int, text string").select("template", F.split("text", " ").alias("w"))
    grams = words.select(
        "template", "w", (F.size("w") - (k - 1)).alias("n_grams"),
        F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("tpos"),
    ).withColumn("gram", F.slice("w", F.col("tpos") + 1, k))
    hashed = grams.withColumn("hash", F.xxhash64(*[F.col("gram")[i] for i in range(k)]))
    end = spark.range(1).select(
        F.lit(END).alias("template"), F.lit(1).alias("n_grams"), F.lit(0).alias("tpos"),
        F.lit(None).cast("array<string>").alias("gram"), F.xxhash64(F.lit("end of text")).alias("hash"),
    )
    return hashed.drop("w").unionByName(end)


def matches(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, digest, template, n_grams, diagonal, tpos) of all verified matches,
    and one END row per text with its number of words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", F.xxhash64("text").alias("digest"), lower_az("text").alias("text")
    )
    at = ", ".join(f"w[i + {j}]" for j in range(k))
    # the one-element array binds the words to a name, so they are split once
    parts = texts.select(
        "id", "digest",
        F.expr(
            f"transform(array(array_remove(split(text, '{NO_WORD}'), '')), w -> struct(w, concat("
            f"CASE WHEN size(w) < {k} THEN array() ELSE transform(sequence(0, size(w) - {k}), i -> xxhash64({at})) "
            f"END, array(xxhash64('end of text'))) AS h))[0]"
        ).alias("c"),
    ).select("id", "digest", "c.w", "c.h")
    rolling = parts.select("id", "digest", "w", F.posexplode_outer("h").alias("pos", "hash"))
    found = rolling.join(F.broadcast(grams), "hash")
    # the last entry of a text is its own; its place is not a k-gram's
    last = F.col("pos") == F.greatest(F.size("w") - (k - 1), F.lit(0))
    words = F.slice("w", F.col("pos") + 1, k)
    checked = found.where(F.when(F.col("template") == END, last).otherwise(~last & (words == F.col("gram"))))
    diagonal = F.when(F.col("template") == END, F.size("w")).otherwise(F.col("pos") - F.col("tpos"))
    return checked.select("id", "digest", "template", "n_grams", diagonal.alias("diagonal"), "tpos")


def notice_spans(k: int, min_cover: float) -> Column:
    """The places of a notice among the ``hits`` of a run.

    Every hit ends its longest chain of hits: document and notice positions
    grow, and the diagonal moves by at most MAX_SHIFT from one to the next.  A
    predecessor is at most a notice away, so only that many hits are held.  Of
    chains that overlap the best one stays."""
    n = F.col("n_grams")

    def chained(recent: Column, h: Column) -> Column:
        prior = F.filter(recent, lambda r: (
            (r["pos"] < h["pos"]) & (r["tpos"] < h["tpos"])
            & (F.abs(h["pos"] - h["tpos"] - r["pos"] + r["tpos"]) <= MAX_SHIFT)
            & (h["pos"] - r["begin"] + k <= 2 * (n + k - 1))
        ))
        best = F.array_max(F.transform(prior, lambda r: F.struct(r["size"].alias("size"), r["begin"].alias("begin"))))
        return F.struct(
            h["pos"].alias("pos"), h["tpos"].alias("tpos"), F.coalesce(best["begin"], h["pos"]).alias("begin"),
            (F.coalesce(best["size"], F.lit(0)) + 1).alias("size"),
        )

    def placed(spans: Column, mine: Column) -> Column:
        own = F.struct(
            F.col("template").alias("template"), mine["begin"].alias("begin"),
            (mine["pos"] - mine["begin"] + k).alias("words"), (mine["size"] / n).alias("cover"),
        )
        last = F.element_at(spans, -1)
        better = (own["cover"] > last["cover"]) | ((own["cover"] == last["cover"]) & (own["words"] < last["words"]))
        return F.when(own["cover"] < min_cover, spans).when(
            (F.size(spans) == 0) | (mine["begin"] >= last["begin"] + last["words"]), F.concat(spans, F.array(own))
        ).when(better, F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(own))).otherwise(spans)

    def step(state: Column, h: Column) -> Column:
        near = F.filter(state["recent"], lambda r: r["pos"] >= h["pos"] - n - MAX_SHIFT)
        both = F.transform(F.array(chained(near, h)), lambda mine: F.struct(
            F.concat(near, F.array(mine)).alias("recent"), placed(state["spans"], mine).alias("spans")
        ))
        return both[0]

    empty = F.struct(
        F.expr("CAST(array() AS array<struct<pos:int,tpos:int,begin:int,size:int>>)").alias("recent"),
        F.expr("CAST(array() AS array<struct<template:int,begin:int,words:int,cover:double>>)").alias("spans"),
    )
    return F.aggregate(F.array_sort("hits"), empty, step, lambda state: state["spans"])


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES,
    id_col: str = "doc_id", text_col: str = "text", k: int = K, min_cover: float = MIN_COVER,
) -> DataFrame:
    """(id, digest, n_words, spans): one row per document row.  ``spans`` holds
    struct(template, begin, words, cover) for every place found; templates are
    numbered through phrases, then notices."""
    grams = template_grams(docs.sparkSession, phrases, notices, k)
    keys = ["id", "digest", "template", "n_grams"]
    votes = matches(docs, grams, id_col, text_col, k).groupBy(*keys, "diagonal", "tpos").agg(F.count("*").alias("rows"))
    is_notice = F.col("template") >= len(phrases)
    # diagonals of one notice in one document; a run ends where the shift is too large
    order = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    shift = F.col("diagonal") - F.lag("diagonal").over(order)
    run = F.sum(F.when((shift == 0) | (is_notice & (shift <= MAX_SHIFT)), 0).otherwise(1)).over(order)
    hit = F.struct((F.col("diagonal") + F.col("tpos")).alias("pos"), "tpos")
    merged = votes.withColumn("run", run).groupBy(*keys, "run").agg(
        F.min("diagonal").alias("diagonal"), F.count("*").alias("votes"), F.max("rows").alias("rows"),
        F.count_distinct("tpos").alias("seen"), F.collect_list(F.when(is_notice, hit)).alias("hits"),
    )
    whole = F.array(F.struct(
        "template", F.col("diagonal").cast("int").alias("begin"), (F.col("n_grams") + k - 1).cast("int").alias("words"),
        F.lit(1.0).alias("cover"),
    ))
    none = F.slice(whole, 1, 0)
    spans = F.when(F.col("template") == END, none).when(
        is_notice, F.when(F.col("seen") >= min_cover * F.col("n_grams"), notice_spans(k, min_cover)).otherwise(none)
    ).otherwise(F.when(F.col("votes") == F.col("n_grams"), whole).otherwise(none))
    merged = merged.select("id", "digest", "template", "diagonal", "rows", spans.alias("spans"))
    per = merged.groupBy("id", "digest").agg(
        F.max(F.when(F.col("template") == END, F.col("diagonal"))).alias("n_words"),
        F.max(F.when(F.col("template") == END, F.col("rows"))).alias("copies"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    each = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.drop("copies", "copy")


def labelled(spans: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Labels, places and score of every scanned document."""
    names = F.array(*[F.lit(x) for x in [*phrases.values(), *notices.values()]])
    base = F.filter("spans", lambda s: s["template"] < len(phrases))

    def joined(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: F.get(names, s["template"])))), ",")

    return spans.select("*", base.alias("base")).select(
        F.col("id"), F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["begin"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["begin"])).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
