r"""Licence scan: a positional index of rare licence words, with verified key phrases.

Words are runs of letters, digits and characters beyond ASCII, A-Z lowered; places count from 0. Two native passes go over the
whole texts:

1. Document frequencies of all words of the templates, over all documents, give each template's ``RARE`` words of highest IDF.
   Their postings (word, template, place in the template) are the index.
2. Each document keeps the places of index words and phrase words only. Looked up in the postings, a place gives (template,
   offset = place in the document - place in the template). An offset that gathers at least half of a template's rare words, with
   the template's key phrase standing at its place, verifies the template: its label counts, and its score is the share of the
   rare words' IDF found at that offset.

Base phrases are counted at all their places, also overlapping ones, whatever the templates say; their labels stay. ``score`` is the
best of the verified templates, rounded to six digits, or 0.

A null text counts as empty: no words, no labels. Repeated rows get equal results, rows without an id too. Other columns are
not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girthline.session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 4

#: The phrases that are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, notice, its key phrase).
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[dict[str, int], int]:
    """Documents with each word of the vocabulary, and all documents."""
    words = docs.select(F.array_intersect(_words(F.col(text)), F.array(*map(F.lit, vocabulary))).alias("w"))
    # The empty word stands for the document itself.
    counts = words.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counts}
    return found, found.pop("", 0)


def postings(frequencies: dict[str, int], n: int) -> list[tuple[str, int, int, float]]:
    """(word, template, place, IDF) of each template's rarest words; a word's first place counts."""
    out = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        idf = {w: math.log((n + 1) / (frequencies.get(w, 0) + 1)) for w in words}
        rare = sorted(idf, key=lambda w: (-round(idf[w], 9), w))[:RARE]
        out += [(w, t, words.index(w), idf[w]) for w in rare]
    return out


def _phrase_places(hits: Column, phrases: list[str]) -> Column:
    """(phrase number, first place) of each phrase whose words follow each other among the kept (word, place) pairs."""
    longest = max(len(p.split()) for p in phrases)
    shifted = [hits if k == 0 else F.slice(hits, F.lit(k + 1), F.greatest(F.size(hits), F.lit(1))) for k in range(longest)]
    zipped = F.arrays_zip(*(x.alias(f"h{k}") for k, x in enumerate(shifted)))

    def found(e: Column) -> Column:
        def whole(words: list[str]) -> Column:
            test = e["h0"]["x"] == words[0]
            for k, w in enumerate(words[1:], 1):
                test = test & (e[f"h{k}"]["x"] == w) & (e[f"h{k}"]["i"] == e["h0"]["i"] + k)
            return test

        return F.array_compact(F.array(*(F.when(whole(p.split()), F.struct(F.lit(n).alias("p"), e["h0"]["i"].alias("i"))) for n, p in enumerate(phrases))))

    return F.flatten(F.transform(zipped, found))


def scanned(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    index = postings(*document_frequencies(docs, vocabulary, text))
    phrases = list(dict.fromkeys([*BASE, *(key for _, _, key in TEMPLATES)]))
    kept = sorted({w for w, *_ in index} | {w for p in phrases for w in p.split()})

    t = docs.select(F.col(row_id).alias("row_id"), F.xxhash64(text).alias("text_key"), _words(F.col(text)).alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(kept))
    t = t.select("row_id", "text_key", F.size("w").cast("long").alias("n_words"), hits.alias("hits"))
    t = t.withColumn("places", F.when(F.size("hits") > 1, _phrase_places(F.col("hits"), phrases)).otherwise(F.array().cast("array<struct<p:int,i:int>>")))
    base = F.filter("places", lambda p: p["p"] < len(BASE))
    starts = F.transform(base, lambda p: p["i"])
    names = F.array(*map(F.lit, BASE.values()))
    t = t.withColumn("n_base", F.size(base).cast("long")).withColumn("first_word", F.array_min(starts).cast("long"))
    t = t.withColumn("last_word", F.array_max(starts).cast("long"))
    t = t.withColumn("base_list", F.array_distinct(F.transform(base, lambda p: F.get(names, p["p"]))))
    t = cut(t)

    # Rare words and key phrases give the same evidence: (template, offset).
    spark = docs.sparkSession
    rare = spark.createDataFrame(index, "x string, template int, place int, idf double")
    keys = [(phrases.index(key), n, _place(notice, key)) for n, (_, notice, key) in enumerate(TEMPLATES)]
    key = spark.createDataFrame(keys, "p int, template int, place int")
    rows = t.select("row_id", "text_key", "hits", "places").where("size(places) > 0").distinct()
    words = rows.select("row_id", "text_key", F.explode("hits").alias("h")).select("row_id", "text_key", F.col("h.x").alias("x"), F.col("h.i").alias("i")).join(rare, "x")
    seen = rows.select("row_id", "text_key", F.explode("places").alias("h")).select("row_id", "text_key", F.col("h.p").alias("p"), F.col("h.i").alias("i")).join(key, "p")
    evidence = words.select("row_id", "text_key", "template", (F.col("i") - F.col("place")).alias("offset"), "idf", F.lit(0).alias("key")).unionByName(
        seen.select("row_id", "text_key", "template", (F.col("i") - F.col("place")).alias("offset"), F.lit(0.0).alias("idf"), F.lit(1).alias("key")))
    at = evidence.groupBy("row_id", "text_key", "template", "offset").agg(F.sum("idf").alias("idf"), F.sum(1 - F.col("key")).alias("n"), F.max("key").alias("key"))
    totals = [(n, label, sum(i for _, t_, _, i in index if t_ == n), sum(t_ == n for _, t_, _, _ in index)) for n, (label, _, _) in enumerate(TEMPLATES)]
    verified = at.where("key = 1").join(spark.createDataFrame(totals, "template int, label string, whole double, rare int"), "template").where("2 * n >= rare")
    share = F.when(F.col("whole") > 0, F.least(F.lit(1.0), F.col("idf") / F.col("whole"))).otherwise(1.0)
    best = verified.groupBy("row_id", "text_key").agg(F.collect_set("label").alias("more"), F.round(F.max(share), 6).alias("score"))
    best = best.withColumnsRenamed({"row_id": "b_id", "text_key": "b_key"})
    out = t.drop("hits", "places").join(best, F.col("row_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("row_id").alias(row_id), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base_list"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base_list", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _place(notice: str, key: str) -> int:
    words, wanted = notice.split(), key.split()
    return next(i for i in range(len(words)) if words[i:i + len(wanted)] == wanted)
