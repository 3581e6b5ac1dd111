"""License scans: phrases and notices found by voting on diagonals.

Templates are phrases (whose places are exact) and notices (which may be reworded a little).
Every rolling word k-gram of every text is joined by hash with the templates' k-grams (k is
``PHRASE_GRAM`` words for phrases, ``NOTICE_GRAM`` for notices); a match votes for its
diagonal, the place in the text less the place in the template.  Votes are counted per
(document, template, diagonal); a notice's diagonals that lie within ``NEAR`` words of the
next one are merged, so that inserted or lost words do not split it.  Spans with as many
votes as a match can do with are then verified on the words of the texts themselves:

* a phrase must stand there word by word;
* a notice must have at least ``SHARE`` of its words covered by its k-grams in the span; of
  notices whose spans overlap, those with most covered words remain, and of these the
  shortest (the LGPL's notice holds nearly all words of the GPL's).

The templates are a fixed list of some hundred k-grams, so they are broadcast; texts are
joined again only where a span needs verifying.  A text's k-grams are exploded from arrays of
at most ``CHUNK`` words; votes are combined before the shuffle, and the largest group is one
text and one template.

Rules: a word is a run of ASCII digits, letters (A-Z lower-cased) and other non-ASCII
characters; null texts are empty; rows of one id are scanned each on its own; no label is an
empty string; ``score`` is the largest covered share of a template among the verified
candidates, 0 without any.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.llm.common import ID_FILTER, let, shared_table

PHRASE_GRAM, NOTICE_GRAM = 2, 4
NEAR = 4
SHARE = 0.8
CHUNK = 4096

# The phrases and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Notices that public licenses ask to be placed in a work, and short forms.
NOTICES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """t, label, phrase (boolean), words; a template has at least one k-gram."""
    if any(len(x.split()) < k for list_, k in ((phrases, PHRASE_GRAM), (notices, NOTICE_GRAM)) for _, x in list_):
        raise ValueError("a template is shorter than its k-grams")
    rows = [(i, label, text.split(), phrase) for i, (label, text, phrase) in enumerate(
        [(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in notices])]
    return spark.createDataFrame(rows, "t int, label string, words array<string>, phrase boolean")


def _gram_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def _grams(temps: DataFrame, k: int, name: str) -> DataFrame:
    """Hash -> the template places of that k-gram."""
    at = temps.select("t", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("tpos"))
    return at.groupBy(_gram_hash(F.col("words"), F.col("tpos"), k).alias(name)).agg(
        F.collect_list(F.struct("t", "tpos")).alias(f"of_{name}"))


def _votes(docs: DataFrame, temps: DataFrame) -> DataFrame:
    """id, id2, t, diagonal, votes and the first and last place voted from."""
    overlap = max(PHRASE_GRAM, NOTICE_GRAM) - 1
    words = docs.select("id", "id2", scan_words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = words.select("id", "id2", F.explode(F.transform(starts, lambda s: F.struct(
        s.alias("base"), F.slice("words", s + 1, CHUNK + overlap).alias("w")))).alias("c"))
    places = chunks.select("id", "id2", "c.base", "c.w").where("size(w) >= 2")
    each = F.transform(F.sequence(F.lit(0), F.least(F.size("w"), F.lit(CHUNK)) - 1), lambda i: F.struct(
        (F.col("base") + i).alias("pos"), _gram_hash(F.col("w"), i, PHRASE_GRAM).alias("h_phrase"), _gram_hash(F.col("w"), i, NOTICE_GRAM).alias("h_notice")))
    grams = places.select("id", "id2", F.explode(each).alias("g")).select("id", "id2", "g.*")
    hits = grams.join(F.broadcast(_grams(temps.where("phrase"), PHRASE_GRAM, "h_phrase")), "h_phrase", "left")
    hits = hits.join(F.broadcast(_grams(temps.where("NOT phrase"), NOTICE_GRAM, "h_notice")), "h_notice", "left")
    hits = hits.where("of_h_phrase IS NOT NULL OR of_h_notice IS NOT NULL")
    none = F.array().cast("array<struct<t:int,tpos:int>>")
    hits = hits.select("id", "id2", "pos", F.explode(F.concat(F.coalesce("of_h_phrase", none), F.coalesce("of_h_notice", none))).alias("m"))
    return hits.groupBy("id", "id2", F.col("m.t").alias("t"), (F.col("pos") - F.col("m.tpos")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _candidates(votes: DataFrame, temps: DataFrame) -> DataFrame:
    """Spans with as many votes as a match needs: id, id2, t, start, end (words)."""
    size = temps.select("t", "phrase", F.size("words").alias("size"))
    x = votes.join(F.broadcast(size), "t")
    w = Window.partitionBy("id", "id2", "t").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.when(F.col("phrase"), 0).otherwise(NEAR), F.lit(True))
    x = x.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(w))
    x = x.groupBy("id", "id2", "t", "group").agg(F.sum("votes").alias("votes"), F.max("last").alias("last"),
                                                 F.min(F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.col("first"))).alias("start"),
                                                 F.first("phrase").alias("phrase"), F.first("size").alias("size"))
    # m covered words of a notice take at least m / k of its k-grams
    need = F.when(F.col("phrase"), F.col("size") - PHRASE_GRAM + 1).otherwise(F.ceil(F.ceil(F.col("size") * SHARE) / NOTICE_GRAM))
    return x.where((F.col("votes") >= need) & (F.col("start") >= 0)).select("id", "id2", "t", "start", (F.col("last") + F.when(F.col("phrase"), PHRASE_GRAM).otherwise(NOTICE_GRAM)).alias("end"))


def _covered(words: Column, span: Column, temp_words: Column) -> Column:
    """How many of a notice's words its k-grams found in the span cover."""
    inside = F.slice(words, span["start"] + 1, span["end"] - span["start"])

    def grams(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - NOTICE_GRAM), lambda i: F.array_join(F.slice(ws, i + 1, NOTICE_GRAM), " "))

    found = let(grams(inside), lambda there: F.transform(grams(temp_words), lambda g: F.array_contains(there, g)))
    return let(found, lambda hit: F.size(F.filter(F.sequence(F.lit(0), F.size(temp_words) - 1), lambda i: F.exists(
        F.slice(hit, F.greatest(i - NOTICE_GRAM + 2, F.lit(1)), F.least(i + 1, F.lit(NOTICE_GRAM))), lambda f: f))))


def license_spans(docs: DataFrame, temps: DataFrame | None = None) -> DataFrame:
    """Verified spans of ``docs`` (id, id2, text): id, id2, label, phrase, start, end, share
    (of the template's words) and found (false: below ``SHARE``, or outdone by another notice)."""
    spark = docs.sparkSession
    temps = templates(spark) if temps is None else temps
    cand = shared_table(_candidates(shared_table(_votes(docs, temps), "license-votes"), temps), "license-spans")
    ids = cand.select("id", "id2").distinct()
    texts = docs.where("text IS NOT NULL").join(ids.hint("shuffle_hash"), ["id", "id2"]).select(
        "id", "id2", scan_words(F.col("text")).alias("words")).dropDuplicates(["id", "id2"])
    spans = cand.join(F.broadcast(temps.withColumnRenamed("words", "temp")), "t")
    spans = spans.groupBy("id", "id2").agg(F.collect_list(F.struct("t", "label", "phrase", "temp", "start", "end")).alias("spans"))

    def check(words):
        return F.transform(F.col("spans"), lambda s: F.struct(
            s["label"].alias("label"), s["phrase"].alias("phrase"), s["start"].alias("start"), s["end"].alias("end"), F.size(s["temp"]).alias("size"),
            F.when(s["phrase"], F.when(F.slice(words, s["start"] + 1, F.size(s["temp"])) == s["temp"], F.size(s["temp"])).otherwise(0))
            .otherwise(_covered(words, s, s["temp"])).alias("covered")))

    seen = spans.join(texts, ["id", "id2"]).select("id", "id2", F.explode(check(F.col("words"))).alias("s")).select("id", "id2", "s.*")
    seen = seen.where("NOT phrase OR covered > 0")
    seen = seen.withColumns({"share": F.col("covered") / F.col("size"), "found": F.col("phrase") | (F.col("covered") >= F.ceil(F.col("size") * SHARE))})
    # regions of overlapping notices keep those with most covered words, and of these the shortest
    by = Window.partitionBy("id", "id2", "phrase")
    reach = F.max("end").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    seen = seen.withColumn("region", F.sum("new").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(F.col("covered"), -F.col("size"))
    most = F.max(rank).over(Window.partitionBy("id", "id2", "phrase", "region"))
    seen = seen.withColumn("most", most).withColumn("found", F.col("found") & (F.col("phrase") | (rank == F.col("most"))))
    return shared_table(seen.select("id", "id2", "label", "phrase", "start", "end", "share", "found"), "license-found", **ID_FILTER)


def _labels(name: str) -> Column:
    return F.array_join(F.sort_array(F.coalesce(F.col(name), F.array().cast("array<string>"))), ",")


def license_scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its number of words, phrase places (count, first, last),
    phrase labels, all labels, and score."""
    x = docs.select(F.col(key).alias("doc_id"), "text", F.xxhash64(F.col(key), F.col("text")).alias("id"),
                    F.xxhash64(F.col("text"), F.lit(7), F.col(key)).alias("id2"))
    spans = license_spans(x.select("id", "id2", "text"))
    place = F.col("phrase") & F.col("found")
    per = spans.groupBy("id", "id2").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"),
        F.max(F.when(place, F.col("start"))).alias("last_word"), F.collect_set(F.when(place, F.col("label"))).alias("base"),
        F.collect_set(F.when(F.col("found"), F.col("label"))).alias("every"), F.max("share").alias("score"))
    n_words = F.regexp_count(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    rows = x.select("doc_id", "id", "id2", n_words.cast("long").alias("n_words"))
    return rows.join(per, ["id", "id2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), _labels("base").alias("base_labels"), _labels("every").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
