"""License scans by diagonal voting.

All rolling hashes of GRAM words of every text are joined with the places where the templates have them. Equal offsets
(place in the text minus place in the template) are one diagonal; each diagonal gets the votes of its hits, diagonals at
most DRIFT apart are merged, which bridges inserted and dropped words. Within what was merged, the stretch of SPREAD times
the template's length with most of its grams is the span; repeats around it do no harm. It is kept when its hits hold the
template's decisive word, if it has one, and are all but so many of its grams as EDITS allows: an edited word spoils GRAM
of them at most. Of the five words of the shortest template the outer ones may be edited.

The templates are a fixed list, so their grams can be broadcast at any size of the corpus. Only hits are shuffled.

Beside that, the places of a few base phrases are counted; they always give their label.

Defined cases: null and empty texts have no words, no labels and score 0; rows with equal id and text get equal results;
null ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

GRAM = 3
DRIFT = 3
#: Words of a template for each edit that it may have.
EDITS = 24
SPREAD = 2.0

# The base phrases, and openings or key clauses of public licenses.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-text": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-text": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
}
#: Words that tell a template from one that differs in them alone.
DECISIVE = {"mit-notice": "mit", "apache-notice": "apache", "gpl-notice": "gnu", "lgpl-text": "lesser", "cc-by-nc-notice": "nc", "cc-by-text": "attribution", "mpl-text": "mozilla"}


def _hashes(phrase: str) -> np.ndarray:
    return C.word_hashes(pa.array([phrase]), C.NOT_ALNUM)[0]


def _grams(h: np.ndarray) -> np.ndarray:
    n = len(h) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return C.mix(sum(h[j : n + j] * C._STEP[j] for j in range(GRAM)))


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(_hashes(p), label) for p, label in BASE.items()]
    for b in batches:
        for lo, hi in C.row_chunks(b.column(2)):
            h, _, cut = C.word_hashes(b.column(2).slice(lo, hi - lo), C.NOT_ALNUM)
            doc = np.repeat(np.arange(hi - lo), np.diff(cut))
            n_base, first, last, labels = np.zeros(hi - lo, np.int64), [None] * (hi - lo), [None] * (hi - lo), [set() for _ in range(hi - lo)]
            for phrase, label in phrases:
                hit = np.flatnonzero(h == phrase[0])
                hit = hit[hit + len(phrase) <= len(h)]
                for j in range(1, len(phrase)):
                    hit = hit[(h[hit + j] == phrase[j]) & (doc[hit + j] == doc[hit])]
                for at in hit.tolist():
                    d = int(doc[at])
                    at -= int(cut[d])
                    n_base[d] += 1
                    first[d] = at if first[d] is None else min(first[d], at)
                    last[d] = at if last[d] is None else max(last[d], at)
                    labels[d].add(label)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(cut)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))],
                ["key", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"],
            )


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in C.row_chunks(b.column(1)):
            h, _, cut = C.word_hashes(b.column(1).slice(lo, hi - lo), C.NOT_ALNUM)
            g = _grams(h).view(np.int64)
            end = np.maximum(np.minimum(cut[1:] - GRAM + 1, len(g)), cut[:-1])
            # grams that reach into the next text are left out
            take = np.concatenate([np.arange(s, e) for s, e in zip(cut[:-1], end, strict=True)]) if len(g) else np.zeros(0, np.int64)
            off = np.concatenate([[0], np.cumsum(end - cut[:-1] if len(g) else np.zeros(hi - lo, np.int64))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off), pa.array(g[take]))], ["key", "grams"])


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, template, start, end, cover): the best verified span, in words of the text, of each group of diagonals; key identifies id and text of a row."""
    spark = docs.sparkSession
    C.batch_rows(spark)
    places = []
    for name, text in TEMPLATES.items():
        own, words = _grams(_hashes(text)).view(np.int64), text.split()
        key = words.index(DECISIVE[name]) if name in DECISIVE else None
        may_lack = 1 if len(own) <= GRAM else GRAM * -(-len(words) // EDITS)
        places += [(int(g), name, at, len(own), len(own) - may_lack, key is None or at <= key < at + GRAM) for at, g in enumerate(own)]
    table = spark.createDataFrame(places, "gram long, template string, t_at int, t_grams int, t_least int, decisive boolean")
    rows = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grams = rows.mapInArrow(_rolling, "key long, grams array<long>").select("key", F.posexplode("grams").alias("at", "gram"))
    hits = grams.join(F.broadcast(table), "gram").select("key", "template", "at", "t_at", "t_grams", "t_least", "decisive", (F.col("at") - F.col("t_at")).alias("diagonal")).distinct()
    votes = hits.groupBy("key", "template", "diagonal").agg(F.count("*").alias("votes"), F.first("t_grams").alias("t_grams"), F.first("t_least").alias("t_least"), F.collect_set(F.struct("t_at", "decisive")).alias("covered"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int")
    groups = votes.withColumn("fresh", F.coalesce(new, F.lit(1))).withColumn("group", F.sum("fresh").over(order))
    # each place of a group looks as far ahead as a span of the longest template may reach
    places = groups.select("key", "template", "group", "diagonal", "t_grams", "t_least", F.explode("covered").alias("c")).select("key", "template", "group", "t_grams", "t_least", (F.col("diagonal") + F.col("c.t_at")).alias("at"), "c")
    ahead = Window.partitionBy("key", "template", "group").orderBy("at").rangeBetween(0, int(SPREAD * max(len(t.split()) for t in TEMPLATES.values())))
    limit = F.col("at") + SPREAD * (F.col("t_grams") + GRAM - 1) - GRAM
    within = places.withColumn("ahead", F.collect_list(F.struct("at", "c.t_at", "c.decisive")).over(ahead)).withColumn("own", F.filter("ahead", lambda x: x["at"] <= limit))
    n = F.size(F.array_distinct(F.transform("own", lambda x: x["t_at"])))
    spans = within.where(F.exists("own", lambda x: x["decisive"])).select("key", "template", "group", "t_grams", "t_least", "at", n.alias("n"), (F.array_max(F.transform("own", lambda x: x["at"])) + GRAM).alias("end")).where(F.col("n") >= F.col("t_least"))
    best = spans.groupBy("key", "template", "group").agg(F.max_by(F.struct("at", "end", "n", "t_grams"), F.struct("n", -F.col("at"))).alias("b"))
    return best.select("key", "template", F.col("b.at").alias("start"), "b.end", (F.col("b.n") / F.col("b.t_grams")).alias("cover"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs."""
    C.batch_rows(docs.sparkSession)
    rows = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = rows.mapInArrow(_measures, "key long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    found = license_spans(docs, id_col, text_col).groupBy("key").agg(F.collect_set("template").alias("found"), F.max("cover").alias("cover"))
    out = base.join(found, "key", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
