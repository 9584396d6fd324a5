"""License scans by diagonal voting, in DataFrame functions alone.

A text is a sequence of words; every run of three words is hashed, and a fixed bitmap of the templates' hashes lets the
few runs through that a template may hold. Those are joined to the template positions on the words themselves (so hash
collisions drop out), counted by offset diagonal (position in the text less position in the template), neighbouring
diagonals of one template are merged (they differ where words were put in or left out), and a merged span is a find
when its distinct template runs cover enough of the template. Base phrases must be covered whole on one diagonal, which
is an occurrence word for word.

The templates are a fixed list, whose size bounds what is broadcast. One scan and one shuffle of hits; a text without
hits sends one row.

Defined results: a null text is empty (no words, no labels, score 0); rows that repeat doc_id and text give a row each;
a null doc_id is a value like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


K = 3
BITS = 16


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# fixed values: the base phrases and their labels
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# fixed values: the opening or naming sentences of widely used licenses
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("gpl", "gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("boost-1", "distributed under the boost software license version 1 0"),
)

_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case; the Kelvin sign, whose lower case is a plain k, stays apart."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")))
    return F.array_remove(F.split(low, _GAP), "")


def template_runs(spark: SparkSession, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """(run, tid, tpos, runs): each template's runs of k words."""
    rows = []
    for tid, t in enumerate(templates):
        w = re.findall("[a-z0-9]+", t.text.lower())
        rows += [(" ".join(w[i : i + k]), tid, i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "run string, tid int, tpos int, runs int")


def bitmap(runs: DataFrame, bits: int = BITS) -> list[int]:
    """The hashes of the runs' words, cut to so many bits, as a bitmap of longs."""
    words = F.split("run", " ")
    found = runs.select(F.pmod(F.xxhash64(*[words[i] for i in range(K)]), F.lit(1 << bits)).alias("h")).distinct().collect()
    out = [0] * (1 << bits - 6)
    for r in found:
        out[r.h >> 6] |= 1 << (r.h & 63)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, coverage: float = 0.8, drift: int = 2) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    runs = template_runs(spark, templates)
    bits = F.lit(bitmap(runs))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), words_of(F.col("text")).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))

    def may_be(i: Column) -> Column:
        at = F.pmod(F.xxhash64(*[F.get("w", i + j) for j in range(K)]), F.lit(1 << BITS)).cast("int")
        word = F.element_at(bits, F.shiftright(at, 6) + 1)
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1

    starts = F.when(F.col("n_words") >= K, F.sequence(F.lit(0), F.size("w") - K)).otherwise(F.array().cast("array<int>"))
    spots = F.transform(F.filter(starts, may_be), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i + 1, K), " ").alias("run")))
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("run")))
    hits = rows.select("doc_id", "h", "n_words", F.explode(F.concat(head, spots)).alias("s")).select("doc_id", "h", "n_words", "s.pos", "s.run")
    hits = hits.join(F.broadcast(runs), "run", "left").where("pos < 0 or tid is not null")
    doc = ["doc_id", "h", "n_words"]
    # one shuffle: what follows groups by these columns and more
    hits = hits.repartition(*doc)
    diagonals = hits.groupBy(*doc, "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("votes"), F.first("runs").alias("runs"), F.count(F.when(F.col("pos") < 0, 1)).alias("copies"))
    order = Window.partitionBy(*doc, "tid").orderBy("diagonal")
    base = F.col("tid") < sum(t.base for t in templates)
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(base, 0).otherwise(drift), F.lit(True))
    spans = diagonals.withColumn("far", far).withColumn("span", F.sum(F.col("far").cast("int")).over(order))
    spans = spans.groupBy(*doc, "tid", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("votes"), F.first("runs").alias("runs"), F.sum("copies").alias("copies"), F.min("diagonal").alias("start"))
    # verification: the distinct runs of a span against the template's
    share = F.when(F.col("tid").isNotNull(), F.col("votes") / F.col("runs"))
    whole = base & (F.col("votes") == F.col("runs"))
    names = F.array(*[F.lit(t.label) for t in templates])
    name = F.get(names, F.col("tid"))
    out = spans.groupBy(*doc).agg(
        F.sum("copies").alias("copies"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, name))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole | (~base & (share >= coverage)), name))), ",").alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"))
    # repeated rows were counted as one
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
