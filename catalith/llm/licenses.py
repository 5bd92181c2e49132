"""Operator 10: license scans, with DataFrame functions only.

Texts and templates become words (lower-case, cut at ASCII punctuation and blanks) and five-word shingles. Templates of
one length form a class; for each class a text has overlapping windows, a quarter longer than the template and set so
close that every stretch of the template's length lies whole in one. A window's MinHash signature has `BANDS` bands of
one row each, and windows retrieve the templates that hold the same value in the same band. A window at Jaccard similarity s with a template meets it with
probability 1 - (1 - s) ** BANDS. A template that lies whole in a window has s of at least 0.5, one with the least accepted containment (0.8) at
least 0.4: they meet with probability 0.99998 and 0.9997. Whatever meets is verified by exact shingle containment in the window's
neighbourhood, which reaches half a template further on both sides, so words set between those of a notice don't hide it.

A band can only meet if the window holds the very shingle that is the template's minimum there. Only windows around such shingles (a
few hundred hashes, fixed by the templates) are formed; that loses nothing. Texts are cut into overlapping segments of
`SEGMENT` words first, so no row holds the windows of a whole long text. The signatures of the templates are a fixed-size
table, the only thing broadcast.

Defined cases. Null and empty texts, and texts of fewer than five words, match nothing and give no rows. Repeated rows
give repeated matches (each is scanned by itself). Of several places of one license in a text the first counts, with the greatest
containment of all. Columns besides doc_id and text are not read. Templates need at least five words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
SEGMENT = 4096

# fixed values: public license notices
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_CUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_CUT, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, _CUT), "")


def shingle_hashes(w: Column) -> Column:
    """The hash of each five-word shingle; none for shorter texts."""
    whole = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE))))
    return F.when(F.size(w) >= SHINGLE, whole).otherwise(F.array().cast("array<bigint>"))


def band(hashes: Column, k: int) -> Column:
    """The k-th minimum of a set of shingle hashes."""
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k))))


def window_shape(length: int) -> tuple[int, int]:
    """Words in a window for templates of `length` words, and the step between windows."""
    slack = max(1, length // 4)
    return length + slack, slack + 1


def signatures(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """name, length, shingles (hashes) and bands of every template: a fixed number of values."""
    rows = []
    for name, text in templates.items():
        w = words_of(text)
        if len(w) < SHINGLE:
            raise ValueError(f"the template {name} has fewer than {SHINGLE} words")
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(len(w)).alias("length"), F.array(*map(F.lit, w)).alias("w")))
    made = spark.range(1).select(F.explode(F.array(*[F.struct(r["name"], r["length"], shingle_hashes(r["w"]).alias("s")) for r in rows])).alias("t"))
    made = made.select("t.*").withColumn("bands", F.array(*[band(F.col("s"), k) for k in range(BANDS)]))

    def mark(k: int) -> Column:
        return F.array_min(F.filter("s", lambda h: F.xxhash64(h, F.lit(k)) == F.col("bands")[k]))

    marks = F.array(*map(mark, range(BANDS)))
    return [r.asDict() for r in made.withColumn("marks", F.array_distinct(marks)).collect()]


def segments(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, row, offset (shingles before the segment) and s, the shingle hashes of `SEGMENT` begins and `longest` more on both
    sides."""
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    rows = rows.where(F.size("w") >= SHINGLE)
    begins = F.sequence(F.lit(0), F.size("w") - 1, F.lit(SEGMENT))

    def cut(b: Column) -> Column:
        lo = F.greatest(F.lit(0), b - longest)
        return F.struct(lo.alias("offset"), b.alias("begin"), F.slice("w", lo + 1, b - lo + SEGMENT + longest + SHINGLE - 1).alias("w"))

    cuts = rows.select("doc_id", "row", F.explode(F.transform(begins, cut)).alias("cut"))
    return cuts.select("doc_id", "row", "cut.offset", "cut.begin", shingle_hashes(F.col("cut.w")).alias("s"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, first_word (the first word of the match, counted from one), containment and windows, for every license found in a text."""
    spark = docs.sparkSession
    known = signatures(spark, templates)
    marks = sorted({m for t in known for m in t["marks"]})
    shapes = sorted({t["length"] for t in known})
    rows = segments(docs, 2 * shapes[-1])

    def is_mark(h: Column) -> Column:
        return h.isin(marks)

    rows = rows.where(F.exists("s", is_mark))
    # the places of marks, by word of the text from zero
    at = F.filter(F.transform("s", lambda h, k: F.when(is_mark(h), k + F.col("offset"))), lambda k: k.isNotNull())
    rows = rows.withColumn("at", at)

    def laid(length: int) -> Column:
        """The windows of a class that hold a mark and begin in this segment: on a grid of the text, so of no other segment."""
        size, step = window_shape(length)
        reach = size - SHINGLE  # the last shingle of a window begins so many words after its first
        firsts = F.transform("at", lambda p: F.greatest(F.lit(0), F.ceil((p - reach) / F.lit(step)).cast("int")) * step)
        grid = F.flatten(F.zip_with("at", firsts, lambda p, b: F.when(b <= p, F.sequence(b, p, F.lit(step))).otherwise(F.array().cast("array<int>"))))
        inside = F.filter(F.array_distinct(grid), lambda b: (b >= F.col("begin")) & (b < F.col("begin") + SEGMENT))

        def window(b: Column) -> Column:
            lo = F.greatest(b - length // 2, F.col("offset"))
            wide = F.slice("s", lo - F.col("offset") + 1, b - lo + reach + 1 + length // 2)
            return F.struct(F.lit(length).alias("length"), b.alias("window"), F.slice("s", b - F.col("offset") + 1, F.lit(reach + 1)).alias("s"), lo.alias("lo"), wide.alias("wide"))

        return F.transform(inside, window)

    windows = rows.select("doc_id", "row", F.explode(F.concat(*map(laid, shapes))).alias("win")).select("doc_id", "row", "win.*")
    values = sorted({v for t in known for v in t["bands"]})
    bands = F.array(*[F.struct(F.lit(k).alias("k"), band(F.col("s"), k).alias("v")) for k in range(BANDS)])
    signed = windows.withColumn("band", F.explode(F.filter(bands, lambda x: x["v"].isin(values)))).select("*", "band.k", "band.v").drop("s", "band")
    table_ = F.array(*[F.struct(F.lit(t["name"]).alias("license"), F.lit(t["length"]).alias("length"), F.array(*map(F.lit, t["s"])).alias("t"), F.lit(k).alias("k"), F.lit(v).alias("v")) for t in known for k, v in enumerate(t["bands"])])
    catalogue = spark.range(1).select(F.explode(table_).alias("x")).select("x.*")
    met = signed.join(F.broadcast(catalogue), ["length", "k", "v"])
    shared = F.array_intersect("t", "wide")
    met = met.withColumn("containment", F.size(shared) / F.size(F.array_distinct("t"))).where(F.col("containment") >= least)
    first = F.array_min(F.transform(shared, lambda h: F.array_position("wide", h))).cast("int") + F.col("lo")
    best = met.withColumn("first", first).groupBy("row", "doc_id", "license")
    return best.agg(F.min("first").alias("first_word"), F.max("containment").alias("containment"), F.count_distinct("window").alias("windows")).drop("row")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
