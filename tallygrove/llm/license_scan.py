"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies.

Only DataFrame functions run. Texts become words ([a-z0-9]+ of the lower-cased text) and shingles
of five words, hashed. A template of n shingles belongs to the size class of the least power of
two that is n or more. For a class c, windows of 2c shingles begin at every c-th shingle, so any
run of c shingles lies whole in one of them.

A window's MinHash has `BANDS` bands of one row. A window with 0.8 of a template's shingles has
a Jaccard similarity of 0.8 n / (2c + 0.2 n) or more, with n over c / 2 that is 0.19, so it misses
all bands with a probability below (1 - 0.19) ** 64, about 1e-6; for most n it is far smaller.
Windows without any template shingle of their class contain nothing and have no signature made.
Retrieved pairs are verified by the exact share of the template's distinct shingles in the window.

Templates are a small table of notices, checked against `TEMPLATE_WORDS` before they are sent.

Null, empty and short texts (under five words) hold nothing. Every window of a long text counts.
Repeated rows give repeated results; two templates in one window are both found; equal shares
give the first place. An empty table of documents or templates gives an empty result. Templates
under five words can't be told from chance and raise a ValueError, as do too many template words.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.common import only

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
BANDS = 64
TEMPLATE_WORDS = 200_000

# Opening lines of common license notices, as their licenses give them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
        " compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted"
    ),
    "MIT": "Released under the MIT License",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def notices(spark: SparkSession) -> DataFrame:
    """The notices above as a table (license_id, text)."""
    return spark.createDataFrame(sorted(NOTICES.items()), "license_id string, text string")


def words(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles(word_list):
    """The hash of the shingle that begins at each word but the last four."""
    def hashed(word, at):
        return F.xxhash64(word, *[F.get(word_list, at + k) for k in range(1, SHINGLE_WORDS)])

    whole = F.slice(word_list, 1, F.greatest(F.lit(0), F.size(word_list) - (SHINGLE_WORDS - 1)))
    return F.transform(whole, hashed)


def band_values(hashes):
    """For each band the least hash of the shingles under the band's own order."""

    def least(band):
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[least(band) for band in range(BANDS)])


def prepared(templates: DataFrame) -> DataFrame:
    """(license_id, size, shingles): distinct shingles of each template, and its size class."""
    rows = only(templates, license_id="string", text="string").dropna()
    rows = rows.withColumn("words", words("text"))
    total, least = rows.agg(F.sum(F.size("words")), F.min(F.size("words"))).first()
    if total is not None and (total > TEMPLATE_WORDS or least < SHINGLE_WORDS):
        raise ValueError(f"templates need {SHINGLE_WORDS} words each and {TEMPLATE_WORDS} in all at most")
    rows = rows.withColumn("shingles", F.array_distinct(shingles(F.col("words"))))
    size = F.pow(2, F.ceil(F.log2(F.size("shingles")))).cast("int").alias("size")
    return rows.select("license_id", size, "shingles")


def scan(documents: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license_id, containment, first_word, windows) of each template found in a row.

    `containment` is the best share over the row's windows, `first_word` where the first such
    window begins, `windows` how many hold the template. Texts are not shuffled: windows stay
    with their row until their matches, a few numbers each, are gathered by row.
    """
    spark = documents.sparkSession
    known = prepared(templates)
    classes = known.groupBy("size").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("any")).collect()
    found = "doc_id bigint, license_id string, containment double, first_word bigint, windows bigint"
    if not classes:
        return spark.createDataFrame([], found)
    any_shingle = F.array(*[F.lit(h) for h in sorted({h for c in classes for h in c["any"]})])

    texts = only(documents, **{doc_id: "bigint", text: "string"}).toDF("doc_id", "text")
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", words("text").alias("words"))
    rows = rows.select("row", "doc_id", shingles(F.col("words")).alias("hashes"))
    rows = rows.where(F.arrays_overlap("hashes", any_shingle))

    def windows(size, of_class):
        """Structs of the windows of a class with a template shingle."""
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("hashes") - 1), F.lit(size))
        cut = F.transform(
            starts,
            lambda at: F.struct(
                F.lit(size).alias("size"), at.alias("at"), F.slice("hashes", at + 1, 2 * size).alias("hashes")
            ),
        )
        wanted = F.array(*[F.lit(h) for h in sorted(of_class)])
        return F.filter(cut, lambda w: F.arrays_overlap(w["hashes"], wanted))

    every = F.concat(*[windows(c["size"], c["any"]) for c in classes])
    cut = rows.select("row", "doc_id", F.explode(every).alias("w")).select("row", "doc_id", "w.*")
    table = known.select("size", "license_id", "shingles", band_values("shingles").alias("values"))
    in_templates = F.array(*[F.lit(v) for v in sorted({v for r in table.select("values").collect() for v in r[0]})])
    # Of a window's bands only those that some template has go on; the hash of a band names the band.
    keyed = cut.withColumn("value", F.explode(F.array_intersect(band_values("hashes"), in_templates)))
    by_band = table.select("size", "license_id", "shingles", F.explode("values").alias("value"))
    by_band = by_band.groupBy("size", "value").agg(F.collect_set(F.struct("license_id", "shingles")).alias("templates"))
    hits = keyed.join(F.broadcast(by_band), ["size", "value"])
    pairs = hits.select("row", "doc_id", "at", "hashes", F.explode("templates").alias("t"))
    share = F.size(F.array_intersect("t.shingles", "hashes")) / F.size("t.shingles")
    verified = pairs.select("row", "doc_id", "at", F.col("t.license_id").alias("license_id"), share.alias("share"))
    verified = verified.where(F.col("share") >= CONTAINMENT)
    best = F.min(F.struct((-F.col("share")).alias("least"), "at"))
    return (
        verified.groupBy("row", "doc_id", "license_id")
        .agg(best.alias("best"), F.count_distinct("at").alias("windows"))
        .select(
            "doc_id",
            "license_id",
            (-F.col("best.least")).alias("containment"),
            F.col("best.at").cast("bigint").alias("first_word"),
            "windows",
        )
    )
