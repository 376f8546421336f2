"""License scans by MinHash bands over overlapping windows (DataFrame functions only).

Templates are short license notices, cut into shingles of five words (a shorter notice is one
shingle).  For each template length a text has windows of as many shingles, each a quarter of a
window further; a window's MinHash is ``BANDS`` minima, one row per band.  A window that shares 0.8 of a
template's shingles and lies up to half a step off has a Jaccard similarity of at least 0.5 with
it, so it meets the template in some band with probability at least 1 - 0.5^BANDS (0.9998).  What
is retrieved is verified: the share of the template's shingles, as words and not hashes, within
the window and a step around it must be 0.8 or more.

A window can only meet a template in a band if it holds the very shingle that is the template's
minimum there.  So windows are only made around these few shingles, and texts without any are
passed over, most of them because they lack even the words (:func:`anchors`); this changes the order of
work and no result.

Template tables have one row per template and band, a size fixed by the list, and are broadcast.

Defined results: null and empty texts match nothing; a null id stays null; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 12

# Notices in public use.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at",
    "bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}


def words(lowered: Column) -> Column:
    found = F.regexp_extract_all(lowered, F.lit(r"([\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*)"))
    return F.coalesce(found, F.array().cast("array<string>"))


def _runs(tokens: Column, k: Column, make) -> Column:
    """``make`` of every run of ``k`` words, in order; nothing for fewer words."""
    last = F.size(tokens) - k + 1
    starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
    return F.transform(starts, lambda i: make(F.slice(tokens, i, k)))


def hashes(tokens: Column, k: Column) -> Column:
    return _runs(tokens, k, F.xxhash64)


def shingles(tokens: Column, k: Column) -> Column:
    return _runs(tokens, k, lambda run: F.array_join(run, " "))


def _minima(hashed: Column, bands: int) -> Column:
    return F.array(*[F.array_min(_rehash(hashed, j)) for j in range(bands)])


def _rehash(hashed: Column, j: int) -> Column:
    return F.transform(hashed, lambda x: F.xxhash64(x, F.lit(j)))


def template_table(spark, templates: dict[str, str], bands: int) -> DataFrame:
    """template, k, s (shingles), its distinct shingles, minima and the shingles that are them."""
    t = spark.createDataFrame(sorted(templates.items()), "template string, text string").withColumn("w", words(F.lower("text")))
    k = F.least(F.size("w"), F.lit(SHINGLE))
    parts = t.where(F.size("w") > 0).select("template", k.alias("k"), F.array_distinct(shingles(F.col("w"), k)).alias("shingles"),
                                            shingles(F.col("w"), k).alias("runs"), hashes(F.col("w"), k).alias("h"))
    minimal = F.array(*[F.min_by("x", F.xxhash64("x", F.lit(j))) for j in range(bands)])
    least = parts.select("template", F.explode("h").alias("x")).groupBy("template").agg(minimal.alias("selected"))
    return parts.join(least, "template").select("template", "k", F.size("h").alias("s"), "shingles", "runs", "h", "selected",
                                                _minima(F.col("h"), bands).alias("minima"))


def anchors(shingles: set[str]) -> list[str]:
    """A few words of which every one of ``shingles`` holds at least one, rare (long) ones first."""
    left, out = set(shingles), []
    while left:
        words = {w for s in left for w in s.split(" ")}
        best = max(words, key=lambda w: (sum(w in s for s in left) * min(len(w), 9) ** 2, w))
        out.append(best)
        left = {s for s in left if best not in s}
    return out


def _window(at: Column, bands: int) -> Column:
    """The window of ``s`` shingles from ``at``: its minima, and its words with a step on either side."""
    first = F.greatest(at - F.col("step"), F.lit(1))
    around = F.slice("w", first, F.col("s") + 2 * F.col("step") + F.col("k") - 1)
    return F.struct(around.alias("around"), _minima(F.slice("h", at, F.col("s")), bands).alias("minima"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None,
         bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: key, n_licenses, licenses (names, sorted), best (highest containment)."""
    spark = docs.sparkSession
    table = materialize(template_table(spark, templates or TEMPLATES, bands), "license-templates")
    listed = table.select("template", "k", "s", "runs", "h", "selected").collect()  # one row per template
    selected, shaped = defaultdict(set), defaultdict(set)
    for r in listed:
        selected[r["k"]].update(r["selected"])
        shaped[r["k"], r["s"]].update(r["selected"])
    shapes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.array(*[F.lit(x) for x in sorted(some)]).alias("some"))
                       for (k, s), some in sorted(shaped.items())])

    chosen = {run for r in listed for run, h in zip(r["runs"], r["h"]) if h in r["selected"]}
    worded = F.lit(False)
    for word in anchors(chosen):
        worded = worded | F.contains("low", F.lit(word))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.lower(text).alias("low"))
    rows = rows.select("row", "id", F.when(worded, words(F.col("low"))).otherwise(F.array().cast("array<string>")).alias("w"))
    holds = F.lit(False)
    for k, some in sorted(selected.items()):
        holds = holds | F.arrays_overlap(hashes(F.col("w"), F.lit(k)), F.array(*[F.lit(x) for x in sorted(some)]))
    rows = materialize(rows.withColumn("w", F.when(holds, F.col("w"))), "license-candidates")

    # Few texts are left, in few files: spread them.  Each array is made once per row, by a generator, since
    # Catalyst would copy its expression into the loops that read it.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spaced = rows.where("w is not null").repartition(n).select("row", "w", F.explode(shapes).alias("_shape")).select("row", "w", "_shape.*")
    spaced = spaced.select("*", F.greatest(F.expr("s div 4"), F.lit(1)).cast("int").alias("step"),
                           F.explode(F.array(hashes(F.col("w"), F.col("k")))).alias("h"))
    spaced = spaced.select("row", "w", "k", "s", "step", "h", F.explode(F.array(F.array_intersect("h", "some"))).alias("some"))
    spaced = spaced.where(F.size("some") > 0)
    # Numbers of the windows (window m starts at 1 + m * step) that hold one of these shingles.
    at_some = F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: F.array_contains(F.col("some"), F.element_at("h", i)))
    most = F.greatest(F.ceil((F.size("h") - F.col("s")) / F.col("step")), F.lit(0)).cast("int")
    numbers = F.transform(at_some, lambda i: F.sequence(
        F.least(F.greatest(F.ceil((i - F.col("s")) / F.col("step")).cast("int"), F.lit(0)), most),
        F.least(F.floor((i - 1) / F.col("step")).cast("int"), most)))
    spaced = spaced.select("*", F.explode(F.array(F.array_distinct(F.flatten(numbers)))).alias("numbers"))
    made = F.transform("numbers", lambda m: _window(m * F.col("step") + 1, bands))
    windows = spaced.select("row", "k", "s", F.explode(made).alias("_window")).select(
        "row", "k", "s", "_window.around", F.posexplode("_window.minima").alias("band", "least"))
    bound = table.select("template", F.col("k").alias("_k"), F.col("s").alias("_s"), "shingles",
                         F.posexplode("minima").alias("_band", "_least"))
    # One row per template and band: bounded by the template list.
    met = windows.join(F.broadcast(bound), (F.col("k") == F.col("_k")) & (F.col("s") == F.col("_s")) &
                       (F.col("band") == F.col("_band")) & (F.col("least") == F.col("_least")))
    share = F.size(F.array_intersect("shingles", shingles(F.col("around"), F.col("k")))) / F.size("shingles")
    found = met.select("row", "template", share.alias("share")).where(F.col("share") >= containment)
    found = found.groupBy("row", "template").agg(F.max("share").alias("share"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_set("template")).alias("names"), F.max("share").alias("best"))
    found = found.withColumnRenamed("row", "_row")
    return rows.select("row", "id").join(found, F.col("row") == F.col("_row"), "left").select(
        F.col("id").alias(key), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))
