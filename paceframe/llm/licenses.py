"""Licenses found in texts by MinHash over windows of words, verified by shingle containment.

Texts and templates are folded to words of letters and digits. A window is six words, two
shingles of five; windows start at every second word of a text, so that each shingle lies in one,
and at every word of a template. Each window has BANDS min-hashes, a band
each. A window of a text
that holds a template of one shingle agrees with it in half of all shingles at least, windows that
hold two of a template's in all, so a template is missed with a probability of at most
2 ** -BANDS in each of its windows. Retrieved templates are matches if the text has at least
``containment`` of their shingles.

A template of fewer than five words is one shingle of its own length, whose hash is its only band:
every run of so many words of a text is looked up, so none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.session import materialise

SHINGLE_WORDS = 5
WINDOW_SHINGLES = 2
BANDS = 14

# Customary notices, as their licenses word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

# Notices of fewer than five words, each found as a whole.
NOTICES = [
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD", "SPDX-License-Identifier: BSD"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]


def words_of(text: Column) -> Column:
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.filter(F.split(folded, " ", -1), lambda w: w != "")


def _with_shingles(df: DataFrame) -> DataFrame:
    """Adds ``h``: a hash of each run of five words, from ``w``."""
    def joined(h: Column, distance: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + distance)))

    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # Runs of two words, of four, of five. Each step uses the last one more than once, so Spark
    # computes it as a column of its own.
    for distance in (1, 2, 1):
        df = df.withColumn("h", joined(F.col("h"), distance))
    return df.withColumn("h", F.slice("h", 1, F.greatest(F.lit(0), F.size("w") - (SHINGLE_WORDS - 1))))


def _bands(step: int, last: Column) -> Column:
    """The bands of the windows that start at every ``step`` shingles below ``last``, in one array.

    A band is the least hash of the window's two shingles; the last window may have only one.
    """

    def of_window(i: Column) -> Column:
        x = F.get("h", i)
        y = F.coalesce(F.get("h", i + 1), x)
        return F.array(*[F.least(F.xxhash64(x, F.lit(j)), F.xxhash64(y, F.lit(j))) for j in range(BANDS)])

    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), last - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, of_window))


def _runs(words: str, n: int) -> Column:
    """A hash of each run of ``n`` words, from the hashes of the words; runs cut by the end come last."""
    return F.transform(words, lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(F.col(words), i + k) for k in range(1, n)]))


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, license, words, shingles, bands) of templates with words, by their place."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("w", words_of(F.col("text"))).withColumn("x", F.transform("w", lambda x: F.xxhash64(x)))
    rows = _with_shingles(rows).where(F.size("w") > 0)
    # Whole windows at every word, or the one short window of a single shingle.
    bands = _bands(1, F.greatest(F.lit(1), F.size("h") - (WINDOW_SHINGLES - 1)))
    short = F.coalesce(*[F.when(F.size("w") == n, F.slice(_runs("x", n), 1, 1)) for n in range(1, SHINGLE_WORDS)])
    return rows.select(
        "template", "license", F.size("w").alias("words"),
        F.coalesce(short, F.array_distinct("h")).alias("shingles"), F.coalesce(short, F.array_distinct(bands)).alias("bands"),
    )


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = 0.8) -> DataFrame:
    """One row per match: doc_id, license, template (its place in the list), n_shared, n_shingles.

    ``n_shared`` counts the different shingles of the template that the text has, which are at
    least ``containment`` of its ``n_shingles``; a template of fewer than five words has one, the
    whole of it. Null texts match nothing. Rows that repeat an id have matches of their own.
    Templates are a parameter of bounded size, TEMPLATES and NOTICES if it is left out; those
    without words can't be found. Columns besides doc_id and text are not read.
    """
    spark = df.sparkSession
    known = materialise(template_table(spark, [*TEMPLATES, *NOTICES] if templates is None else templates), "templates")
    keys = known.agg(F.array_distinct(F.flatten(F.collect_list("bands")))).scalar()
    rows = _with_shingles(df.select("doc_id", words_of(F.col("text")).alias("w")))
    bands = _bands(WINDOW_SHINGLES, F.size("h"))
    lengths = sorted(r["words"] for r in known.where(F.col("words") < SHINGLE_WORDS).select("words").distinct().collect())
    if lengths:
        short_keys = known.where(F.col("words") < SHINGLE_WORDS).agg(F.array_distinct(F.flatten(F.collect_list("bands")))).scalar()
        rows = rows.withColumn("x", F.transform("w", lambda x: F.xxhash64(x)))
        rows = rows.withColumn("short", F.array_intersect(F.concat(*[_runs("x", n) for n in lengths]), short_keys))
        rows = rows.withColumn("bands", bands).withColumn("h", F.concat("h", "short"))
        bands = F.concat("bands", "short")
    # The row number keeps the filter from being computed apart from the bands.
    found = F.array_intersect(bands, keys).alias("hits")
    hits = rows.select("doc_id", "h", F.monotonically_increasing_id().alias("use"), found).where(F.size("hits") > 0)
    by_band = known.select("template", "license", "shingles", F.explode("bands").alias("band"))
    retrieved = hits.withColumn("band", F.explode("hits")).join(F.broadcast(by_band), "band")
    # One row for each text and template, whatever the number of bands they share.
    pairs = retrieved.groupBy("use", "template").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "license", "shingles", "h")])
    shared = F.size(F.array_intersect("shingles", "h"))
    matches = pairs.select("doc_id", "license", "template", shared.cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_shingles"))
    return matches.where(F.col("n_shared") * 100 >= F.col("n_shingles") * round(containment * 100))
