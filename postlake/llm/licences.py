"""Licence notices by a trained paragraph classifier, confirmed against templates."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.sources.scratch import cut_lineage

NONE, UNKNOWN = "none", "unknown"
#: Longest n-gram of words that is a feature.
NGRAM = 3
#: Paragraphs of the corpus that stand for "no licence", those with the least hashes: so many
#: with an anchor word and so many without. Lines with a telling word are not among them.
NEGATIVES = 2_000
TELLING = r"(?i)licen[cs]|copyright|copyleft|[al]?gpl|warranty|redistribut|spdx|cc[ -]by|cc0|domain|proprietary|reserved"
#: Share of unlicensed paragraphs that may pass the confidence threshold, and its bounds.
FALSE_SHARE, LEAST_CONFIDENCE, MOST_CONFIDENCE = 0.001, 0.5, 0.9
#: Share of a template's word pairs that a paragraph must hold to confirm its family.
CONFIRMED = 0.6

#: Words one of which every licence notice holds. Only n-grams around them are
#: features, so paragraphs without them have the score of an empty text: no licence.
ANCHORS = (
    "licence", "licences", "licenced", "license", "licenses", "licensed", "licensing", "sublicense", "copyright",
    "copyrighted", "copyleft", "gpl", "lgpl", "agpl", "gnu", "mit", "apache", "bsd", "mozilla", "mpl", "isc", "cc",
    "cc0", "creative", "commons", "unlicense", "spdx", "warranty", "redistribution", "proprietary", "confidential",
    "rights",
)

#: Short notices of public licence families.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense and sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and modify it under the terms of the GNU Lesser General Public License.",
        "Released under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it under the terms of the GNU Affero General Public License.",
        "Released under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "This software is released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Released under CC0 1.0 Universal, public domain dedication by Creative Commons.",
        "This is free and unencumbered software released into the public domain under the Unlicense.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "Copyright, all rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without written permission of the copyright holder.",
        "This document is proprietary and confidential and may not be copied without a license.",
        "Unauthorized copying of this file is strictly prohibited; all rights reserved.",
    ),
}
#: Words around a notice, with which every template is also learned.
FRAMES = ("{}", "Copyright 2024 the authors. {}", "{} See the terms for details.", "The text of this page: {}")
#: Sentences that name licences without granting one.
MENTIONS = (
    "The apache helicopter crossed the border at night.", "She studied physics at MIT for four years.",
    "His driving licence expired in March.", "The rights of the workers were debated.", "Civil rights and human rights.",
    "The bsd meeting was postponed.", "He asked for a creative solution.", "The house of commons voted on the bill.",
    "The warranty of the fridge has expired.", "Copyright law is complicated.", "A confidential letter arrived.",
    "The gnu is a large antelope.", "Licence fees rose again this year.", "The licensed driver was fined.",
)


@dataclass(frozen=True)
class LicenceModel:
    """Feature weights per family as a table, and the threshold below which it is unknown."""

    families: list[str]
    weights: DataFrame
    intercepts: list[float]
    threshold: float


def words_of(text: Column) -> Column:
    """Lower-cased words: letters, digits, and dots or hyphens between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), 0)


def features_of(words: Column) -> Column:
    """The distinct n-grams of one to NGRAM words that hold an anchor word or part of one."""
    grams = [_grams(words, n) for n in range(1, NGRAM + 1)]
    return F.array_distinct(F.filter(F.concat(*grams), lambda g: g.rlike(_anchor_pattern())))


def _grams(words: Column, n: int) -> Column:
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def _anchor_pattern() -> str:
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(ANCHORS) + r")(?![\p{L}\p{N}])"


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, paragraph) of the lines that hold an anchor word; others have no feature."""
    pattern = "(?i)" + _anchor_pattern()
    # A look at the whole text first: most texts have no anchor and need no cutting up.
    held = docs.select(
        F.col("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")
    ).where(F.col("text").rlike(pattern))
    lines = held.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    return lines.where(F.col("paragraph").rlike(pattern))


def train(docs: DataFrame) -> LicenceModel:
    """Learn the families from the templates in their frames, and "none" from MENTIONS and
    NEGATIVES paragraphs of the corpus. L1 keeps few features; their number is bounded by
    the templates, whatever the size of the corpus."""
    spark = docs.sparkSession
    notices = [(family, frame.format(text)) for family, texts in TEMPLATES.items() for text in texts for frame in FRAMES]
    mentions = [(NONE, frame.format(text)) for text in MENTIONS for frame in FRAMES]
    known = _rows(spark, notices + mentions, "family", "paragraph")
    plain = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph")).where(
        F.length("paragraph") > 0).where(~F.col("paragraph").rlike(TELLING))
    anchored = F.col("paragraph").rlike("(?i)" + _anchor_pattern())
    for rows in (plain.where(anchored), plain.where(~anchored)):
        least = rows.select("paragraph", F.xxhash64("paragraph").alias("h")).orderBy("h", "paragraph").limit(NEGATIVES)
        known = known.unionByName(least.select(F.lit(NONE).alias("family"), "paragraph"))
    # The sample is bounded; in one partition, a training step is one task.
    sample = cut_lineage(known.select(
        "family", features_of(words_of(F.col("paragraph"))).alias("grams")), "training").coalesce(1)
    families = [*TEMPLATES, NONE]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    sample = sample.withColumn("label", label.cast("double"))
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(sample)
    # Classes weigh alike, however many plain paragraphs there are.
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weight = F.element_at(F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, 1.0 / c)]), F.col("label"))
    rows = counter.transform(sample).withColumn("weight", weight)
    fitted = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=1e-3, elasticNetParam=0.5, maxIter=60).fit(rows)
    matrix, vocabulary = fitted.coefficientMatrix.toArray(), counter.vocabulary
    kept = [n for n in range(len(vocabulary)) if abs(matrix[:, n]).max() > 0]
    weights = _rows(spark, [(vocabulary[n], ",".join(repr(float(v)) for v in matrix[:, n])) for n in kept], "gram", "text")
    weights = weights.select("gram", F.split("text", ",").cast("array<double>").alias("weights"))
    intercepts = [float(v) for v in fitted.interceptVector.toArray()]
    model = LicenceModel(families, weights, intercepts, LEAST_CONFIDENCE)
    scored = _scored(sample.withColumn("n", F.monotonically_increasing_id()), ["n", "family"], model)
    wrong = scored.where(F.col("family") == NONE).select(F.array_max(F.slice("p", 1, len(families) - 1)).alias("p"))
    most = wrong.agg(F.percentile("p", 1 - FALSE_SHARE)).first()[0] or 0.0
    return LicenceModel(families, weights, intercepts, min(max(most, LEAST_CONFIDENCE), MOST_CONFIDENCE))


def _rows(spark: SparkSession, rows: list[tuple[str, str]], *names: str) -> DataFrame:
    """A small table of literals, made in the JVM."""
    cells = F.array(*[F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for a, b in rows])
    return spark.range(1).select(F.inline(cells))


def _scored(rows: DataFrame, keys: list[str], model: LicenceModel) -> DataFrame:
    """keys and p, the probability of every family; `rows` has keys and grams."""
    k = len(model.families)
    sums = rows.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram").groupBy(*keys).agg(
        *[F.sum(F.get("weights", F.lit(i))).alias(f"w{i}") for i in range(k)])
    scores = F.array(*[F.col(f"w{i}") + model.intercepts[i] for i in range(k)])
    held = sums.select(*keys, scores.alias("s")).withColumn(
        "e", F.transform("s", lambda v: F.exp(v - F.array_max("s"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return held.withColumn("total", total).select(*keys, F.transform("e", lambda v: v / F.col("total")).alias("p"))


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per paragraph that grants a licence, or seems to: doc_id, line (from 0),
    family, probability, similarity, confirmed, paragraph.

    A paragraph is a line. The most likely family is reported; where its probability is
    below the calibrated threshold, or no feature is known, but "no licence" is not the likelier
    answer either, the family is `unknown`. `similarity` is the share of word pairs of
    the closest template of the family that the paragraph holds; `confirmed` from CONFIRMED
    on. Paragraphs without an anchor word have no feature and are no licence. NULL and
    empty texts give no rows; repeated rows are reported once each; other columns are
    ignored.
    """
    docs = docs.select("doc_id", "text")
    model = model or train(docs)
    found = paragraphs(docs).withColumn("words", words_of(F.col("paragraph")))
    found = cut_lineage(found.withColumn("grams", features_of(F.col("words"))), "paragraphs")
    scored = _scored(found, ["row", "line"], model)
    families = F.array(*map(F.lit, model.families[:-1]))
    best = F.array_max(F.slice("p", 1, len(model.families) - 1))
    none = F.get("p", F.lit(len(model.families) - 1))
    named = scored.select("row", "line", best.alias("probability"), none.alias("none"), F.element_at(
        families, F.array_position("p", best).cast("int")).alias("likely"))
    named = named.where((F.col("probability") >= model.threshold) | (F.col("none") < 0.5))
    named = named.withColumn("family", F.when(F.col("probability") >= model.threshold, F.col("likely")).otherwise(UNKNOWN))
    named = found.drop("grams").join(named, ["row", "line"])
    pairs = lambda words: F.array_distinct(_grams(words, 2))
    templates = _rows(docs.sparkSession, list(chain.from_iterable(
        [(f, t) for t in texts] for f, texts in TEMPLATES.items())), "likely", "template")
    templates = templates.groupBy("likely").agg(F.collect_list(pairs(words_of(F.col("template")))).alias("templates"))
    held = named.join(F.broadcast(templates), "likely").withColumn("pairs", pairs(F.col("words")))
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.greatest(F.size(t), F.lit(1))))
    return held.select(
        "doc_id", F.col("line").cast("long").alias("line"), "family", F.round("probability", 6).alias("probability"),
        F.round(share, 6).alias("similarity"), ((share >= CONFIRMED) & (F.col("family") != UNKNOWN)).alias("confirmed"), "paragraph")
