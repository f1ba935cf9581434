"""License scans: a paragraph classifier confirmed by templates.

A paragraph is a line. Its sparse features are the one- and two-word n-grams of license
language; a multinomial logistic regression with an L1 penalty tells license families,
`unknown` (a license, but of no family known here) and `none` apart. Probabilities are
calibrated by a temperature fitted on paragraphs kept aside, and a family is only reported
above a calibrated probability and if templates confirm it: enough of the three-word n-grams
of one of its notices are in the paragraph, or of the paragraph's in its texts. A likely
license that is not confirmed is `unknown`.

The classifier learns from the notices, from cut and filled variants of them, from sentences
that only sound like licenses, and from a bounded sample of paragraphs without license
words. Features that the fitted model gives no weight are dropped; a paragraph without any
other feature gets the same verdict as an empty one, so only paragraphs with one are scored.

Cases: null and empty texts have no paragraphs and no license. A document with several
licenses reports all, in order of name. Very long texts are split whole. Repeated rows get equal
results; texts are told apart by a hash of 64 bits. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.sampling import picked
from holdfast.session import cut_lineage

NONE, UNKNOWN = "none", "unknown"
WORDS = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"

# Notices of well-known licenses, as their texts ask them to be given.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the"
        " LICENSE file.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International"
        " License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or"
        " neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this"
        " program.",
        "Released under the GNU GPL version 2.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the Software without"
        " restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
        "Licensed under the MIT license.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at"
        " http://mozilla.org/MPL/2.0/.",
    ),
    UNKNOWN: (
        "Licensed under the terms of the Example Community License, version 1.1.",
        "This file is distributed under a proprietary license agreement.",
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "Released under the Acme Public License.",
        "You may use this material only under the license terms of the publisher.",
        "This document is licensed under the Open Data License of the city.",
    ),
    # Sentences with the words of licenses, but without their sense.
    NONE: (
        "The driver lost his license after the accident and had to take the bus to work.",
        "A professor at MIT released a new study under the title of public health.",
        "The Apache helicopter was released for use by the army under the new program.",
        "Creative people in common rooms share software and documentation without restriction.",
        "The general public asked for free software courses in the city library.",
        "Permission to enter the building is granted at the front desk, free of charge.",
        "He had a copy of the file and the list of conditions on his desk.",
        "The work of this version is under way and all copies of the book are sold.",
    ),
}


@dataclass(frozen=True)
class Licenses:
    """`sample` bounds the paragraphs learned from; `variants` are made of each notice.

    A family needs `likely` probability and a share `confirmed` of its three-word n-grams.
    """

    sample: int = 2000
    variants: int = 40
    penalty: float = 0.0005
    likely: float = 0.6
    confirmed: float = 0.6


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits, dots, hyphens and plus signs, without end dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)


def ngrams(words: str, n: int) -> Column:
    if n == 1:
        return F.col(words)
    joined = ", ' ', ".join(f"get({words}, i + {k})" for k in range(n))
    # Past the end get() is null, and so is the n-gram.
    return F.expr(
        f"filter(transform({words}, (w, i) -> concat({joined})), g -> g is not null)"
    )


def _features(rows: DataFrame) -> DataFrame:
    """Distinct one- and two-word n-grams of column `text`."""
    split = rows.withColumn("words", tokens(F.col("text")))
    return split.withColumn(
        "grams", F.array_distinct(F.concat(ngrams("words", 1), ngrams("words", 2)))
    )


def _notices(spark: SparkSession) -> DataFrame:
    every = [(family, text) for family, texts in sorted(NOTICES.items()) for text in texts]
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in every]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _variants(notices: DataFrame, how: Licenses) -> DataFrame:
    """Each notice as it is, and with words left out or other words around, by hash."""
    each = notices.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(how.variants))))
    kept = F.expr(
        "array_join(transform(split(text, ' '), (w, i) ->"
        " if(nth = 0 or pmod(xxhash64(text, nth, i), 8) > 0, w, '')), ' ')"
    )
    filler = F.concat(
        F.lit("w"), F.pmod(F.xxhash64("text", "nth", F.lit("a")), F.lit(997)).cast("string")
    )
    text = F.when(F.col("nth") % 3 == 0, kept).otherwise(F.concat_ws(" ", filler, kept, filler))
    return each.select("family", text.alias("text"), F.col("nth"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc, text): the lines of column `text` that have a word."""
    lines = docs.select("doc", F.explode(F.split("text", "\n")).alias("text"))
    return lines.where(F.col("text").rlike("[A-Za-z]"))


def _cue(feature: str) -> str:
    """The longest run of letters and digits in an n-gram."""
    return max(re.findall("[a-z0-9]+", feature), key=lambda w: (len(w), w))


@dataclass(frozen=True)
class Classifier:
    """A fitted model: features with their weights per family, and the calibration."""

    families: list[str]
    features: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    temperature: float

    def cues(self) -> list[str]:
        """Words of which a paragraph with a feature has at least one."""
        return sorted({_cue(f) for f in self.features})

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds `chances`: calibrated probability per family, from column `grams`."""
        table = F.map_from_arrays(
            F.array(*map(F.lit, self.features)),
            F.array(*(F.array(*map(F.lit, w)) for w in self.weights)),
        )
        start = F.array(*map(F.lit, self.intercepts))
        known = F.filter("grams", lambda g: g.isin(*self.features))
        logits = F.aggregate(
            known, start, lambda s, g: F.zip_with(s, table[g], lambda a, b: a + b)
        )
        scaled = rows.withColumn(
            "logits", F.transform(logits, lambda x: x / F.lit(self.temperature))
        )
        top = scaled.withColumn("top", F.array_max("logits")).withColumn(
            "powers", F.expr("transform(logits, x -> exp(x - top))")
        )
        total = "aggregate(powers, 0D, (s, x) -> s + x)"
        return top.withColumn("chances", F.expr(f"transform(powers, x -> x / {total})")).drop(
            "logits", "top", "powers"
        )


def fitted(docs: DataFrame, how: Licenses = Licenses()) -> Classifier:
    """Learn from the notices and a bounded sample of the lines of `docs` (doc, text).

    What reaches the driver is the vocabulary of the notices and the model.
    """
    spark = docs.sparkSession
    made = _variants(_notices(spark), how)
    some = picked(docs, how.sample, "doc", "text", seed=5)
    # Lines with plain license words have no sure label; the others have none, unless they
    # share a run of three words with a notice. A line that many documents hold counts once.
    lines = paragraphs(some).where(~F.col("text").rlike("(?i)licen[sc]|copyright|permission"))
    stated = sorted({g for f, own in NOTICES.items() if f != NONE for t in own for g in _three(t)})
    noticed = F.arrays_overlap(ngrams("words", 3), F.array(*map(F.lit, stated)))
    # Written, or the filter would split a line anew for each of its words.
    lines = cut_lineage(lines.select("text").distinct().withColumn("words", tokens(F.col("text"))))
    lines = lines.where(~noticed).orderBy(F.xxhash64("text"), "text").limit(how.sample)
    plain = lines.select(F.lit(NONE).alias("family"), "text", F.lit(-1).alias("nth"))
    rows = cut_lineage(_features(made.unionByName(plain)))

    own = rows.where(F.col("family") != NONE).select(F.explode("grams").alias("gram")).distinct()
    # N-grams of the notices that plain lines rarely have.
    plain_rows = rows.where(F.col("nth") < 0)
    common = (
        plain_rows.select(F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 0.01 * max(plain_rows.count(), 1))
    )
    # Without letters, or with a filler word, an n-gram says nothing.
    kept = own.where(F.col("gram").rlike("[a-z]") & ~F.col("gram").rlike("\\bw[0-9]+\\b"))
    # Each of at most 100 n-grams per word of a line is that common, so they are few.
    often = {r[0] for r in common.select("gram").collect()}
    vocabulary = [r[0] for r in kept.orderBy("gram").collect()]
    vocabulary = [g for g in vocabulary if g not in often and _cue(g) not in often]

    families = [NONE, UNKNOWN, *sorted(f for f in NOTICES if f not in (NONE, UNKNOWN))]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    counter = CountVectorizerModel.from_vocabulary(
        vocabulary, inputCol="grams", outputCol="features", binary=True
    )
    data = counter.transform(rows.withColumn("label", label.cast("double")))
    aside = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(4)) == 0
    learner = LogisticRegression(
        family="multinomial", regParam=how.penalty, elasticNetParam=1.0, maxIter=80,
        standardization=False,
    )
    model = learner.fit(data.where(~aside))
    matrix = model.coefficientMatrix.toArray()
    used = [j for j in range(len(vocabulary)) if abs(matrix[:, j]).max() > 1e-6]

    # The temperature with the least log loss on the rows kept aside.
    grid = [0.25 * 2 ** (i / 4) for i in range(17)]
    raw = model.transform(data.where(aside)).select(
        "label", vector_to_array("rawPrediction").alias("raw")
    )

    def loss(t: float) -> Column:
        powers = F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp(x / t))
        own = F.element_at("raw", (F.col("label") + 1).cast("int"))
        return F.sum(F.log(powers) - own / t)

    losses = raw.agg(*(loss(t) for t in grid)).first()
    held = [(x, t) for x, t in zip(losses, grid) if x is not None]
    return Classifier(
        families,
        [vocabulary[j] for j in used],
        [[float(x) for x in matrix[:, j]] for j in used],
        [float(x) for x in model.interceptVector.toArray()],
        min(held)[1] if held else 1.0,
    )


def _confirmed(how: Licenses) -> Column:
    """Whether notices of the likely family confirm the paragraph."""
    known = {f: t for f, t in NOTICES.items() if f not in (NONE, UNKNOWN)}
    case = None
    for family, texts in sorted(known.items()):
        notices = [_three(text) for text in texts]
        every = sorted({g for n in notices for g in n})
        share = [
            F.size(F.array_intersect("threes", F.array(*map(F.lit, n)))) / float(len(n))
            for n in notices
        ]
        inside = F.size(F.array_intersect("threes", F.array(*map(F.lit, every))))
        held = inside / F.greatest(F.size("threes"), F.lit(1)).cast("double")
        fits = F.greatest(*share, held) >= how.confirmed
        hit = F.col("likely") == family
        case = F.when(hit, fits) if case is None else case.when(hit, fits)
    return case.otherwise(False)


def _three(text: str) -> list[str]:
    """Distinct three-word n-grams of a notice, or all its words together."""
    words = re.findall(WORDS, text.lower())
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})


def _words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def license_scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    how: Licenses = Licenses(),
) -> DataFrame:
    """(id, licenses, n_paragraphs, probability) for every row of `docs`.

    `licenses` are the families found, comma-joined (null if none), `n_paragraphs` counts
    the paragraphs that gave them, `probability` is the largest calibrated one of a license.
    """
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    model = fitted(rows, how)
    cues = F.array(*(F.lit(c) for c in model.cues())).cast("array<string>")
    # A text's verdict depends on the text alone, so equal texts are judged once, and what is
    # shuffled of a text is its lines with a cue.
    held = (
        rows.where(F.arrays_overlap(_words_of(F.col("text")), cues))
        .select(
            F.xxhash64("text").alias("text_hash"),
            F.filter(
                F.split("text", "\n"), lambda s: F.arrays_overlap(_words_of(s), cues)
            ).alias("lines"),
        )
        .groupBy("text_hash")
        .agg(F.first("lines").alias("lines"))
        .select("text_hash", F.explode("lines").alias("text"))
    )
    # Written between the steps: a filter below would repeat their expressions.
    scored = cut_lineage(model.scored(cut_lineage(_features(held))))
    families = F.array(*map(F.lit, model.families))
    best = F.array_position("chances", F.array_max("chances")).cast("int")
    judged = cut_lineage(
        scored.withColumn("likely", F.element_at(families, best))
        .withColumn("chance", F.array_max("chances"))
        .withColumn("licensed", 1 - F.element_at("chances", 1))
        .withColumn("threes", F.array_distinct(F.when(
            F.size("words") < 3, F.array(F.array_join("words", " "))
        ).otherwise(ngrams("words", 3))))
        .withColumn("sure", (F.col("chance") >= how.likely) & _confirmed(how))
        .withColumn(
            "license",
            F.when(F.col("sure"), F.col("likely")).when(
                F.col("licensed") >= how.likely, F.lit(UNKNOWN)
            ),
        )
        .select("text_hash", "license", "licensed")
    )
    found = judged.where("license is not null").groupBy("text_hash").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.max("licensed").alias("probability"),
    )
    # Missing texts share no key with anything.
    text_hash = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    keyed = rows.select("doc", text_hash.alias("text_hash"))
    return keyed.join(found, "text_hash", "left").select(
        F.col("doc").alias(id_column),
        "licenses",
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
