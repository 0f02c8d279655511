"""Licence families of documents, by a trained classifier of paragraphs, in DataFrame operations only.

A sparse multinomial logistic regression over hashed word n-grams (one to three words) is trained on the statements in
`TEMPLATES`, on them with any one word missing or with foreign words around them, on statements of the same form
about licences that do not exist, with names from the corpus (the class `unknown`), and on everyday sentences with the
words of licences, alone and among words of the corpus (the class `none`). A quarter of the rows, by a
hash, is kept from training: there the least probability is found at which 99 % of the accepted rows are right, and
whatever scores below it is `unknown`. A prediction must then be confirmed by a template of its family, of whose word
pairs the paragraph holds at least `CONFIRMED`; else it is `unknown` as well, unless it is `none`. A piece of text that is
word for word one of the statements, such as "MIT License" alone in a line, has that family with probability 1.

Scored are single lines, windows of two and three neighbouring lines of a paragraph, and in longer paragraphs the `REACH`
words on both sides of each cue word, however they are wrapped into lines; lines without a letter or digit part
paragraphs. Only pieces with a cue are scored: all statements trained on have one, so others are outside of what the
classifier knows, and count as no licence. What is trained on is bounded: the templates are fixed, and about `FOREIGN`
texts, those whose hash is below a share that follows from their number, lend eight words each, from a place that the
hash chooses in the whole text.

Cases: null and empty texts have no licence. Very long lines are scored whole. Of several licences in one document all
families are listed and the most probable decides; ties go to the first by name. The probability of `none` and `unknown`
is 0. Rows that share a doc_id, or have none, share their licences. No rows give no rows, and nothing is trained where no
text has a cue. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import stage

#: Statements by which texts name their licence.
TEMPLATES = {
    "apache": (
        "Apache License",
        "Apache Software License, Version 2.0",
        "Licensed under the Apache 2.0 license",
        "Apache-2.0",
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "Licensed under the Apache License, Version 2.0",
        "Distributed under the terms of the Apache License 2.0",
        "you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0",
        "Apache License, Version 2.0",
        "License: Apache-2.0",
    ),
    "mit": (
        "The MIT License",
        "Distributed under the MIT license",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is available under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "License: MIT",
    ),
    "gpl": (
        "GPL version 2 or later",
        "License: GPL version 2 or later",
        "Licensed under the GPL, version 3",
        "GNU GPL version 3",
        "GPL-3.0",
        "GPL-2.0",
        "you should have received a copy of the GNU General Public License along with this program",
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License",
        "License: GPL-3.0",
    ),
    "lgpl": (
        "LGPL version 2.1 or later",
        "License: LGPL version 3 or later",
        "LGPL-2.1",
        "LGPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "GNU Lesser General Public License",
        "License: LGPL-2.1",
    ),
    "bsd": (
        "BSD-3-Clause",
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice in the documentation",
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "BSD License",
        "License: BSD",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "ISC License",
        "Licensed under the ISC License",
        "License: ISC",
    ),
    "mpl": (
        "MPL-2.0",
        "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at the Mozilla license page",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License 2.0",
        "License: MPL-2.0",
    ),
    "cc-by": (
        "Creative Commons Attribution 4.0 International License",
        "CC BY 4.0",
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Creative Commons Attribution-ShareAlike 4.0 International License",
        "CC BY-SA 4.0",
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Creative Commons Attribution-NonCommercial 4.0 International License",
        "CC BY-NC 4.0",
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "public-domain": (
        "released into the public domain",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal public domain dedication",
        "This work is dedicated to the public domain under CC0 1.0",
        "This is free and unencumbered software released into the public domain",
    ),
    "proprietary": (
        "Copyright. All rights reserved. No part may be reproduced without written permission",
        "This document is proprietary and confidential. All rights reserved",
        "All rights reserved",
    ),
}
#: Forms for licences that do not exist; the names come from the corpus.
FORMS = (
    "Licensed under the {} License, Version 2.0", "Released under the {} License", "Licensed under {} 4.0",
    "This work is licensed under the {} Public License, version 3", "the {} license of the license {}",
    "Copyright {} and others", "permission {} copyright {}", "SPDX-License-Identifier: {}", "{} License", "License: {}",
)
#: Everyday sentences with words of licences: no licence is meant.
EVERYDAY = (
    "we drove past the licensed {} office", "his driving license was in the {}", "she asked the {} for permission is it allowed",
    "the {} lost its license to sell alcohol", "a licensed {} must sign the form", "you need a fishing license in {}",
    "the copyright office of {} opened at nine", "they argued about copyright and {} all day", "the {} license plate was bent",
    "the pilot renewed the license for {}", "nobody knew who held the copyright of the {} song", "a poetic license of the {}",
    "the {} is in the public domain of thought", "all seats are reserved and {} rights were discussed", "permission is needed to enter {}",
    "the redistribution of land in {}", "the licensing of {} doctors takes a year",
)
UNKNOWN, NONE = "unknown", "none"
FAMILIES = (*sorted(TEMPLATES), NONE, UNKNOWN)
#: Between the words of a cue a line may end, and the next one begin with signs of a comment.
CUE = (
    r"(?i)licen[sc]|copyright|spdx|permission\W+(?:is|to)|public\W+domain|redistribution|rights\W+reserved|creative\W+commons"
    r"|\b(?:l?gpl|mpl|apache|bsd|cc(?:\W+by)?(?:\W+(?:sa|nc))?)\W*(?:v|version\W+)?\d|without\W+warranties"
)
#: Words that a cue has, or begins with.
CUE_WORD = r"(?i)licen[sc]|copyright|spdx|permission|domain|redistribution|reserved|commons|gpl|mpl|apache|bsd|\bcc|warranties"
#: Lines of windows; words around a cue word, more than a statement has. Statements of fewer words lose none in training.
WINDOWS, REACH, SHORT = (2, 3), 24, 4
FOREIGN, FEATURES, CONFIRMED, RIGHT = 400, 1 << 14, 0.6, 0.99


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "licenc", "licens"), "[^a-z0-9à-öø-ÿ.]+|[.](?![0-9])"), lambda word: word != "")


def joined(words_: str, size: int) -> Column:
    """Runs of `size` neighbouring words."""
    starts = F.sequence(F.lit(1), F.size(words_) - (size - 1))
    runs = F.transform(starts, lambda at: F.concat_ws(" ", F.slice(words_, at, size)))
    return F.when(F.size(words_) >= size, runs).otherwise(F.array().cast("array<string>"))


def grams(rows: DataFrame, text: str) -> DataFrame:
    """Add `words`, `pairs` and the sparse vector `features`."""
    rows = rows.withColumn("words", words(F.col(text))).withColumn("pairs", joined("words", 2))
    rows = rows.withColumn("grams", F.concat("words", "pairs", joined("words", 3)))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows).drop("grams")


def paragraphs(docs: DataFrame) -> DataFrame:
    """The pieces with a cue of each document and how many lines each has (0: words around a cue word of a long paragraph)."""
    cued = docs.where(F.col("text").rlike(CUE)).select("doc_id", F.explode(F.split("text", r"\n(?:[^\p{L}\p{N}\n]*\n)+")).alias("part"))
    cued = cued.where(F.col("part").rlike(CUE)).select("doc_id", F.split("part", "\n").alias("all"), F.split("part", r"\s+").alias("each"))
    kind = "array<struct<lines:int,line:string>>"

    def windows(size: int) -> Column:
        starts = F.when(F.size("all") >= size, F.sequence(F.lit(1), F.size("all") - (size - 1)))
        made = F.transform(starts, lambda at: F.struct(F.lit(size).alias("lines"), F.array_join(F.slice("all", at, size), " ").alias("line")))
        return F.coalesce(made, F.array().cast(kind))

    long = F.size("all") > max(WINDOWS)
    at_cues = F.filter(F.sequence(F.lit(1), F.size("each")), lambda at: F.element_at("each", at).rlike(CUE_WORD))

    def words_around(at: Column) -> Column:
        first = F.greatest(at - REACH, F.lit(1))
        return F.struct(F.lit(0).alias("lines"), F.array_join(F.slice("each", first, at - first + REACH + 1), " ").alias("line"))

    around = F.when(long, F.transform(at_cues, words_around)).otherwise(F.array().cast(kind))
    pieces = F.concat(*map(windows, (1, *WINDOWS)), around)
    return cued.select("doc_id", F.inline(F.filter(pieces, lambda piece: piece["line"].rlike(CUE))))


def corpus_words(docs: DataFrame, foreign: int = FOREIGN) -> DataFrame:
    """w, h: eight neighbouring words of about `foreign` texts; only these few short rows leave the reading tasks."""
    some = docs.where("text IS NOT NULL AND text <> ''").select("text", F.xxhash64("text").alias("h"))
    count = max(1, some.count())
    chosen = some.where(F.pmod("h", F.lit(1 << 40)) < F.lit(int(min(1.0, foreign / count) * (1 << 40))))
    split = chosen.select(words(F.col("text")).alias("w"), "h").where(F.size("w") >= 3)
    start = F.pmod(F.xxhash64(F.lit("place"), "h"), F.greatest(F.size("w") - 7, F.lit(1))).cast("int") + 1
    return split.select(F.slice("w", start, 8).alias("w"), "h").distinct()


def training_rows(names: DataFrame) -> DataFrame:
    """family and line: statements, statements changed, statements about licences that do not exist, everyday sentences.

    `names` are `corpus_words`, as a stored table.
    """
    fixed = [(f, t) for f, texts in TEMPLATES.items() for t in texts] + [(NONE, form.replace("{} ", "")) for form in EVERYDAY]
    fixed = names.sparkSession.createDataFrame(fixed, "family string, line string").withColumn("parts", F.split("line", " "))
    place = F.explode(F.sequence(F.lit(1), F.size("parts")))
    shorter = fixed.where((F.col("family") != NONE) & (F.size("parts") >= SHORT)).withColumn("at", place).select(
        "family", F.array_join(F.filter("parts", lambda _, i: i + 1 != F.col("at")), " ").alias("line")
    )
    around = fixed.crossJoin(F.broadcast(names.orderBy("h").limit(8)))  # fixed sizes: statements times eight
    longer = around.select("family", F.concat_ws(" ", F.array_join(F.slice("w", 1, 2), " "), "line", F.element_at("w", 3)).alias("line"))
    forms = [(UNKNOWN, form) for form in FORMS] + [(NONE, form) for form in EVERYDAY]
    forms = F.array(*[F.struct(F.lit(family).alias("family"), F.lit(form).alias("form")) for family, form in forms])
    name = F.initcap(F.element_at("w", F.pmod(F.xxhash64("form", "h"), F.lit(3)).cast("int") + 1))
    filled = names.select("w", "h", F.inline(forms)).select("family", F.regexp_replace("form", r"\{\}", name).alias("line"))
    return fixed.select("family", "line").unionByName(shorter).unionByName(longer).unionByName(filled)


def train(rows: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the least probability that it accepts."""
    label = (F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1).cast("double")
    held = F.pmod(F.xxhash64("line"), F.lit(4)) == 0
    rows = grams(rows, "line").withColumn("label", label).withColumn("held", held)
    # about ten thousand short rows: one partition sends the driver one gradient an iteration
    rows = rows.coalesce(1).persist()
    counts = rows.where("NOT held").groupBy("family").count()
    counts = F.broadcast(counts)  # one row per family; each iteration then keeps the partition of the rows
    weighted = rows.where("NOT held").join(counts, "family").withColumn("share", 100 / F.col("count"))
    fit = LogisticRegression(maxIter=80, regParam=0.003, elasticNetParam=0.3, weightCol="share").fit(weighted)
    best = F.array_max(vector_to_array("probability"))
    checked = fit.transform(rows.where("held")).select(best.alias("p"), (F.col("prediction") == F.col("label")).alias("right"))
    by_chance = Window.orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    accepted = checked.withColumn("precision", F.avg(F.col("right").cast("double")).over(by_chance))
    least = accepted.where(F.col("precision") >= RIGHT).agg(F.min("p")).first()[0]
    rows.unpersist()
    return fit, float(least if least is not None else 1.0)


def _templates(spark: SparkSession) -> DataFrame:
    """One row per family: the word pairs of its statements."""
    rows = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, line string")
    rows = rows.withColumn("words", words(F.col("line"))).withColumn("pairs", joined("words", 2))
    return rows.groupBy("family").agg(F.collect_list("pairs").alias("statements"))


def classify(lines: DataFrame, model: LogisticRegressionModel, least: float) -> DataFrame:
    """The lines with `family`, `probability` and `confirmed`, the share of a template's word pairs they hold."""
    scored = model.transform(grams(lines, "line")).withColumn("chances", vector_to_array("probability"))
    scored = scored.withColumn("probability", F.array_max("chances"))
    names = F.array(*map(F.lit, FAMILIES))
    scored = scored.withColumn("guess", F.element_at(names, F.col("prediction").cast("int") + 1))
    held = F.transform("statements", lambda pairs: F.size(F.array_intersect(pairs, "pairs")) / F.size(F.array_distinct(pairs)))
    templates = F.broadcast(_templates(lines.sparkSession).withColumnRenamed("family", "guess"))  # one row per family
    scored = scored.join(templates, "guess", "left").withColumn("confirmed", F.coalesce(F.array_max(held), F.lit(0.0)))
    sure = (F.col("probability") >= least) & (F.col("confirmed") >= CONFIRMED)
    # short forms are too few words for the classifier: a piece that is a whole statement needs none
    said = lines.sparkSession.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "exact string, statement string")
    said = F.broadcast(said.select("exact", F.array_join(words(F.col("statement")), " ").alias("said")))  # fixed size
    scored = scored.withColumn("said", F.array_join("words", " ")).join(said, "said", "left")
    harmless = (F.col("guess") == NONE) & (F.col("probability") >= least)
    family = F.coalesce("exact", F.when(sure, F.col("guess")), F.when(harmless, F.lit(NONE)), F.lit(UNKNOWN))
    is_exact = F.col("exact").isNotNull()
    return scored.select(
        *lines.columns, family.alias("family"), F.when(is_exact, 1.0).otherwise(F.col("probability")).alias("probability"),
        F.when(is_exact, 1.0).otherwise(F.col("confirmed")).alias("confirmed"),
    )


def scan(docs: DataFrame, folder: str) -> DataFrame:
    """One row per document: its licence (a family, unknown or none), probability, all families and lines with a cue."""
    docs = docs.select("doc_id", "text")
    lines = stage(paragraphs(docs), folder, "lines")
    if lines.isEmpty():
        none = [F.lit(NONE).alias("license"), F.lit(0.0).alias("probability"), F.array().cast("array<string>").alias("families")]
        return docs.select("doc_id", *none, F.lit(0).cast("long").alias("cue_lines"))
    names = stage(corpus_words(docs), folder, "names")
    model, least = train(stage(training_rows(names), folder, "training"))
    found = classify(lines, model, least)
    named = ~F.col("family").isin(UNKNOWN, NONE)
    known = F.when(named, F.struct((-F.col("probability")).alias("p"), "family"))
    per_doc = found.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.min(known).alias("best"), F.count(F.when(F.col("lines") == 1, 1)).alias("cue_lines"),
        F.array_sort(F.collect_set(F.when(named, F.col("family")))).alias("families"), F.bool_and(F.col("family") == NONE).alias("harmless"),
    )
    per_doc = stage(per_doc, folder, "per_doc")
    listed = docs.select("doc_id").join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    licence = F.when(F.col("cue_lines").isNull() | F.col("harmless"), NONE).otherwise(F.coalesce("best.family", F.lit(UNKNOWN)))
    return listed.select(
        "doc_id", licence.alias("license"), F.coalesce(-F.col("best.p"), F.lit(0.0)).alias("probability"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("cue_lines", F.lit(0)).alias("cue_lines"),
    )
