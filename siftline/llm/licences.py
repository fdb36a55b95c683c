"""Licence scans: a trained paragraph classifier, calibrated, and confirmed against templates.

Paragraphs are lines, and runs of lines with words: a run is judged as a whole and in overlapping
windows of words, so that wrapped notices and notices inside long paragraphs are found. Only what
covers a template can count, so runs and windows that cover none are left out first. Features are hashed words and word pairs; a multinomial logistic regression is
fitted to notices of known licences (whole, shortened and with single words left out) and to a
bounded sample of the corpus's own lines as the class ``unknown``. On examples kept aside its
probabilities are rescaled by a temperature, and the probability that a licence needs is set so that
ordinary lines stay below it. A predicted licence counts if its words also cover a template of it.
All in DataFrame functions and Spark's own estimators.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.frames import settled
from siftline.session import literal_rows, stage_table

UNKNOWN = "unknown"
FEATURES = 1 << 13
SAMPLE_DOCS = 400  # documents, about, whose lines teach the unknown class
COVER = 0.75  # of a template's words
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)

# Notices of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Licensed under the BSD 2-Clause License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "Licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC0", "Released into the public domain under CC0 1.0 Universal."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
)
_COMMENT = r"(?im)^[ \t]*(?:dnl|rem)\b"  # other comment marks have no letters and so are in no word
FAMILIES = (UNKNOWN, *sorted({f for f, _ in TEMPLATES}))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _featured(paragraphs: DataFrame, text: str) -> DataFrame:
    """Adds ``_words`` and the hashed words and word pairs in ``_features``."""
    own = F.col("_words")
    pairs = F.transform(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(own, i + 1)))
    grams = paragraphs.withColumn("_words", words(F.col(text))).withColumn("_grams", F.concat(own, pairs))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True).transform(grams)


def _templates(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, [(f, FAMILIES.index(f), t) for f, t in TEMPLATES], ["family", "label", "template"]).withColumn("t_words", F.array_distinct(words(F.col("template"))))


def _cover(template: Column, own: Column) -> Column:
    return F.size(F.array_intersect(template, own)) / F.size(template)


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, paragraph, line) of lines with a letter or digit; paragraphs are numbered from 0."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("paragraph", "line"))
    return rows.filter(F.col("line").rlike("[\\p{L}\\p{N}]"))


def examples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, line): notices with variants, and corpus lines that resemble none of them as unknown."""
    templates = _templates(docs.sparkSession)
    w = F.col("w")
    whole = templates.select("label", F.split("template", " ").alias("w"))
    left_out = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.concat(F.slice(w, 1, i - 1), F.slice(w, i + 1, F.size(w))))
    part = F.ceil(F.size(w) * 0.75).cast("int")
    variants = whole.select("label", F.explode(F.concat(F.array(w, F.slice(w, 1, part), F.slice(w, F.size(w) - part + 1, part)), left_out)).alias("v"))
    notices = variants.select("label", F.array_join("v", " ").alias("line"))
    apart = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.filter(F.pmod(F.xxhash64(doc_id, text), F.lit(apart)) == 0)
    cover = templates.agg(F.collect_list("t_words").alias("all"))  # a fixed number of short lists
    lines = lines_of(sample, doc_id, text).select("line").distinct().join(F.broadcast(cover), F.lit(True))
    plain = lines.filter(~F.exists("all", lambda t: _cover(t, words(F.col("line"))) >= 0.5))
    return notices.unionByName(plain.select(F.lit(0).alias("label"), "line"))


def runs_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, w, at) of runs of lines with a letter or digit: words, and the line of each word."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _COMMENT, "")
    told = settled(docs.select(F.col(doc_id).alias("_id"), F.transform(F.split(plain, "\n"), words).alias("told")), "_id", "told")
    held = lambda i: F.coalesce(F.size(F.get("told", i)) > 0, F.lit(False))
    every = F.sequence(F.lit(0), F.size("told") - 1)
    begins, ends = F.filter(every, lambda i: held(i) & ~held(i - 1)), F.filter(every, lambda i: held(i) & ~held(i + 1))
    bounds = told.withColumns({"begins": begins, "ends": ends}).withColumn("bounds", F.arrays_zip("begins", "ends"))
    runs = bounds.select("_id", "told", F.inline("bounds").alias("a", "b"))
    own = settled(runs.withColumn("own", F.slice("told", F.col("a") + 1, F.col("b") - F.col("a") + 1)), "_id", "a", "own")
    lines = F.flatten(F.transform("own", lambda x, i: F.array_repeat(F.col("a") + i, F.size(x))))
    return settled(own.withColumns({"w": F.flatten("own"), "at": lines}), "_id", "w", "at")


def windows_of(runs: DataFrame) -> DataFrame:
    """(_id, paragraph, line) of whole runs and windows that cover a template; ``paragraph``: the line they begin on.

    Windows begin at each word of the template that is followed by enough others; they are a quarter
    longer than the template, and than the longest one.
    """
    split = [re.findall(r"[^\W_]+", t.lower()) for _, t in TEMPLATES]
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    least = [math.ceil(COVER * len(set(t))) for t in split]
    known = F.array(*[F.struct(texts(sorted(set(t))).alias("t_words"), F.lit(need).alias("need"), F.lit(len(t)).alias("n")) for t, need in zip(split, least)])
    vocabulary = texts(sorted(set().union(*split)))
    met = settled(runs.withColumn("met", F.array_intersect("w", vocabulary)), "_id", "w", "at", "met").filter(F.size("met") >= min(least))
    near = settled(met.withColumn("near", F.filter(known, lambda t: F.size(F.array_intersect(t["t_words"], "met")) >= t["need"])), "_id", "w", "at", "near")
    near = near.filter(F.size("near") > 0).select("_id", "w", "at", F.inline("near"))
    spots = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("t_words", x), i)), lambda i: i.isNotNull())
    near = settled(near.withColumn("spots", spots), "_id", "w", "at", "t_words", "need", "n", "spots")

    def begun(size: Column) -> Column:
        close = F.filter("spots", lambda p, j: F.coalesce(F.get("spots", j + F.col("need") - 1) < p + size, F.lit(False)))
        return F.transform(close, lambda p: F.struct(p.alias("s"), size.alias("k")))

    longest = max(map(len, split))
    whole = F.array(F.struct(F.lit(0).alias("s"), F.size("w").alias("k")))
    spans = F.concat(whole, begun(F.col("n") + F.ceil(F.col("n") / 4).cast("int")), begun(F.lit(longest + -(-longest // 4))))
    cut = near.withColumn("spans", spans).select("_id", "w", "at", "t_words", "need", F.inline("spans"))
    own = settled(cut.withColumns({"own": F.slice("w", F.col("s") + 1, F.col("k")), "paragraph": F.get("at", F.col("s"))}), "_id", "t_words", "need", "own", "paragraph")
    held = own.filter(F.size(F.array_intersect("t_words", "own")) >= F.col("need"))
    return held.select("_id", "paragraph", F.array_join("own", " ").alias("line")).distinct()


@dataclass
class Classifier:
    model: LogisticRegressionModel
    temperature: float
    least: float  # probability that a licence needs

    def classified(self, paragraphs: DataFrame, text: str) -> DataFrame:
        """Adds ``_words``, ``label`` (0: unknown) and ``probability``."""
        scored = _rescaled(self.model.transform(_featured(paragraphs, text)), self.temperature, *paragraphs.columns, "_words")
        label = F.array_position("_raised", F.col("_best")).cast("int") - 1
        return scored.select(*paragraphs.columns, "_words", F.when(F.col("_best") / F.col("_total") >= self.least, label).otherwise(0).alias("label"), (F.col("_best") / F.col("_total")).alias("probability"))


def _rescaled(scored: DataFrame, temperature: float, *keep: str) -> DataFrame:
    """``keep``, the probabilities to the power 1/temperature, their sum, and the largest of a licence."""
    classes = settled(scored.withColumn("_classes", vector_to_array("_probability")), *keep, "_classes")
    raised = settled(classes.withColumn("_raised", F.transform("_classes", lambda p: F.pow(p, F.lit(1 / temperature)))), *keep, "_raised")
    summed = raised.withColumns({"_total": F.aggregate("_raised", F.lit(0.0), lambda a, x: a + x), "_best": F.array_max(F.slice("_raised", 2, len(FAMILIES) - 1))})
    return settled(summed, *keep, "_raised", "_total", "_best")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """Fits and calibrates on notices and about ``SAMPLE_DOCS`` documents of ``docs``."""
    drawn = stage_table(examples(docs, doc_id, text), "examples")
    known = _featured(drawn, "line").withColumn("aside", F.pmod(F.xxhash64("line"), F.lit(5)) == 0)
    sizes = known.groupBy((F.col("label") == 0).alias("plain")).agg(F.count(F.lit(1)).alias("n"))
    n = {r["plain"]: r["n"] for r in sizes.collect()}  # two numbers
    weight = F.when(F.col("label") == 0, F.lit(n.get(False, 1) / max(n.get(True, 1), 1))).otherwise(F.lit(1.0))
    estimator = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw", family="multinomial", regParam=1e-3, maxIter=40)
    every = literal_rows(docs.sparkSession, [(k, FAMILIES[k]) for k in range(len(FAMILIES))], ["label", "line"])  # so that each class is there
    taught = known.filter("not aside").select("label", "_features", weight.alias("weight")).unionByName(_featured(every, "line").select("label", "_features", F.lit(1e-6).alias("weight")))
    model = estimator.fit(taught.repartition(1))
    kept = model.transform(known.filter("aside").select("label", "_features")).select("label", "_probability")
    losses = {}
    for t in TEMPERATURES:
        own = F.element_at("_raised", F.col("label") + 1) / F.col("_total")
        losses[t] = _rescaled(kept, t, "label").agg(F.avg(-F.log(F.greatest(own, F.lit(1e-9)))).alias("loss")).first()["loss"] or 0.0
    temperature = min(TEMPERATURES, key=lambda t: (losses[t], t))
    plain = _rescaled(kept.filter("label = 0"), temperature, "label").agg(F.percentile(F.col("_best") / F.col("_total"), F.lit(0.999)).alias("p")).first()["p"]
    return Classifier(model, temperature, max(0.5, plain or 0.0))


def licences(docs: DataFrame, classifier: Classifier | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id: ``families`` (sorted) and ``paragraphs`` that the classifier and a template agree on.

    ``paragraph``: the number of a line, or of the line on which a window begins; overlapping windows
    of one notice may begin on neighbouring lines.
    Null and empty texts have none. Rows of one id are one document; rows with a null id are one too.
    Equal probabilities go to the family that comes first by name.
    """
    classifier = classifier or fit(docs, doc_id, text)
    lines = lines_of(docs, doc_id, text).unionByName(windows_of(runs_of(docs, doc_id, text)))
    likely = classifier.classified(lines, "line").filter("label > 0")
    templates = _templates(docs.sparkSession).select("label", "family", "t_words")
    matched = likely.join(templates, "label").withColumn("cover", _cover(F.col("t_words"), F.array_distinct("_words")))
    best = F.max(F.struct("cover", "probability"))  # of a line and the windows that begin on it
    confirmed = matched.groupBy("_id", "paragraph", "family").agg(best.alias("best")).select("_id", "paragraph", "family", "best.*").filter(F.col("cover") >= COVER)
    found = confirmed.groupBy(F.col("_id").alias("_key")).agg(
        F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_list(F.struct("paragraph", "family", "probability", "cover"))).alias("paragraphs"),
    )
    rows = docs.select(F.col(doc_id).alias("_id")).distinct().join(found, F.col("_id").eqNullSafe(F.col("_key")), "left")
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,cover:double>>")
    return rows.select(F.col("_id").alias(doc_id), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("paragraphs", none).alias("paragraphs"))
