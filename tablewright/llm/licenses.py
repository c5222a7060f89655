"""License scan: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over hashed word unigrams and bigrams tells the
families and an unknown class apart.  It is trained on notices written out by rule
from the tables below, on the same sentences with licenses of no family here, on
sentences that merely speak of licenses, and on at most ``max_negatives`` whole
paragraphs of the corpus itself.  A second regression, fitted on notices and paragraphs
held out from the first, turns the margin over the unknown class into a calibrated
probability; below one half a paragraph is unknown.

A predicted family is confirmed by template comparison: the paragraph must hold
``agree`` of the words and pairs of one of the family's templates, and ``agree`` of those
among them that no other family's or other license's templates have, which are what
tells the family.  What is not confirmed is reported as unknown, with the prediction beside.

A paragraph is a run of lines that look wrapped: each but the last has 40 to 100
characters, the next at most 100, and none is blank.  Every other line is a paragraph of
its own.  The lines of a run are looked at one by one as well, so that a notice on one
line is not lost in its neighbours; a run is reported where no single line of it already
confirms its family.

All text work is native: split, explode, hashed term frequencies and Spark ML.

Defined results: null and blank texts have no paragraphs; a line of any length is one
paragraph; families of equal score are taken in the order of ``NAMES``; repeated rows are
scanned each; a null doc_id is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, let, only, staged, text_or_empty

#: Names by family, fixed values.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT license", "Expat License", "X11 License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "new BSD license"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GPL-3.0-or-later", "GNU GPL v2"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "agpl": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "public-domain": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Unlicense", "public domain"],
}
#: Sentences a notice takes.
FRAMES = (
    "Licensed under {the}{name}.",
    "Released under {the}{name}.",
    "Distributed under the terms of {the}{name}.",
    "This work is licensed under {the}{name}.",
    "This file is made available under {the}{name}.",
    "This software is licensed to you under {the}{name}.",
    "SPDX-License-Identifier: {name}",
    "License: {name}",
    "Published under {the}{name}, see the file LICENSE for details.",
    "You may use and copy this under {the}{name}.",
)
#: Customary wording of whole notices.
NOTICES = {
    "apache": ["You may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files, to deal in the Software without restriction"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation"],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
             "License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
            "with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "public-domain": ["This is free and unencumbered software released into the public domain",
                      "To the extent possible under law, the author has waived all copyright and related rights to this work"],
}
#: Sentences that speak of licenses, or share their words, without granting any.
OTHERS = (
    "He lost his driving license on the way to the office.",
    "The license fee was raised again this year.",
    "A fishing license is required in this area.",
    "She released her second album under a new name.",
    "The work is distributed over several sites and teams.",
    "All public documents are kept in the city archive.",
    "The university of the commons opened a general library.",
    "Version 2.0 of the program adds support for more files.",
    "Students at the institute study software and law.",
    "The foundation supports free schools in the region.",
    "Terms and conditions may apply to this offer.",
    "Copy the file to the folder and open it.",
    "The doctor is licensed to practice in two states.",
    "International attribution of the painting remains unclear.",
    "The source of the river lies in the mountains.",
)
#: Licenses that are no family here; sentences with them are unknown.
OTHER_NAMES = (
    "Eclipse Public License 2.0", "EPL-2.0", "ISC License", "Common Development and Distribution License 1.0", "CDDL-1.0",
    "Artistic License 2.0", "WTFPL", "zlib License", "Boost Software License 1.0", "European Union Public Licence 1.2",
    "SIL Open Font License 1.1", "Microsoft Public License", "PostgreSQL License", "Python Software Foundation License",
)
OTHER_NOTICES = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
    "https://www.eclipse.org/legal/epl-2.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except "
    "in compliance with the License",
    "The Artistic License gives the Copyright Holder some semblance of artistic control over the development of the package",
)
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NAMES]


def _framed(name: str) -> list[str]:
    the = "" if name.startswith(("CC", "Creative")) or "-" in name else "the "
    return [frame.format(the=the, name=name) for frame in FRAMES]


def notices() -> list[tuple[str, str]]:
    """(family, text): every frame with every name, and the whole notices."""
    out = [(f, text) for f, names in NAMES.items() for n in names for text in _framed(n)]
    return out + [(f, t) for f, texts in NOTICES.items() for t in texts]


def others() -> list[str]:
    """Texts of no family: other licenses in the same frames, and sentences about licenses."""
    return [text for n in OTHER_NAMES for text in _framed(n)] + [*OTHER_NOTICES, *OTHERS]


def _plain_grams(text: str) -> set[str]:
    """The words and pairs of an ASCII text, as ``_grams`` has them."""
    w = re.findall("[a-z0-9]+", text.lower())
    return {*w, *map(" ".join, zip(w, w[1:]))}


def templates() -> dict[str, list[tuple[set[str], set[str]]]]:
    """By family, the grams of each bare name and notice, and those that no other family
    and no other license has."""
    texts = [(f, n) for f, names in NAMES.items() for n in names] + notices()
    spread = Counter(g for _, g in {(f, g) for f, t in [*texts, *((UNKNOWN, t) for t in others())] for g in _plain_grams(t)})
    out: dict[str, list[tuple[set[str], set[str]]]] = {}
    for f, t in texts:
        grams = _plain_grams(t)
        own = {g for g in grams if spread[g] == 1}
        if own:
            out.setdefault(f, []).append((grams, own))
    return out


def _rows(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(structs))


def _terms(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(terms):
    pairs = F.transform(F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(terms, i), w))
    return F.concat(terms, pairs)


def _with_features(df: DataFrame, features: int) -> DataFrame:
    hashed = HashingTF(numFeatures=features, inputCol="grams", outputCol="features", binary=True)
    return hashed.transform(df.withColumn("grams", let(_terms(F.col("text")), _grams))).drop("grams")


def _runs(lines):
    """(first, last, text, run) of the wrapped runs among ``lines`` and of all single lines."""
    def wrapped(i):  # the break before line i
        a, b = F.get(lines, i - 1), F.get(lines, i)
        return F.length(a).between(40, 100) & (F.length(b) <= 100) & (F.btrim(a, F.lit(SPACES)) != "") & (F.btrim(b, F.lit(SPACES)) != "")

    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | ~wrapped(i))

    def runs(starts):
        def run(s, j):
            last = F.coalesce(F.get(starts, j + 1), F.size(lines)) - 1
            own = F.slice(lines, s + 1, last - s + 1)
            single = F.transform(own, lambda t, k: F.struct((s + k).alias("first"), (s + k).alias("last"), t.alias("text"), s.alias("run")))
            whole = F.struct(s.alias("first"), last.alias("last"), F.array_join(own, "\n").alias("text"), s.alias("run"))
            return F.when(last > s, F.concat(F.array(whole), single)).otherwise(single)

        return F.flatten(F.transform(starts, run))

    return let(starts, runs)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, first, last, text, run): the wrapped runs of lines and the single lines
    of every text that are not blank, with their line numbers; ``row`` tells rows apart."""
    numbered = only(docs, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    each = numbered.select("doc_id", "row", F.inline(let(F.split(text_or_empty(), "\n"), _runs)))
    return each.where(F.btrim("text", F.lit(SPACES)) != "").select(
        "doc_id", "row", F.col("first").cast("long"), F.col("last").cast("long"), "text", F.col("run").cast("long"))


class LicenseModel:
    """The fitted classifier, its calibration and the templates."""

    def __init__(self, classifier: LogisticRegressionModel, calibration: LogisticRegressionModel, features: int, agree: float):
        self.classifier, self.calibration, self.features, self.agree = classifier, calibration, features, agree

    def found(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` (text) that are not unknown, with ``v``: family and calibrated
        probability.  Rows go through a generator, as a filter on the probability would be
        pushed below the classifier and run it again."""
        a, b = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        names = F.array(*[F.lit(f) for f in FAMILIES])

        def verdict(r):
            best = F.array_max(F.slice(r, 2, len(FAMILIES) - 1))
            return F.struct(F.element_at(names, F.array_position(r, best).cast("int")).alias("family"),
                            (1 / (1 + F.exp(-(F.lit(a) * (best - r[0]) + F.lit(b))))).alias("probability"))

        raw = self.classifier.transform(_with_features(df, self.features))
        each = F.filter(F.transform(F.array(vector_to_array("rawPrediction")), verdict), lambda v: v["probability"] >= 0.5)
        return raw.select(*df.columns, F.explode(each).alias("v"))


def _negatives(docs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` whole paragraphs of the corpus that do not name licenses, rights or
    permissions: those with the smallest hash in about 4 * ``most`` documents, which a
    hash of their doc_id picks, so that no task gathers more at any size."""
    named = r"(?i)licen[sc]|copyright|permission|spdx|creative commons|\bcc[ -]?(by|0)|public domain"
    wide = 1 << 30
    share = min(wide, -(-4 * most * wide // max(1, docs.count())))
    some = docs.where(F.pmod(F.xxhash64(F.lit(13), F.col("doc_id")), F.lit(wide)) < share)
    texts = paragraphs(some).where(~F.col("text").rlike(named)).select("text").distinct()
    return staged(texts.orderBy(F.xxhash64("text"), "text").limit(most), "negatives")


def train(docs: DataFrame, max_negatives: int = 2000, features: int = 1 << 14, agree: float = 0.8) -> LicenseModel:
    spark = docs.sparkSession
    whole = {*OTHER_NOTICES, *(t for texts in NOTICES.values() for t in texts)}  # too few to hold any out
    known = _rows(spark, [(f, FAMILIES.index(f), t, t in whole) for f, t in notices()] + [(UNKNOWN, 0, t, t in whole) for t in others()],
                  ["family", "label", "text", "always"])
    unknown = _negatives(docs, max_negatives).select(F.lit(UNKNOWN).alias("family"), F.lit(0).alias("label"), "text", F.lit(False).alias("always"))
    rows = known.unionByName(unknown).coalesce(2).withColumn("label", F.col("label").cast("double"))
    # as much weight for each class, however many paragraphs stand for it; a row a class
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    rows = staged(rows.join(F.broadcast(sizes), "label").withColumn("weight", 1 / F.col("n")).withColumn("held", ~F.col("always") & (F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(4)) == 0)).coalesce(2), "notices")
    classifier = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=0.0005,
                                    maxIter=60, probabilityCol="probability_").fit(_with_features(rows.where("NOT held"), features))
    model = LicenseModel(classifier, None, features, agree)
    raw = classifier.transform(_with_features(rows.where("held"), features)).withColumn("r", vector_to_array("rawPrediction"))
    margin = F.array_max(F.slice("r", 2, len(FAMILIES) - 1)) - F.col("r")[0]
    held = raw.select(array_to_vector(F.array(margin)).alias("m"), (F.col("label") > 0).cast("double").alias("y"), "weight")
    model.calibration = LogisticRegression(featuresCol="m", labelCol="y", regParam=0.001, maxIter=50).fit(held)
    return model


def _compared(found: DataFrame, agree: float) -> DataFrame:
    """``found`` (family, text) with similarity and confirmed."""
    lines = [(f, "\n".join("|".join(sorted(g)) + "\t" + "|".join(sorted(o)) for g, o in ts)) for f, ts in templates().items()]
    table = _rows(found.sparkSession, lines, ["family", "all"])

    def parts(t):
        both = F.split(t, "\t")
        return F.struct(F.split(both[0], r"\|").alias("grams"), F.split(both[1], r"\|").alias("own"))

    table = table.select("family", F.transform(F.split("all", "\n"), parts).alias("templates"))  # a row a family

    def likeness(mine):
        def share(grams):
            return F.size(F.array_intersect(grams, mine)) / F.size(grams)
        return F.array_max(F.transform("templates", lambda t: F.least(share(t["grams"]), share(t["own"]))))

    similarity = let(let(_terms(F.col("text")), _grams), likeness)
    return found.join(F.broadcast(table), "family").withColumn("similarity", similarity).withColumn("confirmed", F.col("similarity") >= agree).drop("templates")


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """(doc_id, paragraph, last_line, family, predicted, probability, similarity, confirmed) of
    every paragraph that the classifier takes for a notice; ``paragraph`` is its first line."""
    found = model.found(paragraphs(docs)).select("doc_id", "row", "first", "last", "text", "run", "v.family", "v.probability")
    found = _compared(found, model.agree).withColumn("whole", F.col("last") > F.col("first"))
    run, kind = W.partitionBy("row", "run"), W.partitionBy("row", "run", "family")  # one row's lines
    sure = F.col("confirmed")
    found = found.withColumns({
        "lines": F.count_if(~F.col("whole")).over(run), "same": F.count_if(~F.col("whole") & sure).over(kind),
        "run_sure": F.count_if(F.col("whole") & sure).over(run) > 0, "run_same": F.count_if(F.col("whole") & sure).over(kind) > 0})
    stays = F.when(F.col("whole"), F.when(sure, F.col("same") != 1).otherwise(F.col("lines") == 0)).otherwise(
        F.when(sure, ~F.col("run_same") | (F.col("same") == 1)).otherwise(~F.col("run_sure")))
    return found.where(stays).select(
        "doc_id", F.col("first").alias("paragraph"), F.col("last").alias("last_line"), F.when(F.col("confirmed"), F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.col("family").alias("predicted"), F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")
