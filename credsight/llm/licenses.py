"""Licence scans: a trained paragraph classifier and a comparison with templates.

Paragraphs are the lines, and the joined lines of every stretch of lines that have
a letter or digit.  They are described by the word n-grams (1 to 3) of a vocabulary
that comes from the licence templates; hyphens part words.  A sparse multinomial
logistic regression tells licence families apart from everything else; the class of
everything else is calibrated: a family is only predicted above the probability that
all but ``FALSE_SHARE`` of the held-out other paragraphs stay under.  A prediction is
confirmed when the paragraph contains ``CONFIRM`` of the word pairs of one of the
family's templates.  Joined lines are also found, and confirmed, for a family that
isn't the predicted one, when they contain all pairs of a template of ``LONG`` pairs.

Joined lines add what their lines don't tell: a family confirmed by a longer template
than any line confirms it by (it replaces those of its lines: a wrapped notice whose
name stands in one line), or a likely one where no line has any finding.

The model is trained here on the templates, on notices around the licences' names, and
on paragraphs made from them by rule (kept whole, cut, framed, shuffled into nonsense,
taken as single words), a few thousand rows whatever the input.  The fitted weights say which paragraphs can't
reach a family: without any of the ``needed`` words and word pairs, all the n-grams
that remain, together, leave every family under the threshold.  Text without any of
them is left out by one expression, with the result of scoring it all.

Defined cases: a null or empty text has no findings; repeated paragraphs are
findings of their own; rows may repeat; an empty table gives an empty table; a
paragraph of any length is read whole.

Scale: no text is shuffled.  Findings (few, no text) are grouped by row key and
joined back to the ids.  Templates and model have fixed sizes.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import stop_words
from . import common as C

OTHER = "other"
FALSE_SHARE, LEAST, CONFIRM, LONG, SEED = 0.01, 0.5, 0.8, 4, 7
TOKEN = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"

TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the MIT License.",
            "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
            "MIT-licensed.", "The code is MIT-licensed.", "publish, distribute, sublicense, and/or sell copies",
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Apache License Version 2.0, January 2004",
                   "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis",
                   "You may not use this file except in compliance with the License. You may obtain a copy of the License"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
            "BSD-licensed.", "The code is BSD-licensed.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
            "SPDX-License-Identifier: BSD-2-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 2 or later.",
            "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2", "SPDX-License-Identifier: EUPL-1.2"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
            "SPDX-License-Identifier: ISC"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable",
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
             "SPDX-License-Identifier: Zlib"],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
              "SPDX-License-Identifier: BSL-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
            "Creative Commons Attribution 4.0 International"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
            "Creative Commons Attribution-ShareAlike 4.0 International"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
            "Creative Commons Attribution-NonCommercial 4.0 International"],
    "public-domain": ["This is free and unencumbered software released into the public domain.",
                      "This work is in the public domain.", "Released into the public domain by the authors.", "Dedicated to the public domain.",
                      "Released into the public domain under CC0 1.0, no rights reserved.", "SPDX-License-Identifier: CC0-1.0"],
    "all-rights": ["All rights reserved.", "Copyright. All rights reserved.", "Proprietary and confidential. All rights reserved.",
                   "No part of this publication may be reproduced without prior written permission of the publisher."],
}
# What a licence is called, and what stands around its name in a notice.
NAMES = {
    "mit": ["MIT License", "Expat License"],
    "apache-2.0": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license"],
    "bsd": ["BSD License", "Modified BSD License", "New BSD License", "BSD 2-Clause License", "3-clause BSD license", "BSD-style license"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL", "GPL, version 3", "GPLv2", "GPLv3", "GPL v2"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPL, version 3", "LGPLv2.1", "LGPLv3"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPL, version 3", "AGPLv3"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License, Version 2.0", "MPL 2.0"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL 2.0"],
    "eupl": ["European Union Public Licence", "EUPL", "EUPL 1.2"],
    "isc": ["ISC License", "ISC licence"],
    "zlib": ["zlib License", "zlib/libpng license"],
    "boost": ["Boost Software License", "Boost Software License, Version 1.0"],
}
TITLES = ["{}", "{}", "The {}", "License: {}"]
NOTICES = ["Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This library is available under the {}.",
           "You may use it under the {} or not at all.", "The source code is subject to the {}.", "Copying is permitted by the {}"]
FRAMES = ["{}", "{}", "Note: {}", "This file: {}", "{} See the file for details.", "(c) The authors. {}"]
OTHERS = ["The driver showed a licence to the officer.", "She asked for permission to leave the room.", "A table was reserved for four people.",
          "The warranty of the car ends in May.", "He lost his fishing license near the lake.", "Permission was denied by the council.",
          "Seats are reserved for members of the club.", "Copyright law is taught in the second year.", "The court discussed copyright and patents.",
          "Redistribution of wealth was the topic of the debate.", "The confidential letter was read aloud.", "A proprietary blend of herbs and spices.",
          "Licensing fees rose again this year.", "The pub lost its license after the complaint.", "Rights were reserved to the states by the amendment.",
          "No license plate was found at the scene.", "Your warranty does not cover water damage.", "The planning permission expired last week.",
          "Er kam mit der Bahn und ging mit dem Hund nach Hause.", "She studied at MIT and works in the public sector.",
          "The public domain name was sold.", "A creative person is free to work under this version of the plan.",
          "The nurse is licensed under the supervision of a doctor.", "He was released under the terms of the bail.", "Food was distributed under the terms of the treaty.",
          "The library is available under the bridge.", "You may use it under the table or not at all.", "The source code is subject to the review of the team.",
          "Copying is permitted by the teacher.", "The eclipse was seen by the public of the European Union.", "The boost in software sales made the general happy.",
          "The general public has no license.", "Apache helicopters were released.", "A public license was issued to the Union.", "A license of version 2.0 of the software."]


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0))


def _runs(tok: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.size(tok) - n), lambda i: F.concat_ws(" ", *[F.get(tok, i + j) for j in range(n)]))
    return F.when(F.size(tok) >= n, runs).otherwise(F.array().cast("array<string>"))


def with_grams(df: DataFrame) -> DataFrame:
    """Columns pairs (2-grams) and grams (1- to 3-grams) of the column line, made once: no later filter or
    column repeats the work below a generator."""
    def made(tok: Column) -> Column:
        return C.let(_runs(tok, 2), lambda pairs: F.struct(pairs.alias("pairs"), F.concat(tok, pairs, _runs(tok, 3)).alias("grams")))

    return df.withColumn("_made", F.explode(F.array(C.let(tokens(F.col("line")), made)))).withColumns({"pairs": F.col("_made.pairs"), "grams": F.col("_made.grams")}).drop("_made")


def _words(line: str) -> list[str]:
    return re.findall(r"\w+(?:\.\w+)*", line.lower())


def training_rows(seed: int = SEED) -> list[tuple[str, str, bool]]:
    """(line, family, held out) made from the templates by rule."""
    rng, rows = random.Random(seed), []
    called = [f" {' '.join(_words(name))} " for names in NAMES.values() for name in names]
    for family, lines in TEMPLATES.items():
        for line in lines:
            for frame in FRAMES:
                rows.append((frame.format(line), family))
                rows.append((frame.format(line.rstrip(".").lower()), family))
            words = _words(line)
            pairs = set(zip(words, words[1:]))
            for _ in range(6 * (len(words) > 3)):    # the same words out of order are no licence
                for _ in range(40):
                    rng.shuffle(words)
                    some = " ".join(words[: max(2, len(words) // 2)])
                    if not pairs & set(zip(words, words[1:])) and not any(x in f" {some} " for x in called):
                        rows.append((some, OTHER))
                        break
            if len(line.split()) > 8:
                rows.append((" ".join(line.split()[: len(line.split()) * 3 // 4]), family))
    rows += [(x, family) for family, names in NAMES.items() for name in names
             for notice in NOTICES + TITLES
             for x in (notice.format(name), notice.format(name).lower().rstrip("."))]
    rows += [(frame.format(x), OTHER) for x in OTHERS for frame in FRAMES] + [("", OTHER)] * 40
    own = {w for names in NAMES.values() for name in names if len(_words(name)) == 1 for w in _words(name)}    # they mean nothing else
    words = sorted({w for told in (TEMPLATES, NAMES) for lines in told.values() for line in lines for w in _words(line)} - own)
    rows += [(w, OTHER) for w in words]         # nor is a word alone, any number of them, or a pair that families share
    shared = Counter(p for lines in TEMPLATES.values() for p in {p for line in lines for p in zip(_words(line), _words(line)[1:])})
    common = set(stop_words())                  # and what has only stop words is none either
    threes = {p for lines in TEMPLATES.values() for line in lines for p in zip(_words(line), _words(line)[1:], _words(line)[2:])}
    bare = [p for p in sorted(shared) if shared[p] > 1 or common.issuperset(p)] + [p for p in sorted(threes) if common.issuperset(p)]
    rows += [(" ".join(p), OTHER) for p in bare for _ in range(3)]
    rows += [(" ".join(rng.sample(words, n)), OTHER) for n in (5, 10, 20, 40, 80, len(words)) for _ in range(20)]
    rng.shuffle(rows)
    return [(line, family, i % 4 == 0) for i, (line, family) in enumerate(rows)]


@dataclass
class Scanner:
    """The fitted vocabulary, regression and calibrated threshold."""

    families: list[str]
    vector: CountVectorizerModel
    regression: LogisticRegressionModel
    threshold: float

    def needed(self) -> list[str]:
        """Words and word pairs one of which is in every paragraph that a family can be predicted for."""
        names = self.vector.vocabulary
        weights, b = self.regression.coefficientMatrix.toArray(), self.regression.interceptVector.toArray()
        gain = np.maximum(weights[1:] - weights[0], 0.0)            # over the class of everything else
        room = np.log(self.threshold / (1 - self.threshold)) - (b[1:] - b[0]) - 1e-6
        parts = []
        for g in names:
            w = g.split(" ")
            parts.append({*w, *(" ".join(x) for x in zip(w, w[1:]))})
        total = {x: max(gain[:, [x in p for p in parts]].sum(axis=1)) for x in set().union(*parts)}
        own = {g: float(max(gain[:, i])) for i, g in enumerate(names)}
        common, free = set(stop_words()), set()
        prose = common | {w for line in OTHERS for w in _words(line)}

        def order(x: str) -> tuple:                                 # words of prose and pairs of stop words, other words, other pairs
            return (not (common if " " in x else prose).issuperset(x.split(" ")), " " in x, own.get(x, 0.0), total[x], x)

        for x in sorted(total, key=order):                          # what together stays under the room
            if (gain[:, [p <= free | {x} for p in parts]].sum(axis=1) < room).all():
                free.add(x)
        return sorted(set(total) - free)

    def possible(self) -> Callable[[Column], Column]:
        """Whether a text has a needed word or pair."""
        tree: dict[str, dict[str, set[str]]] = {}
        for x in self.needed():
            w, _, after = x.partition(" ")
            tree.setdefault(w[0], {}).setdefault(w[1:], set()).add(after)
        gap = r"[^\p{L}\p{N}]+"

        def then(after: set[str]) -> str:
            return "" if "" in after else f"{gap}(?:{'|'.join(re.escape(x) for x in sorted(after))})"

        some = "|".join(f"{k}(?:{'|'.join(re.escape(w) + then(x) for w, x in sorted(rest.items()))})" for k, rest in sorted(tree.items()))
        return lambda text: F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{some})(?![\p{{L}}\p{{N}}])")

    def classify(self, lines: DataFrame) -> DataFrame:
        """Adds family, probability (of the best family, other included) and chances (of all) to rows with grams."""
        out = self.regression.transform(self.vector.transform(lines))
        out = out.withColumn("_p", F.explode(F.array(vector_to_array("probability"))))      # once a row, as in with_grams
        named = F.array(*[F.lit(f) for f in self.families])
        best = F.array_max("_p")
        family = F.element_at(named, F.array_position("_p", best).cast("int"))
        out = out.withColumn("probability", best).withColumn("family", F.when(best >= self.threshold, family).otherwise(OTHER))
        return out.withColumnRenamed("_p", "chances").drop("features", "rawPrediction", "prediction")


def fit(spark: SparkSession, seed: int = SEED) -> Scanner:
    """Train on the rows made from the templates; nothing here depends on the corpus."""
    families = [OTHER, *TEMPLATES]
    rows = training_rows(seed)
    frame = spark.createDataFrame([(line, float(families.index(f)), held) for line, f, held in rows], "line string, label double, held boolean")
    frame = with_grams(frame.coalesce(1))
    vocabulary = sorted({g for r in frame.where("label > 0 AND NOT held").select("grams").collect() for g in r.grams})
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    vector.setBinary(True)
    made = vector.transform(frame).cache()
    regression = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60).fit(made.where("NOT held"))
    scanner = Scanner(families, vector, regression, LEAST)
    judged = scanner.regression.transform(made.where("held AND label = 0")).withColumn("_p", vector_to_array("probability"))
    top = F.array_max(F.slice("_p", 2, len(families)))
    high = judged.agg(F.percentile(top, F.lit(1 - FALSE_SHARE))).first()[0]
    scanner.threshold = min(0.95, max(LEAST, high or 0.0))
    made.unpersist()
    return scanner


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, line) for told in (TEMPLATES, NAMES) for f, lines in told.items() for line in lines]
    rows += [(f, f"the {name}") for f, names in NAMES.items() for name in names if len(_words(name)) == 1]
    t = with_grams(spark.createDataFrame(rows, "template_family string, line string").coalesce(1))
    return t.where(F.size("pairs") > 0).select("template_family", F.array_distinct("pairs").alias("template_pairs"))


def paragraphs(docs: DataFrame, possible: Callable[[Column], Column]) -> DataFrame:
    """row_key, block (number of its first line, from 0), paragraph (number of the first line), joined
    and line of the possible lines and of the joined lines of the possible blocks."""
    some = docs.where(possible(F.col("text"))).select(C.row_key("doc_id", "text").alias("row_key"), "text")
    # lines carry their number, so that blocks can be cut apart: two line feeds or more stand between them
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(x.rlike(r"[\p{L}\p{N}]"), F.concat(i.cast("string"), F.lit("\t"), x)).otherwise(""))
    blocks = some.select("row_key", F.explode(F.split(F.array_join(numbered, "\n"), "\n{2,}")).alias("_block"))
    blocks = blocks.withColumn("joined", F.regexp_replace("_block", r"(?md)^[0-9]+\t", "")).where(possible(F.col("joined")))

    def unit(at: Column, joined: bool, line: Column) -> Column:
        return F.struct(at.cast("int").alias("paragraph"), F.lit(joined).alias("joined"), line.alias("line"))

    def one(x: Column) -> Column:
        at = F.substring_index(x, "\t", 1)
        return unit(at, False, F.substring(x, F.length(at) + 2, F.length(x)))

    whole = F.regexp_replace("_block", r"^\n+", "")
    first = F.substring_index(whole, "\t", 1)
    each = F.split(whole, "\n+", -1)
    units = F.concat(F.transform(F.filter(each, lambda x: x != ""), one),
                     F.when(F.size(each) > 1, F.array(unit(first, True, F.col("joined")))).otherwise(F.array().cast("array<struct<paragraph:int,joined:boolean,line:string>>")))
    out = blocks.select("row_key", first.cast("int").alias("block"), F.explode(units).alias("_u")).select("row_key", "block", "_u.*")
    return out.where(possible(F.col("line")))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """row_key, paragraph (number of its first line, from 0), family, probability, similarity and
    confirmed of every paragraph that a family is found for."""
    templates = _templates(docs.sparkSession)         # a few dozen rows, fixed
    told = F.array(*[F.lit(x) for x in sorted({x for r in templates.collect() for x in r.template_pairs})])
    scored = scanner.classify(with_grams(paragraphs(docs, scanner.possible()))).where((F.col("family") != OTHER) | F.col("joined"))
    # a long paragraph is held against all pairs once, and its few known pairs against each template
    scored = scored.withColumn("pairs", F.explode(F.array(F.array_intersect("pairs", told))))
    t = F.broadcast(templates)
    predicted = F.col("family") == F.col("template_family")
    near = F.size(F.array_intersect("pairs", "template_pairs")) / F.size("template_pairs")
    named = F.array(*[F.lit(f) for f in scanner.families])
    found = (scored.join(t, predicted | (F.col("joined") & (F.size("template_pairs") >= LONG))).withColumn("similarity", near)
             .where(predicted | (F.col("similarity") == 1))
             .withColumn("probability", F.element_at("chances", F.array_position(named, F.col("template_family")).cast("int")))
             .groupBy("row_key", "block", "paragraph", "joined", F.col("template_family").alias("family"))
             .agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity"),
                  F.max(F.when(F.col("similarity") >= CONFIRM, F.size("template_pairs"))).alias("_told"))
             .withColumn("confirmed", F.col("similarity") >= CONFIRM))
    block = Window.partitionBy("row_key", "block")
    same = Window.partitionBy("row_key", "block", "family")
    joined, sure = F.col("joined"), F.col("confirmed")
    most = F.coalesce(F.max(F.when(~joined & sure, F.col("_told"))).over(same), F.lit(0))
    whole = F.coalesce(F.max(F.when(joined & sure, F.col("_told"))).over(same), F.lit(0))
    found = found.withColumns({"_line": F.max(~joined).over(block), "_longer": whole > most})
    stays = F.when(joined, F.when(sure, F.col("_longer")).otherwise(~F.col("_line"))).otherwise(~F.col("_longer"))
    return found.where(stays).select("row_key", "paragraph", "family", "probability", "similarity", "confirmed")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: numbers of predicted and confirmed paragraphs, the confirmed families, and all findings."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(spark))
    told = F.concat_ws(":", F.col("paragraph").cast("string"), "family", F.when(F.col("confirmed"), "confirmed").otherwise("likely"))
    per = found.groupBy("row_key").agg(
        F.count("*").alias("n_found"), F.count_if("confirmed").alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", told.alias("told")))), lambda x: x.told), ",").alias("findings"))
    rows = docs.select("doc_id", C.row_key("doc_id", "text").alias("row_key"))
    return rows.join(per, "row_key", "left").select(
        "doc_id", F.coalesce("n_found", F.lit(0)).cast("bigint").alias("n_found"),
        F.coalesce("n_confirmed", F.lit(0)).cast("bigint").alias("n_confirmed"),
        F.coalesce("families", F.lit("")).alias("families"), F.coalesce("findings", F.lit("")).alias("findings"))
