"""Licence scans by a trained paragraph classifier, in DataFrame expressions and JVM code only.

A paragraph is a run of lines: comment marks go, and a line that does not end with a closing mark goes on in
the next one, up to a blank line; so a notice that is wrapped over several lines is one paragraph. It is described
by its words and pairs of neighbours (small letters, ``GPLv3`` is ``gpl 3``); the vocabulary is what the examples
of licences hold. A multinomial logistic regression with L1 sparsity tells the licence families, ``unknown``
(a licence of another name, or of none) and ``none`` apart. It is trained from notices, whole and in parts; from
short declarations, which are all names of a family in all sentences that declare one; from the same sentences with
names of other licences, or without a name; and from paragraphs that are none: a fixed list of sentences that use
the same words otherwise, and at most MAX_NEGATIVES different first paragraphs of the corpus without a marker.

Calibration: a second model is trained without the held-out notices, sentences and names of other licences. Its
scores of these, which no training row resembles, give the temperature of the probabilities, and the probability
below which a licence counts as unknown, where held-out known and unknown licences are told apart best.

A family is confirmed if the paragraph holds, in order, CONFIRMS of the neighbouring pairs of one of its notices, or
of one of its declarations with a word that names the family.

Every paragraph is judged, but most need no score: the weights prove which words a paragraph must hold to be
anything but ``none`` (``gate``). ``n_candidates`` counts the paragraphs that hold such a word.

The result is one row per document: the licence paragraph with the best evidence (confirmed, then
probable; ties by family and place). Defined cases: null and empty texts have no paragraphs and are
``none``; texts and lines of any length are read whole; repeated rows are judged each; a null doc_id is passed on.
Other columns are not touched. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import Scratch, column, once, table

#: Names of the families' licences, and the words that tell them.
NAMES = {
    "agpl": ("GNU Affero General Public License", "GNU AGPL", "AGPL-3.0", "AGPLv3"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache 2.0", "Apache"),
    "bsd": ("BSD 3-Clause", "BSD", "2-Clause BSD", "BSD-style"),
    "cc-by": ("Creative Commons Attribution 4.0 International", "CC BY 4.0", "CC-BY"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0", "CC-BY-NC"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0", "CC-BY-SA"),
    "cc0": ("CC0 1.0", "CC0", "Creative Commons Zero"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPL-3.0", "GPLv2"),
    "isc": ("ISC",),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPL-2.1", "LGPLv3"),
    "mit": ("MIT",),
    "mpl": ("Mozilla Public License", "MPL 2.0", "MPL"),
    "unlicense": ("Unlicense",),
}
TELLING = {"agpl": "affero agpl", "apache": "apache", "bsd": "bsd", "cc-by": "attribution by", "cc-by-nc": "noncommercial nc", "cc-by-sa": "sharealike sa", "cc0": "cc0 zero", "gpl": "general gpl", "isc": "isc", "lgpl": "lesser lgpl", "mit": "mit", "mpl": "mozilla mpl", "unlicense": "unlicense"}
#: Sentences that declare a licence; those of HELD_OUT only calibrate.
DECLARED = ("Licensed under the {} license.", "Released under the {} License.", "Released under {}.", "This work is licensed under a {} License.", "This program is licensed under the {}, version 3.", "Distributed under the terms of the {}.", "This code is {} only.", "{} applies to this file.", "SPDX-License-Identifier: {}", "This software is dual-licensed under {} and a commercial license.")
DECLARED_HELD_OUT = ("Licensed under {}.", "Available under {} or later.", "Use of this source code is governed by a {} license that can be found in the file.", "License: {}", "Distributed under the {}.")
#: Names of other licences.
OTHER_NAMES = ("Artistic License 2.0", "zlib", "Boost Software License", "Microsoft Public License", "Open Font License", "PostgreSQL License", "CDDL-1.0", "Sleepycat", "Open Software License 3.0")
OTHER_NAMES_HELD_OUT = ("EUPL-1.2", "Eclipse Public License 2.0", "WTFPL", "Python Software Foundation License", "Educational Community License")
#: Notices that hold no name.
NOTICES = {
    "agpl": ("You can redistribute it and/or modify it under the terms of the GNU Affero General Public License",),
    "apache": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0."),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "proprietary": ("All rights reserved.", "Copyright (c) the authors. All rights reserved.", "This software is confidential and proprietary; no part may be copied or redistributed without written permission."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Dedicated to the public domain."),
}
UNNAMED = ("Licensed under the license.", "Subject to the terms of the public license.", "The license of this project.", "It uses the open license.", "This work is licensed under a license.", "See the license for details.", "Released under an open source license.", "Permission to copy is granted under the following license.", "The software is provided as is, without warranty of any kind, express or implied.", "This software is distributed without any warranty, without even the implied warranty of merchantability or fitness for a particular purpose.")
UNNAMED_HELD_OUT = ("The program is provided as is without warranty of any kind.", "Distributed under the following license.")
#: Words that speak of licences, and sentences that use them otherwise.
MARKERS = "license licensed licenses licensing licence licenced copyright copyrighted rights reserved redistribute redistribution redistributed permission permitted spdx-license-identifier gnu gpl lgpl agpl mpl bsd apache mozilla cc cc0 creative commons proprietary warranty".split()
OTHERWISE = ("The driver lost his license after the accident.", "She applied for a fishing licence in spring.", "Human rights are discussed in this chapter.", "The right of way is not reserved for cyclists.", "Tables can be reserved by phone.", "He asked for permission to leave early.", "The Apache helicopter landed at noon.", "A herd of gnu crossed the river.", "Creative people meet in the commons.", "The license plate was dirty.", "Parking is permitted on Sundays.", "All rights come with duties.", "The committee will redistribute the seats.", "A licensed electrician must do the work.", "The debate about copyright went on for hours.", "Mozilla was founded in California.", "He studied at MIT for two years.", "The software is new and the public liked it.", "A general spoke to the public.", "The warranty ends after two years.", "You can use it for any purpose.", "The artistic director left the theatre.", "The program is free on Sundays.", "This work is done.")
#: Telling words that are words of other kinds, or of other languages.
PLAIN_WORDS = ("mit", "sa", "by", "general", "attribution", "zero", "lesser", "apache", "unlicense", "isc", "cc", "mit der", "mit dem", "sa mit")
MAX_NEGATIVES, SAMPLED, NONE_ODDS, CONFIRMS = 2_000, 2_000, 10.0, 0.6


def normal(text: Column) -> Column:
    """Small letters, with versions set apart from names: ``GPLv3``, ``GPL v. 3`` and ``GPL-3`` are ``gpl 3``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, r"(gpl|mpl|epl|bsd|apache|cddl|eupl)v?\.?([0-9])", "$1 $2")
    return F.regexp_replace(low, r"(?<![a-z0-9])v\.? ?([0-9])", "$1")


def word_list(normal_text: Column) -> Column:
    """Runs of letters and digits, with dots inside."""
    return F.filter(F.transform(F.split(normal_text, r"[^a-z0-9.]+"), lambda x: F.trim(x, F.lit("."))), lambda x: x != "")


def pairs(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order. Comment marks at the start of lines go; a line that ends without a closing mark goes on in the next."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[\x20\t]*(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--|(?i:rem|dnl)(?=\s))[\x20\t]*", "")
    plain = F.regexp_replace(plain, r"([^\s.!?:…])[\x20\t\r]*\n[\x20\t]*(?=\S)", "$1 ")
    return F.split(plain, "\n")


def _words(text: str) -> list[str]:
    low = re.sub(r"(gpl|mpl|epl|bsd|apache|cddl|eupl)v?\.?([0-9])", r"\1 \2", text.lower())
    low = re.sub(r"(?<![a-z0-9])v\.? ?([0-9])", r"\1", low)
    return [w for w in (x.strip(".") for x in re.split(r"[^a-z0-9.]+", low)) if w]


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def examples(held_out: bool = False) -> list[tuple[str, str]]:
    """(class, paragraph) to train from, or those that only calibrate: notices, declarations, other licences, other sentences."""
    declared, other, unnamed = (DECLARED_HELD_OUT, OTHER_NAMES_HELD_OUT, UNNAMED_HELD_OUT) if held_out else (DECLARED, OTHER_NAMES, UNNAMED)
    out = [(family, d.format(n)) for family, names in NAMES.items() for n in names for d in declared]
    out += [("unknown", d.format(n)) for n in other for d in declared]
    out += [("unknown", t) for t in unnamed for _ in range(3)]
    for family, texts in NOTICES.items():
        for t in texts:
            w = t.split()
            half = len(w) // 2
            if held_out:  # the middle part, of notices that are long enough to tell
                out += [(family, " ".join(w[len(w) // 4 : -(len(w) // 4)]))] if len(w) >= 16 else []
            else:
                out += [(family, t)] * 6 + ([(family, " ".join(w[:half])), (family, " ".join(w[half:]))] if len(w) >= 16 else [])
    return out + ([] if held_out else [("none", t) for t in (*OTHERWISE, *PLAIN_WORDS) for _ in range(4)])


def templates() -> dict[str, list[list[str]]]:
    """For each family, of its notices and declarations: the pairs; those of declarations come behind a first item of telling words."""
    out: dict[str, list[list[str]]] = {}
    for family, names in NAMES.items():
        out[family] = [[f"?{TELLING[family]}", *dict.fromkeys(_pairs(_words(d.format(n))))] for n in names for d in (*DECLARED, *DECLARED_HELD_OUT)]
    for family, texts in NOTICES.items():
        out.setdefault(family, []).extend(["?", *dict.fromkeys(_pairs(_words(t)))] for t in texts)
    return out


class Scanner:
    """The trained classifier: ``verdicts`` judges rows with a column ``words`` (those of a paragraph)."""

    def __init__(self, spark: SparkSession, negatives: DataFrame):
        """``negatives``: a bounded table of paragraphs (column ``paragraph``) that are no licences."""
        self.spark = spark
        self.classes = [*sorted({*NAMES, *NOTICES}), "unknown", "none"]
        code = {f: float(i) for i, f in enumerate(self.classes)}
        vocabulary = sorted({g for _, t in examples() for w in [_words(t)] for g in w + _pairs(w)})
        self.vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
        self.vectors.setBinary(True)
        none = negatives.select(F.lit(code["none"]).alias("label"), "paragraph", (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0).alias("out"))
        made = lambda out: spark.createDataFrame([(code[f], t, out) for f, t in examples(out)], "label double, paragraph string, out boolean")
        rows = made(False).unionByName(made(True)).unionByName(none).coalesce(1)  # some thousands of rows
        rows = self._vectors(rows.withColumn("words", word_list(normal(F.col("paragraph"))))).cache()
        # classes weigh alike, but for none: most paragraphs are none, so what holds no word of the vocabulary is
        kinds = {r.label: r.n for r in rows.filter("NOT out").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        mean = sum(kinds.values()) / len(kinds)
        weight = F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, mean / n * (NONE_ODDS if k == code["none"] else 1.0))])
        weighted = rows.filter("NOT out").withColumn("weight", weight[F.col("label")])
        learner = LogisticRegression(weightCol="weight", maxIter=60, regParam=0.001, elasticNetParam=0.9, family="multinomial", standardization=False)
        judge = learner.fit(weighted)
        self.temperature, self.least = self._calibrated(judge, rows.filter("out"))
        self.model: LogisticRegressionModel = judge
        # how common words are where there is no licence
        words = rows.filter(F.col("label") == code["none"]).select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        self.common = {r.w: r.n / kinds[code["none"]] for r in words.filter(F.col("w").isin([g for g in vocabulary if " " not in g])).collect()}  # words of the vocabulary
        rows.unpersist()

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return self.vectors.transform(rows.withColumn("grams", F.concat("words", pairs(F.col("words")))))

    def _calibrated(self, model: LogisticRegressionModel, rows: DataFrame) -> tuple[float, float]:
        """The temperature under which held-out rows are most likely, and the least probability of a family that is told best."""
        scored = model.transform(rows).select("label", vector_to_array("rawPrediction").alias("m")).collect()  # some hundreds of rows
        m, y = np.array([r.m for r in scored]), np.array([int(r.label) for r in scored])
        weight = np.where(y == len(self.classes) - 1, 1 / max(1, (y == len(self.classes) - 1).sum()), 1 / max(1, (y != len(self.classes) - 1).sum()))

        def probabilities(t: float) -> np.ndarray:
            e = np.exp((m - m.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = [2 ** (k / 4) for k in range(-8, 9)]
        t = min(grid, key=lambda t: -(weight * np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12)).sum())
        p, unknown = probabilities(t), self.classes.index("unknown")
        known, best = y < unknown, p.argmax(axis=1)

        def told(least: float) -> float:
            """Balanced share of known licences that keep their right family, and of unknown ones that get none."""
            sure = (best < unknown) & (p.max(axis=1) >= least)
            return (sure & (best == y))[known].mean() + (~sure)[y == unknown].mean()

        steps = [k / 20 for k in range(4, 19)]
        most = max(told(x) for x in steps)
        good = [x for x in steps if told(x) == most]
        return t, good[len(good) // 2]

    def gate(self) -> list[str]:
        """Words one of which a paragraph must hold to be anything but ``none``, those that are rare elsewhere first.

        Without them, no class is likelier than ``none``, whatever other words it holds.
        """
        w, b = self.model.coefficientMatrix.toArray(), np.array(self.model.interceptVector.toArray())
        lift, start = np.maximum(w[:-1] - w[-1], 0), b[:-1] - b[-1]
        parts = [g.split() for g in self.vectors.vocabulary]
        at = {word: [i for i, p in enumerate(parts) if word in p] for word in {x for p in parts for x in p}}
        out: list[str] = []
        while at and (start + lift.sum(axis=1)).max() >= 0:
            left = lift.sum(axis=0)
            worth = {word: left[i].sum() for word, i in at.items()}
            word = max(sorted(worth), key=lambda x: worth[x] / (1e-3 + self.common.get(x, 0.0)))
            if not worth[word]:
                raise ValueError("the model takes an empty paragraph for a licence")
            out.append(word)
            lift[:, at.pop(word)] = 0
        return sorted(out)

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """Add family, probability, similarity and status ('confirmed', 'unconfirmed', 'unknown', 'none')."""
        scored = self.model.transform(self._vectors(rows))
        scored = scored.withColumn("m", vector_to_array("rawPrediction")).drop("rawPrediction", "probability", "prediction", "features")
        scored = once(scored, e=F.transform("m", lambda x: F.exp((x - F.array_max("m")) / self.temperature)))
        names = F.array(*[F.lit(f) for f in self.classes])
        scored = once(scored, f=F.element_at(names, F.array_position("m", F.array_max("m")).cast("int")), p=F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        held = F.from_json(F.lit(json.dumps(templates())), "map<string,array<array<string>>>")
        share = lambda t: F.size(F.array_intersect("grams", t)) / (F.size(t) - 1)
        named = lambda t: (t[0] == "?") | F.arrays_overlap("words", F.split(F.substring(t[0], 2, 100), " "))
        similar = F.array_max(F.transform(F.filter(F.element_at(held, F.col("f")), named), share))
        scored = once(scored, similarity=F.coalesce(similar, F.lit(0.0)))
        unsure = (F.col("f") == "unknown") | ((F.col("f") != "none") & (F.col("p") < self.least))
        status = F.when(F.col("f") == "none", "none").when(unsure, "unknown").when(F.col("similarity") >= CONFIRMS, "confirmed").otherwise("unconfirmed")
        return scored.select(*[F.col(c) for c in rows.columns], F.when(unsure, "unknown").otherwise(F.col("f")).alias("family"), F.col("p").alias("probability"), "similarity", status.alias("status"))


def negatives(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """Different first paragraphs without a marker, of MAX_NEGATIVES texts that are first in an order by hash (of their first SAMPLED characters)."""
    starts = docs.select(F.substring(column(text), 1, SAMPLED).alias("start")).filter("start <> ''").withColumn("h", F.xxhash64("start"))
    first = starts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy("h").limit(MAX_NEGATIVES).select(F.col("h").alias("of"))
    chosen = starts.join(F.broadcast(first), F.col("h") == F.col("of")).select("start").distinct()  # MAX_NEGATIVES rows
    marker = F.lit(r"(^|[^a-z0-9])(" + "|".join(sorted(MARKERS)) + r")($|[^a-z0-9])")
    lines = scratch.keep(chosen, "starts").select(paragraphs(F.col("start"))[0].alias("paragraph"))
    return lines.filter(~F.regexp_like(F.lower("paragraph"), marker) & (F.length("paragraph") > 0)).distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, family, status, probability, similarity, paragraph_no, n_candidates."""
    s = Scratch(docs.sparkSession, "licences")
    scanner = Scanner(docs.sparkSession, negatives(docs, s, text))
    gate = scanner.gate()
    first = "".join(sorted({x[0] for x in gate}))
    holds = F.lit(r"(?:^|[^a-z0-9])(?=[" + first + r"])(?:" + "|".join(re.escape(x) for x in gate) + r")(?![a-z0-9])")
    named = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    may = F.regexp_like(normal(F.col("text")), holds)
    # a text without such a word has no paragraph with one
    found = F.transform(paragraphs(F.col("text")), lambda x, i: F.struct(i.alias("no"), word_list(normal(x)).alias("words")))
    found = F.filter(found, lambda x: F.arrays_overlap(x["words"], F.array(*[F.lit(g) for g in gate])))
    rows = once(named, found=F.when(may, found)).select("doc_id", "found", F.coalesce(F.size("found"), F.lit(0)).alias("n_candidates"))
    rows = s.keep(rows.withColumn("n_candidates", F.greatest("n_candidates", F.lit(0))).withColumn("uid", F.monotonically_increasing_id()), "rows")
    none = rows.filter("n_candidates = 0").select("doc_id", F.lit("none").alias("family"), F.lit("none").alias("status"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("paragraph_no"), "n_candidates")
    judged = scanner.verdicts(rows.filter("n_candidates > 0").select("uid", "doc_id", "n_candidates", F.inline("found")))
    order = F.struct(F.when(F.col("status") == "confirmed", 0).otherwise(1).alias("a"), (-F.col("probability")).alias("b"), F.col("family").alias("c"), F.col("no").alias("d"))
    told = F.when(F.col("status") != "none", F.struct(order.alias("o"), "family", "status", "probability", "similarity", "no"))
    best = judged.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_candidates").alias("n_candidates"), F.min(told).alias("b"))
    best = best.select("doc_id", F.coalesce("b.family", F.lit("none")).alias("family"), F.coalesce("b.status", F.lit("none")).alias("status"), "b.probability", "b.similarity", F.col("b.no").alias("paragraph_no"), "n_candidates")
    return none.unionByName(best)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: one row per row of ``documents``."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
