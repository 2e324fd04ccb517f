"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line, or several that a notice was wrapped to: a line of at most
``WRAPPED`` characters that doesn't end a sentence (``.!?:``) goes on in the next, if both
have words. Comment marks are no words, so a line of them alone parts paragraphs. A
sentence that ends with a line ends the paragraph. Features are the words and word pairs (A to Z lower-cased) that
occur in the templates; each counts once a paragraph. A multinomial logistic
regression gives each family, and the class ``none``, a probability. It is fitted on
the driver, on texts made from the templates (whole, cut short, and inside other
words), on ordinary sentences that use the same words, and on ``SAMPLE`` lines of the
input at most that hold no word of ``CUES``. What is a licence but not surely of one
family is ``unknown``: the least probability for naming a family is calibrated on
models that have not seen the family of the text at hand, against held-out texts of
known families. A named family is confirmed if one of its templates is found again:
``CONFIRM`` of its word pairs at least.

The scan is DataFrame operations alone: words are looked up in a table of the features
by their first word (a few thousand rows, whatever the input), and what is found is
summed by paragraph.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, Scratch, renamed_clashes, table, words_of
from .decontaminate import ascii_lower

#: Notices as they are usually written; each line is a template.
TEMPLATES = {
    "mit": """Released under the MIT License.
Licensed under the MIT license. See LICENSE file in the project root for full license information.
This project is licensed under the terms of the MIT license.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.""",
    "apache": """Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
This software is distributed under the Apache 2.0 license.""",
    "gpl": """This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.
Released under the GPL version 2 or later.
You should have received a copy of the GNU General Public License along with this program.""",
    "lgpl": """This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.
Licensed under the LGPL version 2.1.
This work is licensed under the GNU Lesser General Public License, version 3.""",
    "agpl": """This program is licensed under the GNU Affero General Public License, version 3.
Released under the AGPL version 3.
This work is licensed under the GNU Affero General Public License as published by the Free Software Foundation.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.
Released under the BSD License.
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
Licensed under the 3-clause BSD license.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
Licensed under the Mozilla Public License, version 2.0.
Released under the MPL 2.0.""",
    "epl": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.
Licensed under the Eclipse Public License, version 1.0.""",
    "isc": """Released under the ISC License.
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
Licensed under the ISC license.""",
    "cc-by": """Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
Content is available under a Creative Commons Attribution license.""",
    "cc-by-sa": """Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License.""",
    "cc-by-nc": """Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
Available under CC BY-NC for non-commercial use.""",
    "cc-by-nd": """Licensed under CC BY-ND 4.0.
This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.""",
    "public-domain": """This work is dedicated to the public domain under CC0 1.0.
This is free and unencumbered software released into the public domain.
To the extent possible under law, the author has waived all copyright and related rights to this work.""",
    "proprietary": """All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.
Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.""",
}
ORDINARY = """He lost his driving license and had to ask for permission to drive under supervision.
The license plate of the car was version two of the old design.
The new version was released in public last week, and the software is free to use.
The terms of the agreement were published by the foundation under general conditions.
Please see the file in the project root for full information about the work.
The fishing licence is available at the office without restriction.
The apache helicopter was seen near the commons by any person with attribution to the author.
A copy of the book was distributed with or without charge along the public road.
The students of the institute at mit built this program as a project.
You may obtain a ticket for any purpose, provided that you comply with the following rules.
You should have received a letter from the mozilla office, the eclipse was international news.
The source of the river is free of charge and open to the public domain of the park.
The right to copy was granted, and the work is subject to change as published.""".split("\n")
FAMILIES = ["none", *TEMPLATES]
CUES = r"\b(licen[sc]e[ds]?|copyright|rights|redistribut\w*|gpl|mit|bsd|apache|mozilla|eclipse|commons|cc0?|public|permission)\b"
SAMPLE, CONFIRM, SEED = 1000, 0.7, 3
#: The widest line that may go on in the next.
WRAPPED = 120
_SIGN = r"0-9A-Za-z\x80-\x{10FFFF}"
#: A line's end within a paragraph, in Java's syntax; what the line before holds is looked at only here.
INNER_END = rf"\n(?<=(?:\A|\n)(?=[^\n]*[{_SIGN}])[^\n]{{1,{WRAPPED}}}\n)(?<![.!?:][^{_SIGN}\n]{{0,20}}\n)(?=[^\n]*[{_SIGN}])"
STEPS, RATE, RIDGE = 300, 2.0, 2e-4


def words(text: str) -> list[str]:
    return re.findall(ALNUM_WORD, "".join(c.lower() if c.isascii() else c for c in text))


def grams(text: str) -> set[tuple[str, str]]:
    """Words as (word, ''), and pairs of words."""
    w = words(text)
    return {(a, "") for a in w} | set(zip(w, w[1:]))


TEMPLATE_LINES = [(family, line) for family, text in TEMPLATES.items() for line in text.split("\n")]
VOCABULARY = sorted(set().union(*(grams(line) for _, line in TEMPLATE_LINES)))
_AT = {g: i for i, g in enumerate(VOCABULARY)}


def made(rng: random.Random, family: str, line: str) -> tuple[str, str]:
    """A template as it may stand in a text."""
    w, other = line.split(), lambda n: [rng.choice(("ba", "lo", "ti", "re")) + rng.choice(("ka", "mo", "nu")) for _ in range(rng.randrange(n))]
    if len(w) > 8 and rng.random() < 0.4:  # most of it
        at = rng.randrange(0, len(w) // 3)
        w = w[at : at + max(6, int(len(w) * rng.uniform(0.6, 0.9)))]
    elif rng.random() < 0.2:
        w[rng.randrange(len(w))] = "x"
    return family, " ".join(other(8) + w + other(8))


def examples(rng: random.Random, lines: list[str], each: int) -> list[tuple[str, str]]:
    out = [made(rng, f, line) for f, line in TEMPLATE_LINES for _ in range(each)]
    for line in ORDINARY:
        for _ in range(2 * each):
            w = line.split()
            at = rng.randrange(len(w))
            out.append(("none", " ".join(w[at:] + w[:at] if rng.random() < 0.5 else w[: rng.randrange(2, len(w) + 1)])))
    return out + [("none", line) for line in lines]


def matrix(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), len(VOCABULARY) + 1), np.float32)
    x[:, -1] = 1
    for i, t in enumerate(texts):
        for g in grams(t):
            if g in _AT:
                x[i, _AT[g]] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Softmax regression by gradient steps with momentum; features that are rare in a class keep small weights."""
    w, v, n = np.zeros((x.shape[1], classes), np.float32), 0, len(y)
    scale = 1 / np.sqrt(np.maximum((x**2).sum(1, keepdims=True), 1))
    for _ in range(STEPS):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        v = 0.9 * v - RATE * (x.T @ (p * scale) / n + RIDGE * w)
        w = w + v
    return w


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def calibrate(lines: tuple[str, ...]) -> float:
    """The least probability to name a family: where texts of unseen families are turned away as often as texts of seen ones are named."""
    known, strange = [], []
    for fold in range(5):  # a fifth of the families is unseen each time
        rng = random.Random(SEED + fold)
        unseen = {f for i, f in enumerate(TEMPLATES) if i % 5 == fold}
        seen = [f for f in FAMILIES if f not in unseen]
        train = [(f, t) for f, t in examples(rng, list(lines), 4) if f not in unseen]
        w = fit(matrix([t for _, t in train]), np.array([seen.index(f) for f, _ in train]), len(seen))
        test = [x for x in examples(rng, [], 2) if x[0] != "none"]
        p = probabilities(matrix([t for _, t in test]), w)
        for (f, _), own in zip(test, p, strict=True):
            named = own[1:].max() / max(1e-9, own[1:].sum())
            (strange if f in unseen else known).append(named)
    cuts = np.linspace(0.3, 0.99, 70)
    return float(cuts[np.argmax([np.mean(np.array(known) >= c) + np.mean(np.array(strange) < c) for c in cuts])])


@cache
def model(lines: tuple[str, ...]) -> tuple[np.ndarray, float]:
    """Weights (features and intercept by class) and the least probability to name a family."""
    train = examples(random.Random(SEED), list(lines), 8)
    return fit(matrix([t for _, t in train]), np.array([FAMILIES.index(f) for f, _ in train]), len(FAMILIES)).astype(float), calibrate(lines)


def sample(docs: DataFrame, most: int = SAMPLE) -> tuple[str, ...]:
    """Lines without a cue, of the documents with the smallest hashes of their ids."""
    ids = [r[0] for r in docs.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(100).collect()]
    if not ids:
        return ()
    lines = docs.filter(F.col("doc_id").isin(ids)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s")).filter(~F.col("s").rlike(f"(?i){CUES}"))
    return tuple(r["s"] for r in lines.orderBy("doc_id", "i", "s").limit(most).collect())


def paragraphs(text: Column | str) -> Column:
    """Array of line (the first, from 0) and s, in which a byte of 1 stands for each line's end."""
    marked = F.regexp_replace(F.translate(text, "\x01", "\x02"), INNER_END, "\x01")
    ends = F.regexp_extract_all(marked, F.lit("[\\n\\x01]"), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.array_compact(F.transform(ends, lambda x, i: F.when(x == "\n", i + 1))))
    return F.arrays_zip(starts.alias("line"), F.split(marked, "\n", -1).alias("s"))


def _look_up(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """first, features: for each word, the features that begin with it, as id and second word."""
    by: dict[str, list] = {}
    for i, (a, b) in enumerate(VOCABULARY):
        by.setdefault(a, []).append((i, b))
    return spark.createDataFrame(sorted(by.items()), "first string, features array<struct<id:int,second:string>>")


def scan(docs: DataFrame, fitted: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """A row for each paragraph that is a licence: doc_id, text_key, line (its first), family, probability, similarity, confirmed.

    family is ``unknown`` where none is sure; probability is that of being a licence
    times that of the family among families; similarity is the largest share of a
    template of the family (of any, if unknown) found. Needs doc_id and text, and takes no
    other column. Rows with the same doc_id and text are one document (text_key is the
    text's xxhash64). Null and empty texts have no licence.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    weights, least = fitted or model(sample(docs))
    key = ["doc_id", "text_key", "line"]
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(paragraphs(ascii_lower(F.col("text")))).alias("p")).select("doc_id", "text_key", "p.line", "p.s").select(*key, words_of(F.col("s"), ALNUM_WORD).alias("w"))
    pairs = lines.select(*key, F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p")).select(*key, F.col("p.a").alias("first"), F.col("p.b").alias("next"))
    looked = pairs.join(F.broadcast(_look_up(spark, weights)), "first")  # as many rows as templates have words
    found = looked.select(*key, "next", F.explode("features").alias("f")).filter((F.col("f.second") == "") | (F.col("f.second") == F.col("next"))).select(*key, F.col("f.id").alias("id")).distinct()
    table_ = spark.createDataFrame([(i, weights[i].tolist()) for i in range(len(VOCABULARY))], "id int, w array<double>")
    scored = found.join(F.broadcast(table_), "id").groupBy(*key).agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(FAMILIES))], F.collect_list("id").alias("ids"))
    z = [F.col(f"z{k}") + float(weights[-1, k]) for k in range(len(FAMILIES))]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    scored = scored.select(*key, "ids", F.array(*e).alias("e"))
    families = F.slice("e", 2, len(FAMILIES) - 1)
    scored = scored.withColumn("licence", F.aggregate(families, F.lit(0.0), lambda a, x: a + x)).withColumn("best", F.array_max(families)).filter(F.col("licence") > F.col("e")[0])
    scored = scored.withColumn("own", F.col("best") / F.col("licence")).withColumn("probability", F.col("best") / (F.col("licence") + F.col("e")[0]))
    names = F.array(*map(F.lit, TEMPLATES))
    scored = scored.withColumn("family", F.when(F.col("own") >= least, F.get(names, (F.array_position(families, F.col("best")) - 1).cast("int"))).otherwise("unknown"))
    held = F.lit(0.0)
    for family in TEMPLATES:
        share = F.greatest(*[F.size(F.array_intersect("ids", F.array(*[F.lit(_AT[g]) for g in sorted(grams(line)) if g[1]]))) / float(sum(bool(g[1]) for g in grams(line))) for f, line in TEMPLATE_LINES if f == family] + [F.lit(0.0)])
        held = F.greatest(held, F.when(F.col("family").isin(family, "unknown"), share).otherwise(0.0))
    return scored.select(*key, "family", "probability", held.alias("similarity"), ((F.col("family") != "unknown") & (held >= CONFIRM)).alias("confirmed"))


def licences(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row with n_licences, n_unknown, families and confirmed (sorted names, comma-joined). Clashing columns come back as ``<name>_in``."""
    docs = renamed_clashes(docs, ["n_licences", "n_unknown", "families", "confirmed"], [])
    keep = docs.columns if keep is None else keep
    found = Scratch(docs.sparkSession, "licences").save(scan(docs), "found")
    of = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("family")))), ",")
    each = found.groupBy(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")).agg(F.count("*").alias("n"), F.count_if(F.col("family") == "unknown").alias("u"), of(F.col("family") != "unknown").alias("families"), of(F.col("confirmed")).alias("confirmed"))
    rows = docs.withColumn("__t", F.xxhash64("text")).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "doc_id", "__t"])])
    out = rows.join(each, (F.col("__t") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("n", F.lit(0)).alias("n_licences"), F.coalesce("u", F.lit(0)).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("confirmed", F.lit("")).alias("confirmed"))


def op2_licences(spark, sf_dir) -> DataFrame:
    return licences(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
