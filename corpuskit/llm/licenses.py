"""Licence scans of paragraphs by a trained linear classifier, by DataFrame operations alone.

A sparse logistic regression over word 1- and 2-grams names the licence family of a paragraph or
``unknown``; its probabilities are calibrated by a temperature fitted on held-out examples. A
prediction holds only if the paragraph also has most of the word pairs of one of the family's
templates; of a short template it must have the words in order and close together, as everyday prose may
hold its pairs by chance. Distinct paragraphs are classified once, whatever the number of documents with them.

The model is fitted on the driver from the templates below: changed, shortened and surrounded
copies for each family, scattered template words and everyday uses for ``unknown``. Its features are
the n-grams of the templates, so a text without any of ``GATES`` cannot be confirmed and is passed
over early (the pairs of a template without one of these words fall short of ``COVERAGE``; tests hold
that).
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import spread_join
from corpuskit.plans.durable import cut

COVERAGE = 0.6
MIN_PROBABILITY = 0.5
UNKNOWN = "unknown"
SEED = 5
VARIANTS = 8
#: Words of a short template at most, and words that may stand between two of its words.
SHORT, GAP = 12, 3
#: Rows of keys and families, or of keys and a text's notices, that are broadcast at most.
BROADCAST = 200_000

#: Notices by which works declare their licences.
TEMPLATES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD license.",
        "Licensed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is in the public domain under the CC0 1.0 Universal license."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced or transmitted in any form without prior written permission of the copyright owner.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
#: Everyday uses of licence words.
EVERYDAY = [
    "She renewed her driving license last week.", "A fishing license is needed at the lake.", "The court heard a case about copyright law.",
    "Researchers at MIT published a paper on copies of the software.", "The Apache helicopter landed at the base.", "The gnu grazes on the plain with its herd.",
    "The warranty of the machine ends in May.", "The general public was not admitted.", "He gave permission to use the room free of charge.",
    "The terms of the contract were published.", "The foundation offers free software courses to any person.", "All of the above is a work of fiction.",
    "Version 3 of the report was released in April.", "The creative team works in the commons.", "The following conditions are common in source and binary stars.",
]
#: Words of any text, of which a gate is made only if a template has no others.
COMMON = set((
    "a", "all", "and", "any", "are", "as", "at", "be", "by", "copy", "for", "form", "forms", "free", "from",
    "general", "in", "is", "it", "may", "no", "not", "of", "on", "or", "other", "part", "person", "public",
    "published", "source", "that", "the", "this", "to", "under", "use", "via", "with", "work", "you",
))
WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def pairs_of(text: str) -> set[str]:
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def gates() -> tuple[str, ...]:
    """Words of the templates without any of which no text has ``COVERAGE`` of a template's pairs."""
    out = []
    for t in (t for ts in TEMPLATES.values() for t in ts):
        size = len(pairs_of(t))
        while len(rest := [p.split() for p in sorted(pairs_of(t)) if not set(p.split()) & set(out)]) >= COVERAGE * size:
            out.append(max({w for p in rest for w in p}, key=lambda w: (w not in COMMON, sum(w in p for p in rest), len(w), w)))
    return tuple(sorted(out))


#: Texts without any of these words, in lower case, hold no licence notice.
GATES = gates()


def ordered_pattern(family: str) -> str:
    """A pattern of texts in lower case with a part of a short template of the family in its order.

    The part has ``COVERAGE`` of the template's pairs. What reserves all rights does not deny it and
    goes on, if at all, with whom they are reserved to.
    """
    out, between = [], rf"[^a-z0-9]+(?:[a-z0-9.]+[^a-z0-9]+){{0,{GAP}}}?"
    for words in (words_of(t) for t in TEMPLATES[family]):
        if len(words) <= SHORT:
            n = math.ceil(COVERAGE * (len(words) - 1)) + 1
            out += [between.join(map(re.escape, words[i : i + n])) for i in range(len(words) - n + 1) if "rights" not in words]
    if family == "Proprietary":
        out.append(r"(?<!not )all[^a-z0-9]+rights[^a-z0-9]+reserved(?![^\S\n]+(?!by |to |worldwide)[a-z])")
    return rf"(?<![a-z0-9])(?:{'|'.join(sorted(set(out)))})(?![a-z0-9])" if out else "(?!)"


def _in_order(family: Column, paragraph: Column) -> Column:
    """Whether a paragraph in lower case has a short template's words in order."""
    first, *rest = TEMPLATES
    return reduce(lambda c, f: c.when(family == f, paragraph.rlike(ordered_pattern(f))), rest, F.when(family == first, paragraph.rlike(ordered_pattern(first))))


def examples(seed: int = SEED) -> list[tuple[list[str], str]]:
    """Labelled word lists made from the templates and everyday sentences by fixed rules."""
    rng, out = random.Random(seed), []
    pool = [w for s in EVERYDAY for w in words_of(s)]
    every = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t)]
    for family, templates in TEMPLATES.items():
        for t in templates:
            words = words_of(t)
            for i in range(VARIANTS):
                lost = 0.25 * rng.random() if i > 2 and len(words) > 6 else 0
                body = [w for w in words if rng.random() >= lost]
                out.append((rng.choices(pool, k=rng.choice([0, 0, 3, 12])) + body + rng.choices(pool, k=rng.choice([0, 0, 3, 12])), family))
    for i in range(40 * VARIANTS):
        some = rng.choices(pool, k=rng.randint(0, 12)) + rng.choices(every, k=rng.randint(0, 6))
        rng.shuffle(some)
        out.append((some, UNKNOWN))
        out.append((words_of(rng.choice(EVERYDAY)), UNKNOWN))
    return out


@lru_cache(1)
def trained() -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """``(families, grams, weights, bias)``; weights and bias are divided by the calibrating temperature."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    grams = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t))})
    index = {g: i for i, g in enumerate(grams)}
    data = examples()
    x, y = np.zeros((len(data), len(grams))), np.zeros(len(data), int)
    for row, (words, family) in enumerate(data):
        x[row, [index[g] for g in grams_of(words) if g in index]] = 1
        y[row] = families.index(family)
    held = np.arange(len(data)) % 5 == 0
    target = np.eye(len(families))[y]
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    fit = ~held
    for _ in range(200):
        d = (softmax(x[fit] @ w + b) - target[fit]) / fit.sum()
        w -= 4.0 * (x[fit].T @ d + 1e-4 * w)
        b -= 4.0 * d.sum(axis=0)
    z = x[held] @ w + b
    loss = {t: -np.log(softmax(z / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in np.linspace(0.3, 3, 28)}
    t = min(loss, key=loss.get)
    return families, grams, w / t, b / t


def _paragraphs(text: Column) -> Column:
    """Distinct lines of a text in lower case that may hold a notice."""
    return F.array_distinct(F.filter(F.split(text, "\n"), _gated))


def _runs(text: Column, found: Column) -> Column:
    """Distinct runs of two or more adjacent lines, none of which is blank or has its key in ``found``, that may hold a notice."""
    rest = F.transform(F.split(text, "\n"), lambda x: F.when(F.array_contains(found, F.xxhash64(x)), "").otherwise(x))
    runs = F.split(F.array_join(rest, "\n"), r"\n(?:[^a-z0-9\n]*\n)+")
    runs = F.transform(runs, lambda x: F.regexp_replace(x, r"^[^a-z0-9]*\n|\n[^a-z0-9]*$", ""))
    return F.array_distinct(F.filter(runs, lambda x: x.contains("\n") & _gated(x)))


def _gated(text: Column) -> Column:
    """Whether a text in lower case holds a gate word, by the borders of ``WORDS``: a word may follow a number directly."""
    words = "|".join(re.escape(g) + ("" if "." in g else "(?![a-z])") for g in GATES)
    return text.rlike(rf"(?<![a-z])(?:{words})")


def classify(paragraphs: DataFrame) -> DataFrame:
    """``(paragraph_key, family, probability, coverage, sure)`` of the paragraphs of ``paragraphs(paragraph_key, paragraph)`` with most pairs of a template.

    ``sure`` are those that have most pairs of a long one; others are yet to be looked at for the order of words.
    """
    spark = paragraphs.sparkSession
    families, grams, weights, bias = trained()
    columns = ", ".join(f"w{i} double" for i in range(len(families)))
    table = spark.createDataFrame([(g, *map(float, weights[i])) for i, g in enumerate(grams)], f"gram string, {columns}")
    templates = [(f, i, p) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for p in sorted(pairs_of(t))]
    sizes = {(f, i): (len(pairs_of(t)), len(words_of(t)) > SHORT) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)}
    pairs = spark.createDataFrame([(p, f, i, *sizes[f, i]) for f, i, p in templates], "gram string, family string, template int, size int, long boolean")

    words = F.regexp_extract_all("paragraph", F.lit(WORDS), F.lit(0))
    both = F.expr("array_distinct(concat(words, transform(sequence(0, size(words) - 2), i -> concat(words[i], ' ', words[i + 1]))))")
    split = paragraphs.withColumn("words", words).where(F.size("words") >= 2)
    each = split.select("paragraph_key", F.explode(both).alias("gram"))
    scored = each.join(table, "gram").groupBy("paragraph_key").agg(*[(F.sum(f"w{i}") + F.lit(float(bias[i]))).alias(f"z{i}") for i in range(len(families))])
    z = F.array(*[F.struct(F.col(f"z{i}").alias("z"), F.lit(-i).alias("at"), F.lit(f).alias("family")) for i, f in enumerate(families)])
    scored = scored.withColumn("z", z).withColumn("best", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x.z - F.col("best.z")))
    scored = scored.select("paragraph_key", F.col("best.family").alias("family"), (1 / total).alias("probability")).where(F.col("family") != UNKNOWN)
    held = each.join(pairs, "gram").groupBy("paragraph_key", "family", "template").agg((F.count(F.lit(1)) / F.first("size")).alias("coverage"), F.first("long").alias("long"))
    best = F.max(F.when(F.col("long"), F.col("coverage")))
    held = held.groupBy("paragraph_key", "family").agg(F.max("coverage").alias("coverage"), F.coalesce(best >= COVERAGE, F.lit(False)).alias("sure"))
    found = scored.where(F.col("probability") >= MIN_PROBABILITY).join(held, ["paragraph_key", "family"])
    return found.where(F.col("coverage") >= COVERAGE).select("paragraph_key", "family", "probability", "coverage", "sure")


def _meet(rows: DataFrame, table: DataFrame, key: str, table_key: str, how: str = "inner") -> DataFrame:
    """``rows`` with a cut table of distinct keys; where it is large, rows of a key that many have are dealt over tasks."""
    if table.count() <= BROADCAST:
        return rows.join(F.broadcast(table), F.col(key) == F.col(table_key), how)
    return spread_join(rows, table, key, table_key, ["doc_id", "text_key"], how)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, families, n_paragraphs, least_probability, least_coverage)`` of every document with a licence notice.

    One row per distinct id and text: the families of its distinct notices in order, how many
    notices there are, and the least sure of them. Null and empty texts, and texts without a
    confirmed notice, give no row. A notice is a line, or a run of adjacent lines that are not notices
    by themselves, judged whole; a run ends at a line without a letter a to z or digit. Ties between
    families go to the first in order.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.lower(text).alias("text")).where(_gated(F.col("text")))

    def hits(paragraphs: Column, rows: DataFrame) -> DataFrame:
        each = rows.select("doc_id", "text_key", F.explode(paragraphs).alias("paragraph")).withColumn("paragraph_key", F.xxhash64("paragraph"))
        found = cut(classify(each.select("paragraph_key", "paragraph").distinct()).withColumnRenamed("paragraph_key", "found_key"))
        met = _meet(each, found, "paragraph_key", "found_key").where(F.col("sure") | _in_order(F.col("family"), F.col("paragraph")))
        return met.select("doc_id", "text_key", "paragraph_key", "family", "probability", "coverage")

    lines = cut(hits(_paragraphs(F.col("text")), rows))
    known = cut(lines.groupBy(F.col("text_key").alias("known_key")).agg(F.collect_set("paragraph_key").alias("found")))
    rest = _meet(rows, known, "text_key", "known_key", "left")
    runs = hits(_runs(F.col("text"), F.coalesce("found", F.array().cast("array<long>"))), rest)
    return (
        lines.unionByName(runs).groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_set("family")).alias("families"), F.count_distinct("paragraph_key").alias("n_paragraphs"), F.min("probability").alias("least_probability"), F.min("coverage").alias("least_coverage"))
        .drop("text_key")
    )
