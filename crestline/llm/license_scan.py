"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

A multinomial logistic regression over hashed words and word pairs names the licence family of a paragraph, or the
class ``unknown``.  It is trained on the driver from the templates below, thinned and mixed with ordinary words, and a
bounded sample of ordinary paragraphs; its temperature is fitted on examples it was not trained on.  A named family
holds only if the paragraph also has most words of one of the family's templates.  Short tags (``MIT License``, SPDX
identifiers) name their family where no template is confirmed.

A line with a cue word is judged alone first.  If that confirms nothing, groups of lines around it are, up to the next
blank or confirmed line, so that wrapped notices count; the lines of one wrapped notice are one paragraph.

The scan itself is DataFrame functions without a shuffle.  A paragraph without any of the cue words, of which every
template holds one, can't be confirmed and is passed over.

Defined cases: a null or empty text has no licence; repeated rows each get a row; an empty table
gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions.let import let
from crestline.llm.common import read, whole_text

BUCKETS = 2048
#: Ordinary paragraphs that the classifier is trained on, and the documents they may come from.
SAMPLE, SAMPLE_DOCS = 2000, 2000
#: Share of a template's distinct words that a paragraph must have, and least calibrated probability.
COVER, LEAST = 0.75, 0.5
EXAMPLES, EPOCHS, RATE = 24, 200, 4.0
SEED = 5

# fixed values: usual notices of each family
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See the license file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 into the public domain; the license waives all rights.", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."],
}
# fixed values: tags of each family, as words in a row
TAGS: dict[str, list[str]] = {
    "MIT": ["spdx license identifier mit", "mit license", "license mit"],
    "Apache-2.0": ["spdx license identifier apache 2 0", "apache license 2 0", "apache license version 2 0", "license apache 2 0"],
    "GPL-3.0": ["spdx license identifier gpl 3 0", "gnu general public license v3", "license gpl 3 0", "license gplv3", "gplv3 license"],
    "GPL-2.0": ["spdx license identifier gpl 2 0", "gnu general public license v2", "license gpl 2 0", "license gplv2", "gplv2 license"],
    "LGPL-3.0": ["spdx license identifier lgpl 3 0", "gnu lesser general public license v3", "license lgpl 3 0", "license lgplv3", "lgplv3 license"],
    "BSD-3-Clause": ["spdx license identifier bsd 3 clause", "bsd 3 clause license", "license bsd 3 clause"],
    "MPL-2.0": ["spdx license identifier mpl 2 0", "mozilla public license 2 0", "mozilla public license version 2 0", "license mpl 2 0"],
    "CC-BY-4.0": ["spdx license identifier cc by 4 0", "license cc by 4 0"],
    "CC-BY-SA-4.0": ["spdx license identifier cc by sa 4 0", "license cc by sa 4 0"],
    "CC-BY-NC-4.0": ["spdx license identifier cc by nc 4 0", "license cc by nc 4 0"],
    "CC0-1.0": ["spdx license identifier cc0 1 0", "license cc0 1 0"],
}
# fixed values: sentences that use the same words and name no licence
UNKNOWN = (
    "the driver lost his license last year",
    "a license is required for this work",
    "the version of the work is under review",
    "please ask for permission before you copy the files",
    "the public may use the software at home",
    "the copyright office is closed",
    "all seats are reserved",
    "there is no warranty for it",
    "the license terms are listed in another file",
)
CUES = "(?i)licen[cs]e|copyright|permission|rights reserved|redistribut|public domain"
CLASSES = ("unknown", *TEMPLATES)


def words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+", -1), lambda w: w != "")


def grams(word_list: Column) -> Column:
    """Distinct bucket numbers of the words and word pairs."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    one = F.transform(word_list, lambda w: bucket(w))
    two = F.transform(F.sequence(F.lit(1), F.size(word_list) - 1), lambda i: bucket(F.get(word_list, i - 1), F.get(word_list, i)))
    return F.array_distinct(F.concat(one, F.when(F.size(word_list) > 1, two).otherwise(F.array().cast("array<int>"))))


@dataclass
class Model:
    """Weights (class, bucket), biases and the temperature that calibrates them."""

    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    @classmethod
    def fit(cls, rows: list[list[int]], labels: np.ndarray) -> Model:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for k, own in enumerate(rows):
            x[k, own] = 1 / max(1, len(own)) ** 0.5
        held = np.arange(len(rows)) % 5 == 4
        one = np.eye(len(CLASSES), dtype=np.float32)[labels]
        weight, bias = np.zeros((BUCKETS, len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)

        def soft(z: np.ndarray) -> np.ndarray:
            z = np.exp(z - z.max(1, keepdims=True))
            return z / z.sum(1, keepdims=True)

        own, target = x[~held], one[~held]
        for _ in range(EPOCHS):
            error = soft(own @ weight + bias) - target
            weight -= RATE * (own.T @ error / len(own) * 10 + 1e-4 * weight)
            bias -= RATE * error.mean(0)
        z = x[held] @ weight + bias
        loss = lambda t: -np.log(soft(z / t)[np.arange(len(z)), labels[held]] + 1e-9).mean()
        temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        return cls(weight.T.astype(float), bias.astype(float), temperature)

    def logits(self, gram_list: Column) -> Column:
        """One calibrated logit per class."""

        def one(k: int) -> Column:
            table = F.split(F.lit(",".join(f"{w:.3f}" for w in self.weight[k])), ",").cast("array<double>")
            total = F.aggregate(gram_list, F.lit(0.0), lambda a, g: a + F.get(table, g))
            scaled = total / F.sqrt(F.greatest(F.size(gram_list), F.lit(1)))
            return (scaled + F.lit(float(self.bias[k]))) / F.lit(self.temperature)

        return F.array(*[one(k) for k in range(len(CLASSES))])


def train(docs: DataFrame) -> Model:
    """Fit on thinned templates against ordinary paragraphs of about ``SAMPLE_DOCS`` documents, chosen by a hash."""
    spark = docs.sparkSession
    rate = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    lines = some.select(F.explode(F.split(whole_text(), "\n")).alias("p")).where(~F.col("p").rlike(CUES) & (F.length("p").between(20, 1000)))
    plain = sorted(r["p"] for r in lines.distinct().orderBy(F.xxhash64("p")).limit(SAMPLE).collect())
    pool = [w for p in plain for w in p.split()] or ["and"]
    rng = np.random.default_rng(SEED)
    examples: list[tuple[str, int]] = [(p, 0) for p in plain]

    def thinned(text: str, share: float) -> str:
        own = [w for w in text.split() if rng.random() > share]
        around = [pool[i] for i in rng.integers(0, len(pool), int(rng.integers(0, 12)))]
        cut = int(rng.integers(0, len(around) + 1))
        return " ".join([*around[:cut], *own, *around[cut:]])

    for k, family in enumerate(CLASSES):
        for template in UNKNOWN if k == 0 else TEMPLATES[family]:
            examples += [(thinned(template, 0.1 * (j % 3)), k) for j in range(EXAMPLES)] + [(template, k)]
    table = spark.createDataFrame(examples, "p string, label int").select("p", "label", grams(words(F.col("p"))).alias("g"))
    rows = sorted((r["label"], r["p"], r["g"]) for r in table.collect())
    order = rng.permutation(len(rows))
    return Model.fit([rows[i][2] for i in order], np.array([rows[i][0] for i in order]))


def _cover(word_list: Column, family: Column) -> Column:
    """Largest share of a template's words that the paragraph has, over the templates of its family."""
    import re

    best = F.lit(0.0)
    for name, templates in TEMPLATES.items():
        for template in templates:
            own = sorted(set(re.findall("[a-z0-9]+", template.lower())))
            share = F.size(F.array_intersect(word_list, F.array(*[F.lit(w) for w in own]))) / F.lit(float(len(own)))
            best = F.greatest(best, F.when(family == name, share).otherwise(F.lit(0.0)))
    return best


def judge(paragraph: Column, model: Model) -> Column:
    """Struct of one paragraph: family, probability, cover; a family that is not confirmed becomes ``unknown``."""
    names = F.array(*[F.lit(c) for c in CLASSES])

    def named(own: Column, z: Column) -> Column:
        top = F.array_max(z)
        family = F.get(names, F.array_position(z, top).cast("int") - 1)
        probability = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
        found = F.struct(family.alias("family"), probability.alias("probability"), _cover(own, family).alias("cover"))
        confirmed = lambda f: (f["cover"] >= COVER) & (f["probability"] >= LEAST)
        tag = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        tagged = F.coalesce(*[F.when(tag.rlike(f" (?:{'|'.join(tags)}) "), F.lit(name)) for name, tags in TAGS.items()])
        sure = F.lit(1.0)
        return let(
            found,
            lambda f: F.when(confirmed(f) | tagged.isNull(), F.struct(
                F.when(confirmed(f), f["family"]).otherwise(F.lit("unknown")).alias("family"), f["probability"].alias("probability"), f["cover"].alias("cover")
            )).otherwise(F.struct(tagged.alias("family"), sure.alias("probability"), sure.alias("cover"))),
        )

    return let(words(paragraph), lambda own: let(model.logits(grams(own)), lambda z: named(own, z)))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, families, n_paragraphs, n_unknown, paragraphs) for every row of ``docs``.

    ``families`` are the distinct confirmed families, sorted and comma-joined; ``n_paragraphs`` counts their paragraphs
    and ``n_unknown`` those with a cue word but no confirmed family.  ``paragraphs`` lists line number (from 0), family,
    probability and cover of every paragraph with a cue word.
    """
    model = model or train(docs)
    # a line's last sentences carry the notice; the words before it do not count against it
    lines = F.transform(F.split("text", "\n", -1), lambda p, i: F.struct(i.alias("line"), p.alias("p")))
    cued = F.filter(lines, lambda s: s["p"].rlike(CUES))
    alone = F.transform(cued, lambda s: F.struct(s["line"].alias("line"), judge(_notice(s["p"]), model).alias("j"), F.lit(-1).alias("block")))
    unknown = lambda a: a["j"]["family"] == "unknown"

    def grouped(found: Column) -> Column:
        """The lines judged alone, those without a family again with the lines around them."""
        sure = F.transform(F.filter(found, lambda a: ~unknown(a)), lambda a: a["line"])
        return let(F.transform(F.split("text", "\n", -1), lambda p, i: F.when(F.array_contains(sure, i), F.lit("")).otherwise(p)), lambda rest: widened(found, rest))

    def widened(found: Column, rest: Column) -> Column:
        def again(a: Column) -> Column:
            judged = F.transform(_groups(rest, a["line"]), lambda g: judge(_notice(g), model))
            best = F.array_max(F.transform(F.filter(judged, lambda j: j["family"] != "unknown"), lambda j: F.struct(j["cover"], j["probability"], j.alias("j"))))
            block = F.size(F.filter(F.slice(rest, 1, a["line"] + 1), lambda p: ~p.rlike("[A-Za-z0-9]")))
            return let(best, lambda b: F.when(b.isNull(), a).otherwise(F.struct(a["line"].alias("line"), b["j"].alias("j"), block.alias("block"))))

        return let(F.transform(found, lambda a: F.when(unknown(a), again(a)).otherwise(a)), merged)

    def merged(found: Column) -> Column:
        """Without the later lines of a wrapped notice."""
        same = lambda a, b: (a["block"] >= 0) & (a["block"] == b["block"]) & (a["j"]["family"] == b["j"]["family"]) & (a["line"] - b["line"] <= _REACH)
        return F.filter(found, lambda a, k: ~F.coalesce(same(a, F.get(found, k - 1)), F.lit(False)))

    judged = let(alone, lambda found: F.when(F.exists(found, unknown), grouped(found)).otherwise(found))
    flat = F.transform(judged, lambda s: F.struct(s["line"].alias("line"), s["j"]["family"].alias("family"), s["j"]["probability"].alias("probability"), s["j"]["cover"].alias("cover")))
    none = F.array().cast("array<struct<line:int,family:string,probability:double,cover:double>>")
    found = F.when(F.col("text").rlike(CUES), flat).otherwise(none)
    rows = docs.select("doc_id", whole_text().alias("text")).select("doc_id", found.alias("paragraphs"))
    sure = F.filter("paragraphs", lambda p: p["family"] != "unknown")
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_paragraphs"),
        (F.size("paragraphs") - F.size(sure)).cast("long").alias("n_unknown"),
        "paragraphs",
    )


#: Sentences around a cue that are judged with it, so that a notice at the end of a long line stands out.
_AROUND = 2


#: Lines before and after a cue that are judged with it, and how far the cues of one wrapped notice lie apart.
_GROUPS = ((0, 1), (1, 0), (1, 1), (0, 3), (3, 3), (0, 7))
_REACH = 8


def _groups(lines: Column, at: Column) -> Column:
    """Texts of the groups of lines around line ``at`` (from 0), each cut at lines without a letter or digit."""
    blank = "\\n[^A-Za-z0-9\\n]*(?=\\n)"

    def group(back: int, on: int) -> Column:
        low = F.greatest(at - back, F.lit(0))
        before = F.concat(F.lit("\n"), F.array_join(F.slice(lines, low + 1, at - low), "\n"), F.lit("\n"))
        after = F.concat(F.array_join(F.slice(lines, at + 1, F.lit(on + 1)), "\n"), F.lit("\n"))
        return F.concat(F.element_at(F.split(before, blank, -1), -1), F.get(F.split(after, blank, -1), F.lit(0)))

    return F.array_distinct(F.transform(F.array(*[group(b, o) for b, o in _GROUPS]), lambda g: F.trim(F.regexp_replace(g, "\\s+", " "))))


def _notice(paragraph: Column) -> Column:
    """The sentences of a paragraph from the first cue's to a few after the last cue's."""
    sentences = F.split(paragraph, "(?<=[.;:])\\s+", -1)

    def cut(s: Column) -> Column:
        hits = F.filter(F.transform(s, lambda x, i: F.when(x.rlike(CUES), i)), lambda i: i.isNotNull())
        return let(
            hits,
            lambda h: F.when(
                F.size(h) > 0, F.array_join(F.slice(s, F.array_min(h) + 1, F.array_max(h) - F.array_min(h) + _AROUND), " ")
            ).otherwise(F.array_join(s, " ")),
        )

    return let(sentences, cut)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE: dict[str, str] = {}
