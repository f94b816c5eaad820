"""Licence scans: a paragraph classifier over sparse word n-grams, and templates that confirm what it says.

A multinomial logistic regression over the templates' word n-grams is fitted on the driver, on variations of the
templates and on paragraphs that aren't licences; the latter make up the unknown class. A temperature calibrates the
probabilities: it is fitted on templates that a model like it has not seen, one of each family. Scanning uses DataFrame
operations only: the model is a table of n-grams and weights of bounded size, and paragraphs are scored by joining
their n-grams with it. A paragraph ends at a blank line, or at a line's end after a sentence's; so wrapped lines belong
together.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import stage

GRAMS, UNKNOWN, LEAST_PROBABILITY, LEAST_CONTAINED = (1, 2, 3), "unknown", 0.5, 0.5
VARIATIONS, ROUNDS, RATE, DECAY = 16, 300, 0.5, 1e-4
#: Paragraphs longer than PIECE characters are read in pieces that overlap by more than the longest template.
PIECE, OVERLAP = 1 << 16, 1 << 10
PARAGRAPHS = r"(?<=[.!?:;])[ \t\r]*\n|\n[ \t\r]*\n"
WORD = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"

#: Words of which a licence paragraph has one at least; a paragraph without any is unknown.
CUES = (
    "licens", "licenc", "copyright", "warrant", "permission", "redistribut", "public domain", "spdx", "copyleft", "all rights reserved",
    "apache", "gpl", "gnu ", "bsd", "mpl", "mozilla public", "cc by", "cc-by", "cc0", "creative commons", "unencumbered",
)

#: Usual notices of licence families.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache-2.0",
        "Apache 2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "Distributed under the GPL v3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GPL v3.",
        "GPLv3",
        "GPL-3.0",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "Licensed under the GNU GPL, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GPL v2",
        "GPL-2.0",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "LGPL v3",
    ),
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL v3 license.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "AGPL v3",
        "AGPL-3.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "MPL 2.0",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "CC BY 4.0",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "CC BY-SA 4.0",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "CC BY-NC 4.0",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Published under CC0 1.0.",
        "CC0 1.0",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    ),
}

#: Sentences with the cues that name no licence, and ordinary words to vary paragraphs with.
OTHER = (
    "She renewed her driving licence last week.", "The police issued a search warrant on Monday.", "He asked permission to leave the room.", "You need a license to fish here.",
    "The warranty covers parts and labour for two years.", "Copyright law has a long history.", "The park redistributes water to the valley.", "The bar lost its liquor license.",
    "With your permission we will begin.", "The results warrant a closer look.", "A pilot's licence takes a year to earn.", "The song is about copyright and money.",
    "Licensed professionals must renew each year.", "The plumber is licensed and insured.", "They released the album under a new name.", "A licensed dealer sold the car under contract.",
    "Please see the license for details.", "This software is licensed, not sold.", "The court granted permission for the appeal.", "The files are public domain or copyright of their owners, it is said.",
    "An Apache helicopter landed on the field.", "The Apache people live in the south-west.", "A gnu is a large antelope.", "The council's debate about the license went on.", "The debate on the MIT license continued.",
)
FILLER = "the of and a to in is was for on that with as by at from this it an be are or not have had they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under never same another know while last might us great go come since against right came take used himself few house use place during high without again home around small however found".split()

_word = re.compile(WORD)


def words_of(paragraph: str) -> list[str]:
    return _word.findall(paragraph.lower())


def grams_of(paragraph: str) -> set[str]:
    """The distinct word n-grams of a paragraph that has a cue; of any other, none."""
    low = paragraph.lower()
    if not any(c in low for c in CUES):
        return set()
    w = words_of(paragraph)
    return {" ".join(w[i : i + n]) for n in GRAMS for i in range(len(w) - n + 1)}


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  # the last is UNKNOWN
    grams: tuple[str, ...]
    weights: np.ndarray  # grams x families, divided by the temperature
    bias: np.ndarray
    templates: tuple[tuple[str, int, frozenset[str]], ...]  # family, number, n-grams

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """Family, its probability, and the share of its closest template's n-grams that the paragraph has."""
        found = grams_of(paragraph)
        place = {g: i for i, g in enumerate(self.grams)}
        z = self.bias + sum((self.weights[place[g]] for g in sorted(found) if g in place), np.zeros(len(self.families)))
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        shares = [len(found & g) / len(g) for f, _, g in self.templates if f == self.families[best]]
        return self.families[best], float(p[best]), max(shares, default=0.0)


def _vary(text: str, r: random.Random) -> str:
    """text with up to a fifth of its words left out, and ordinary words around it."""
    words = [w for w in text.split() if r.random() > r.choice((0, 0, 0.1, 0.2))] or text.split()
    return " ".join([*r.choices(FILLER, k=r.choice((0, 0, 2, 6))), *words, *r.choices(FILLER, k=r.choice((0, 0, 2, 6)))])


def _examples(templates: dict[str, tuple[str, ...]], other: tuple[str, ...], seed: int) -> tuple[list[str], np.ndarray]:
    """Paragraphs and their classes, in the order of TEMPLATES and then unknown: variations, the first of each as it is."""
    r, families = random.Random(seed), list(TEMPLATES)
    out = [(_vary(t, r) if k else t, families.index(f)) for f, ts in templates.items() for t in ts for k in range(VARIATIONS)]
    out += [(_vary(t, r) if k else t, len(families)) for t in other for k in range(VARIATIONS)]
    out += [(f"{' '.join(r.choices(FILLER, k=r.randrange(4, 30)))} {c} {' '.join(r.choices(FILLER, k=r.randrange(4)))}", len(families)) for c in ("license", "copyright", "warranty", "permission", "licensed under", "redistribution", "all rights reserved by") for _ in range(VARIATIONS)]
    return [t for t, _ in out], np.array([k for _, k in out])


def _matrix(texts: list[str], grams: tuple[str, ...]) -> np.ndarray:
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(texts), len(grams)), np.float32)
    for i, t in enumerate(texts):
        x[i, [place[g] for g in grams_of(t) if g in place]] = 1
    return x


def _trained(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial logistic regression, by steps scaled to past gradients."""
    classes = len(TEMPLATES) + 1
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    square_w, square_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    target = np.eye(classes, dtype=np.float32)[y]
    for _ in range(ROUNDS):
        d = (_softmax(x @ w + b) - target) / len(y)
        gw, gb = x.T @ d + DECAY * w, d.sum(0)
        square_w += gw * gw
        square_b += gb * gb
        w -= RATE * gw / np.sqrt(square_w)
        b -= RATE * gb / np.sqrt(square_b)
    return w, b


@lru_cache(2)
def fit_licences(seed: int = 5) -> LicenceModel:
    """The same model each time. Its tables have some thousand rows, whatever is scanned."""
    grams = tuple(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(t)} | {g for t in OTHER for g in grams_of(t) if " " not in g}))
    # the temperature is fitted where a model has not been trained: on one template of each family, and a fourth of the others
    aside = {f: ts[1:2] for f, ts in TEMPLATES.items()}
    texts, y = _examples({f: tuple(t for t in ts if t not in aside[f]) for f, ts in TEMPLATES.items()}, tuple(t for i, t in enumerate(OTHER) if i % 4 != 3), seed)
    w, b = _trained(_matrix(texts, grams), y)
    texts, y = _examples(aside, OTHER[3::4], seed + 1)
    z = _matrix(texts, grams) @ w + b
    cost = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-9).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    t = min(cost, key=cost.get)
    texts, y = _examples(TEMPLATES, OTHER, seed)
    w, b = _trained(_matrix(texts, grams), y)
    templates = tuple((f, i, frozenset(grams_of(s))) for f, ts in TEMPLATES.items() for i, s in enumerate(ts))
    # rounded, so that sums don't depend on their order
    return LicenceModel((*TEMPLATES, UNKNOWN), grams, np.round(w / t, 4).astype(np.float64), np.round(b / t, 4).astype(np.float64), templates)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _has_cue(low: Column) -> Column:
    out = F.lit(False)
    for cue in CUES:
        out = out | low.contains(cue)
    return out


def _runs(words: Column, n: int) -> Column:
    """Each n words that follow one another, joined by spaces."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table written into the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_id, low (the text in lower case, null where it has no cue), written once: a row keeps its number."""
    low = F.lower(F.col(text_col))
    return stage(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.when(_has_cue(low), low).alias("low")), "hits")


def licence_paragraphs(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each paragraph of docs that is a licence: doc_id, row_id, paragraph (from 0), family, probability, contained, confirmed.

    Paragraphs end as PARAGRAPHS says. probability: the model's, calibrated; families below LEAST_PROBABILITY count as
    unknown and give no row. contained: the share of n-grams of the family's closest template that the paragraph has;
    confirmed from LEAST_CONTAINED on. A paragraph of over PIECE characters is read in overlapping pieces, and its
    likeliest piece counts, so that n-grams of one piece only are held at a time. Null and empty texts give no row;
    repeated and null ids are rows of their own. Ties go to the family first in model.families.
    """
    return _paragraphs(_hits(docs, id_col, text_col), model or fit_licences())


def _paragraphs(hits: DataFrame, model: LicenceModel) -> DataFrame:
    spark, key = hits.sparkSession, ["row_id", "paragraph", "piece"]
    whole = hits.filter("low is not null").select("doc_id", "row_id", F.posexplode(F.split("low", PARAGRAPHS)).alias("paragraph", "all")).filter(_has_cue(F.col("all")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("all") - 1), F.lit(PIECE))
    pieces = whole.select("*", F.explode(starts).alias("piece")).select("doc_id", *key, F.col("all").substr(F.col("piece") + 1, F.lit(PIECE + OVERLAP)).alias("part")).filter(_has_cue(F.col("part")))
    some = [_runs(F.col("w"), n) for n in GRAMS]
    grams = pieces.select("doc_id", *key, F.regexp_extract_all("part", F.lit(f"({WORD})"), 1).alias("w")).select("doc_id", *key, F.explode(F.array_distinct(F.concat(*some))).alias("gram"))
    weights = F.broadcast(_table(spark, [{"gram": g, "weights": w.tolist()} for g, w in zip(model.grams, model.weights)], "gram:string,weights:array<double>"))
    weighted = grams.join(weights, "gram")
    sums = weighted.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), *[F.sum(F.col("weights")[k].cast("decimal(18,4)")).alias(f"w{k}") for k in range(len(model.families))], F.collect_list("gram").alias("found"))
    z = [F.col(f"w{k}").cast("double") + float(b) for k, b in enumerate(model.bias)]
    top = F.greatest(*z)
    exps = [F.exp(v - top) for v in z]
    total = sum(exps[1:], exps[0])
    best = F.lit(len(z) - 1)
    for k in range(len(z) - 1, -1, -1):
        best = F.when(z[k] == top, F.lit(k)).otherwise(best)
    scored = sums.select("doc_id", *key, "found", F.element_at(F.array(*map(F.lit, model.families)), best + 1).alias("family"), (1 / total).alias("probability"))
    scored = scored.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))
    templates = F.broadcast(_table(spark, [{"of": f, "grams": sorted(g)} for f, _, g in model.templates], "of:string,grams:array<string>"))
    share = F.size(F.array_intersect("found", "grams")) / F.size("grams")
    compared = scored.join(templates, F.col("family") == F.col("of")).groupBy(*key).agg(
        F.first("doc_id").alias("doc_id"), F.first("family").alias("family"), F.first("probability").alias("probability"), F.max(share).alias("contained")
    )
    likeliest = F.max_by(F.struct("doc_id", "family", "probability", "contained"), F.struct("probability", -F.col("piece"))).alias("is")
    one = compared.groupBy("row_id", "paragraph").agg(likeliest).select("is.doc_id", "row_id", "paragraph", "is.family", "is.probability", "is.contained")
    return one.withColumn("confirmed", F.col("contained") >= LEAST_CONTAINED)


def licence_scan(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, licences (families found, sorted, joined by commas; '' for none), n_paragraphs
    (licence paragraphs), n_confirmed, first_paragraph (null for none), probability (the least of them, rounded; null for none).

    Rows are read once and numbered then; rules for nulls, ties and long texts as in licence_paragraphs().
    """
    hits = _hits(docs, id_col, text_col)
    found = _paragraphs(hits, model or fit_licences()).groupBy(F.col("row_id").alias("of")).agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"), F.count("*").alias("n_paragraphs"), F.count_if("confirmed").alias("n_confirmed"),
        F.min("paragraph").alias("first_paragraph"), F.round(F.min("probability"), 4).alias("probability"),
    )
    zero = F.lit(0).cast("long")
    return hits.select("doc_id", "row_id").join(found, F.col("row_id") == F.col("of"), "left").select(
        "doc_id", "row_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_paragraphs", zero).alias("n_paragraphs"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), "first_paragraph", "probability"
    )
