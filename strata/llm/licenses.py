"""Licence scans in DataFrame functions alone: Dice coefficient over word bigrams against templates.

A document is taken as its whole text, its paragraphs (parted by empty lines) and its lines. Each part
is normalised (A-Z to lower case, every run of other ASCII characters than letters and digits to one
space) and compared with licence templates by word bigrams: of a part each as often as it occurs, of a
template once. With a and b bigrams the Dice coefficient is at most 2 min(a, b) / (a + b), so only
templates whose size bounds hold a part's size are candidates, and parts that suit no template are
dropped by their number of words, before any bigram is made. Templates are a
parameter of fixed size, so all work is row by row: no shuffle, and no row meets another.

Defined results: null and empty texts have no parts and no licence; a text of one word has one bigram,
that word alone; equal texts have equal results; ties in score go to the smaller licence id; an empty
table gives no rows; other columns pass through (the added ones must not be there already).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices and licence texts by id; fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("proprietary", "Copyright. All rights reserved."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), OTHER, " "))


def template_bigrams(text: str) -> list[str]:
    words = re.sub(OTHER, " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, words).otherwise(pairs)


def bounds(templates, threshold: float) -> tuple[int, int]:
    """The sizes beyond which no template can reach the threshold."""
    sizes = [len(template_bigrams(t)) for _, t in templates]
    return int(min(sizes) * threshold / (2 - threshold)), int(max(sizes) * (2 - threshold) / threshold) + 1


def window_scores(body: Column, templates, threshold: float) -> Column:
    """(dice, id) of the windows of the whole text that reach the threshold: as many bigrams as the template has
    words' pairs (fewer at the text's end), from each bigram on that is one of the template's. A window that begins
    otherwise has no more of them than the one behind it."""
    known = [(i, template_bigrams(t), max(len(re.sub(OTHER, " ", t.lower()).split()) - 1, 1)) for i, t in templates]
    every = F.array(*map(F.lit, sorted({x for _, own, _ in known for x in own})))

    def of_template(b: Column, hits: Column, i: str, own: list[str], length: int) -> Column:
        n, all_own = len(own), F.array(*map(F.lit, own))

        def score(k):
            part = F.slice(b, k, length)
            return F.struct((2.0 * F.size(F.array_intersect(part, all_own)) / (F.size(part) + n)).alias("dice"), F.lit(i).alias("id"))

        starts = F.filter(F.sequence(F.lit(1), F.size(b)), lambda k: F.array_contains(all_own, F.get(b, k - 1)))
        enough = (2 - threshold) * F.size(F.array_intersect(hits, all_own)) >= threshold * n - 1e-9
        return F.filter(F.transform(F.when(enough, starts).otherwise(F.array().cast("array<int>")), score), lambda x: x["dice"] >= threshold)

    def of_text(b: Column) -> Column:
        return F.flatten(F.transform(F.array(F.array_intersect(b, every)), lambda h: F.concat(*[of_template(b, h, *k) for k in known])))

    words = F.array(F.split(normalised(body), " "))
    return F.flatten(F.transform(F.transform(words, bigrams), of_text))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text", windows: bool = False) -> DataFrame:
    """``docs`` with (``windows``: also of windows within the text, see window_scores) licenses (sorted distinct ids at or over the threshold), best_license and best_dice."""
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, template_bigrams(t))).alias("bigrams"),
                               F.lit(len(template_bigrams(t))).alias("n")) for i, t in templates])
    least, most = bounds(templates, threshold)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = F.array_distinct(F.concat(F.array(body), F.split(body, r"\n[\x20\x09\x0D]*\n"), F.split(body, r"\n")))
    size = lambda w: F.greatest(F.size(w) - 1, F.lit(1))
    words = F.filter(F.transform(texts, lambda p: F.split(normalised(p), " ")),
                     lambda w: (size(w) >= least) & (size(w) <= most) & (F.get(w, F.lit(0)) != ""))

    def scored(s: Column) -> Column:
        a = F.size(s)
        near = F.filter(known, lambda t: 2 * F.least(a, t["n"]) >= threshold * (a + t["n"]))
        return F.transform(near, lambda t: F.struct((2.0 * F.size(F.array_intersect(s, t["bigrams"])) / (a + t["n"])).alias("dice"), t["id"].alias("id")))

    found = F.filter(F.flatten(F.transform(F.transform(words, bigrams), scored)), lambda x: x["dice"] >= threshold)
    if windows:
        found = F.concat(found, window_scores(body, templates, threshold))
    best = F.array_min(F.transform("license_scores", lambda x: F.struct((-x["dice"]).alias("dice"), x["id"].alias("id"))))
    return (docs.withColumn("license_scores", found)
            .withColumn("licenses", F.array_sort(F.array_distinct(F.transform("license_scores", lambda x: x["id"]))))
            .withColumn("best_license", best["id"]).withColumn("best_dice", -best["dice"]).drop("license_scores"))
