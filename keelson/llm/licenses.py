"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. Words (lower case letters, digits, points inside numbers) of the templates are
   counted over all files: their document frequencies give the weights
   ln((N + 1) / (df + 1)) + 1.  Any other word weighs as much as one that occurs
   nowhere.
2. Every line of every file is a passage; a long line is looked at through windows
   of each template's length.  So is the whole text, in which line ends and comment
   marks are not words, so that a header may run over several lines.  A passage belongs to the template with the highest
   cosine, if that reaches `THRESHOLD`.  Passages without any of the templates'
   strong words are passed over: strong words are as many of the heaviest as it
   takes for the others alone to stay below the threshold with every template.
   In files named like licence files (`LICENSE_NAMES`) the whole text is a passage,
   too, so that long texts match long templates.
3. A file's licence is that of its best passage (ties: the first template by name).
   A file without one inherits from the nearest ancestor directory that has a
   licence file with one; of several in a directory, the best, then the first by
   path.  The chain of ancestors is joined per distinct directory, not per file.

Defined cases: null and empty texts have no passage; a null path has no
directory and inherits nothing; repeated rows have a result each; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+")
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)(\..*|-.*)?$"

# Short forms in which licences are commonly stated, by SPDX id.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Matcher:
    """Cosines of passages to weighted templates."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, threshold: float):
        self.threshold, self.other = threshold, math.log(n + 1) + 1
        parts = [(name, words_of(t)) for name in sorted(templates) for t in templates[name]]
        self.weight = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for _, ws in parts for w in ws}
        self.parts = []
        for name, ws in parts:
            v = {w: c * self.weight[w] for w, c in Counter(ws).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.parts.append((name, len(ws), {w: x / norm for w, x in v.items()}))
        self.strong: set[str] = set()
        for w in sorted(self.weight, key=lambda w: (-self.weight[w], w)):
            if all(sum(x * x for u, x in v.items() if u not in self.strong) < threshold**2 for _, _, v in self.parts):
                break
            self.strong.add(w)
        # Weights by number of a word, and each template's share in the cosine; 0: any other word.
        self.number = {w: i for i, w in enumerate(sorted(self.weight), 1)}
        self.weights = np.array([self.other] + [self.weight[w] for w in sorted(self.weight)])
        self.shares = [np.array([0.0] + [self.weight[w] * v.get(w, 0.0) for w in sorted(self.weight)]) for _, _, v in self.parts]

    def cosine(self, words: list[str], v: dict[str, float]) -> float:
        x = {w: c * self.weight.get(w, self.other) for w, c in Counter(words).items()}
        return sum(x[w] * v[w] for w in x if w in v) / math.sqrt(sum(y * y for y in x.values()))

    def passage(self, words: list[str], whole: bool = False) -> tuple[str, float] | None:
        """Best template and cosine of a passage, if it reaches the threshold."""
        strong = self.strong
        at = [i for i, w in enumerate(words) if w in strong]
        best = None
        for name, size, v in self.parts if at else ():
            if whole or len(words) <= size + size // 2:
                score = self.cosine(words, v)
            else:
                starts = sorted({s for i in at if words[i] in v for s in range(max(0, i - size + 1), min(i, len(words) - size) + 1)})
                score = max((self.cosine(words[s : s + size], v) for s in starts), default=0.0)
            if score >= self.threshold and (best is None or score > best[1] + 1e-12):
                best = (name, score)
        return best


    def anywhere(self, words: list[str]) -> tuple[str, float] | None:
        """Best template and cosine among all windows of the templates' lengths, if it reaches the threshold.

        A window's product with a template is a sum over its places, and its norm at
        least that of its words taken one by one: only windows that may reach the
        threshold by these sums are compared.
        """
        ids = np.array([self.number.get(w, 0) for w in words], np.int64)
        norms = np.append(0.0, np.cumsum(self.weights[ids] ** 2))
        best = None
        for (name, size, v), share in zip(self.parts, self.shares, strict=True):
            size = min(size, len(words))
            products = np.append(0.0, np.cumsum(share[ids]))
            may = products[size:] - products[:-size] >= self.threshold * np.sqrt(norms[size:] - norms[:-size]) - 1e-6 if size else np.empty(0, bool)
            score = max((self.cosine(words[s : s + size], v) for s in np.flatnonzero(may).tolist()), default=0.0)
            if score >= self.threshold and (best is None or score > best[1] + 1e-12):
                best = (name, score)
        return best


def frequencies(vocabulary: set[str]):
    """Arrow function: (word, documents) for the templates' words."""

    def run(rows):
        total: Counter = Counter()
        for batch in rows:
            for text in batch.column(0).to_pylist():
                total.update(vocabulary.intersection(words_of(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "df"])

    return run


def scanner(templates, df, n: int, threshold: float):
    """Arrow function: adds each file's own licence and score."""

    def run(rows):
        match, name = Matcher(templates, df, n, threshold), re.compile(LICENSE_NAMES)
        keyword = re.compile("|".join(sorted(map(re.escape, match.strong), key=lambda w: (-len(w), w))))
        for batch in rows:
            found, scores, files = [], [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                best = None
                is_file = path is not None and bool(name.match(path.rsplit("/", 1)[-1]))
                lower = (text or "").lower()
                if keyword.search(lower):
                    for line in lower.split("\n"):
                        if keyword.search(line) and (hit := match.passage(WORD.findall(line))) and (best is None or hit[1] > best[1]):
                            best = hit
                    words = WORD.findall(lower)
                    if (hit := match.anywhere(words)) and (best is None or hit[1] > best[1] + 1e-12):
                        best = hit
                    if is_file and (hit := match.passage(words, whole=True)) and (best is None or hit[1] > best[1]):
                        best = hit
                found.append(best and best[0])
                scores.append(best and best[1])
                files.append(is_file)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(files, pa.bool_())], names=["id", "path", "own", "own_score", "is_file"])

    return run


def licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `files`: doc_id, license, score, how (file, header, inherited; null: none), from_path (of the licence file inherited from)."""
    from .common import materialize

    templates = TEMPLATES if templates is None else templates
    kind = files.schema[id_col].dataType.simpleString()
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("_text"))
    vocabulary = {w for ts in templates.values() for t in ts for w in words_of(t)}
    n = base.count()
    df = {r.word: r.n for r in base.select("_text").mapInArrow(frequencies(vocabulary), "word string, df bigint").groupBy("word").agg(F.sum("df").alias("n")).collect()}
    own = materialize(base.mapInArrow(scanner(templates, df, n, threshold), f"id {kind}, path string, own string, own_score double, is_file boolean"), "licenses")

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = own.withColumn("_dir", F.when(F.col("path").isNotNull(), folder))
    ranked = F.min(F.struct(-F.col("own_score"), F.col("path"), F.col("own")))
    given = own.where("is_file and own is not null").groupBy(F.col("_dir").alias("_up")).agg(ranked.alias("b"))
    given = given.select("_up", F.col("b.own").alias("license"), (-F.col("b.col1")).alias("score"), F.col("b.path").alias("from_path"))
    parts = F.split("_dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    wanting = own.where("own is null and _dir is not null").select("_dir").distinct()
    ups = wanting.select("_dir", F.posexplode(F.array_distinct(chain)).alias("depth", "_up"))
    near = ups.join(given, "_up").groupBy("_dir").agg(F.max_by(F.struct("license", "score", "from_path"), "depth").alias("h"))
    out = own.join(near, "_dir", "left")
    inherits = F.col("own").isNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.coalesce("own", F.col("h.license")).alias("license"),
        F.coalesce("own_score", F.when(inherits, F.col("h.score"))).alias("score"),
        F.when(~inherits, F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("h").isNotNull(), "inherited").alias("how"),
        F.when(inherits, F.col("h.from_path")).alias("from_path"),
    )
