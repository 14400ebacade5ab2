"""Licence scans: TF-IDF cosine of passages to templates, then inheritance from the nearest directory.

Compared with each template are every line of a text, every paragraph and the whole text. A word that
occurs c times weighs (1 + log c) * idf; document frequencies of all words are counted over all documents.
The cosine of a passage is at most the norm of the part of the template whose words the passage has
(Cauchy-Schwarz); only texts, and of these only passages, where that reaches the threshold are weighed,
which loses nothing. Words of no template only lengthen a passage's vector, each by a weight of 1 at
least; passages that would reach the threshold at that weight are joined with the frequencies, the
others can't reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .work import Work, col, kind_of
from .words import Hasher, slices

#: (licence, text): notices and headers, then whole texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("MIT", 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.'),
    ("LGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
    ("EPL-2.0", 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/'),
    *((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
)
LAST_RESORT = ("Proprietary",)  # given only where no other template is reached
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)[^/]*$"


def term_counts(words: np.ndarray) -> dict:
    return dict(zip(*(x.tolist() for x in np.unique(words, return_counts=True)), strict=True))


def template_terms(templates=TEMPLATES) -> list[tuple[str, dict]]:
    """(licence, {word hash: count}) of each template."""
    h, o = Hasher().words(pa.array([t for _, t in templates], pa.string()))
    return [(name, term_counts(h[a:b])) for (name, _), a, b in zip(templates, o[:-1], o[1:], strict=True)]


def _summed(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, with the sum of its counts."""
    words, at = np.unique(words, return_inverse=True)
    return words, np.bincount(at, n, len(words)).astype(np.int64)


def _frequencies(most: int = 1 << 19):
    """(word, documents that have it), in parts to be summed; a null word has the number of all documents. Holds about `most` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, words, n = Hasher(), 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        part = lambda w, n: pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])
        for batch in batches:
            total += batch.num_rows
            for _, texts in slices(batch.column(0)):
                h, o = hasher.words(texts)
                order = np.argsort(h, kind="stable")
                h, row = h[order], np.repeat(np.arange(len(o) - 1), np.diff(o))[order]
                once = h[np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]]
                words, n = _summed(np.concatenate([words, once]), np.concatenate([n, np.ones(len(once), np.int64)]))
                if len(words) > most:
                    yield part(words.view(np.int64), n)
                    words, n = words[:0], n[:0]
        yield part(words.view(np.int64), n)
        yield part([None], [total])

    return count


class Scorer:
    """Passages against the templates, as far as the templates' terms go."""

    def __init__(self, templates: list[tuple[str, dict]], idf: dict, threshold: float):
        self.idf, self.threshold, self.least = idf, threshold, (threshold - 1e-9) ** 2
        self.templates, self.having, shares = [], {}, []
        for name, counts in templates:
            v = {t: (1 + math.log(c)) * idf[t] for t, c in counts.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            if not norm:
                continue
            for t, x in v.items():
                self.having.setdefault(t, []).append((len(self.templates), x / norm))
            self.templates.append((name, norm))
            # A template's weakest terms are taken for granted: up to half of what the threshold needs.
            weak, strong = 0.0, {}
            for t, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
                if weak + (x / norm) ** 2 <= self.least / 2:
                    weak += (x / norm) ** 2
                else:
                    strong[t] = (x / norm) ** 2
            shares.append((weak, strong))
        self.strong = np.array(sorted({t for _, strong in shares for t in strong}), np.uint64)
        self.weak = np.array([weak for weak, _ in shares])
        self.share = np.array([[strong.get(t, 0.0) for _, strong in shares] for t in self.strong.tolist()]).reshape(len(self.strong), len(shares))

    def marked(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of strong terms, which terms)."""
        at = np.minimum(np.searchsorted(self.strong, words), len(self.strong) - 1)
        place = np.flatnonzero(self.strong[at] == words)
        return place, at[place]

    def may_reach(self, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which rows (ascending) have strong terms enough for some template."""
        each = np.unique(row * len(self.strong) + term)
        row, term = np.divmod(each, len(self.strong))
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        if not len(first):
            return first
        return row[first][(np.add.reduceat(self.share[term], first) + self.weak >= self.least - 1e-9).any(1)]

    def best(self, words: np.ndarray) -> dict | None:
        """The template of the best cosine (of equals the first by name), unless that is under the threshold whatever the other words weigh.

        The cosine is dot / sqrt(square + what the other words add); these don't bear on which is best.
        """
        square, others, dots, rest = 0.0, 0.0, [0.0] * len(self.templates), []
        for t, c in term_counts(words).items():
            tf = 1 + math.log(c)
            if t in self.having:
                x = tf * self.idf[t]
                square += x * x
                for i, y in self.having[t]:
                    dots[i] += x * y
            else:
                others += tf * tf
                rest.append((t, c))
        dot, name, i = min((-dot, self.templates[i][0], i) for i, dot in enumerate(dots))
        if not square or -dot < (self.threshold - 1e-9) * math.sqrt(square + others):
            return None
        return {"license": name, "norm": self.templates[i][1], "dot": -dot, "square": square, "words": [{"word": t - (t >> 63 << 64), "n": c} for t, c in rest]}

    def scan(self, text: str, hasher: Hasher) -> list[dict]:
        """A text's passages that may reach the threshold, each with its share of the words."""
        lines = text.splitlines()
        h, o = hasher.words(pa.array(lines))
        blank = [i for i, line in enumerate(lines) if not line.strip()]
        edges = [-1, *blank, len(lines)]
        passages = {(int(o[a + 1]), int(o[b])) for a, b in zip(edges[:-1], edges[1:], strict=True) if a + 1 < b} | {(0, len(h))}
        passages |= {(int(o[i]), int(o[i + 1])) for i in range(len(lines))}
        place, term = self.marked(h)
        out = []
        for a, b in sorted(passages):
            i, j = np.searchsorted(place, (a, b))
            if i < j and len(self.may_reach(np.zeros(j - i, np.int64), term[i:j])) and (found := self.best(h[a:b])):
                out.append(found | {"share": (b - a) / len(h)})
        return out


_PASSAGES = "array<struct<license string, norm double, dot double, square double, share double, words array<struct<word bigint, n bigint>>>>"


def _scanner(templates, idf: dict, threshold: float, kind: pa.DataType):
    passage = pa.struct([("license", pa.string()), ("norm", pa.float64()), ("dot", pa.float64()), ("square", pa.float64()), ("share", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, scorer = Hasher(), Scorer(templates, idf, threshold)
        for batch in batches:
            rows = []
            for first, texts in slices(batch.column("text")):
                h, o = hasher.words(texts)
                place, term = scorer.marked(h)
                for i in scorer.may_reach(np.searchsorted(o, place, "right") - 1, term).tolist():
                    if found := scorer.scan(texts[i].as_py(), hasher):
                        rows.append((batch.column("doc_id")[first + i].as_py(), batch.column("path")[first + i].as_py(), found))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (kind, pa.string(), pa.list_(passage)), strict=True)], names=["doc_id", "path", "passages"])

    return scan


def scan_licenses(files: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, whole: float = 0.5, templates=TEMPLATES, last_resort=LAST_RESORT) -> DataFrame:
    """(doc_id, path, license, score, origin, license_path): files that have a licence, their own or their directory's.

    Own: each line, each paragraph and the whole text has its best template, of equals the first by name. Of
    those whose cosine comes to the threshold the weightiest is taken: the highest cosine times norm of the
    template, of equals the first by name; licences of `last_resort` only if there is no other. A file is a
    licence file if it has a licence and is named like one (LICENSE, COPYING, ...) or the passage is at least
    the share `whole` of its words. A file without its own gets the licence of the nearest ancestor directory
    with a licence file (of several there, the highest score, then the first path); origin says own or
    inherited, license_path whose it is.

    Nulls: a null or empty text has no licence of its own; a null path has no directory, so it neither
    gives nor inherits. A null doc_id keeps its row; ids keep their type. Repeated rows each get a row. An
    empty table, and no templates or none with a word, give no rows. Other columns aren't read.
    """
    spark = files.sparkSession
    work = Work(spark, "licenses")
    rows = files.select(col(id_col).alias("doc_id"), col(path_col).cast("string").alias("path"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    terms = template_terms(templates)
    vocabulary = sorted({t for _, counts in terms for t in counts})
    if not vocabulary:
        text = [F.lit("").alias(c) for c in ("license", "origin", "license_path")]
        return rows.where("false").select("doc_id", "path", text[0], F.lit(0.0).alias("score"), *text[1:])
    frequencies = work.table(rows.select("text").mapInArrow(_frequencies(), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    signed = np.array(vocabulary, np.uint64).view(np.int64).tolist()
    n = {r.word: r.n for r in frequencies.where(F.col("word").isNull() | F.col("word").isin(signed)).collect()}  # a row for each term of the templates
    total = n.get(None, 0)
    idf = {t: math.log((1 + total) / (1 + n.get(i, 0))) + 1 for t, i in zip(vocabulary, signed, strict=True)}
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    found = rows.mapInArrow(_scanner(terms, idf, threshold, kind), f"doc_id {kind_of(rows, 'doc_id')}, path string, passages {_PASSAGES}")
    passages = work.table(found.withColumn("row", F.expr("uuid()")), "passages").select("row", "doc_id", "path", F.posexplode("passages").alias("at", "p")).select("row", "doc_id", "path", "at", "p.*")
    weight = (1 + F.log("c")) * (F.log((1 + total) / (1 + F.col("df"))) + 1)
    words = passages.select("row", "at", F.explode("words").alias("w")).select("row", "at", "w.word", F.col("w.n").alias("c")).join(frequencies.select("word", F.col("n").alias("df")), "word")
    # Summed in the order of the words, so that equal passages get equal scores.
    more = words.groupBy("row", "at").agg(F.sort_array(F.collect_list(F.struct("word", weight.alias("x")))).alias("xs"))
    more = more.select("row", "at", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["x"] * x["x"]).alias("more"))
    scored = passages.join(more, ["row", "at"], "left").withColumn("score", F.col("dot") / F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))).where(F.col("score") >= threshold)
    rank = F.struct(F.col("license").isin(list(last_resort)).alias("last"), (-F.round(F.col("score") * F.col("norm"), 6)).alias("mass"), "license", (-F.col("score")).alias("s"), (-F.col("share")).alias("c"))
    best = scored.groupBy("row", "doc_id", "path").agg(F.min(rank).alias("b"))
    own = work.table(best.select("doc_id", "path", "b.license", F.round(-F.col("b.s"), 6).alias("score"), F.round(-F.col("b.c"), 6).alias("coverage")), "own")
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    givers = own.where((F.col("coverage") >= whole) | F.col("path").rlike(LICENCE_FILE)).where("path is not null").select(directory.alias("dir"), F.struct((-F.col("score")).alias("s"), "path", "license").alias("g")).groupBy("dir").agg(F.min("g").alias("g"))
    named = own.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path")).distinct()
    rest = rows.select("doc_id", "path").where("path is not null").join(named, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("path") == F.col("own_path")), "left_anti").withColumn("home", directory)
    parts = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    nearest = rest.select("home").distinct().select("home", F.posexplode(above).alias("depth", "dir")).join(givers, "dir").groupBy("home").agg(F.max(F.struct("depth", "g")).alias("m"))
    inherited = rest.join(nearest, "home").select("doc_id", "path", F.col("m.g.license").alias("license"), F.round(-F.col("m.g.s"), 6).alias("score"), F.lit("inherited").alias("origin"), F.col("m.g.path").alias("license_path"))
    return own.select("doc_id", "path", "license", "score", F.lit("own").alias("origin"), F.col("path").alias("license_path")).unionByName(inherited)
