"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files as _package

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .kernel import Lookup, by_bytes, raw, words

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
#: SPDX id → wordings of its notice, as headers have it.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", _MIT],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", _ISC],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_MIT_TAIL = ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_TAIL = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def full_texts() -> dict[str, list[str]]:
    """SPDX id → wordings of the whole licence, as licence files have it: those in licence_texts, MIT, ISC and the short BSD."""
    out = {f.name.removesuffix(".txt"): [f.read_text("utf-8")] for f in sorted(_package(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    third = re.compile(r"3\. Neither the name.*?written permission\.", re.S)
    return out | {"MIT": ["MIT License " + _MIT + _MIT_TAIL], "ISC": ["ISC License " + _ISC + _ISC_TAIL], "BSD-2-Clause": [third.sub("", out["BSD-3-Clause"][0])]}


LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"


def _hashes(text: str) -> np.ndarray:
    return words(*raw(pa.array([text])))[0]


class _Templates:
    """Sparse TF-IDF vectors of the templates over their own vocabulary; notices first, then whole licences."""

    def __init__(self, notices: dict[str, list[str]], texts: dict[str, list[str]], n_docs: int = 0, df: dict[int, int] | None = None):
        flat = [(k, t) for group in (notices, texts) for k, own in group.items() for t in own]
        self.names = [k for k, _ in flat]
        self.notices = sum(map(len, notices.values()))
        each = [_hashes(t) for _, t in flat]
        self.size = np.array([len(h) for h in each], np.int64)
        self.vocab = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        self.lookup = Lookup(self.vocab)
        df = df or {}
        self.idf = np.array([np.log((1 + n_docs) / (1 + df.get(i, 0))) + 1 for i in range(len(self.vocab))])
        self.other = float(np.log(1 + n_docs) + 1)
        self.w = np.zeros((len(each), len(self.vocab)))
        for t, h in enumerate(each):
            np.add.at(self.w[t], self.lookup.find(h), 1)
        self.w *= self.idf
        norm = np.linalg.norm(self.w, axis=1, keepdims=True)
        self.w /= np.where(norm > 0, norm, 1)
        self.known = (self.w[: self.notices] > 0).any(axis=0) if self.notices else np.zeros(len(self.vocab), bool)

    def whole(self, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, cosine) of whole texts, text i having the terms first[i]:first[i+1], to the whole licences; term is -1 for words outside the vocabulary, each of which counts as a rare term of its own."""
        best, cos = np.full(len(first) - 1, -1), np.zeros(len(first) - 1)
        if self.notices == len(self.names):
            return best, cos
        for i in range(len(first) - 1):
            own = term[first[i] : first[i + 1]]
            if not len(own):
                continue
            x = np.bincount(own[own >= 0], minlength=len(self.vocab)) * self.idf
            c = self.w[self.notices :] @ x / np.sqrt((x**2).sum() + (own < 0).sum() * self.other**2)
            best[i], cos[i] = c.argmax() + self.notices, c.max()
        return best, cos

    def headers(self, term: np.ndarray, first: np.ndarray, line: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, template, cosine) of every segment that has a notice's cosine of threshold or more.

        Segments are all lines, and for each notice the windows of as many
        words as it has, begun at every word that any notice has; windows may
        span lines, not texts. line has each word's line, ascending. With
        every word counted once a vector isn't longer than it is, so dot
        products by running sums bound the cosine from above; only segments
        that the bound lets pass are counted term by term, and none is lost.
        """
        n = len(term)
        end = np.repeat(first[1:], np.diff(first))  # of the word's text
        ok = term >= 0
        ok[ok] = self.known[term[ok]]
        known = np.flatnonzero(ok)
        if not len(known):
            return known, known, np.zeros(0)
        own = term[known]
        least = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, self.idf[term], self.other) ** 2)])
        cut = np.concatenate([[0], np.flatnonzero(line[1:] != line[:-1]) + 1, [n]])
        rank = np.concatenate([[0], np.cumsum(ok)])  # known words before each place
        some = np.flatnonzero(np.diff(rank[cut]))  # lines without a known word are nobody's
        begin, stop = cut[some], cut[some + 1]
        line_least = least[stop] - least[begin]
        lo, hi = rank[begin], rank[stop]
        hits = []
        for t in range(self.notices):
            dot = np.concatenate([[0.0], np.cumsum(self.idf[own] * self.w[t, own])])
            d = dot[hi] - dot[lo]
            i = np.flatnonzero(d >= threshold * np.sqrt(line_least) - 1e-9)
            hits.append((begin[i], stop[i], np.full(len(i), t), d[i]))
            to = np.minimum(known + self.size[t], end[known])
            d = dot[rank[to]] - dot[:-1]
            i = np.flatnonzero((d >= threshold * np.sqrt(least[to] - least[known]) - 1e-9) & (d > 0))
            hits.append((known[i], to[i], np.full(len(i), t), d[i]))
        b, e, t, d = (np.concatenate(x) for x in zip(*hits))
        size = e - b
        seg = np.repeat(np.arange(len(b)), size)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b, size)
        # exact lengths, of each segment's terms with their counts
        word = term[at]
        pair, count = np.unique(seg[word >= 0] * max(1, len(self.vocab)) + word[word >= 0], return_counts=True)
        length = np.bincount(pair // max(1, len(self.vocab)), (count * self.idf[pair % max(1, len(self.vocab))]) ** 2, len(b)) + np.bincount(seg[word < 0], minlength=len(b)) * self.other**2
        cos = d / np.sqrt(length)
        good = cos >= threshold - 1e-12
        return b[good], t[good], cos[good]


def term_counts(files: DataFrame, t: _Templates) -> tuple[int, dict[int, int]]:
    """Files with text, and how many hold each term of the templates, over all files; rows (_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(t.vocab), np.int64), 0
        for b in by_bytes(batches, "_text"):
            h, _, _, first = words(*raw(b.column(0)))
            i = t.lookup.find(h)
            row = np.repeat(np.arange(b.num_rows), np.diff(first))[i >= 0]
            pair = np.unique(row * max(1, len(t.vocab)) + i[i >= 0])
            df += np.bincount(pair % max(1, len(t.vocab)), minlength=len(t.vocab))
            n += b.num_rows - b.column(0).null_count
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[n], df]))], ["term", "n"])

    found = files.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row for each term of the templates
    by = {r["term"]: r["n"] for r in found}
    return by.pop(-1, 0), by


def notices(files: DataFrame, templates: dict[str, list[str]], texts: dict[str, list[str]], threshold: float, file_threshold: float) -> DataFrame:
    """(_id, _path, licence, score, line): the best notice or licence of each file that has one; rows (_id, _path, _text)."""
    n, df = term_counts(files.select("_text"), _Templates(templates, texts))
    t = _Templates(templates, texts, n, df)
    schema = StructType().add("_id", files.schema["_id"].dataType).add("_path", StringType()).add("licence", StringType()).add("score", DoubleType()).add("line", LongType())
    name = re.compile(LICENCE_FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", 2 << 20):
            data, offs = raw(b.column(2))
            h, start, _, first = words(data, offs)
            if not len(h):
                continue
            term = t.lookup.find(h)
            breaks = np.sort(np.concatenate([np.flatnonzero(data == 10), offs[:-1] - 1]))
            at, tpl, cos = t.headers(term, first, np.searchsorted(breaks, start), threshold)
            row = np.searchsorted(first, at, "right") - 1
            files_ = np.flatnonzero([bool(p and name.match(p.rsplit("/", 1)[-1])) for p in b.column(1).to_pylist()])
            if len(files_):
                pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in files_])
                k, c = t.whole(term[pick], np.concatenate([[0], np.cumsum(np.diff(first)[files_])]))
                good = c >= file_threshold
                row, at = np.concatenate([row, files_[good]]), np.concatenate([at, first[files_[good]]])
                tpl, cos = np.concatenate([tpl, k[good]]), np.concatenate([cos, c[good]])
            o = np.lexsort((tpl, at, -np.round(cos, 9), row))
            row, at, tpl, cos = row[o], at[o], tpl[o], cos[o]
            one = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            row, at, tpl, cos = row[one], at[one], tpl[one], cos[one]
            line = [int((data[offs[r] : start[a]] == 10).sum()) for r, a in zip(row, at)]
            idx = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array([t.names[i] for i in tpl], pa.string()), pa.array(np.round(cos, 6)), pa.array(line, pa.int64())], schema.names)

    return files.mapInArrow(run, schema)


def license_scan(files: DataFrame, path: Column, templates: dict[str, list[str]] = TEMPLATES, texts: dict[str, list[str]] | None = None, threshold: float = 0.7, file_threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, path, licence, score, origin, source_path) of every file.

    Of every file all lines are compared with the notices of `templates`, and
    so are all windows of as many words as a notice has, wherever it is wrapped;
    a licence file (by its name) is compared as a whole with the licences of
    `texts` (full_texts() by default) too. The best of cosine `threshold` or
    more, for whole licences file_threshold, is the file's own. Terms are
    weighted by document frequencies over all files. A file without one inherits that of
    the licence file in its own directory or the nearest above; of several in
    one directory the first by path counts. origin is own, inherited or none.
    Null texts and paths have none of their own; a null path inherits nothing.
    Repeated rows each get their result. Ties go to the first place and
    template. Other columns are ignored.
    """
    slim = files.select(F.col(id_col).alias("_id"), path.alias("_path"), F.col(text_col).alias("_text"))
    from .shared import written

    own = written(notices(slim, templates, full_texts() if texts is None else texts, threshold, file_threshold).dropDuplicates(["_id", "_path", "licence", "score", "line"]))
    w = Window.partitionBy("_id", "_path").orderBy(F.desc("score"), "line", "licence")
    own = own.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    up = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    base = F.regexp_extract(F.col("_path"), r"([^/]*)$", 1)
    dirs = own.where(base.rlike(LICENCE_FILE)).groupBy(up(F.col("_path")).alias("_at")).agg(F.min(F.struct("_path", "licence", "score")).alias("_l"))
    need = slim.select(up(F.col("_path")).alias("_dir")).where("_dir is not null").distinct()
    parts = F.split("_dir", "/")
    above = need.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_at"))
    near = above.join(dirs, "_at").groupBy("_dir").agg(F.max(F.struct(F.length("_at").alias("depth"), "_l")).alias("_n")).select("_dir", "_n._l")
    base_rows = slim.select("_id", "_path", up(F.col("_path")).alias("_dir"))
    mine = own.select(F.col("_id").alias("_i"), F.col("_path").alias("_p"), F.col("licence").alias("_own"), F.col("score").alias("_score"))
    joined = base_rows.join(mine, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_path").eqNullSafe(F.col("_p")), "left").join(near, "_dir", "left")
    return joined.select(F.col("_id").alias(id_col), F.col("_path").alias("path"), F.coalesce("_own", "_l.licence").alias("licence"), F.coalesce("_score", "_l.score").alias("score"), F.when(F.col("_own").isNotNull(), "own").when(F.col("_l").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(F.col("_own").isNotNull(), F.col("_path")).otherwise(F.col("_l._path")).alias("source_path"))
