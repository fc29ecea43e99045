"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

Every line of a file that holds a word typical of licences is a header line; it is compared alone and with the header
lines beside it. Notices inside sentences, under copyright lines or over wrapped lines are found by windows: around
every typical word, windows of each template's own length move over the file's words in small steps. A header gets the
template with the largest cosine; a short template needs all its naming words. A file that as a whole is close to a
template or a full licence text, starts with a licence's title, or is named like a licence file, is a licence file and
grants its licence to its directory. Files without a licence of their own take that of the nearest ancestor directory
with a grant: distinct directories meet their ancestors in an equi-join, so a hot directory is looked up once.

The templates are a small fixed table that every task holds; whole texts are read.
"""

import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepgrove.session import materialize

from .catalog import query, table

#: Least cosine of a header, and of a whole file to be a licence file.
LEAST_HEADER = 0.6
LEAST_FILE = 0.8
#: Words of a window of a long segment; windows overlap by half.
WINDOW = 60

#: Fixed texts: short notices and opening sentences of common licences, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}
for _name, _texts in TEMPLATES.items():
    _texts.append(f"SPDX-License-Identifier: {_name}")

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Complete licence texts; whole files are compared with them too.
FULL = {
    "BSD-2-Clause": [_BSD.format("")],
    "BSD-3-Clause": [_BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. "
    )],
    "ISC": [
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ],
    "MIT": [
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ],
}
#: First words of licences that are too long to be templates; a file that starts with them is that licence.
TITLES = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
#: A text that starts with a title is a licence, not a notice, when it has so many words.
TITLED = 300
#: Templates of at most so many words are matched only with all their words but these.
SHORT = 16
GENERIC = frozenset(
    "a code form general identifier international is licence license licensed of public released source spdx subject terms the "
    "this to under v version work".split()
)
#: Fixed words that make a line a header line, and base names of licence files.
CUES = re.compile(r"licen[sc]|copyright|permission|redistribut|warrant|\bspdx\b|\bgnu\b|creative commons", re.IGNORECASE)
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"

ADDED = ("licence", "cosine", "header", "whole_licence", "whole_cosine")

_TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def terms(text):
    return _TERM.findall(text.lower())


class Templates:
    """TF-IDF vectors of the templates; a term that no template holds weighs as much as the rarest."""

    def __init__(self, templates):
        self.names = [name for name in sorted(templates) for _ in templates[name]]
        bags = [self._bag(t) for name in sorted(templates) for t in templates[name]]
        held = {}
        for bag in bags:
            for term in bag:
                held[term] = held.get(term, 0) + 1
        self.idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in held.items()}
        self.rare = math.log(1 + len(bags)) + 1
        self.sizes = [sum(bag.values()) for bag in bags]
        self.keys = [frozenset(bag) - GENERIC if n <= SHORT else frozenset() for bag, n in zip(bags, self.sizes)]
        self.postings, self.vectors = {}, []
        for i, bag in enumerate(bags):
            weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in bag.items()}
            length = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / length for t, w in weights.items()})
            for t, w in weights.items():
                self.postings.setdefault(t, []).append((i, w / length))

    @staticmethod
    def _bag(text):
        return Templates._counts(terms(text))

    @staticmethod
    def _counts(found):
        bag = {}
        for t in found:
            bag[t] = bag.get(t, 0) + 1
        return bag

    def window(self, text):
        """(name, cosine, part) of the window nearest to a template of its own length; windows hold a cue."""
        spans = [m.span() for m in _TERM.finditer(text)]
        found, starts = [text[a:b].lower() for a, b in spans], [a for a, _ in spans]
        cues = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in CUES.finditer(text)}) if spans else []
        held, best = set(found), (None, 0.0, None)
        for i, own in enumerate(self.vectors):
            # No window has a larger cosine than the template's share that the text holds at all.
            if not self.keys[i] <= held or sum(w * w for t, w in own.items() if t in held) < LEAST_HEADER**2:
                continue
            n = min(self.sizes[i], len(found))
            last = len(found) - n
            for at in sorted({min(max(0, c - k), last) for c in cues for k in range(0, n, max(1, n // 8))}):
                bag = self._counts(found[at : at + n])
                if not self.keys[i] <= bag.keys():
                    continue
                dot = norm = 0.0
                for t, count in bag.items():
                    w = (1 + math.log(count)) * self.idf.get(t, self.rare)
                    norm += w * w
                    dot += w * own.get(t, 0.0)
                cosine = min(1.0, dot / math.sqrt(norm))
                if cosine > best[1] + 1e-12:
                    best = (self.names[i], cosine, " ".join(text[spans[at][0] : spans[at + n - 1][1]].split()))
        return best

    def best(self, text):
        """(name, cosine) of the nearest template; ties go to the name that sorts first; (None, 0.0) without a shared term."""
        bag = self._bag(text)
        weights = {t: (1 + math.log(n)) * self.idf.get(t, self.rare) for t, n in bag.items()}
        scores = np.zeros(len(self.names))
        for t, w in weights.items():
            for i, x in self.postings.get(t, ()):
                scores[i] += w * x
        for i in np.flatnonzero(scores):
            if not self.keys[i] <= bag.keys():
                scores[i] = 0.0
        if not scores.any():
            return None, 0.0
        at = int(np.argmax(scores))
        return self.names[at], min(1.0, float(scores[at] / math.sqrt(sum(w * w for w in weights.values()))))


def segments(text):
    """Runs of neighbouring lines that hold a cue, long ones as overlapping windows of words."""
    if not CUES.search(text):
        return
    run = []
    for line in [*text.split("\n"), ""]:
        if line.strip() and CUES.search(line):
            run.append(line)
            continue
        if run:
            yield from _windows(run)
            if len(run) > 1:
                yield from run
        run = []


def _windows(run):
    found = " ".join(run).split()
    if len(found) <= WINDOW:
        yield " ".join(found)
        return
    for at in range(0, len(found), WINDOW // 2):
        part = " ".join(found[at : at + WINDOW])
        if CUES.search(part):
            yield part


def own_licences(files, path="path", text="text", carry=(), templates=None):
    """(path, carried columns, licence, cosine, header, whole_licence, whole_cosine) of files; nulls where nothing is near."""
    known = Templates(TEMPLATES if templates is None else templates)
    full = Templates({} if templates is not None else FULL)
    titles = Templates({} if templates is not None else TITLES)

    def whole_file(text):
        """(name, cosine, if it is by a complete text or a title) of the licence that the whole text is nearest to."""
        name, cosine = known.best(text)
        other = full.best(text)
        if other[1] > cosine:
            name, cosine = other
        start = terms(text[:1000])
        if cosine < LEAST_FILE and len(text.split(None, TITLED)) > TITLED:
            opening = max((titles.best(" ".join(start[:n])) for n in sorted(set(titles.sizes))), key=lambda x: x[1], default=(None, 0.0))
            if opening[1] >= LEAST_FILE:
                return *opening, True
        return name, cosine, cosine == other[1] and cosine >= LEAST_FILE

    def run(batches):
        for batch in batches:
            found = []
            for data in batch.column("text").to_pylist():
                text = data.decode("utf-8", "replace") if data else ""
                best = (None, 0.0, None)
                for part in segments(text):
                    name, cosine = known.best(part)
                    if cosine > best[1]:
                        best = (name, cosine, part)
                cued = CUES.search(text) is not None
                part = known.window(text) if cued and best[1] < 1.0 - 1e-9 else best
                best = part if part[1] > best[1] else best
                *whole, complete = whole_file(text) if cued else (None, 0.0, False)
                if complete:
                    best = (*whole, best[2])
                found.append((*(best if best[1] >= LEAST_HEADER else (None, best[1], None)), *whole))
            kept = [c for c in batch.schema.names if c != "text"]
            kinds = (pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64())
            columns = zip(*found) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *[pa.array(x, t) for x, t in zip(columns, kinds)]],
                names=[*kept, *ADDED],
            )

    plain = files.select(*[F.col(c) for c in carry], F.col(path).cast("string").alias("path"), F.col(text).cast("binary").alias("text"))
    kinds = (T.StringType(), T.DoubleType(), T.StringType(), T.StringType(), T.DoubleType())
    schema = T.StructType([*plain.drop("text").schema.fields, *map(T.StructField, ADDED, kinds)])
    return plain.mapInArrow(run, schema)


def directory(path):
    """The directory of a path; empty at the top, null for null."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(found):
    """``found`` with directory, granted_by (the directory it inherits from), inherited, and effective licence."""
    placed = found.withColumn("directory", directory(F.col("path")))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    grants = (
        placed.filter(F.when(named, F.col("licence").isNotNull()).otherwise(F.col("whole_cosine") >= LEAST_FILE))
        .select("directory", F.coalesce(F.when(F.col("whole_cosine") >= LEAST_FILE, F.col("whole_licence")), "licence").alias("licence"), named.alias("named"), "whole_cosine", "path")
        .groupBy("directory")
        .agg(F.min_by("licence", F.struct(~F.col("named"), -F.col("whole_cosine"), "path")).alias("granted"))
    )
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    asked = placed.filter("directory IS NOT NULL").select("directory").distinct().select("directory", F.explode(F.array_distinct(above)).alias("ancestor"))
    nearest = (
        asked.join(grants.withColumnRenamed("directory", "ancestor"), "ancestor")
        .groupBy("directory")
        .agg(F.max_by(F.struct(F.col("ancestor").alias("granted_by"), "granted"), F.length("ancestor")).alias("grant"))
    )
    # Stored, so that the join has a table of known size beside the files and may split a hot directory.
    joined = placed.join(materialize(nearest), "directory", "left")
    return joined.withColumns({
        "granted_by": F.when(F.col("licence").isNull(), F.col("grant.granted_by")),
        "effective": F.coalesce("licence", "grant.granted"),
    }).drop("grant")


def scan(files, path="path", text="text", carry=(), templates=None):
    """One row per row of ``files``: its own licence with evidence, and the one in force for it.

    Null and empty texts have no licence of their own and may inherit; a null path neither grants nor inherits. Of
    several grants in one directory files named like licence files win, then the larger cosine, then the smaller path.
    Repeated rows come out each; ``carry`` names the columns to keep, others play no part.
    """
    return inherit(materialize(own_licences(files, path, text, carry, templates)))


@query("op5_license_scan")
def op5_license_scan(spark, folder):
    docs = table(spark, folder, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    found = scan(files, carry=["doc_id"])
    return found.select("doc_id", "path", "licence", "cosine", "header", "granted_by", "effective")
