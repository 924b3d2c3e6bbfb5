"""License scans: TF-IDF cosine of lines to templates, then inheritance from the nearest directory.

Every line of a file is compared with license templates, several per license (short notices, grant paragraphs, SPDX
lines), by the cosine of sparse TF-IDF vectors, and so is every window of as many terms as a template has, across
line ends, that holds the words which name the license. The best at or above ``min_cosine`` names the file's license.
Document frequencies of the templates' terms are counted over all files and taken as shares of at most ``IDF_FILES``
files, so more files of the same kind change no score; any other term weighs like one that no file has, so unrelated
words inside a notice pull a cosine down and those around it don't. Whole license texts come first: a window as long as
such a text with a cosine of ``full_cosine`` names the license, the best text wins, and notices are not asked (their
first sentences are in several texts). A license file's finding holds for its directory;
a file without one of its own takes that of its nearest ancestor directory.

Defined cases: a null or empty text has no license; a null path has no directory and inherits nothing; of several
license files in a directory the best cosine wins, then the template's name; of equal cosines in a file the
template first by name; equal rows get equal results; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut

MIN_COSINE = 0.6
#: Short notices by SPDX-like name; fixed values.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Terms weigh as in this many files, however many more there are.
IDF_FILES = 1000
#: More notices per license: sentences and headers that also stand alone. SPDX lines follow from the names.
NOTICES = {
    "AGPL-3.0": ("GNU Affero General Public License version 3", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU AGPL version 3"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "GPL-2.0": ("GNU General Public License version 2", "GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "GNU GPL version 2"),
    "GPL-3.0": ("GNU General Public License version 3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU GPL version 3"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU LGPL version 3"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("The Unlicense",),
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies"""
_ISC_REST = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_ADVERTISING = """ All advertising materials mentioning features or use of this software must display the following acknowledgement: This
product includes software developed by the organization."""
_BSD_NAME = """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_REST = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain."""
_APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU {name} for more details."""
#: Whole texts and headers by SPDX-like name, with words that each must have; fixed values.
FULL_TEXTS = {
    "0BSD": (_ISC + _ISC_REST, "fee granted tortious"),
    "AGPL-3.0": (_GNU.format(name="Affero General Public License", version="3"), "gnu affero general public 3 redistribute"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); " + _APACHE, "apache 2.0 compliance governing"),
    "BSD-2-Clause": (_BSD + _BSD_REST, "redistribution retain reproduce disclaimed"),
    "BSD-3-Clause": (_BSD + _BSD_NAME + _BSD_REST, "redistribution retain reproduce disclaimed endorse promote"),
    "BSD-4-Clause": (_BSD + _BSD_ADVERTISING + _BSD_NAME + _BSD_REST, "redistribution retain reproduce disclaimed endorse promote advertising mentioning"),
    "GPL-2.0": (_GNU.format(name="General Public License", version="2"), "gnu general public 2 redistribute"),
    "GPL-3.0": (_GNU.format(name="General Public License", version="3"), "gnu general public 3 redistribute"),
    "ISC": (_ISC + _ISC_NOTICE + _ISC_REST, "fee granted provided appear tortious"),
    "LGPL-3.0": (_GNU.format(name="Lesser General Public License", version="3"), "gnu lesser general public 3 redistribute"),
    "MIT": (_MIT, "permission granted sublicense noninfringement"),
    "Unlicense": (_UNLICENSE, "unencumbered jurisdictions dedicate"),
    "Zlib": (_ZLIB, "misrepresented altered plainly"),
}
#: A window as long as a whole text is that text from this cosine on.
FULL_COSINE = 0.85
#: Words that name a license; a notice that has some of them is found only where they all stand.
NAMING = frozenset(
    """affero agpl apache attribution binary bsd by cc endorse general gpl granted lesser lgpl mit mozilla nc noncommercial permission redistribution
    reserved rights sa sharealike unencumbered unlicense waived cc0""".split()
)
#: Notices of up to so many terms must be there as a whole, or two licenses' headers would pass for each other.
WHOLE = 4
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright)[^/]*$"
_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def templates() -> list[tuple[str, str]]:
    """All (license, notice), by license."""
    spdx = {name: (f"SPDX-License-Identifier: {name}", *(f"SPDX-License-Identifier: {name}-{x}" for x in ("only", "or-later") if "GPL" in name)) for name in TEMPLATES if name != "Proprietary"}
    return [(name, x) for name in sorted(TEMPLATES) for x in dict.fromkeys((TEMPLATES[name], *NOTICES.get(name, ()), *spdx.get(name, ())))]


def required(notice: str) -> frozenset[str]:
    """The terms that must be there for something to count as this notice."""
    found = terms(notice)
    if len(found) <= WHOLE or found[0] == "spdx":
        return frozenset(found)
    return NAMING.intersection(found)


def document_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many each term of the templates occurs (a bounded vocabulary)."""
    vocabulary = sorted({t for _, x in templates() for t in terms(x)} | {t for x, _ in FULL_TEXTS.values() for t in terms(x)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, n = set(vocabulary), Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                seen.update(known.intersection(terms(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen]), pa.array([n, *seen.values()], pa.int64())], names=["term", "n"])

    counts = files.select(F.col("text").cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in counts.collect()}  # one row per template term
    return got.pop("", 0), got


class Matcher:
    """Cosines of lines and windows to all templates; the notices come first in its lists, then the whole texts."""

    def __init__(self, n_files: int, df: dict[str, int], min_cosine: float = MIN_COSINE, full_cosine: float = FULL_COSINE) -> None:
        self.notices = templates()
        self.names = [name for name, _ in self.notices]
        self.required = [frozenset() if x == TEMPLATES[name] else required(x) for name, x in self.notices]
        # A window must also agree in version numbers.
        self.named = [required(x) | {t for t in terms(x) if t[0].isdigit()} for _, x in self.notices]
        self.least = max(min_cosine, 0.0) ** 2 - 1e-9
        n = min(n_files, IDF_FILES)
        scale = n / n_files if n_files else 0.0
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0) * scale)) + 1 for _, x in self.notices for t in terms(x)}
        self.full_idf = {t: math.log((1 + n) / (1 + df.get(t, 0) * scale)) + 1 for x, _ in FULL_TEXTS.values() for t in terms(x)}
        self.full_cosine = full_cosine
        self.other = math.log(1 + n) + 1
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.weights: list[dict[str, float]] = []
        self.sizes: list[int] = []
        for k, (_, notice) in enumerate(self.notices):
            self._add(notice, self.idf)
            for t, x in self.weights[-1].items():
                self.postings.setdefault(t, []).append((k, x))
        for name, (text, needed) in sorted(FULL_TEXTS.items()):
            self._add(text, self.full_idf)
            self.names.append(name)
            self.named.append(set(needed.split()))

    def _add(self, text: str, idf: dict[str, float]) -> None:
        tf = Counter(terms(text))
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        self.weights.append({t: n * idf[t] / norm for t, n in tf.items()})
        self.sizes.append(sum(tf.values()))

    def best(self, line: str) -> tuple[float, int]:
        tf = Counter(terms(line))
        own = [t for t in tf if t in self.postings]
        if not own:
            return 0.0, -1
        norm = math.sqrt(sum((n * self.idf.get(t, self.other)) ** 2 for t, n in tf.items()))
        dots = [0.0] * len(self.notices)
        for t in own:
            w = tf[t] * self.idf[t] / norm
            for k, x in self.postings[t]:
                dots[k] += w * x
        k = max(range(len(dots)), key=lambda i: (round(dots[i], 9) if self.required[i] <= tf.keys() else 0.0, -i))
        return (dots[k], k) if self.required[k] <= tf.keys() else (0.0, -1)

    def window(self, found: list[str], k: int) -> float:
        """The best cosine to template *k* of a window of its length that holds its naming terms."""
        size, named, weights, idf, other = min(self.sizes[k], len(found)), self.named[k], self.weights[k], self.idf if k < len(self.notices) else self.full_idf, self.other
        pivot = min(sorted(named), key=found.count)
        top, start, at = 0.0, -1, -1
        tf: Counter = Counter()
        dot = square = 0.0
        for place, term in enumerate(found):
            if term != pivot:
                continue
            for s in range(max(0, place - size + 1, at + 1), min(place, len(found) - size) + 1):
                if s == start + 1 and start >= 0:
                    changes = ((found[start], -1), (found[start + size], 1))
                else:
                    tf.clear()
                    dot = square = 0.0
                    changes = tuple((t, 1) for t in found[s : s + size])
                for t, d in changes:
                    w = idf[t] if t in weights else other
                    c = tf[t]
                    square += w * w * (2 * c * d + 1)
                    dot += d * w * weights.get(t, 0.0)
                    tf[t] = c + d
                start = at = s
                if all(tf[t] for t in named):
                    top = max(top, dot / math.sqrt(square))
        return top

    def scan(self, text: str) -> tuple[float, int]:
        """The best whole text, or else the best of all lines and windows."""
        found = terms(text)
        own = set(found)
        whole = [(round(self.window(found, k), 9), -k) for k in range(len(self.notices), len(self.names)) if self.named[k] <= own]
        if whole and max(whole)[0] >= self.full_cosine:
            return max(whole)[0], -max(whole)[1]
        present = self.postings.keys() & own
        cover = [0.0] * len(self.notices)
        for t in sorted(present):
            for k, x in self.postings[t]:
                cover[k] += x * x
        # A cosine is never above the root of what share of the template's squared norm is there at all.
        able = [k for k, x in enumerate(cover) if x >= self.least and x > 0]
        top, which = 0.0, -1
        if any(self.required[k] <= present for k in able):
            for line in text.split("\n"):
                got, k = self.best(line)
                if k >= 0 and (round(got, 9), -k) > (round(top, 9), -which):
                    top, which = got, k
        for k in able:
            if self.named[k] <= present:
                got = self.window(found, k)
                if got and (round(got, 9), -k) > (round(top, 9), -which):
                    top, which = got, k
        return top, which


def own_licenses(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """*files* without ``text``, with own_license and own_score (null without one) and n_words."""
    n, df = document_frequencies(files)
    others = [c for c in files.columns if c not in ("text", "own_license", "own_score", "n_words")]
    held = files.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(n, df, min_cosine)
        for batch in batches:
            names, scores, words = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                top, which = match.scan(text)
                hit = which >= 0 and top >= min_cosine
                names.append(match.names[which] if hit else None)
                scores.append(round(top, 6) if hit else None)
                words.append(len(text.split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(words, pa.int64())], names=["row", "own_license", "own_score", "n_words"])

    out = held.mapInArrow(run, held.select("row").schema.add("own_license", "string").add("own_score", "double").add("n_words", "long"))
    return out.select("row.*", "own_license", "own_score", "n_words")


def inherit(scanned: DataFrame, is_license_file=None) -> DataFrame:
    """Add license and from_dir: a file's own license, else that of its nearest ancestor directory.

    Each distinct directory is joined once, by the paths of its ancestors; files then join their directory.
    """
    is_license_file = F.col("path").rlike(LICENSE_FILE) if is_license_file is None else is_license_file
    scanned = scanned.drop("license", "from_dir").withColumn("_lic_dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    licensed = scanned.filter(is_license_file & F.col("own_license").isNotNull() & F.col("_lic_dir").isNotNull())
    best = licensed.groupBy("_lic_dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("b"))
    best = best.select(F.col("_lic_dir").alias("anc"), F.col("b.name").alias("name"))
    dirs = scanned.select("_lic_dir").filter("_lic_dir IS NOT NULL").distinct()
    parts = F.split("_lic_dir", "/")
    ups = dirs.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("anc", F.when(F.col("_lic_dir") == "", F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.col("depth")), "/")))
    # Written apart, so that the join deals its rows anew and can split those of a very large directory.
    near = cut(ups.join(best, "anc").groupBy("_lic_dir").agg(F.max(F.struct("depth", "anc", "name")).alias("n")).select("_lic_dir", F.col("n.anc").alias("_lic_from"), F.col("n.name").alias("_lic_name")))
    out = scanned.join(near, "_lic_dir", "left")
    own = F.col("own_license").isNotNull()
    return out.withColumns({"license": F.coalesce("own_license", "_lic_name"), "from_dir": F.when(~own, F.col("_lic_from"))}).drop("_lic_dir", "_lic_name", "_lic_from")


def scan(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """License findings for files (path, text, ...)."""
    return inherit(cut(own_licenses(files, min_cosine)))


#: Documents have no paths: a document lies in <source>/<lang>/<last digit of doc_id>, one of up to SHORT words that
#: names a license acts as the license file of <source>/<lang>.
SHORT = 60


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    found = cut(own_licenses(docs))
    notice = (F.col("n_words") <= SHORT) & F.col("own_license").isNotNull()
    place = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    found = found.withColumn("notice", notice).withColumn("path", F.when(notice, F.concat(place, F.lit("/LICENSE-"), F.col("doc_id"))).otherwise(F.concat(place, F.lit("/"), F.pmod("doc_id", F.lit(10)), F.lit("/"), F.col("doc_id"))))
    return inherit(found, F.col("notice")).select("doc_id", "path", "own_license", "own_score", "license", "from_dir")
