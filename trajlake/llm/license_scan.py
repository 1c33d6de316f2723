"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Every line of a whole text is a candidate statement, every paragraph (a run of lines with words) a header that may be wrapped
over lines, and the whole text a licence file. Terms weigh by how rare they are among all lines of the corpus; only the
templates' terms need counting, as any other term takes part in a unit's length alone, as a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import materialize

MIN_COSINE = 0.8

#: Notices of headers and bodies of licence files, in the words of the licences themselves: fixed values.
NOTICES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: Statements by which files usually name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    *NOTICES,
)
#: Names of files that speak for their directory and all below it.
LICENSE_FILE = r"(?i)^(LICEN[CS]E|COPYING|NOTICE)(\..*)?$"


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, the line of each (numbered over all texts), the text of each word, and each text's first line."""
    data, bounds = _text.raw(texts)
    low = _text.LOWER[data]
    starts, ends, first = _text.spans(low, bounds, _text.ALNUM)
    newlines = np.flatnonzero(data == 10)
    text = _text.owners(first)
    return _text.hashes(low, starts, ends), np.searchsorted(newlines, starts) + text, text, np.searchsorted(newlines, bounds[:-1]) + np.arange(len(bounds) - 1)


class _Model:
    """The templates' terms, their weights, and each template as a unit vector over them."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        words, _, of, _ = _lines(pa.array([x for _, x in templates]))
        self.names = np.array([x for x, _ in templates], object)
        self.vocab, term = np.unique(words, return_inverse=True)
        self.tf = np.zeros((len(templates), len(self.vocab)))
        np.add.at(self.tf, (of, term), 1.0)

    def weigh(self, lines: int, df: np.ndarray) -> None:
        self.idf, self.rare = np.log((1 + lines) / (1 + df)) + 1, np.log(1 + lines) + 1
        self.units = self.tf * self.idf
        self.units /= np.linalg.norm(self.units, axis=1, keepdims=True)

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        return np.where(self.vocab[at] == words, at, -1)


def _units(line: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each word's line, its paragraph (lines with words that follow one another in a text), and its text."""
    paragraph = np.cumsum(np.concatenate([[True], (np.diff(line) > 1) | (np.diff(text) != 0)])[: len(line)])
    return line, paragraph, text


def _per_line(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line: one place of each, its line, and how often it occurs in it."""
    order = np.lexsort((words, line))
    w, k = words[order], line[order]
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])])) if len(w) else np.zeros(0, np.int64)
    return order[new], k[new], np.diff(np.append(new, len(w)))


def license_lines(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """row, license and cosine of the likest template of every row of docs (row, text); null where none reaches min_cosine.

    A template is compared with each line, each paragraph and the text as a whole. Of equally like ones the licence that sorts
    first counts. A line or text without words is like nothing.
    """
    model = _Model(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, lines = np.zeros(len(model.vocab) + 1, np.int64), 0
        for piece in _text.pieces(batches):
            words, line, _, _ = _lines(piece.column("text"))
            term = model.terms(words)
            lines += len(np.unique(line))
            keys = np.unique(line[term >= 0] * len(model.vocab) + term[term >= 0])
            df[:-1] += np.bincount(keys % len(model.vocab), minlength=len(model.vocab))
        df[-1] = lines
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().sort_values("term")["n"].to_numpy()
    model.weigh(*(counted[-1], counted[:-1]) if len(counted) else (0, np.zeros(len(model.vocab))))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            words, line, text, _ = _lines(piece.column("text"))
            n = piece.num_rows
            best, name = np.zeros(n), np.full(n, None, object)
            units = []
            for unit in _units(line, text):
                at, k, tf = _per_line(words, unit)
                ids, k = np.unique(k, return_inverse=True)
                term = model.terms(words[at])
                weight = tf * np.where(term >= 0, model.idf[term], model.rare)
                owner = np.zeros(len(ids), np.int64)
                owner[k] = text[at]
                inside = term >= 0
                units.append((owner, np.sqrt(np.bincount(k, weight**2, len(ids))), k[inside], term[inside], weight[inside]))
            for t in np.argsort(model.names, kind="stable"):
                top = np.zeros(n)
                for owner, norm, k, term, weight in units:
                    dot = np.bincount(k, weight * model.units[t][term], len(norm))
                    np.maximum.at(top, owner, np.round(dot / np.maximum(norm, 1e-300), 9))
                better = (top >= min_cosine) & (top > best)
                best[better], name[better] = top[better], model.names[t]
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(name, pa.string()), pa.array(best, mask=best == 0)], names=["row", "license", "cosine"])

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(match, f"row {kind}, license string, cosine double")


def license_scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, path, own_license, cosine, license and origin of files (doc_id, path, text).

    license is the file's own, else that of the nearest directory above it (its own first) with a licence file that has one;
    origin is `own`, that directory, or null. Of several licence files in a directory, the licence that sorts first counts.

    Null or empty text has no licence of its own. Null path: the file is in no directory and inherits nothing. Null doc_ids
    and repeated rows are rows of their own. No rows give no rows. Other columns are ignored.
    """
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path")).alias("row")
    own = materialize(license_lines(files.select(row, F.col("text").cast("string").alias("text")), templates, min_cosine), "licenses").select("row.*", F.col("license").alias("own_license"), "cosine")
    parts = F.split("path", "/")
    own = own.withColumns({"__dirs": F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "__id": F.monotonically_increasing_id()})
    stated = own.filter(F.col("own_license").isNotNull() & F.element_at(parts, -1).rlike(LICENSE_FILE)).groupBy(F.array_join("__dirs", "/").alias("dir")).agg(F.min("own_license").alias("dir_license"))
    stated = materialize(stated, "directory_licenses")
    # Only directories are joined with their ancestors: as many rows as they are deep.
    dirs = own.filter(F.col("path").isNotNull()).select(F.array_join("__dirs", "/").alias("of"), "__dirs").distinct()
    above = dirs.select("of", F.explode(F.sequence(F.lit(0), F.size("__dirs"))).alias("depth"), "__dirs")
    above = above.select("of", "depth", F.when(F.col("depth") > 0, F.array_join(F.expr("slice(__dirs, 1, depth)"), "/")).otherwise("").alias("dir"))
    nearest = above.join(stated, "dir").groupBy("of").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("from"))
    out = own.withColumn("of", F.when(F.col("path").isNotNull(), F.array_join("__dirs", "/"))).join(nearest, "of", "left")
    return out.select(
        "doc_id", "path", "own_license", "cosine",
        F.coalesce("own_license", "from.dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").otherwise(F.col("from.dir")).alias("origin"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: they are laid out as files by source and doc_id, every twentieth a licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = F.concat_ws("/", "source", F.expr("doc_id div 2000"), F.when(F.col("doc_id") % 40 != 0, F.expr("doc_id div 200")))
    name = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    return license_scan(docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")).withColumn("cosine", F.round("cosine", 6))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH RECURSIVE m AS (SELECT * FROM (VALUES {", ".join(f"""({i}, '{name}', '{text.replace("'", "''")}')""" for i, (name, text) in enumerate(TEMPLATES))}) t(k, license, text)),
mt AS (SELECT k, w, count(*) AS tf FROM (SELECT k, unnest({_TERMS.format("text")}) AS w FROM m) GROUP BY k, w),
l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
lt AS (SELECT doc_id, i, {_TERMS.format("s")} AS w FROM l),
lu AS (SELECT doc_id, i, w, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM lt WHERE len(w) > 0),
un AS (SELECT doc_id, 'l' || i AS line, w FROM lu UNION ALL SELECT doc_id, 'p' || p, w FROM lu UNION ALL SELECT doc_id, 't', w FROM lu),
uw AS (SELECT doc_id, line, w, count(*) AS tf FROM (SELECT doc_id, line, unnest(w) AS w FROM un) GROUP BY doc_id, line, w),
lw AS (SELECT * FROM uw WHERE line LIKE 'l%'),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, line FROM lw)),
v AS (SELECT w, ln((1 + (SELECT n FROM n)) / (1 + count(lw.w))) + 1 AS idf FROM (SELECT DISTINCT w FROM mt) x LEFT JOIN lw USING (w) GROUP BY w),
mn AS (SELECT k, sqrt(sum((tf * idf) ** 2)) AS norm FROM mt JOIN v USING (w) GROUP BY k),
ln_ AS (SELECT doc_id, line, sqrt(sum((tf * coalesce(idf, ln(1 + (SELECT n FROM n)) + 1)) ** 2)) AS norm FROM uw LEFT JOIN v USING (w) GROUP BY doc_id, line),
dot AS (SELECT doc_id, line, mt.k, sum(uw.tf * mt.tf * idf * idf) AS d FROM uw JOIN mt USING (w) JOIN v USING (w) GROUP BY doc_id, line, mt.k),
c AS (SELECT doc_id, license, max(round(d / ln_.norm / mn.norm, 9)) AS cosine FROM dot JOIN ln_ USING (doc_id, line) JOIN mn USING (k) JOIN m USING (k) GROUP BY doc_id, license),
b AS (SELECT doc_id, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS r FROM c WHERE cosine >= {MIN_COSINE}) WHERE r = 1),
f AS (SELECT doc_id, concat_ws('/', source, (doc_id // 2000)::VARCHAR, CASE WHEN doc_id % 40 <> 0 THEN (doc_id // 200)::VARCHAR END) AS dir,
  CASE WHEN doc_id % 20 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name FROM documents),
s AS (SELECT dir, min(license) AS license FROM f JOIN b USING (doc_id) WHERE name LIKE 'LICENSE.%' GROUP BY dir),
a AS (SELECT DISTINCT dir AS of, dir, 0 AS up FROM f UNION ALL SELECT of, regexp_replace(dir, '/[^/]*$', ''), up + 1 FROM a WHERE dir LIKE '%/%'),
i AS (SELECT of, arg_min(a.dir, up) AS dir, arg_min(license, up) AS license FROM a JOIN s ON s.dir = a.dir GROUP BY of)
SELECT f.doc_id, f.dir || '/' || f.name AS path, b.license AS own_license, round(b.cosine, 6) AS cosine, coalesce(b.license, i.license) AS license,
  CASE WHEN b.license IS NOT NULL THEN 'own' ELSE i.dir END AS origin
FROM f LEFT JOIN b ON b.doc_id = f.doc_id LEFT JOIN i ON i.of = f.dir
"""
