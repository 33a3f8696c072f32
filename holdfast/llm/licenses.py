"""Licence detection: sparse TF-IDF cosine to licence templates, then inheritance from the nearest ancestor directory.

Every line of a text that has a licence cue is a header; runs of cue lines next to each other are one header, and the block
of lines around it, up to a blank one or one of another comment sign, another. These, and the whole text and its paragraphs where the file's
name is that of a licence file or headers make up half of it, are compared with all templates over a sparse weighted
vocabulary (words and word pairs, inverse document frequency over the templates). What is larger is asked first: the text,
then blocks, then headers and paragraphs; the first of these with a template at `SURE` or more decides, as a sentence that
two licences share says less than the text around it. Else the best template at `LEAST` or more is the document's own
licence; ties go to the first name. A document without one
inherits from the nearest directory above it that has a licence file: the directories of a path are exploded, each directory once, and joined
by equality with the licence files' directories, which are first reduced to one licence for each directory (best score,
then name). Null texts are empty, null paths have no directory and inherit nothing; repeated rows are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts that several licences share parts of, as they are published.
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS
    + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)


def _grant(what: str, name: str, version: str, later: bool = True) -> str:
    """The grant of the GNU licences, as headers have it."""
    which = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License only."
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; {which}"


def _gnu(what: str, name: str, version: str) -> tuple[str, ...]:
    grant = _grant(what, name, version)
    rest = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    return grant, f"{grant} {rest}", _grant(what, name, version, later=False), f"This {what} is licensed under the GNU {name}, version {version}.", f"GNU {name} v{version}"


#: Usual notices, several for each licence.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE, "SPDX-License-Identifier: Apache-2.0"),
    "BSD-2-Clause": (f"{_BSD_1} {_BSD_2} {_BSD_END}", f"{_BSD_1} {_BSD_2}", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (f"{_BSD_1} {_BSD_2} {_BSD_3} {_BSD_END}", f"{_BSD_1} {_BSD_2} {_BSD_3}", "BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "GPL-3.0": (*_gnu("program", "General Public License", "3"), "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-2.1": (*_gnu("library", "Lesser General Public License", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "LGPL-3.0": (*_gnu("library", "Lesser General Public License", "3"), "This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "MIT": (_MIT, "MIT License", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "GPL-2.0": (*_gnu("program", "General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only"),
    "AGPL-3.0": (*_gnu("program", "Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: EPL-2.0"),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Zlib": (_ZLIB, _ZLIB.partition(" Permission is")[0], "zlib License", "SPDX-License-Identifier: Zlib"),
    "BSL-1.0": (_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
}
LEAST, SURE = 0.6, 0.85
CUE = re.compile(r"licen[sc]e|copyright|\(c\) [0-9]|©|spdx|all rights reserved|redistribution and use|permission is hereby granted|free software|provided .{0,2}as.is|cc by|creative commons", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
COMMENT = re.compile(r"\s*(//+|#+|\*(?!\*)|--+|;+|%+|)")
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")
FILE_NAME = re.compile(r"(?i)^(licen[sc]e|copying|copyright|notice|unlicense)([.-][a-z0-9.-]+)?$")


def terms(text: str) -> Counter:
    words = WORD.findall(text.lower())
    return Counter(words) + Counter(zip(words, words[1:]))


@lru_cache
def _index() -> tuple[dict, dict, list]:
    """Weights of terms, postings (term: template, weight) and the templates' licences."""
    bags = [(name, terms(t)) for name, texts in sorted(TEMPLATES.items()) for t in texts]
    seen = Counter(t for _, bag in bags for t in bag)
    weight = {t: 1 + math.log(len(bags) / n) for t, n in seen.items()}
    postings: dict = {}
    for i, (_, bag) in enumerate(bags):
        norm = math.sqrt(sum((n * weight[t]) ** 2 for t, n in bag.items()))
        for t, n in bag.items():
            postings.setdefault(t, []).append((i, n * weight[t] / norm))
    return weight, postings, [name for name, _ in bags]


def best(text: str) -> tuple[str | None, float]:
    """The licence whose template is nearest, and the cosine; terms of no template weigh as the rarest do."""
    weight, postings, names = _index()
    bag, rarest = terms(text), 1 + math.log(len(names))
    norm = math.sqrt(sum((n * weight.get(t, rarest)) ** 2 for t, n in bag.items()))
    score: Counter = Counter()
    for t, n in bag.items():
        for i, w in postings.get(t, ()):
            score[i] += n * weight[t] * w
    if not score:
        return None, 0.0
    top = min(score, key=lambda i: (-round(score[i], 12), names[i]))
    return names[top], score[top] / norm


def headers(text: str) -> list[str]:
    if not CUE.search(text):
        return []
    out, last = [], -2
    for i, line in enumerate(text.split("\n")):
        if CUE.search(line):
            if i == last + 1:
                out[-1] += "\n" + line
            else:
                out.append(line)
            last = i
    return out


def blocks(text: str) -> list[str]:
    """The runs of lines that hold a cue, up to a blank line or one that begins with another comment sign."""
    out, held, cue, sign = [], [], False, ""
    for line in (*text.split("\n"), ""):
        own = COMMENT.match(line)[1]
        if held and (own != sign or not line.strip()):
            if cue:
                out.append("\n".join(held))
            held, cue = [], False
        if line.strip():
            held.append(line)
            cue, sign = cue or bool(CUE.search(line)), own
    return out


def own_license(text: str, name: str) -> tuple[str | None, float, bool]:
    """Licence, cosine, and whether the document is a licence file."""
    found = headers(text)
    file = bool(FILE_NAME.match(name)) or bool(found) and 2 * sum(map(len, found)) >= len(text.strip())
    tiers = [[text] if file else [], [b for b in blocks(text) if b not in found] if found else [], found + (PARAGRAPH.split(text) if file else [])]
    name, score = None, 0.0
    for tier in tiers:
        tried = [best(part) for part in tier]
        name, score = min([(name, score), *tried], key=lambda x: (-x[1], x[0] or ""))
        if score >= SURE:
            break
    return (name, score, file) if score >= LEAST else (None, score, False)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        got = [own_license(t or "", (p or "").rpartition("/")[2]) for t, p in zip(batch.column("text").to_pylist(), paths)]
        name, score, file = zip(*got) if got else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(file, pa.bool_())], ["doc_id", "path", "own", "cosine", "file"])


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """A row for each document: doc_id, path, own (its licence or null), cosine, license (own or inherited), inherited_from (a directory)."""
    from .common import table

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    found = table(rows.mapInArrow(_own, f"doc_id {kind}, path string, own string, cosine double, file boolean").withColumn("row", F.monotonically_increasing_id()), "licenses")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    by_dir = found.where("file and path is not null").select(folder.alias("above"), "own", "cosine")
    by_dir = by_dir.groupBy("above").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own").alias("license"))).alias("l")).select("above", F.col("l.license").alias("inherited"))
    lacking = found.where("own is null and path is not null").select("row", folder.alias("dir"))
    parts = F.split("dir", "/")
    above = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    near = lacking.select("dir").distinct().select("dir", F.explode(above).alias("above")).join(by_dir, "above")
    near = near.groupBy("dir").agg(F.max_by(F.struct("above", "inherited"), F.length("above")).alias("n"))
    near = lacking.join(near, "dir").select("row", F.col("n.above").alias("inherited_from"), F.col("n.inherited").alias("inherited"))
    return found.join(near, "row", "left").select("doc_id", "path", "own", "cosine", F.coalesce("own", "inherited").alias("license"), "inherited_from")
