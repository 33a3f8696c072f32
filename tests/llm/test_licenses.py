from __future__ import annotations

import math
import random
import textwrap

import numpy as np

from holdfast.llm import licenses


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/d/x.py", "plain code"),
        (3, "a/b/c/own.py", "SPDX-License-Identifier: Apache-2.0\ncode follows here, more of it than the line above has characters"),
        (4, "a/other.py", "nothing"),
        (5, "LICENSE.txt", "Licensed under CC BY 4.0."),
        (6, "ab/z.py", None),
        (7, None, "text"),
        (8, "a/b/c/d/x.py", "plain code"),
        (9, "q/r.txt", "a licence to talk about nothing that any of them says"),
        (None, "a/b/n.txt", ""),
    ]
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], "doc_id long, path string, text string, license string, row long")
    got = {(r.doc_id, r.own, r.license, r.inherited_from) for r in licenses.licenses(docs).collect()}
    assert got == {
        (1, "MIT", "MIT", None), (2, None, "MIT", "a/b"), (3, "Apache-2.0", "Apache-2.0", None), (4, None, "CC-BY-4.0", ""), (5, "CC-BY-4.0", "CC-BY-4.0", None),
        (6, None, "CC-BY-4.0", ""), (7, None, None, None), (8, None, "MIT", "a/b"), (9, None, "CC-BY-4.0", ""), (None, None, "MIT", "a/b"),
    }


def test_every_template_is_nearest_to_itself():
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert licenses.best(t)[0] == name and licenses.best(t)[1] > 0.999


def test_whole_licence_files_are_known_by_a_paragraph():
    body = "\n\n".join(f"{i}. Terms of clause {i} that no template holds, about uses and duties of whoever takes part." for i in range(40))
    for title, name in (
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "GPL-2.0"),
        ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ):
        assert licenses.own_license(f"{title}\n\n{body}", "LICENSE")[0] == name
    assert licenses.own_license(body, "LICENSE")[0] is None


def test_cosines_against_dense_vectors():
    """The sparse index against vectors over all terms."""
    bags = [(name, licenses.terms(t)) for name, texts in sorted(licenses.TEMPLATES.items()) for t in texts]
    draw, pool = random.Random(3), [w for _, b in bags for w in b if isinstance(w, str)]
    for _ in range(50):
        text = " ".join(draw.choices(pool, k=draw.randint(1, 60)) + draw.choices(["other", "words"], k=draw.randint(0, 5)))
        bag = licenses.terms(text)
        every = sorted({t for _, b in bags for t in b} | set(bag), key=str)
        weight = np.array([1 + math.log(len(bags) / max(1, sum(t in b for _, b in bags))) for t in every])
        x = np.array([bag[t] for t in every]) * weight
        cosine = [float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for _, b in bags for y in [np.array([b[t] for t in every]) * weight]]
        name, score = licenses.best(text)
        assert abs(score - max(cosine)) < 1e-9
        assert name in {n for (n, _), c in zip(bags, cosine) if c > max(cosine) - 1e-9}


def test_empty_table(spark):
    assert licenses.licenses(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []


CODE = "\n".join(f"int function_{i}(char *value) {{ return value[{i}] + counter; }}" for i in range(60))
OWNER = ("Copyright (c) 2015, Someone\nAll rights reserved.\n\n", "Copyright 1999-2021 The Authors of Something\n\n", "")


def _labelled():
    """Texts of known licences, wrapped, behind comment signs and in files of their own; words are lost in some."""
    draw = random.Random(8)
    of = licenses.TEMPLATES
    texts = {n: of[n][0] for n in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "Zlib")} | {n: of[n][1] for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC")} | {"Apache-2.0": licenses._APACHE, "MPL-2.0": of["MPL-2.0"][1], "EPL-2.0": of["EPL-2.0"][1]}
    for name, text in texts.items():
        for i in range(12):
            words = [w for w in text.split() if i % 3 or draw.random() > 0.03]
            body = OWNER[i % 3] + "\n".join(textwrap.wrap(" ".join(words), draw.randint(60, 90)))
            if i % 2:
                yield name, body, draw.choice(["LICENSE", "COPYING.txt", "license.md"])
            else:
                sign = draw.choice(["# ", " * ", "// ", "-- "])
                yield name, "\n".join((sign + line).rstrip() for line in body.split("\n")) + "\n" + CODE, "src.c"


def test_labelled_licences_and_nothing_else():
    found = [(want, licenses.own_license(text, name)[0]) for want, text, name in _labelled()]
    assert sum(a == b for a, b in found) >= 0.9 * len(found)
    assert {(a, b) for a, b in found if b not in (a, None)} == set()


def test_versions_and_clauses_are_told_apart():
    grant = "either version {} of the License, or (at your option) any later version."
    of = licenses._grant
    assert licenses.own_license("# " + of("program", "General Public License", "2").replace("; either", ";\n# either"), "x.py")[0] == "GPL-2.0" and grant.format(2) in of("program", "General Public License", "2")
    two, three = licenses.TEMPLATES["BSD-2-Clause"][0], licenses.TEMPLATES["BSD-3-Clause"][0]
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause")):
        assert licenses.own_license("\n\n".join(text.replace(". 2", ".\n\n2").replace(". 3", ".\n\n3").split("\n\n")), "LICENSE")[0] == name
    for version in ("2.1", "3"):
        title = f"GNU LESSER GENERAL PUBLIC LICENSE\n       Version {version}, {'February 1999' if version == '2.1' else '29 June 2007'}\n\n" + "other words of a preamble\n\n" * 30
        assert licenses.own_license(title, "COPYING")[0] == f"LGPL-{version if version == '2.1' else '3.0'}"


def test_odd_rows(spark):
    long = "plain words of nothing at all " * 40_000 + "\nSPDX-License-Identifier: MIT\n" + "more " * 40_000
    rows = [(1, None, None), (2, None, "Released under the MIT License."), (3, "a/LICENSE", ""), (4, "a/x", long), (4, "a/x", long), (5, "", "© nobody"), (6, "///", "x")]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id int, path string, text string")).collect()
    assert sorted((r.doc_id, r.own, r.license) for r in got) == [(1, None, None), (2, "MIT", "MIT"), (3, None, None), (4, "MIT", "MIT"), (4, "MIT", "MIT"), (5, None, None), (6, None, None)]
