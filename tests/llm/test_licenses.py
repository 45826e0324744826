"""The licence scan against a brute-force cosine, the system's own licence files, and lines of the documents."""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frameloom.llm import licenses

SYSTEM = "/usr/share/common-licenses"
#: What the system's files are; others there have no template.
OWN = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def scan(spark, files):
    return {r["path"]: r for r in licenses.scan_licenses(spark.createDataFrame(files, "p string, text string"), F.col("p")).collect()}


def brute(text):
    """(licence, score) by plain cosines of every unit and template."""
    cued = lambda parts: [p for p in parts if re.search(licenses.CUE, p)]
    if tags := re.findall(licenses.TAG, text):
        return (licenses.SPDX_IDS[tags[0].strip().lower()], 1.0)
    units = cued(text.split("\n")) + [b for b in cued(re.split(licenses.BLANK, text)) if "\n" in b] + [licenses.RESERVED_LINE] * bool(re.search(licenses.RESERVED, text))
    flat = licenses.compared()
    n = Counter(w for _, words in flat for w in words)
    idf = lambda w: math.log((1 + len(flat)) / (1 + n[w])) + 1
    vector = lambda words: {w: (1 + math.log(k)) * idf(w) * (3 if w[0].isdigit() else 1) for w, k in words.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best, met = Counter(), {}
    for at, unit in enumerate(units):
        u = vector(Counter(licenses.words_of(unit)))
        for name, words in flat:
            t = vector(words)
            if all(w in u for w in t if licenses.binding(w)) and u and not (set(u) - set(t)) & licenses.MODIFIERS:
                score = round(sum(u.get(w, 0) * x for w, x in t.items()) / size(u) / size(t), 6)
                if set(t) <= set(u) and re.search(licenses.STATEMENT, unit) and len(licenses.words_of(unit)) <= licenses.MOST_WORDS:
                    score = max(score, licenses.THRESHOLD)
                if score >= licenses.THRESHOLD:
                    best[name] = max(best[name], score)
                    met.setdefault(name, set()).add(at)
    found = min(((name == licenses.RESERVED_NAME, -s, -len(met[name]), name) for name, s in best.items()), default=None)
    return (found[3], -found[1]) if found else (None, None)


@pytest.fixture(scope="module")
def texts():
    out = {f"s/{name}": open(f"{SYSTEM}/{name}", encoding="utf-8", errors="replace").read() for name in sorted(OWN) if os.path.exists(f"{SYSTEM}/{name}")}
    for name, ts in licenses.TEMPLATES.items():
        for i, t in enumerate(ts):
            words = t.split(" ")
            wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
            out[f"t/{name}/{i}"] = "# " + wrapped.replace("\n", "\n# ") + "\n#\n\ncode = 1\n"
    out |= {"x/gpl4": "This program is free software under the GNU General Public License, version 4.", "x/none": "a plain text\nof words", "x/two": "Licensed under CC BY 4.0.\nReleased under the MIT License.\nMIT License\nThe MIT License (MIT)"}
    return out


def test_cosines_are_brute_force(spark, texts):
    got = scan(spark, [(f"{i}/{p}", t) for i, (p, t) in enumerate(texts.items())])
    for i, (p, t) in enumerate(texts.items()):
        name, score = brute(t)
        r = got[f"{i}/{p}"]
        assert r["license"] == name and (score is None or abs(r["score"] - score) <= 2e-6), p


def test_the_systems_licence_files_get_their_own_licence(spark, texts):
    files = [(p.replace("s/", f"{i}/") + "/LICENSE", t) for i, (p, t) in enumerate(texts.items()) if p.startswith("s/")]
    got = scan(spark, files)
    assert {p.split("/")[1]: got[p]["license"] for p, _ in files} == {p.split("/")[1]: OWN[p.split("/")[1]] for p, _ in files}


def test_every_template_is_found_in_a_wrapped_comment(spark, texts):
    own = [(p, t) for p, t in texts.items() if p.startswith("t/") and re.search(licenses.CUE, t)]
    got = scan(spark, [(f"{i}/{p}", t) for i, (p, t) in enumerate(own)])
    shared = {"t/GPL-2.0/3", "t/LGPL-2.1/2"}
    for i, (p, _) in enumerate(own):
        assert got[f"{i}/{p}"]["license"] == p.split("/")[1] or p in shared, (p, got[f"{i}/{p}"])
    assert len(own) > 80


def test_versions_that_no_template_has_are_none(spark, texts):
    got = scan(spark, [(p, t) for p, t in texts.items() if p.startswith("x/")])
    assert got["x/gpl4"]["license"] is None and got["x/none"]["license"] is None and got["x/two"]["license"] == "MIT"


def test_reserved_rights_are_a_result_and_never_inherit(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    bsd = licenses.TEMPLATES["BSD-3-Clause"][0]
    files = [
        ("a/LICENSE", mit), ("a/x.txt", "words\nAll rights reserved.\nwords"), ("a/y.txt", "Copyright (c) 2019-2024 Acme Widgets Ltd, Springfield. ALL RIGHTS RESERVED"),
        ("a/z.txt", "words"), ("b/LICENSE", "Copyright 2020 Acme. All rights reserved.\n" + bsd), ("b/x.txt", "some rights reserved"), ("c/COPYING", "All rights reserved."), ("c/x.txt", "words"),
    ]
    got = {p: (r["license"], r["origin"]) for p, r in scan(spark, files).items()}
    mine = licenses.RESERVED_NAME
    assert got["a/x.txt"] == got["a/y.txt"] == got["c/COPYING"] == (mine, "own") and got["c/x.txt"] == (mine, "inherited")
    assert got["a/z.txt"] == ("MIT", "inherited") and got["b/LICENSE"] == ("BSD-3-Clause", "own") and got["b/x.txt"] == ("BSD-3-Clause", "inherited")


def test_every_licence_line_of_the_documents_has_a_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    known = {t: name for name, ts in licenses.TEMPLATES.items() for t in ts}
    want = {r["doc_id"]: {known[x.strip()] for x in (r["text"] or "").split("\n") if x.strip() in known} for r in docs.collect()}
    reserved = {r["doc_id"] for r in docs.filter(F.col("text").rlike(licenses.RESERVED)).collect()}
    found = licenses.scan_licenses(docs, F.col("doc_id").cast("string"), ["doc_id"]).filter("origin = 'own'").collect()
    got = {r["doc_id"]: r["license"] for r in found}
    assert len(reserved) > 50 and reserved <= set(got)
    assert all(got.get(i) in names for i, names in want.items() if names) and set(got) == {i for i, names in want.items() if names} | reserved


HEADERS = {
    "Licensed under the Apache License, Version 1.1": None, "SPDX-License-Identifier: LGPL-2.0-only": "LGPL-2.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": None, "CC-BY-NC-SA-4.0 license": None,
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": None, "WTFPL license version 2": None, "SPDX-License-Identifier: BSD-3-Clause-Clear": None,
    "// SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0", "All rights reserved.\nUse of this source code is governed by an MIT-style license": "MIT",
    "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */": "GPL-2.0 WITH Linux-syscall-note", "Licensed under the MIT license. See LICENSE file in the project root for full license information.": "MIT",
    "Licensed under GPLv3 or later": "GPL-3.0", "Licensed under GPLv4 or later": None, "License: GPLv2": "GPL-2.0", "# License: LGPL-2.1": "LGPL-2.1", "Licensed under the AGPL, version 3": "AGPL-3.0",
    "SPDX-License-Identifier: (MIT AND ISC) OR 0BSD": None, "SPDX-License-Identifier: (MIT AND ISC) OR GPL-2.0+": "(MIT AND ISC) OR GPL-2.0", "SPDX-License-Identifier: MIT OR": None, "SPDX-License-Identifier:": None,
    "SPDX-License-Identifier: mit": "MIT", "<!-- SPDX-License-Identifier: Apache-2.0 -->": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later OR (MIT": None, "SPDX-License-Identifier: NOASSERTION": None,
    "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: BSD-4-Clause": None, "SPDX-License-Identifier: CC0-1.0": "CC0-1.0", "SPDX-License-Identifier: CC-BY-4.0": "CC-BY-4.0", "SPDX-License-Identifier: CC-BY-3.0": None, "SPDX-License-Identifier: EPL-2.0": "EPL-2.0",
    "SPDX-License-Identifier: EPL-1.0": None, "SPDX-License-Identifier: EUPL-1.2": None, "SPDX-License-Identifier: GPL-1.0-only": "GPL-1.0", "SPDX-License-Identifier: GPL-3.0": "GPL-3.0", "SPDX-License-Identifier: GPL-3.0+": "GPL-3.0",
    "SPDX-License-Identifier: ISC": "ISC", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0-only": "LGPL-3.0", "SPDX-License-Identifier: MPL-1.0": None, "SPDX-License-Identifier: MPL-1.1": "MPL-1.1",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "SPDX-License-Identifier: MPL-2.0-no-copyleft-exception": None, "SPDX-License-Identifier: MS-PL": None, "SPDX-License-Identifier: PostgreSQL": None, "SPDX-License-Identifier: Unlicense": "Unlicense",
    "SPDX-License-Identifier: WTFPL": None, "SPDX-License-Identifier: X11": None, "SPDX-License-Identifier: Zlib": None, "SPDX-License-Identifier: Apache-1.1": None, "SPDX-License-Identifier: GPL-2.0 AND MIT WITH": None,
    "This license is not compatible with the GNU General Public License": None, "See the license terms of the vendor": None, "This library is distributed under the Boost Software License 1.0": None,
    "Licensed under the Apache License, Version 2.0 or the MIT license": "Apache-2.0", "Copyright 2024 Acme": None, "Licensed under the Academic Free License version 3.0": None, "Licensed under the Creative Commons BY-SA 4.0 license": "CC-BY-SA-4.0",
}


def test_headers_and_identifiers_have_their_own_licence_or_none(spark):
    got = scan(spark, [(f"{i}/f.txt", f"words\n{t}\nwords") for i, t in enumerate(HEADERS)])
    wrong = {t: got[f"{i}/f.txt"]["license"] for i, (t, want) in enumerate(HEADERS.items()) if got[f"{i}/f.txt"]["license"] != want}
    assert wrong == {}


def test_unknown_identifiers_do_not_inherit(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    files = [("a/LICENSE", mit), ("a/x.c", "// SPDX-License-Identifier: WTFPL\nint x;"), ("a/y.c", "int y;"), ("a/z.c", "// SPDX-License-Identifier: WTFPL\n// SPDX-License-Identifier: ISC\n"), ("b/COPYING", "SPDX-License-Identifier: EUPL-1.2"), ("b/x.c", "x")]
    got = {p: (r["license"], r["origin"]) for p, r in scan(spark, files).items()}
    assert got == {"a/LICENSE": ("MIT", "own"), "a/x.c": (None, "unknown"), "a/y.c": ("MIT", "inherited"), "a/z.c": ("ISC", "own"), "b/COPYING": (None, "unknown"), "b/x.c": (None, None)}
