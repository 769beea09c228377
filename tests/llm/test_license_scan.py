import math
import random
import re
import textwrap
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from sondage.llm import license_scan as L
from sondage.llm._words import text_bytes, words

#: Notices as they stand in files; none is a training sentence as a whole.
NOTICES = {
    "mit": 'Copyright (c) 2019 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd": "Copyright (c) 2011, The Project Authors\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache": 'Copyright 2021 The Authors\n\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl": "This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Copyright (c) 2004 Some One\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
UNSEEN = {
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at http://scripts.sil.org/OFL",
    "artistic": "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
}
M64 = (1 << 64) - 1


@pytest.fixture(scope="module")
def model():
    return L.train()


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for p in text.split("\n") for line in (textwrap.wrap(p, width) or [""]))


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain(model, text):
    """(probability of none, likeliest family, its probability) of one paragraph, n-gram by n-gram."""
    at = {int(k): i for i, k in enumerate(model["keys"])}
    text = re.sub(r"[,;()\"'`<>\[\]{}*#]", " ", text)
    text = re.sub(r"[.:!?](?=[\x20\x09-\x0D]|$)", " ", text)
    split = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text) if any(c.isascii() and c.isalnum() or ord(c) > 127 for c in w)]
    h = [int(words(*text_bytes(pa.array([w])))[0][0]) for w in split]
    rows = set()
    for k in (1, 2, 3):
        for i in range(len(h) - k + 1):
            g = mixed(h[i])
            for j in range(1, k):
                g = mixed((g + h[i + j] * (2 * j + 1)) & M64)
            rows.add(at.get(mixed((g + k) & M64), -1))
    rows.discard(-1)
    if not rows:
        return None
    z = [(sum(float(model["w"][r][f]) for r in rows) / math.sqrt(max(1.0, sum(float(model["q"][r]) for r in rows))) + float(model["b"][f])) / model["t"] for f in range(len(L.FAMILIES))]
    e = [math.exp(x - max(z)) for x in z]
    p = [x / sum(e) for x in e]
    f = max(range(1, len(p)), key=p.__getitem__)
    return p[0], f, p[f]


def sequences(text, k):
    text = re.sub(r"[.:!?](?=[\x20\x09-\x0D]|$)", " ", re.sub(r"[,;()\"'`<>\[\]{}*#]", " ", text))
    w = [x.lower() for x in text.split() if any(c.isalnum() for c in x)]
    return set(zip(*(w[i:] for i in range(k))))


def covered(text, family):
    for s in [*L.TEMPLATES[L.FAMILIES[family]], *L.NAMES.get(L.FAMILIES[family], [])]:
        k = 2 if sequences(s, 2) else 1
        if len(sequences(text, k) & sequences(s, k)) >= 0.7 * len(sequences(s, k)):
            return True
    return False


def brute(model, text):
    lines = (text or "").split("\n")
    has = [any(c.isascii() and c.isalnum() or ord(c) > 127 for c in x) for x in lines]
    out = []
    blocks = [[i for i, _ in g] for k, g in groupby(enumerate(has), key=lambda x: x[1]) if k]
    for n, block in enumerate(blocks):
        units = [(block[0], "\n".join(lines[i] for i in block)), *((i, lines[i]) for i in block)]
        hits = []
        for i, said in units:
            r = plain(model, said)
            if r and r[0] < 0.55:
                sure = covered(said, r[1])
                ok = sure and r[2] >= model["least"]
                hits.append((i, L.FAMILIES[r[1]] if ok else L.UNKNOWN, r[2] if ok else 1 - r[0], sure))
        known = [x for x in hits if x[1] != L.UNKNOWN] or hits[:1]
        for family in sorted({x[1] for x in known}):
            same = [x for x in known if x[1] == family]
            i, name, p, sure = same[1] if len(same) > 1 else same[0]
            out.append((n, i, name, pytest.approx(p, abs=1e-4), sure))
    return len(blocks), out


def test_same_as_paragraph_by_paragraph(spark, model):
    r = random.Random(3)
    filler = " ".join(L.OTHER).split()
    rows = [("a", None), ("b", ""), ("c", "\n\n"), ("d", "All rights reserved."), ("e", "\n" + L.TEMPLATES["mit"][2] + "\n"), ("e", "-- \n# \n" + wrapped(NOTICES["bsd"], 40, "# ")), ("f", None)]
    for i in range(40):
        lines = [" ".join(r.choices(filler, k=r.choice([0, 0, 5, 30]))) for _ in range(r.randrange(1, 8))]
        if i % 2:
            lines.insert(r.randrange(len(lines) + 1), wrapped(r.choice([*L.ODD, *UNSEEN.values(), *NOTICES.values()]), r.choice([30, 60, 200])))
        rows.append((f"x{i}", "\n".join(lines)))
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id string, text string, findings int")
    got = sorted((x["doc_id"], x["n_paragraphs"], [tuple(f) for f in x["findings"]]) for x in L.scan(df, model=model).collect())
    want = sorted(((i, *brute(model, t)) for i, t in rows), key=lambda x: x[:2])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == w[2], g
    assert L.scan(df.limit(0), model=model).count() == 0


def test_wrapped_notices_are_found_and_unseen_licences_are_unknown(spark, model):
    rows = [(f"{name} {width} {mark}", "some text of the file.\n\n" + wrapped(t, width, mark)) for name, t in NOTICES.items() for width in (38, 72, 500) for mark in ("", "# ", " * ")]
    rows += [(f"unknown {name} {width}", wrapped(t, width)) for name, t in UNSEEN.items() for width in (50, 500)]
    out = {x["doc_id"]: {f["family"] for f in x["findings"]} for x in L.scan(spark.createDataFrame(rows, "doc_id string, text string"), model=model).collect()}
    known = {k: v - {L.UNKNOWN} for k, v in out.items() if not k.startswith("unknown")}
    assert all(v == {k.split()[0]} for k, v in known.items()), known  # recall and precision of families: 1
    assert all(v == {L.UNKNOWN} for k, v in out.items() if k.startswith("unknown")), out


#: Notices in wordings that aren't trained on.
FRESH = [
    ("mit", "MIT License"), ("mit", "The code is MIT licensed."), ("mit", "This repository uses the MIT license, so have fun with it."), ("mit", "Copyright (c) 2022 Jo Li. Under MIT License, see the root folder."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("apache", "Apache License 2.0"), ("apache", "Code licensed under Apache 2.0 license by the team"), ("apache", "We chose the Apache License, Version 2.0 for everything in here."),
    ("apache", "Licensed to the Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("bsd", 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.'), ("bsd", "BSD 3-Clause License"), ("bsd", "Rights are granted as in the New BSD License."), ("bsd", "This tool ships under a 2-clause BSD notice"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."), ("gpl", "Distributed under GPLv3."), ("gpl", "Copying is allowed by the GNU GPL, any version."), ("gpl", "License terms are GPL v2"), ("gpl", "The kernel module falls under the GNU General Public License."),
    ("lgpl", "Linking is allowed: the library has the GNU Lesser General Public License."), ("lgpl", "Bindings are offered under LGPLv3 only."), ("agpl", "The server is AGPLv3."), ("agpl", "Network use counts under the GNU Affero General Public License."),
    ("mpl", "Subject to the Mozilla Public License 2.0, a copy is in the tree."), ("mpl", "This add-on is MPL 2.0"), ("isc", "ISC License (ISC)"), ("isc", "The parser is ISC licensed by its author"),
    ("cc-by", "Except where noted, the text is CC BY 4.0."), ("cc-by", "Except where otherwise noted, this work is licensed under a Creative Commons Attribution 4.0 International License, (c) 2021 A. Author."), ("cc-by", "Photos: Creative Commons Attribution 3.0"),
    ("cc-by-sa", "Articles of the wiki are CC BY-SA 3.0."), ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License; by using this site you agree to the terms."), ("cc-by-nc", "Slides are shared as CC BY-NC 4.0"), ("cc-by-nd", "The map is CC BY-ND 4.0, don't change it."),
    ("mit", "Free to use, MIT License."), ("apache", "Terms: Apache License 2.0, January 2004"), ("bsd", "(c) 1998 the group; BSD License applies"), ("gpl", "GPL-3.0 or newer please"), ("gpl", "Any reuse must follow the GNU General Public License"),
    ("lgpl", "plugin under LGPL v3"), ("mpl", "MPL-2.0"), ("isc", "ISC licence, do what you like"), ("cc-by", "Figures may be reused (CC-BY-4.0)"), ("cc-by-sa", "Wiki text: CC-BY-SA-4.0"), ("cc-by-nc", "You may share this under Creative Commons Attribution-NonCommercial 4.0"),
    ("public-domain", "Released into the public domain by its author in 2003"), ("public-domain", "I put this script in the public domain."), ("public-domain", "Data: CC0 1.0"), ("public-domain", "No rights kept, see the Unlicense"),
]


def test_wordings_that_nobody_trained_on(spark, model):
    trained = set(L.examples()[0])
    assert sum(t in trained for _, t in FRESH) <= 6  # a bare name is a notice, whoever writes it
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(FRESH)], "doc_id long, text string")
    got = {x["doc_id"]: {f["family"] for f in x["findings"]} for x in L.scan(df, model=model).collect()}
    wrong = [(f, t, got[i]) for i, (f, t) in enumerate(FRESH) if got[i] != {f}]
    assert len(wrong) <= 0.1 * len(FRESH), wrong


def test_held_out(model):
    assert model["accuracy"] > 0.8 and model["known"] > 0.9 and model["unseen"] > 0.85
    assert 0.02 < model["least"] < 0.98  # inside the range that is searched
    assert (L.score_texts(model, L.OTHER).argmax(1) == 0).all()


def test_very_long_and_repeated(spark, model):
    long = "é\n" * 30000 + "Released under the MIT License." + "\n" + "x " * 50000
    df = spark.createDataFrame([(5, long), (5, long), (None, long)], "doc_id long, text string")
    for x in L.scan(df, model=model).collect():
        assert x["n_paragraphs"] == 1 and [(f["line"], f["family"]) for f in x["findings"]] == [(30000, "mit")]


def test_licence_lines_of_the_documents(spark, sf_dir, model):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = L.scan(docs, model=model).join(docs.select("doc_id", "text"), "doc_id").collect()
    want = {r["doc_id"]: sorted({lines[x] for x in (r["text"] or "").split("\n") if x in lines}) for r in rows}
    got = {r["doc_id"]: sorted({f["family"] for f in r["findings"]}) for r in rows}
    assert sum(bool(w) for w in want.values()) > 2 and np.mean([got[i] == want[i] for i in want]) > 0.99
    assert all(set(want[i]) <= set(got[i]) for i in want)
