"""License scans: a trained paragraph classifier, a calibrated unknown class, and a comparison with templates.

A paragraph is a run of lines that have a word; its lines by themselves are scored too, as a notice may stand in one
line of a longer run. Words without a letter or digit (comment marks at the start of lines) and punctuation at the ends
of words don't count, so wrapping and comments change nothing. A softmax regression over hashed word 1- to 3-grams (those of the training texts only,
so the model is small and sparse) tells licence families from each other and from other prose. It is trained here on
sentences of public licences, whole, in parts and in runs, and on short notices (each name of a family in each of many
wordings), against prose about licences that isn't one.

Temperature and the confidence below which a licence is "unknown" are fitted on sentences and families held out: models
are trained without some families (their sentences are unseen licences) and without some sentences of the others. The
least confidence is the one that tells the two apart best. A family counts as confirmed if the paragraph's word pairs
cover most of one of the template's sentences, or it has a name of the family.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import narrow_batches
from ._words import chunks, distinct, mix, released, shingles, text_bytes, words
from .lm_scoring import Table

#: Characteristic sentences of public licences, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under Creative Commons Attribution unless otherwise noted.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Names of the families. A name is a template too: a text that has it whole is confirmed.
NAMES = {
    "apache": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0", "Apache Software License", "Apache 2 License", "Apache License"],
    "mit": ["MIT License", "MIT licence", "MIT licensed", "MIT-licensed", "MIT-style license", "MIT/X11 License", "Expat License"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL-2.0", "GPL-3.0", "GPL License", "GPL 3"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPLv2.1", "LGPLv3", "LGPL v3", "LGPL-2.1", "LGPL-3.0", "LGPL License"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL v3", "AGPL-3.0", "AGPL License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD", "2-clause BSD", "New BSD License", "BSD licensed"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL v2"],
    "isc": ["ISC License", "ISC licence", "ISC licensed", "ISC-style license"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "CC-BY license", "Creative Commons Attribution License", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-Share Alike", "CC-BY-SA license"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial", "CC-BY-NC license"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives", "CC-BY-ND license"],
    "public-domain": ["CC0 1.0", "CC0-1.0", "the public domain", "the Unlicense", "Creative Commons Zero", "CC0 license"],
}
#: Short notices by the words round a name; the groups that are held out take every fourth of them.
FRAMES = [
    "{}", "Licensed under the {}.", "Released under the {}.", "This project is licensed under the terms of the {}.", "Distributed under {}.", "License: {}",
    "The source code is available under {}.", "See LICENSE for details ({}).", "Use of this source code is governed by a {} that can be found in the LICENSE file.", "Published by the authors under {}, see the file COPYING.",
    "SPDX-License-Identifier: {}", "All files are covered by the {} unless stated otherwise.", "Our software is free, it comes with the {}.", "You can use, copy and change this library under the {}.",
    "Copyright 2018 The Authors, {}", "The documentation and the data are {}", "It is made available under {} or, at your choice, any later version.",
]
#: Sentences that aren't a licence, some with a licence's words; and grants of licences that no template has.
OTHER = [
    "He lost his driving license after the second accident and had to apply for a new one.",
    "The permission of the owner is required before entering the building at night.",
    "All the rights of the people were reserved for the few who could read them.",
    "She released the album under a new label and went on tour.",
    "The software is distributed over three servers and can be used from any office.",
    "The museum is open to the public without charge on Sundays.",
    "We use this work to show that the general theory holds in version two of the model.",
    "The copy of the file that you obtained is missing the second part.",
    "A warrant was issued for the arrest of the man who sold the copies.",
    "The helicopter of the Apache type landed near the city of Boston.",
    "Students at the institute of technology in Massachusetts built the first of them.",
    "The source of the river lies in the form of a small lake in the mountains.",
    "The following conditions were observed in the laboratory for all of the samples.",
    "Please contact the author if you have any questions about the content of this page.",
    "Version 2.0 of the document was published last year and is now in use.",
    "The state may not use force except in compliance with the law.",
    "Creative people often work in common spaces with attribution of ideas to the group.",
    "This is the second time that the material has been reproduced in the press.",
    "This was not what they had in mind, and this is why it was all left as it is.",
    "Tea or coffee, or perhaps a little wine, is served to any of the guests who come in or stay for the night.",
    "Whether or not they knew it, this or that was to be done by them, with or without any help from here.",
    "Any of these, and each of those, may be for you or for your friends, and all of it is to be had in time.",
    "It was here that the two met, and from then on nobody saw the one without the other and its shadow.",
    "To use it in this way or in that is a question of taste, and any answer to it is as good as the next.",
    "What follows in the text and the notes is in part by the editor, and in part from the letters of the time.",
    "This is how this town, this street and this house of theirs came to be what this story is about.",
    "I know this, he said, and this too, but this one thing is new to me.",
    "Der Mann ging mit dem Hund in den Wald und kam mit ihm zurück, mit leeren Händen.",
    "Das Haus mit der Nummer sechs ist von der Straße aus nicht zu sehen, mit oder ohne Licht.",
    "La maison de la rue est pour les enfants qui ne sont pas dans la ville avec eux.",
    "El perro de la casa es para los que no se van con el tren de las seis.",
    "The rooms are available under the terms of the contract that you signed with us.",
    "Distributed under the tables were boxes of apples for all of the guests.",
    "See the manual for details, it is made available by the library at any later hour.",
    "All files are kept in the cellar unless stated otherwise by the head of the office.",
    "Our school is free, it comes with the general duty to the public.",
    "The attribution of the painting is not certain, and its use by the public is not a crime in common law.",
]
ODD = [
    "Licensed under the Foo Bar Community License, see the file for its terms.",
    "This work is licensed under the Quux License, version 7.",
    "You may use this data set under the terms of our research agreement license.",
    "Released under the Beerware license by the author.",
    "Distributed under the Vim license, a charityware license.",
    "Use of this font is governed by the Open Font License agreement.",
]
NONE, UNKNOWN = "none", "unknown"
FAMILIES = [NONE, *TEMPLATES]
#: Share of a template sentence's word pairs that a paragraph must have; groups of families and of sentences held out.
COVER, FOLDS = 0.7, 4
_SOFT, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SOFT[list(b",;()\"'`<>[]{}*#")] = True
_STOP[list(b".:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _cleaned(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of the texts with brackets, quotes, commas and marks, and stops at the ends of words, as spaces."""
    raw = data[int(at[0]) : int(at[-1])].copy()
    raw[_SOFT[raw]] = 32
    after = np.append(raw[1:], 32)
    after[(at[1:-1] - at[0] - 1)[at[1:-1] > at[0]]] = 32  # what follows belongs to the next text
    raw[_STOP[raw] & ((after == 32) | (after >= 9) & (after <= 13))] = 32
    return raw


def _plain_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words that have a letter or digit, punctuation at their ends aside."""
    raw = _cleaned(data, at)
    h, starts, ends, _ = words(raw, at - at[0])
    if not len(h):
        return h, starts
    seen = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    full = seen[ends] > seen[starts]
    return h[full], starts[full]


def features(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of the word 1- to 3-grams of each text."""
    out = []
    data, at = text_bytes(pa.array(texts, pa.string()))
    for i in range(len(texts)):
        h = _plain_words(data, at[i : i + 2])[0]
        out.append(distinct(np.concatenate([_salted(shingles(h, k), k) for k in (1, 2, 3)])))
    return out


def _salted(h: np.ndarray, k: int) -> np.ndarray:
    return mix(h + np.uint64(k))


def examples(seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Training texts, families, and the group of sentences of each: sentences whole, in parts, in other words, in runs."""
    r = random.Random(seed)
    filler = " ".join(OTHER).lower().split()
    texts, labels, groups = [], [], []

    def add(sentence: str, label: int, n: int, group: int) -> None:
        w = sentence.split()
        for k in range(n):
            part = w
            if k and len(w) > 12:
                size = r.randrange(max(8, len(w) // 2), len(w) + 1)
                at = r.randrange(len(w) - size + 1)
                part = w[at : at + size]
            before = r.sample(filler, r.choice([0, 0, 3, 12])) if k > 1 else []
            after = r.sample(filler, r.choice([0, 0, 3, 12])) if k > 1 else []
            text = " ".join([*before, *part, *after])
            texts.append(text.upper() if k % 7 == 6 else text)
            labels.append(label)
            groups.append(group)

    for i, sentences in enumerate([OTHER, *TEMPLATES.values()]):
        for j, sentence in enumerate(sentences):
            add(sentence, i, 12, j % FOLDS)
        for g in range(FOLDS):
            own = sentences[g::FOLDS]
            for _ in range(4 if len(own) > 1 else 0):
                add(" ".join(r.sample(own, r.randrange(2, len(own) + 1))), i, 1, g)
        if i:
            for j, sentence in enumerate(sentences * 4):
                add(sentence, i, 1, j % len(sentences) % FOLDS)
    for i, names in enumerate((NAMES.get(f, []) for f in TEMPLATES), 1):
        for name in names:
            for j, frame in enumerate(FRAMES):
                add(frame.format(name), i, 1, j % FOLDS)
    for k in range(1200):  # lines and paragraphs of loose words, in proportion and of a few words over and over
        some = filler if k % 2 else r.sample(filler, r.choice([5, 40]))
        add(" ".join(r.choices(some, k=r.choice([3, 8, 20, 60, 200 if k % 8 == 0 else 30]))), 0, 1, k % FOLDS)
    return texts, np.array(labels), np.array(groups)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(found: list[np.ndarray], y: np.ndarray, rounds: int, ridge: float) -> dict:
    """Feature keys (of three training texts or more), weights (feature x family) and bias by gradient descent.

    A feature counts by its inverse document frequency (``q``: its square), so that names weigh more than what is said
    round them; a text has length one.
    """
    every, times = np.unique(np.concatenate(found), return_counts=True)
    keys = every[times > 2]
    idf = np.log(len(found) / times[times > 2]).astype(np.float32)
    x = np.zeros((len(found), len(keys)), np.float32)
    for i, f in enumerate(found):
        at = _at(keys, f)
        x[i, at] = idf[at]
    x /= np.maximum(1, np.sqrt((x * x).sum(1, keepdims=True)))
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b = np.zeros((len(keys), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    mw, mb, rate = np.zeros_like(w), np.zeros_like(b), 8.0
    for _ in range(rounds):
        g = _softmax(x @ w + b) - target
        mw, mb = 0.9 * mw + x.T @ g / len(x) + ridge * w, 0.9 * mb + g.mean(0)
        w, b = w - rate * mw, b - rate * mb
    return {"keys": keys, "w": w * idf[:, None], "q": idf * idf, "b": b, "t": 1.0}


def _at(keys: np.ndarray, f: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, f)
    at[at == len(keys)] = 0
    return at[keys[at] == f]


def _logits(model: dict, found: list[np.ndarray]) -> np.ndarray:
    rows = [_at(model["keys"], f) for f in found]
    return np.array([model["w"][at].sum(0) / max(1.0, np.sqrt(model["q"][at].sum())) + model["b"] for at in rows]).reshape(len(found), len(FAMILIES))


@lru_cache(maxsize=2)
def train(seed: int = 11, rounds: int = 80, ridge: float = 1e-4) -> dict:
    """The model: keys, weights, bias, temperature ``t``, least confidence of a known family, and what was measured.

    accuracy: of sentences held out, families and other prose together; known: share of held-out sentences of known
    families at least that confident of their family; unseen: share of held-out families' sentences below it.
    """
    texts, y, groups = examples(seed)
    found = features(texts)
    z, truth, outside = [], [], []
    for fold in range(FOLDS):
        left_out = (y > 0) & (y % FOLDS == fold)
        sentence = (groups == fold) & ~left_out
        fitted = _fit([f for f, a, b in zip(found, left_out, sentence, strict=True) if not (a or b)], y[~left_out & ~sentence], rounds, ridge)
        held = np.flatnonzero(left_out | sentence)
        z.append(_logits(fitted, [found[i] for i in held]))
        truth.append(y[held])
        outside.append(left_out[held])
    z, truth, outside = np.concatenate(z), np.concatenate(truth), np.concatenate(outside)
    loss = lambda t: -np.log(_softmax(z[~outside] / t)[np.arange((~outside).sum()), truth[~outside]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
    p = _softmax(z / temperature)
    best = p[:, 1:].max(1)
    known = best[~outside & (truth > 0) & (p.argmax(1) == truth)]
    unseen = best[outside]
    shares = lambda c: ((known >= c).mean(), (unseen < c).mean())
    least = float(max(np.linspace(0.02, 0.98, 97), key=lambda c: sum(shares(c))))
    model = _fit(found, y, rounds, ridge)
    return {**model, "t": temperature, "least": least, "accuracy": float((p.argmax(1) == truth)[~outside].mean()), "known": float(shares(least)[0]), "unseen": float(shares(least)[1])}


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """Probabilities of the families for each text as one paragraph."""
    return _softmax(_logits(model, features(texts)) / model["t"])


@lru_cache(maxsize=1)
def _templates() -> list[tuple[int, int, np.ndarray]]:
    """(family, k, sorted hashes of k-word sequences) of every template sentence and name; k is 2, or 1 for a single word."""
    said = [(i, s) for i, family in enumerate(TEMPLATES, 1) for s in [*TEMPLATES[family], *NAMES.get(family, [])]]
    return [(i, k, _sequences(s, k)) for i, s in said for k in [2 if len(_sequences(s, 2)) else 1]]


def _sequences(text: str, k: int) -> np.ndarray:
    return distinct(shingles(_plain_words(*text_bytes(pa.array([text])))[0], k))


def confirmed(text: str, family: int) -> bool:
    """The paragraph covers enough of the word pairs of one of the family's sentences or names."""
    own = {k: _sequences(text, k) for k in (1, 2)}
    return any(len(np.intersect1d(own[k], s, assume_unique=True)) >= COVER * len(s) for f, k, s in _templates() if f == family)


def _units(table: Table, model: dict, h: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the units with a known n-gram and the family probabilities of each; ``unit``: that of each word."""
    size, hits = len(model["keys"]), []
    for k in (1, 2, 3):
        n = max(0, len(h) - k + 1)
        inside = np.flatnonzero(unit[:n] == unit[k - 1 : n + k - 1])
        row = table.find(_salted(shingles(h, k), k)[inside]) if n else np.empty(0, np.int64)
        hit = row >= 0
        hits.append(unit[inside[hit]] * np.int64(size) + row[hit])
    hit = distinct(np.concatenate(hits))
    u, row = hit // size, hit % size
    some, begin = np.unique(u, return_index=True)
    if not len(some):
        return some, np.zeros((0, len(FAMILIES)))
    z = np.add.reduceat(model["w"][row], begin, axis=0) / np.sqrt(np.maximum(1, np.add.reduceat(model["q"][row], begin)))[:, None] + model["b"]
    return some, _softmax(z / model["t"])


def _judged(model: dict, text: str, p: np.ndarray) -> tuple[str, float, bool]:
    """Family, probability and confirmation of a paragraph that is a licence; of an unknown one the probability that it is any."""
    family = 1 + int(p[1:].argmax())
    sure = confirmed(text, family)
    if sure and p[family] >= model["least"]:
        return FAMILIES[family], round(float(p[family]), 6), True
    return UNKNOWN, round(float(1 - p[0]), 6), sure


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: dict | None = None, least_licence: float = 0.45) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_paragraphs, findings array<struct<paragraph, line, family, probability, confirmed>>.

    A paragraph, or a line of it, is a finding if the probability of not being a licence is below ``1 - least_licence``.
    Its family is the likeliest one if that is at least the model's confidence and the template confirms it, or else
    "unknown". A paragraph has one finding for each known family, or one unknown; ``line`` is the line of the text
    where it begins, or that of the first line that has the family by itself, all numbered from 0. Null and empty texts have no paragraphs; texts of any length are read whole.
    Ids of any type stay as they are. Rows that repeat an id each get a row; other columns aren't read, whatever their
    names; an empty table gives an empty result.
    """
    narrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = Table(m["keys"])
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))
        for batch in parts:
            data, offsets = text_bytes(batch.column(1))
            for first, last in chunks(offsets):
                at = offsets[first : last + 1]
                raw, rel = data[int(at[0]) : int(at[-1])], at - at[0]
                h, starts = _plain_words(data, at)
                # Lines of the whole chunk, and paragraphs: a new one after a line without a word and at each text.
                edge = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, rel[:-1]]))
                edge = edge[edge < len(raw)] if len(raw) else edge[:0]
                line = np.searchsorted(edge, starts, "right") - 1
                full = np.bincount(line, minlength=len(edge)) > 0
                opens = full & ~np.concatenate([[False], full[:-1]]) | full & np.isin(edge, rel[:-1])
                number = np.cumsum(opens) - 1
                ends = np.append(edge[1:], len(raw))
                leads, closes = np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:], len(edge))
                of_text = np.searchsorted(rel, edge, "right") - 1
                said = lambda i, j: raw[edge[i] : min(int(ends[j]), int(rel[of_text[i] + 1]))].tobytes().decode("utf-8", "replace")  # noqa: B023,E731
                found: dict[int, list[tuple]] = {}
                some, p = _units(table, m, h, number[line] if len(line) else line)
                for i in np.flatnonzero(p[:, 0] < 1 - least_licence):
                    lead = int(leads[some[i]])
                    found.setdefault(int(some[i]), []).append((lead, *_judged(m, said(lead, int(closes[some[i]]) - 1), p[i])))
                some, p = _units(table, m, h, line)
                for i in np.flatnonzero(p[:, 0] < 1 - least_licence):
                    found.setdefault(int(number[some[i]]), []).append((int(some[i]), *_judged(m, said(int(some[i]), int(some[i])), p[i])))
                begin = np.searchsorted(edge, rel[:-1])
                before = np.concatenate([[0], np.cumsum(opens)])[begin]
                total = np.diff(np.append(before, opens.sum()))
                rows: list[list[dict]] = [[] for _ in range(first, last)]
                for paragraph, units in sorted(found.items()):
                    known = [u for u in units if u[1] != UNKNOWN]
                    d = int(of_text[leads[paragraph]])
                    for family in sorted({u[1] for u in known or units[:1]}):
                        lead, family, probability, sure = [u for u in known or units[:1] if u[1] == family][:2][-1]
                        rows[d].append({"paragraph": paragraph - int(before[d]), "line": lead - int(begin[d]), "family": family, "probability": probability, "confirmed": sure})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(total, pa.int64()), pa.array(rows, kind)], ["id", "n_paragraphs", "findings"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(batches), f"id {kind}, n_paragraphs long, findings array<struct<paragraph: int, line: int, family: string, probability: double, confirmed: boolean>>").withColumnRenamed("id", id_col)
