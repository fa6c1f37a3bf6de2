"""Licence scans: a trained paragraph classifier, in DataFrame functions only.

Texts are cut into paragraphs (blank lines, comment marks alone on a line, and sentence ends at the end of a line; a notice wrapped over
lines stays whole). In a paragraph, the words that the model knows and that stand close together make a notice candidate:
at least two of them, with gaps of a few words at most, or one that is a licence's initials. No pattern decides what the classifier sees but its
own vocabulary.

A sparse logistic regression over the word uni- and bigrams of a candidate tells licence families, licences of no known family
("unknown") and other text ("none") apart. It is trained here, on the driver, on the notices below and on licence names in common
phrases (a set of fixed size, so the model is too), and its probabilities are calibrated by a temperature on names and notices that are
held back whole, not on variants of those trained on.

A predicted family has to be confirmed by the templates: the weighted share of 1- to 3-grams that candidate and template have in common (grams
that many families have weigh little) has to be large, larger than with any template of another family or of a licence outside all
families, and some gram that only this family and its kin have is among them. A notice that denies ("not", "never") more often than the template
is not confirmed by it. What is not confirmed or too improbable is unknown.

Equal candidates are judged once, however many documents have them. Scoring is one scan, an explode of the candidates, and
joins with the model's tables, whose size is that of the templates.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm._shared import materialize

#: Notices and opening words of licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "This work is licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v2.", "Licensed under the GPL-2.0 license.", "SPDX-License-Identifier: GPL-2.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3.", "Licensed under the GPL-3.0 license.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU LGPL v2.1.", "Licensed under the LGPL license.", "SPDX-License-Identifier: LGPL-3.0-only", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.", "Licensed under the AGPL-3.0 license.", "SPDX-License-Identifier: AGPL-3.0-only", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0 license.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Dedicated to the public domain under the Unlicense."],
    "CC0-1.0": ["Released under CC0 1.0.", "Licensed under the Creative Commons CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Released under the CC BY 4.0 license."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Released under the CC BY-SA 4.0 license."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Released under the CC BY-NC 4.0 license."],
}
#: What licences of each family are called.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT", "Expat License", "MIT/Expat license", "The MIT License (MIT)", "MIT Licence"],
    "Apache-2.0": ["Apache License", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache 2", "Apache Software License", "ASL 2.0", "Apache Public License 2.0"],
    "BSD": ["BSD License", "BSD", "3-clause BSD license", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "Modified BSD license"],
    "GPL-2.0": ["GPL v2", "GPLv2", "GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPL 2", "GNU General Public License version 2.0"],
    "GPL-3.0": ["GPL v3", "GPLv3", "GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GPL 3", "GNU General Public License version 3.0"],
    "GPL": ["GPL", "GNU General Public License", "GNU GPL", "General Public License", "GPL license"],
    "LGPL": ["LGPL", "GNU Lesser General Public License", "LGPL v2.1", "LGPLv3", "LGPL-2.1", "LGPL 3.0", "GNU Lesser General Public License version 3", "GNU Library General Public License", "GNU LGPL"],
    "AGPL-3.0": ["AGPL", "AGPL v3", "AGPLv3", "AGPL-3.0", "GNU Affero General Public License", "GNU Affero General Public License, version 3", "Affero GPL"],
    "MPL-2.0": ["MPL", "MPL 2.0", "MPL-2.0", "Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License v. 2.0", "MPL v2"],
    "ISC": ["ISC License", "ISC", "ISC licence"],
    "Unlicense": ["Unlicense", "The Unlicense", "Unlicense public domain dedication"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal public domain dedication"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC"],
}
#: Licences outside these families, for the unknown class and as counter-evidence.
OTHERS = ["Eclipse Public License", "Eclipse Public License - v 2.0", "EPL-2.0", "European Union Public Licence", "EUPL 1.2", "Artistic License 2.0", "zlib License", "Boost Software License 1.0", "WTFPL", "Common Development and Distribution License", "CDDL 1.1", "Academic Free License v3.0", "PostgreSQL License", "Python Software Foundation License", "Microsoft Public License", "Ruby License", "PHP License", "OpenSSL License", "SIL Open Font License 1.1", "Open Database License", "CeCILL license", "Beerware license", "Common Public License", "IBM Public License", "Open Software License 3.0", "Server Side Public License", "Business Source License 1.1", "Elastic License 2.0", "Commons Clause", "Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0", "Sun Public License", "Nokia Open Source License", "Q Public License", "Vim License", "X11 style license", "NCSA Open Source License"]
#: Families that share most of their words: what only one of them has is rare, their templates tell them apart.
KIN = {"GPL": "gpl", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL": "gpl", "AGPL-3.0": "gpl", "CC0-1.0": "cc", "CC-BY-4.0": "cc", "CC-BY-SA-4.0": "cc", "CC-BY-NC-4.0": "cc"}
#: Phrases around the name of a licence.
FRAMES = ["{}", "License: {}", "Released under the {}.", "Released under {}.", "Licensed under the {}.", "Licensed under {}", "Distributed under the {}.", "Distributed under {} terms.", "Available under {}.", "Available under the terms of the {}.", "This project is licensed under the terms of the {}.", "This work is licensed under the {}.", "SPDX-License-Identifier: {}", "see the {} for details", "This file is subject to the {}.", "covered by the {}", "{} applies.", "Code under {}", "dual licensed under the {}", "Copyright 2019 the authors. {}"]
#: Licence language of no family, with a place for an invented name.
UNKNOWN = ["Copyright {} All rights reserved.", "All rights reserved.", "Use is subject to license terms.", "Confidential and proprietary; no license is granted.", "This file is subject to the {} proprietary license agreement.", "You may not copy, modify or distribute this software without written permission of {}.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed Materials - Property of {}.", "This license agreement governs your use of the {} software.", "Each contributor hereby grants recipient a non-exclusive, worldwide, royalty-free license under the {} Public License.", "the {} license version 1.3", "For commercial licensing contact {}.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', 'THE SOFTWARE IS PROVIDED "AS IS" AND WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED', "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY DAMAGES"]
#: Words of licences in other text.
NONE = ["The driver's license of {} was taken away.", "Their license plate was stolen in {}.", "A fishing license costs {} a year.", "The restaurant in {} lost its liquor license.", "She is a licensed nurse from {}.", "The court spoke of copyright in {}.", "He copied the copyright page of {}.", "The Apache helicopter landed in {}.", "The people of {} study at MIT.", "MIT researchers found {}.", "students at MIT and Stanford", "The GPL was written about in {}.", "Poetic license is common in {}.", "The public domain of {} is a park.", "Berkeley and MIT are universities.", "das Haus mit der Software von {}", "wir gehen mit {} und mit ihm", "the general public of {} was told in version two of the story", "the software of the project is in use by the public", "copy the files to the folder and use the new version of the program", "the author and the contributors of the paper thank {}", "in no event was the notice of the meeting provided to the public", "the terms of the contract with {} are not known", "the foundation of the house in {} is old", "a permission notice hung on the door of the source of the river", "version 2.0 of the software was released in May", "the free concert was open to the public without charge", "to any person in {} the conditions were hard", "the library is open to the general public", "creative people in the commons", "the zero hour and the attribution of the painting", "the project was released under pressure", "the work was distributed to all authors under the table", "the code is available for the project and the terms of use", "mozilla developers met in {}", "the eclipse was seen in {}", "the clause in the contract about the 3 rooms", "version 3 of the affero report"]
#: Words too common to make a candidate, and features only within bigrams with others.
COMMON = frozenset("a all an and any are as at be by can copy do for from if in is it its may no not of on or out s so that the their they this to use used was were will with you your we he she new or more v 1 2 3 4 0".split())

#: Words that deny what stands beside them; full notices have them too, so a template may hold as many as what it confirms.
DENIALS = frozenset("not no never nor isn aren don doesn didn won cannot neither instead".split())
#: Initials that are a licence's name by themselves, among the words of names: no vowels, or ending in those of "public licence".
_INITIALS = re.compile(r"cc0?|[^aeiou0-9]{3,}\d*|[a-z]*pl(v?\d+)?|unlicense")

_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
#: What cuts paragraphs: a blank line (comment marks may stand on it), or the end of a line after the end of a sentence.
BREAK = r"\n[\s#*/;%>-]*\n|(?<=[.!?])[ \t\r]*\n"
_NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def _grams(words: Sequence[str], sizes: Sequence[int]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)})


def _split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _features(words: Sequence[str]) -> list[str]:
    return _grams(words, (1, 2))


@dataclass
class Model:
    classes: list[str]
    features: list[str]
    weights: np.ndarray  # features by classes
    bias: np.ndarray
    temperature: float
    #: words that make a candidate, two of them together
    known: list[str]
    #: of these, words that make one alone
    signs: list[str]
    #: (gram, family, number of the template, weight of the gram, weight of the template, of this family and its kin alone)
    grams: list[tuple[str, str, int, float, float, bool]]
    #: denials in each template
    denials: dict[int, int]
    #: weight of a gram that no template has
    strange: float


def _invented(rng: random.Random) -> str:
    parts = ("ka", "lo", "mi", "ru", "te", "vo", "an", "es", "nar", "tis", "bel", "dor", "quin", "wex", "pha", "lur", "gra", "sol")
    return "".join(rng.choices(parts, k=rng.randint(2, 3))).title()


def _examples(rng: random.Random, variants: int, phrases: int) -> list[tuple[list[str], str, str]]:
    """(words, class, the name or notice they come from)."""
    found: list[tuple[list[str], str, str]] = []
    prose = [w for text in NONE for w in _split(text.replace("{}", ""))]
    around = lambda words: (rng.choices([rng.choice(prose), _invented(rng).lower()], k=rng.randint(0, 4)) + words + rng.choices([rng.choice(prose), _invented(rng).lower()], k=rng.randint(0, 4)))

    def add(text: str, label: str, origin: str, n: int) -> None:
        words = _split(text)
        found.append((words, label, origin))
        # a notice may break off where its line or page does
        found.extend((words[:k], label, origin) for k in (12, 18, 26, 40) if label in NAMES and len(words) > k + 4)
        for _ in range(n):
            cut = words
            if len(words) > 16:
                start = rng.randint(0, len(words) - 12)
                cut = words[start : start + rng.randint(12, len(words))]
            found.append((around([w for w in cut if len(words) < 8 or rng.random() > 0.04]), label, origin))

    for family, names in NAMES.items():
        for name in names:
            for frame in ["{}", *rng.sample(FRAMES[1:], phrases)]:
                add(frame.format(name), family, name, 1)
        for notice in TEMPLATES.get(family, []):
            add(notice, family, notice, variants)
    for name in [*OTHERS, *(f"{_invented(rng)} {kind}" for kind in ("License", "Public License", "Software License 2.0", "Open License v1.1") for _ in range(6))]:
        for frame in ["{}", *rng.sample(FRAMES[1:], phrases // 2)]:
            add(frame.format(name), "unknown", name, 3 if _INITIALS.fullmatch(name.lower()) else 1)
    for label, texts in (("unknown", UNKNOWN), ("none", NONE)):
        for text in texts:
            for _ in range(variants):
                add(text.format(_invented(rng)), label, text, 1)
    for k in range(variants * 12):
        found.append((rng.choices(prose, k=rng.randint(2, 12)), "none", f"prose {k % 20}"))
    return found


def _templates() -> list[tuple[str, list[str]]]:
    own = [(family, _split(frame.format(name))) for family, names in NAMES.items() for name in names for frame in ("{}", "License: {}")]
    own += [(family, _split(text)) for family, texts in TEMPLATES.items() for text in texts]
    return own + [("unknown", _split(name)) for name in OTHERS] + [("unknown", _split(text.format(""))) for text in UNKNOWN]


def _denied(words: Sequence[str]) -> int:
    return sum(w in DENIALS for w in words)


def _weighted(templates: list[tuple[str, list[str]]]) -> tuple[list[tuple[str, str, int, float, float, bool]], float, dict[int, int]]:
    """The grams of all templates, and how often each denies; a gram weighs the logarithm of how few families have it."""
    families: dict[str, set[str]] = {}
    for family, words in templates:
        for gram in _grams(words, (1, 2, 3)):
            families.setdefault(gram, set()).add(family)
    strange = math.log(len(NAMES) + 2)
    weight = {g: 0.0 if g in COMMON else math.log((len(NAMES) + 2) / len(own)) for g, own in families.items()}
    rows, seen = [], set()
    for i, (family, words) in enumerate(templates):
        grams = _grams(words, (1, 2, 3))
        if (family, tuple(grams)) in seen:
            continue
        seen.add((family, tuple(grams)))
        total = sum(weight[g] for g in grams)
        rows += [(g, family, i, weight[g], total, len({KIN.get(f, f) for f in families[g]}) == 1) for g in grams if weight[g] > 0]
    return rows, strange, {i: _denied(words) for i, (_, words) in enumerate(templates)}


@lru_cache(maxsize=4)
def train(seed: int = 7, variants: int = 10, phrases: int = 9, rounds: int = 120, ridge: float = 1e-4, least_count: int = 3) -> Model:
    """Multinomial logistic regression by gradient descent with momentum; the training set is of fixed size."""
    rng = random.Random(seed)
    rows = _examples(rng, variants, phrases)
    classes = [*NAMES, "unknown", "none"]
    known: dict[str, int] = {}
    for words, _, _ in rows:
        for gram in _features(words):
            known[gram] = known.get(gram, 0) + 1
    invented = re.compile("^(ka|lo|mi|ru|te|vo|an|es|nar|tis|bel|dor|quin|wex|pha|lur|gra|sol){2,3}$")
    features = sorted(g for g, n in known.items() if n >= least_count and not all(w in COMMON for w in g.split()) and not any(invented.match(w) for w in g.split()))
    at = {g: i for i, g in enumerate(features)}
    x, y = np.zeros((len(rows), len(features)), dtype=np.float32), np.zeros(len(rows), dtype=int)
    for i, (words, label, _) in enumerate(rows):
        x[i, [at[g] for g in _features(words) if g in at]] = 1.0
        y[i] = classes.index(label)

    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(part: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(features), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        goal = np.eye(len(classes), dtype=np.float32)[label]
        # every class counts alike, however many notices it has
        share = (1.0 / np.maximum(goal.sum(0), 1)[label] / len(classes)).astype(np.float32)
        for _ in range(rounds):
            gap = (softmax(part @ w + b) - goal) * share[:, None]
            vw = 0.9 * vw - 2.0 * (part.T @ gap + ridge * w)
            vb = 0.9 * vb - 2.0 * gap.sum(0)
            w, b = w + vw, b + vb
        return w, b

    # names and notices held back whole, one in five of each class
    origins = {label: sorted({o for _, own, o in rows if own == label}) for label in classes}
    back = {o for label in classes for o in origins[label][2::5]}
    held = np.array([o in back for _, _, o in rows])
    w, b = fit(x[~held], y[~held])
    scores = x[held] @ w + b
    losses = {t: -np.log(softmax(scores / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in np.linspace(0.4, 3.0, 27)}
    w, b = fit(x, y)
    templates = _templates()
    grams, strange, denials = _weighted(templates)
    words = sorted({w for _, own in templates for w in own if w not in COMMON})
    signs = sorted({x for name in [*OTHERS, *(n for names in NAMES.values() for n in names)] for x in _split(name) if x not in COMMON and _INITIALS.fullmatch(x)})
    return Model(classes, features, w, b, float(min(losses, key=losses.get)), words, signs, grams, denials, strange)


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _ngrams(words, n: int):
    """Distinct n-grams of an array of words."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


def candidates(docs: DataFrame, known: Sequence[str], gap: int = 4, context: int = 2, signs: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, place, notice): runs of words that have two known words or more with at most `gap` others between them, or one of the `signs`.

    A run begins `context` words before its first known word and ends as many after its last; notice is its words, joined by one space.
    """
    paragraphs = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.lower(F.col(text_col)), BREAK, -1)).alias("paragraph", "text"))
    of = lambda words: F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(known)), i)), lambda i: i.isNotNull())
    split = F.transform(F.array(F.split("text", _NOT_WORD, -1)), lambda words: F.struct(words.alias("words"), of(words).alias("hits")))
    alone = lambda words, at: F.coalesce(F.get(words, at).isin(list(signs)), F.lit(False)) if signs else F.lit(False)
    found = paragraphs.select("id", "paragraph", F.explode(F.filter(split, lambda x: (F.size(x["hits"]) >= 2) | ((F.size(x["hits"]) == 1) & alone(x["words"], F.get(x["hits"], F.lit(0)))))).alias("x")).select("id", "paragraph", "x.words", "x.hits")
    begins = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda j: (j == 0) | (F.get("hits", j) - F.get("hits", j - 1) > gap + 1))
    found = found.withColumn("begins", begins).withColumn("ends", F.concat(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("hits"))))
    runs = F.filter(F.zip_with("begins", "ends", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["b"] - x["a"] >= 2) | alone(F.col("words"), F.get("hits", x["a"])))
    found = found.select("id", "paragraph", "words", "hits", F.explode(runs).alias("run"))
    first, last = F.greatest(F.get("hits", F.col("run.a")) - context, F.lit(0)), F.get("hits", F.col("run.b") - 1) + context
    return found.select("id", "paragraph", F.get("hits", F.col("run.a")).alias("place"), F.trim(F.array_join(F.slice("words", first + 1, last - first + 1), " ")).alias("notice"))


def classify(notices: DataFrame, least: float = 0.5, overlap: float = 0.6, model: Model | None = None) -> DataFrame:
    """(notice, family, probability, similarity, rival, confirmed) of different notices (notice: lower-case words joined by one space).

    similarity is that with the guessed family's best template, rival that with the best of all others.
    """
    spark, model = notices.sparkSession, model or train()
    k = len(model.classes)
    weights = _local(spark, [{"feature": f, "w": [round(float(x), 6) for x in row]} for f, row in zip(model.features, model.weights, strict=True)], "feature:string,w:array<double>")
    grams = _local(spark, [{"gram": g, "family": f, "template": i, "weight": round(x, 9), "total": round(t, 9), "alone": own, "denials": model.denials[i]} for g, f, i, x, t, own in model.grams], "gram:string,family:string,template:int,weight:double,total:double,alone:boolean,denials:int")
    worth = _local(spark, [{"gram": g, "own": round(x, 9)} for g, x in {g: x for g, _, _, x, _, _ in model.grams}.items()] + [{"gram": g, "own": 0.0} for g in sorted(COMMON)], "gram:string,own:double")
    words = F.split("notice", " ", -1)
    features = notices.select("notice", F.explode(F.array_distinct(F.concat(words, _ngrams(words, 2)))).alias("feature"))
    # the left join keeps notices without any feature of the model: the bias alone judges them
    scored = features.join(F.broadcast(weights), "feature", "left").groupBy("notice").agg(*[((F.coalesce(F.sum(F.get("w", F.lit(c))), F.lit(0.0)) + float(model.bias[c])) / model.temperature).alias(f"z{c}") for c in range(k)])
    top = F.greatest(*[F.col(f"z{c}") for c in range(k)])
    total = sum((F.exp(F.col(f"z{c}") - F.col("top")) for c in range(1, k)), F.exp(F.col("z0") - F.col("top")))
    chosen = F.coalesce(*[F.when(F.col(f"z{c}") == F.col("top"), F.lit(model.classes[c])) for c in range(k)])
    guess = scored.withColumn("top", top).select("notice", chosen.alias("guess"), (1 / total).alias("probability"))
    own = notices.select("notice", F.explode(F.concat(F.array_distinct(words), _ngrams(words, 2), _ngrams(words, 3))).alias("gram"))
    size = own.join(F.broadcast(worth), "gram", "left").groupBy("notice").agg(F.sum(F.coalesce("own", F.lit(model.strange))).alias("size"))
    met = own.join(F.broadcast(grams), "gram").groupBy("notice", "family", "template").agg(F.sum("weight").alias("common"), F.first("total").alias("total"), F.max("alone").alias("alone"), F.first("denials").alias("denials"))
    denied = F.size(F.filter(words, lambda w: w.isin(list(DENIALS))))
    near = met.join(size, "notice").select("notice", "family", "alone", (F.col("denials") >= denied).alias("says"), (F.col("common") / F.greatest(F.least("total", "size"), F.lit(1e-9))).alias("like"), (F.col("common") / F.greatest(F.greatest("total", "size"), F.lit(1e-9))).alias("tight"))
    best = near.groupBy("notice", "family").agg(F.max("like").alias("like"), F.max("tight").alias("tight"), F.max(F.col("alone")).alias("alone"), F.max(F.when(F.col("says"), F.col("like"))).alias("said"))
    joined = guess.join(best, "notice", "left")
    mine = F.col("family") == F.col("guess")
    # of templates that a notice holds whole, the one that explains more of it wins
    rank = lambda ok: F.max(F.when(ok, F.struct(F.least(F.round("like", 6), F.lit(1.0)).alias("like"), F.round("tight", 6).alias("tight"))))
    judged = joined.groupBy("notice", "guess", "probability").agg(rank(mine).alias("m"), rank(~mine).alias("o"), F.max(F.when(mine, F.col("alone"))).alias("alone"), F.max(F.when(mine, F.col("said"))).alias("said"))
    named = ~F.col("guess").isin("unknown", "none")
    confirmed = named & (F.col("probability") >= least) & (F.coalesce(F.col("m.like"), F.lit(0.0)) >= overlap) & (F.coalesce("said", F.lit(0.0)) >= overlap) & F.coalesce("alone", F.lit(False)) & (F.col("o").isNull() | (F.col("m.tight") >= F.col("o.tight")))
    sure = F.coalesce(confirmed, F.lit(False))
    return judged.select("notice", F.when(sure | ~named, F.col("guess")).otherwise(F.lit("unknown")).alias("family"), "probability", F.coalesce(F.col("m.like"), F.lit(0.0)).alias("similarity"), F.coalesce(F.col("o.like"), F.lit(0.0)).alias("rival"), sure.alias("confirmed"))


def paragraphs(docs: DataFrame, least: float = 0.5, overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every notice candidate: id, paragraph, place, notice, family, probability, similarity, confirmed."""
    model = train()
    found = materialize(candidates(docs, model.known, context=4, signs=model.signs, id_col=id_col, text_col=text_col), "licence-notices", compact=True)
    judged = classify(found.select("notice").distinct(), least, overlap, model)
    return found.join(judged, "notice").select("id", "paragraph", "place", "notice", "family", "probability", "similarity", "confirmed")


def scan_licenses(docs: DataFrame, least: float = 0.5, overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every document: id_col, family, probability, confirmed, families, n_notices.

    family is that of the most probable confirmed notice, else "unknown" where licence language of no known
    family is found, else "none". families lists all confirmed ones, sorted; n_notices counts notices that are not none.

    Defined results: null and empty texts are none; rows that share an id get the findings of all of them; a
    null id is an id like others; a paragraph of any length is read whole; equal probabilities (to nine digits) go by family name; other
    columns are ignored; an empty table gives no rows.
    """
    found = paragraphs(docs, least, overlap, id_col, text_col).where("family <> 'none'")
    best = F.max_by(F.struct("family", "probability", "confirmed"), F.struct(F.col("confirmed").cast("int").alias("c"), F.round("probability", 9).alias("p"), "family"))
    by_doc = found.groupBy("id").agg(best.alias("b"), F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"), F.count("*").alias("n_notices"))
    own = docs.select(F.col(id_col).alias("_own"))
    joined = own.join(by_doc, own["_own"].eqNullSafe(by_doc["id"]), "left")
    return joined.select(F.col("_own").alias(id_col), F.coalesce("b.family", F.lit("none")).alias("family"), F.round(F.coalesce("b.probability", F.lit(0.0)), 9).alias("probability"), F.coalesce("b.confirmed", F.lit(False)).alias("confirmed"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
