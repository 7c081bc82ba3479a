"""Licence scans: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import few, materialize, with_package

# Notices and passages of licence families, from the licences' public texts.
TEMPLATES = {
    "MIT": [
        "released under the mit license", "licensed under the mit license", "spdx-license-identifier mit", "mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0", "apache license version 2.0", "you may not use this file except in compliance with the license", "spdx-license-identifier apache-2.0", "released under the apache license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "licensed under gpl v3", "spdx-license-identifier gpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "GPL-2.0": ["gnu general public license version 2", "licensed under gpl v2", "spdx-license-identifier gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license"],
    "LGPL": ["gnu lesser general public license", "licensed under the lgpl", "spdx-license-identifier lgpl-3.0", "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "AGPL-3.0": ["gnu affero general public license", "licensed under the agpl", "spdx-license-identifier agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3"],
    "BSD": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd 3-clause license", "bsd 2-clause license", "released under the bsd license", "spdx-license-identifier bsd-3-clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"],
    "EPL-2.0": ["eclipse public license v 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "spdx-license-identifier epl-2.0"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "cc by 4.0", "creative commons attribution 4.0 international license"],
    "CC0-1.0": ["cc0 1.0 universal", "dedicated to the public domain", "public domain dedication", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software", "spdx-license-identifier unlicense"],
    "ISC": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx-license-identifier isc"],
    "Zlib": [
        "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "zlib license", "spdx-license-identifier zlib",
    ],
    "Artistic-2.0": ["artistic license 2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "spdx-license-identifier artistic-2.0"],
    "BSL-1.0": ["boost software license version 1.0", "distributed under the boost software license version 1.0", "spdx-license-identifier bsl-1.0"],
    "WTFPL": ["do what the fuck you want to public license", "you just do what the fuck you want to", "spdx-license-identifier wtfpl"],
    "proprietary": ["all rights reserved", "no part of this publication may be reproduced without prior written permission"],
}
FAMILIES = [*TEMPLATES, "unknown"]
PAIRS = [(k, list(dict.fromkeys(zip(t.split(), t.split()[1:], strict=False)))) for k, ts in enumerate(TEMPLATES.values()) for t in ts]
HOLDERS = {p: [i for i, (_, pairs) in enumerate(PAIRS) if p in pairs] for _, ps in PAIRS for p in ps}  # templates of each pair of words
CONFIRM = 0.75  # share of a template's pairs of words that confirms a family
SHORT = {i for i, (_, pairs) in enumerate(PAIRS) if len(pairs) == 1}  # templates of two words, which no text around them need mean
TITLE = 12  # words of a unit that can be a title or a notice by itself
NEAR = 4  # words between a lead-in and the template that it leads in
#: Words that lead in a notice.
LEADS = {"licensed", "released", "distributed", "governed", "copyright", "license", "licence", "spdx-license-identifier"}
UNKNOWN = len(TEMPLATES)
UNIT, SHIFT = 48, 16  # words of a unit; long paragraphs are cut three times, so that any 33 words (a template has 29 at most) stand whole in a unit
LEADERS = {"dnl", "rem"}  # words that open comment lines; leaders of punctuation alone have no letters and so are no words
RESULT = "families array<string>, n_units int, spans array<struct<start:int,end:int,family:string,p:double>>, n_unconfirmed int"


def normal(word: str) -> str:
    """A word as the n-grams take it: lower case, without punctuation at its ends; apostrophes, commas and the like inside go."""
    return re.sub(r"[^a-z0-9.+\-]", "", word.lower()).strip(".-")


def grams(words: list[str]) -> set[str]:
    """Word n-grams of one to three words."""
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass
class Classifier:
    """Sparse weights (n-gram -> row of weights), biases, temperature, and the least calibrated probability of a family."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(FAMILIES))))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(FAMILIES)))
    temperature: float = 1.0
    least: float = 0.5

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def shares(words: list[str]) -> dict[int, float]:
    """For each family with any, the largest share of a template's pairs of neighbouring words that a unit holds.

    A template of two words names much else. It counts only where it ends a unit of up to TITLE words, where a lead-in word stands up to
    NEAR words before it or right behind it, or in a unit that confirms a longer template of any family.
    """
    count: dict[int, int] = {}
    for p in set(zip(words, words[1:], strict=False)):
        for i in HOLDERS.get(p, ()):
            count[i] = count.get(i, 0) + 1
    longer = any(n >= CONFIRM * len(PAIRS[i][1]) for i, n in count.items() if i not in SHORT)
    out: dict[int, float] = {}
    for i, n in count.items():
        if i not in SHORT or longer or led_in(words, PAIRS[i][1][0]):
            k, pairs = PAIRS[i]
            out[k] = max(out.get(k, 0.0), n / len(pairs))
    return out


def led_in(words: list[str], pair: tuple[str, str]) -> bool:
    """Whether a pair of words stands in a unit as a title or next to a lead-in word."""
    plain = [w for w in words if w]
    for j in range(len(plain) - 1):
        if (plain[j], plain[j + 1]) == pair:
            if len(plain) <= TITLE and j + 2 == len(plain):
                return True
            if not LEADS.isdisjoint(plain[max(0, j - NEAR) : j] + plain[j + 2 : j + 3]):
                return True
    return False


def template_share(words: list[str], family: str) -> float:
    return shares(words).get(FAMILIES.index(family), 0.0)


def stretch(words: list[str], family: int) -> set[int]:
    """Places of the words that hold most of one of the family's templates, as near one another as can be."""
    best: tuple[float, int, int, set[int]] = (0.0, 0, 0, set())
    for _, pairs in (x for x in PAIRS if x[0] == family):
        at = [j for j, p in enumerate(zip(words, words[1:], strict=False)) if p in pairs]
        for a in at:
            near = {words[j] + " " + words[j + 1]: j for j in reversed(at) if a <= j <= a + 2 * len(pairs)}
            found = (len(near) / len(pairs), len(near), a - max(near.values()), {x for j in near.values() for x in (j, j + 1)})
            best = max(best, found, key=lambda x: x[:3])
    return best[3]


def units(n: int) -> list[tuple[int, int]]:
    """Ranges of a paragraph's n words that are judged: all of it, or cuts that overlap if it is long."""
    if n <= UNIT:
        return [(0, n)] if n else []
    return [(i, min(i + UNIT, n)) for start in range(0, UNIT, SHIFT) for i in range(start, n, UNIT)]


def paragraphs(text: str) -> list[list[str]]:
    """The normal words of consecutive lines that have any; comment leaders are skipped."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        words = [w for x in line.split() if (w := normal(x))]
        words = words[1:] if words and words[0] in LEADERS else words
        out[-1].extend(words)
        if not words and out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def samples(noise: list[list[str]], each: int, seed: int) -> tuple[list[list[str]], np.ndarray]:
    """Labelled units: templates with changes (words dropped, noise around, copyright lines before), and the noise as unknown.

    Unknown units also get stray words of templates, so that a single one of them proves nothing.
    """
    rng = np.random.default_rng(seed)
    out, label = [], []
    loose = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
    some = lambda: noise[int(rng.integers(len(noise)))] if noise else []
    for k, templates in enumerate(TEMPLATES.values()):
        for i in range(each):
            words = templates[i % len(templates)].split()
            if i >= 2 * len(templates):
                if len(words) > 6:
                    words = [w for w in words if rng.random() > 0.08]
                before, after = some()[: int(rng.integers(9))], some()[: int(rng.integers(9))]
                head = ["copyright", "c", str(int(rng.integers(1990, 2026)))] if rng.random() < 0.3 else []
                words = [*before, *head, *words, *after]
            out.append(words)
            label.append(k)
    for i, words in enumerate(noise):
        words = list(words)
        if i % 2:
            for w in rng.choice(loose, size=int(rng.integers(1, 3))):
                words.insert(int(rng.integers(len(words) + 1)), str(w))
        out.append(words)
        label.append(UNKNOWN)
    return out, np.array(label)


def train(noise: list[list[str]], each: int = 150, steps: int = 200, l1: float = 2e-4, seed: int = 1) -> Classifier:
    """Multinomial logistic regression by proximal steps (L1, so that most weights are zero); a fourth of the samples sets the temperature.

    Features are the templates' n-grams, without those that one in 200 noise units holds; an n-gram that is a whole template stays.
    """
    texts, label = samples(noise, each, seed)
    common: dict[str, int] = {}
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t.split())})
    known = set(vocabulary)
    for words in noise:
        for g in grams(words) & known:
            common[g] = common.get(g, 0) + 1
    whole = {t for ts in TEMPLATES.values() for t in ts}
    vocabulary = [g for g in vocabulary if g in whole or common.get(g, 0) <= max(1, len(noise) // 200)]
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), dtype=np.float32)
    for r, words in enumerate(texts):
        x[r, [index[g] for g in grams(words) if g in index]] = 1
    held = np.random.default_rng(seed + 1).random(len(texts)) < 0.25  # at random, since templates take turns
    y = np.eye(len(FAMILIES), dtype=np.float32)[label]
    xt, yt = x[~held], y[~held]
    balance = (1 / np.maximum(yt.sum(axis=0), 1))[label[~held]][:, None] * len(yt) / len(FAMILIES)
    w, b = np.zeros((x.shape[1], len(FAMILIES)), dtype=np.float32), np.zeros(len(FAMILIES), dtype=np.float32)
    rate = 4.0
    for _ in range(steps):
        z = xt @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (p - yt) * balance / len(yt)
        w -= rate * (xt.T @ miss)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * miss.sum(axis=0)
    keep = np.abs(w).max(axis=1) > 0
    out = Classifier({g: i for i, g in enumerate(g for g, k in zip(vocabulary, keep, strict=True) if k)}, w[keep].astype(np.float64), b.astype(np.float64))
    if held.any():
        logits = x[held].astype(np.float64) @ w + b
        loss = []
        for t in (grid := np.geomspace(0.1, 5, 40)):
            out.temperature = float(t)
            loss.append(-np.log(np.maximum(out.probabilities(logits)[np.arange(held.sum()), label[held]], 1e-12)).mean())
        out.temperature = float(grid[int(np.argmin(loss))])
    return out


def fit(docs: DataFrame, fit_rows: int = 1_000, fit_units: int = 3_000) -> Classifier:
    """A classifier whose unknown class is learned from at most fit_units units of fit_rows documents (those of least hash of doc_id and text).

    Units that alone or with their neighbours confirm a template are left out of the unknown class. Of the others some seven a document
    reach the driver. A bound on the hash leaves few rows before any are sorted, so no task gets texts of all partitions.
    """
    with_package(docs.sparkSession)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                rows = [(words, lo, hi) for words in paragraphs(text) for lo, hi in units(len(words))]
                for words, lo, hi in rows[:: max(1, len(rows) // 4)]:
                    if max(shares(words[max(0, lo - UNIT) : hi + UNIT]).values(), default=0) < CONFIRM:
                        out.append(" ".join(words[lo:hi]))
            yield pd.DataFrame({"line": out})

    some = materialize(few(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), fit_rows, "doc_id", "text"))
    noise = [r["line"] for r in some.mapInPandas(lines, "line string").collect() if r["line"]]
    noise = sorted(noise, key=lambda x: (zlib.crc32(x.encode()), x))[:fit_units]
    return train(sorted(x.split() for x in noise))


def judge(words: list[str], hits: list[tuple[int, int, int]], model: Classifier, owners: list[set[int]], confirm: float) -> tuple[list[tuple[int, float]], int]:
    """The families of a unit with their probabilities, and the number of families that only the classifier or only a template names.

    hits: (place, words, row of weights) of the n-grams; owners: families whose templates hold each row's n-gram. The likeliest family
    that a template confirms is taken with the words of that template, then the next of what is left. Each must then be
    the classifier's choice on the unit without the words of the others.
    """
    score = lambda hs: model.probabilities((model.bias + model.weights[sorted({i for _, _, i in hs})].sum(axis=0))[None, :])[0]
    outside = lambda hs, places: [h for h in hs if places.isdisjoint(range(h[0], h[0] + h[1]))]
    taken: dict[int, set[int]] = {}
    left, rest = hits, list(words)
    while left:
        own = set().union(*(owners[i] for _, _, i in left))
        sure = [k for k, x in shares(rest).items() if x >= confirm and k in own]
        if not sure:
            break
        p = score(left)
        k = max(sure, key=lambda k: p[k])
        places = stretch(rest, k)
        taken.setdefault(k, set()).update(places)
        left = outside(left, places)
        for j in places:
            rest[j] = ""
    found, doubtful = [], 0
    for k in taken:
        p = score(outside(hits, set().union(*(v for f, v in taken.items() if f != k))))
        if int(np.argmax(p)) == k and p[k] >= model.least:
            found.append((k, float(p[k])))
        else:
            doubtful += 1
    if left:
        p = score(left)
        best = int(np.argmax(p))
        doubtful += best != UNKNOWN and best not in taken and p[best] >= model.least
    return found, doubtful


def scan_texts(texts: list[str], model: Classifier, confirm: float = CONFIRM) -> list[tuple[list[str], int, list[dict], int]]:
    """RESULT of each text. Only units that hold an n-gram with a weight are scored; the others have the bias alone and are unknown."""
    index, grams_of = model.index, {}
    for g, i in index.items():
        grams_of.setdefault(g.split()[0], []).append((g.split(), i))
    holds = [{g for t in ts for g in grams(t.split())} for ts in TEMPLATES.values()]
    owners = [{k for k, gs in enumerate(holds) if g in gs} for g in index]
    lines = [[line.split() for line in t.split("\n")] for t in texts]
    flat = [w for ls in lines for ws in ls for w in ws]
    out: list[tuple[list[str], int, list[dict], int]] = []
    kept, first = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    if flat:
        codes, unique = pd.factorize(np.array(flat, dtype=object))
        plain = [normal(w) for w in unique]
        kept = np.array([bool(w) for w in plain])[codes]
        first = np.array([w in grams_of for w in plain])[codes]
    at = 0
    for t, ls in zip(texts, lines, strict=True):
        found, n_units, unconfirmed, begin = [], 0, 0, at
        opened = None  # the paragraph's first word
        for raw in [*ls, []]:
            if raw and plain[codes[at]] in LEADERS:
                kept[at] = first[at] = False
            if kept[at : at + len(raw)].any():
                opened = at if opened is None else opened
            elif opened is not None:
                place = opened + np.flatnonzero(kept[opened:at])
                opened, n_units = None, n_units + len(units(len(place)))
                starts = np.flatnonzero(first[place])
                words = [plain[c] for c in codes[place]] if len(starts) else []
                hits = [(k, len(g), i) for k in starts.tolist() for g, i in grams_of[words[k]] if words[k : k + len(g)] == g]
                begins = [k for k, _, _ in hits]
                for lo, hi in units(len(words)) if hits else ():
                    own = [(k - lo, size, i) for k, size, i in hits[bisect_left(begins, lo) : bisect_left(begins, hi)] if k + size <= hi]
                    if own:
                        named, doubtful = judge(words[lo:hi], own, model, owners, confirm)
                        found += [(int(place[lo]) - begin, int(place[hi - 1]) + 1 - begin, FAMILIES[k], p) for k, p in named]
                        unconfirmed += doubtful
            at += len(raw)
        spans = []
        if found:
            chars = [m.span() for m in re.finditer(r"\S+", t)]
            spans = [{"start": chars[lo][0], "end": chars[hi - 1][1], "family": f, "p": p} for lo, hi, f, p in found if hi <= len(chars)]
        out.append((sorted({f for _, _, f, _ in found}), n_units, spans, unconfirmed))
    return out


def scan(docs: DataFrame, model: Classifier, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, families (sorted), n_units (paragraphs and cuts judged), spans of units with family and calibrated probability, n_unconfirmed.

    Whole texts are read; each family of a unit is reported if classifier and template agree on it; n_unconfirmed counts where only one names it. No shuffle. Null and empty
    texts have no units; null doc_ids and repeated rows are rows like others; other columns are ignored; an empty table gives no rows.
    """
    with_package(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for lo in range(0, len(batch), 1000) for r in scan_texts(batch.iloc[lo : lo + 1000].tolist(), model, confirm)]
            yield pd.DataFrame(rows, columns=["families", "n_units", "spans", "n_unconfirmed"])

    return docs.select("doc_id", F.pandas_udf(run, RESULT)(F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.*")
