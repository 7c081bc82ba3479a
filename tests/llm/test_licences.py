"""The licence scan: held-out accuracy, planted notices, odd input."""

import numpy as np
import pytest

from presswire.llm import licences
from presswire.llm.common import table

NOTICES = {
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
}


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_every_notice_of_the_table_is_found_and_nothing_else(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs, model).collect()}
    want = {r["doc_id"]: sorted({f for k, f in NOTICES.items() if k in r["text"]}) for r in docs.collect()}
    assert {i: f for i, f in got.items() if f != want[i]} == {}
    assert sum(map(bool, want.values())) > 30


def test_held_out_accuracy_and_calibration():
    rng = np.random.default_rng(0)
    noise = [[f"w{i}" for i in rng.integers(300, size=12)] for _ in range(800)]
    model = licences.train(noise)
    assert (np.abs(model.weights) > 0).mean() < 0.6  # sparse
    texts, label = licences.samples(noise, 60, seed=99)
    scores = []
    for words, k in zip(texts, label, strict=True):
        own = sorted({model.index[g] for g in licences.grams(words) if g in model.index})
        p = model.probabilities((model.bias + model.weights[own].sum(axis=0))[None, :])[0]
        scores.append((int(p.argmax()) == k, float(p.max())))
    right, sure = np.array(scores).T
    assert right.mean() > 0.95 and abs(right.mean() - sure.mean()) < 0.06


def test_notices_in_long_lines_and_spans(spark, model):
    pad = " ".join(f"word{i}" for i in range(100))
    texts = {0: f"{pad} Released under the MIT License. {pad}", 1: f"x\n\nLICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\n{pad}", 2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", 3: "the license of rights and the public version under general terms"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df, model).collect()}
    assert got[0]["families"] == ["MIT"] and got[1]["families"] == ["Apache-2.0"] and got[3]["families"] == []
    for r in (got[0], got[1]):
        for s in r["spans"]:
            assert "license" in texts[r["doc_id"]][s["start"] : s["end"]].lower()


def test_template_comparison_overrules_the_classifier(model):
    words = "released under the mit license".split()
    assert licences.template_share(words, "MIT") == 1.0 and licences.template_share(words, "Apache-2.0") < 0.75


def test_odd_input(odd_docs, no_docs):
    model = licences.fit(odd_docs)
    got = licences.scan(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r["families"] == [] for r in got)
    assert {r["doc_id"]: r["n_units"] for r in got if r["doc_id"] in (1, 2, 8)} == {1: 0, 2: 0, 8: 0}
    assert licences.scan(no_docs, licences.fit(no_docs)).count() == 0


WRAPPED = {
    "MIT": 'Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the "Software"), to deal in the Software without restriction,\nincluding without limitation the rights to use, copy, modify, merge,',
    "BSD": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n *",
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
}


@pytest.mark.parametrize("family", sorted(WRAPPED))
@pytest.mark.parametrize("before", [0, 7, 23, 31, 40, 100])
def test_hard_wrapped_notices(model, family, before):
    pad = "\n".join(f"word{i}" for i in range(before))
    got = licences.scan_texts([f"Head\n\n{pad}\n{WRAPPED[family]}\n\nint main;"], model)[0]
    assert got[0] == [family]


def test_paragraphs():
    assert licences.paragraphs("a b\n// c\n *\n\n# d\ndnl e - f\n") == [["a", "b", "c"], ["d", "e", "f"]]


def test_frequent_first_lines_are_no_noise(spark):
    heads = ["MIT License", "ISC License", "SPDX-License-Identifier: GPL-3.0", "CC BY 4.0"]
    texts = [f"{heads[i % 8] if i % 8 < 4 else 'plain'}\n\n" + "\n\n".join(f"w{(i * 7 + k) % 211} v{(i + k * 5) % 97} u{k}" for k in range(4)) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.scan(docs, licences.fit(docs)).collect()}
    want = [["MIT"], ["ISC"], ["GPL-3.0"], ["CC-BY-4.0"], [], [], [], []]
    assert {i: f for i, f in got.items() if f != want[i % 8]} == {}


def test_whole_templates_are_not_pruned():
    noise = [[f"w{i % 50}", f"v{i % 7}"] for i in range(400)] + [["mit", "license"]] * 30
    assert {"mit license", "isc license"} <= set(licences.train(noise, each=4, steps=1, l1=0).index)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under either of Apache License, Version 2.0 or MIT license", ["Apache-2.0", "MIT"]), ("All rights reserved. Released under the MIT License.", ["MIT", "proprietary"]),
        ("Licensed under the Apache License, Version 2.0, or licensed under the LGPL.", ["Apache-2.0", "LGPL"]), ("GNU General Public License version 2", ["GPL-2.0"]),
        ("GNU Lesser General Public License version 3", ["LGPL"]), ("GNU Affero General Public License version 3", ["AGPL-3.0"]), ("BSD 3-Clause License or ISC License or MIT License", ["BSD", "ISC", "MIT"]),
    ],
)
def test_units_of_several_families(model, text, want):
    assert licences.scan_texts([text], model)[0][0] == want


#: Notices as files carry them, none of them a template as it stands, and paragraphs that speak of licences without giving one.
HELD_OUT = [
    ("Copyright (c) 2019 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, subject to the following conditions:", ["MIT"]),
    ("// Use of this code is governed by the MIT license, which stands in the file LICENSE.", ["MIT"]),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0", ["Apache-2.0"]),
    (" * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an \"AS IS\" BASIS,\n * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ["Apache-2.0"]),
    ("This file is part of Foo.\nFoo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0"]),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", ["LGPL"]),
    ("    This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", ["AGPL-3.0"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["BSD"]),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.", ["MPL-2.0"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the project's site.", ["EPL-2.0"]),
    ("Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license.", ["CC-BY-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("To the extent possible under law, the author(s) have waived all copyright and related or neighboring rights to this work worldwide.", ["CC0-1.0"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.", ["Unlicense"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears.", ["ISC"]),
    ("(C) 2020 Example Corp. All rights reserved. Unauthorized copying of this file is prohibited.", ["proprietary"]),
    ("Ze lost the driving license in May and had to apply for a new license at the public office, which took all summer long.", []),
    ("At MIT license fees for patents rose last year, and the institute said that it would spend the money on new laboratories in the city.", []),
    ("The court heard that the license of the pub had been granted in general terms by the public authority, version two of the rules being in force.", []),
    ("Software patents and the general public: a license to print money, some free software people say, without restriction or warranty.", []),
    ("The foundation published a lesser known general history of the public domain, which scholars may copy and distribute.", []),
    ("You may not use this entrance except in an emergency; compliance with the rules is required by law.", []),
    ("This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.", ["Zlib"]),
    ("/* Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt) */", ["BSL-1.0"]),
    ("This License establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.", ["Artistic-2.0"]),
    ("            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n   TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n  0. You just DO WHAT THE FUCK YOU WANT TO.", ["WTFPL"]),
    ("We walked under the old bridge, and there the mit license plate rule was debated by all who were available, for as long as the terms of the evening let us sit.", []),
    ("The committee met under pressure. His isc license for sailing had expired, and a new one was not available before the summer under the terms of the club.", []),
    ("The mit license plate was blue.", []),
    ("Authors will not be held liable, the fair says, for damages that arise from the use of its tents.", []),
    ("The eclipse was seen by the public in many towns, and no license was needed to watch it.", []),
]


def test_held_out_notices_that_training_has_not_seen(model):
    got = [licences.scan_texts([t], model)[0][0] for t, _ in HELD_OUT]
    wrong = [(t[:50], g, w) for (t, w), g in zip(HELD_OUT, got, strict=True) if g != w]
    assert len(wrong) <= 2, wrong


def test_two_words_confirm_no_family_alone(model):
    pad = " ".join(f"word{i}" for i in range(30))
    assert licences.scan_texts([f"{pad} MIT License {pad}"], model)[0][0] == [] and licences.scan_texts([f"{pad} licensed MIT License {pad}"], model)[0][0] == ["MIT"]
    assert licences.scan_texts(["MIT License"], model)[0][0] == ["MIT"]
