"""Sentence rules on written cases and against a plain loop."""

from __future__ import annotations

import random
import re
import textwrap

import pytest

from encore.llm.license import RULES, SENTENCES, scan_licenses

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
CASES = [
    (None, 0, [], [], 0),
    ("", 0, [], [], 0),
    (" \n ", 0, [], [], 0),
    ("Licensed under the Apache License, Version 2.0 (the “License”); you may not use this file except in compliance with the License. You may obtain a copy of the License at", 3, ["apache-2.0-ref", "apache-2.0-comply", "apache-2.0-copy"], ["Apache-2.0"], 0),
    ("Text.\nLicensed under the MIT License.\nMore text! Licensed under CC BY 4.0.", 4, ["mit-ref", "cc-by-4.0-ref"], ["MIT", "CC-BY-4.0"], 0),
    ("You may obtain a copy of the License at", 1, ["apache-2.0-copy"], [], 1),
    ("licensed under the mit license.\nLICENSED -- under the MIT license", 2, ["mit-ref", "mit-ref"], ["MIT"], 0),
    (BSD, 1, ["bsd-grant"], [], 1),
    ("x" * 300_000 + ". All rights reserved.", 2, ["reserved"], [], 1),
]


@pytest.mark.parametrize("text,n,ids,names,left", CASES)
def test_cases(spark, text, n, ids, names, left):
    got = scan_licenses(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, ids string")).first()["license"]
    assert (got["n_sentences"], got["ids"], got["licenses"], got["n_unmatched"]) == (n, ids, names, left)


def test_rules_in_order_against_a_loop(spark):
    rng = random.Random(6)
    sentence = {v: k for k, v in SENTENCES.items()}
    names = list(sentence)
    sequences = [[rng.choice(names) for _ in range(rng.randint(0, 8))] for _ in range(60)]
    sequences += [[x for _, ids in rng.sample(RULES, 3) for x in ids] for _ in range(60)]

    def loop(ids):
        left, found = list(ids), []
        for name, rule in RULES:
            k = 0
            while k <= len(left) - len(rule):
                if left[k : k + len(rule)] == rule:
                    left[k : k + len(rule)] = [None]
                    found.append(name)
                k += 1
        return list(dict.fromkeys(found)), sum(x is not None for x in left)

    texts = [(k, rng.choice(["\n", "\nunknown words here\n"]).join(sentence[x].capitalize() + "." for x in s)) for k, s in enumerate(sequences)]
    for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        ids = sequences[r["doc_id"]]
        assert r["license"]["ids"] == ids
        assert (r["license"]["licenses"], r["license"]["n_unmatched"]) == loop(ids)


def test_known_sentences_are_normalised():
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) for s in SENTENCES)
    assert {x for _, ids in RULES for x in ids} <= set(SENTENCES.values())


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = [
    "MIT License",
    "Copyright (c) 2020 A. Person",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
BSD_2 = [
    "Copyright (c) 2020, A. Person",
    BSD.strip(),
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
NAMES = ["3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
AS_IS = ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.']
GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
REST = ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."]
APACHE = ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.']
FULL = [("MIT", MIT), ("BSD-2-Clause", BSD_2 + AS_IS), ("BSD-3-Clause", BSD_2 + NAMES + AS_IS), ("GPL-3.0-or-later", [GPL.format(":", ",", 3), *REST]), ("GPL-2.0-or-later", [GPL.format(";", ";", 2), *REST]), ("GPL-2.0-or-later", [GPL.format(":", ",", 2), *REST]), ("Apache-2.0", APACHE)]


def test_full_texts_wrapped_or_not(spark):
    rows = []
    for name, paragraphs in FULL:
        for width in (40, 66, 70, 72, 76, 80, 10_000):
            for mark, end in (("", "\n"), ("", "\r\n"), ("# ", "\n"), (" * ", "\n")):
                text = f"\n{mark}\n".join("\n".join(mark + line for line in textwrap.wrap(p, width)) for p in paragraphs)
                rows.append((len(rows), name, "Some words before.\n\n" + text.replace("\n", end)))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["license"]["licenses"], r["license"]["n_unmatched"]) == ([r["name"]], 0), r["text"]


def test_sentences_over_line_breaks(spark):
    cases = [
        ("A line\nthat goes on\nto here. And\nmore", 2, []),
        ("a title\nReleased under the MIT\nLicense\nby its authors", 3, ["mit-ref"]),
        ("Released under\n\nthe MIT License", 2, []),
        ("Licensed under the MIT License\nLicensed under CC BY 4.0\nLicensed under CC BY\nNC 4.0", 3, ["mit-ref", "cc-by-4.0-ref", "cc-by-nc-4.0-ref"]),
    ]
    got = scan_licenses(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["text"], r["license"]["n_sentences"], r["license"]["ids"]) for r in got] == cases
