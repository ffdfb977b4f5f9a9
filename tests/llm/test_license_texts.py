"""Real notices, wrapped and in comments, as files hold them."""

from __future__ import annotations

import pytest

from encore.llm.license import RULES, SENTENCES, _reader, named_licenses, scan_licenses

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
LGPL21 = GPL2.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
NOTICES = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "LGPL-2.1-or-later": LGPL21,
    "LGPL-3.0-or-later": GPL3.replace("GNU General", "GNU Lesser General"), "AGPL-3.0-or-later": GPL3.replace("GNU General", "GNU Affero General"), "ISC": ISC, "MPL-2.0": MPL, "Unlicense": UNLICENSE,
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
@pytest.mark.parametrize("name", sorted(NOTICES))
def test_notice(name, mark):
    text = "".join(f"{mark}{line}\n" for line in NOTICES[name].split("\n"))
    ids = _reader(SENTENCES)(f"some code here\n\n{text}\nand more of it".encode())[1]
    assert named_licenses(ids, RULES) == ([name], 0)


def test_short_name():
    assert named_licenses(_reader(SENTENCES)(b"// SPDX-License-Identifier: LGPL-2.1-or-later\nint x;")[1], RULES) == (["LGPL-2.1-or-later"], 0)


def test_part_of_a_notice_names_nothing():
    assert named_licenses(["bsd-source", "bsd-grant"], RULES) == ([], 2)
    assert named_licenses(["mit-ref", "x", "mit-ref"], RULES) == (["MIT"], 1)


def test_repeated_rows_empty_table_and_a_column_of_the_same_name(spark):
    frame = spark.createDataFrame([(1, MIT), (1, MIT), (2, None), (3, "x " * 400_000)], "doc_id long, text string")
    assert sorted((r["doc_id"], *r["license"]["licenses"]) for r in scan_licenses(frame).collect()) == [(1, "MIT"), (1, "MIT"), (2,), (3,)]
    assert scan_licenses(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(frame.withColumnRenamed("doc_id", "license"))
