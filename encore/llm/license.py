"""License scans by sentence rules.

Texts are cut into pieces (at line breaks, and at `.`, `!`, `?` or `;` before white space) and each
piece is normalised: lower case, every run of other characters than letters and digits one space. A
sentence goes on over single line breaks, up to one of these marks or a line without words. From each
piece on the longest run of pieces that is a known sentence counts as one; pieces between such runs
are one unknown sentence. So wrapped texts are found, and so is a line that is a known sentence in
itself. Known sentences have identifiers; the identifiers of a document, in order and without the
unknown sentences, form a sequence. Rules are tried in their order: a rule whose own sequence occurs
names its licence and takes those identifiers away, so a longer rule keeps its sentences from a
shorter one. What is left counts as unmatched.

Nulls and empty texts have no sentence. Repeated rows are scanned one by one, very long texts whole.
An empty table gives an empty result. Other columns stay; one of the result's name is an error."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import per_value

_CUT = re.compile(r"\n|(?<=[.!?;])\s+")
_OTHER = re.compile(r"[\W_]+")

#: Public licence sentences and the identifiers used for them.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2 0": "apache-2.0-ref",
    "licensed under the apache license version 2 0 the license": "apache-2.0-ref",
    "you may not use this file except in compliance with the license": "apache-2.0-comply",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-ref",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3.0-later",
    "either version 2 of the license or at your option any later version": "gpl-2.0-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-grant",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-ref",
    "licensed under cc by 4 0": "cc-by-4.0-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all rights reserved": "reserved",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-see",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "lgpl-2.1-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3.0-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2.0-ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "epl-2.0-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2.0-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-1.0-dedication",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-ref",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4.0-ref",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-4.0-ref",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-4.0-ref",
}
#: Short names that files give in a line `SPDX-License-Identifier: name`.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
#: Ordered rules (licence, its identifiers in order).
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("GPL-3.0-or-later", ["gpl-3.0-grant"]),
    ("GPL-2.0-or-later", ["gpl-2.0-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "gpl-3.0-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "gpl-2.0-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0-grant"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "lgpl-2.1-later"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-grant"]),
    ("Apache-2.0", ["apache-2.0-ref", "apache-2.0-comply", "apache-2.0-copy", "apache-2.0-basis", "apache-2.0-see"]),
    ("Apache-2.0", ["apache-2.0-ref", "apache-2.0-comply", "apache-2.0-copy", "apache-2.0-basis"]),
    ("Apache-2.0", ["apache-2.0-ref", "apache-2.0-comply", "apache-2.0-copy"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("MPL-2.0", ["mpl-2.0-ref", "mpl-2.0-copy"]),
    ("EPL-2.0", ["epl-2.0-ref"]),
    ("Unlicense", ["unlicense-ref", "unlicense-grant"]),
    ("CC0-1.0", ["cc0-1.0-dedication"]),
    ("Apache-2.0", ["apache-2.0-ref"]),
    ("GPL-3.0", ["gpl-3.0-ref"]),
    ("MIT", ["mit-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-ref"]),
    ("CC-BY-4.0", ["cc-by-4.0-ref"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4.0-ref"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4.0-ref"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4.0-ref"]),
    *((name, [f"spdx-{name}"]) for name in SPDX),
]


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


SENTENCES |= {normalise(f"SPDX-License-Identifier: {name}"): f"spdx-{name}" for name in SPDX}


def _reader(known: dict[str, str]) -> Callable[[bytes | None], tuple[int, list[str]]]:
    """A function from a text to the number of its sentences and the known ones' ids in order."""
    longest = max(map(len, known), default=0) * 2 + 20
    begins = {" ".join(words[: k + 1]) for words in map(str.split, known) for k in range(len(words))}

    def matched(run: list[str]) -> tuple[int, list[str]]:
        """Sentences and known ids of pieces with nothing but line breaks between them."""
        n, ids, at, unknown = 0, [], 0, False
        while at < len(run):
            words, to, end, k = run[at], at + 1, at, None
            while words in begins:
                if words in known:
                    end, k = to, known[words]
                if to == len(run):
                    break
                words, to = f"{words} {run[to]}", to + 1
            if k is None:
                n, at, unknown = n + (not unknown), at + 1, True
            else:
                ids.append(k)
                n, at, unknown = n + 1, end, False
        return n, ids

    def read(raw: bytes | None) -> tuple[int, list[str]]:
        ids, n, run = [], 0, []
        for piece in [*_CUT.split(raw.decode()), ""] if raw else ():
            words = normalise(piece)
            if words:
                # a known sentence plus as much punctuation; far longer ones are not kept whole
                run.append(words if len(piece) <= longest or len(words) <= longest else "")
            else:
                n += bool(piece and not piece.isspace())
            if run and (not words or piece.rstrip()[-1] in ".!?;"):
                more, found = matched(run)
                n += more
                ids += found
                run = []
        return n, ids

    return read


def named_licenses(ids: list[str], rules: list[tuple[str, list[str]]]) -> tuple[list[str], int]:
    """The licences that rules name, in the order of the rules, and how many ids no rule took."""
    left: list[str | None] = list(ids)
    here, found = set(ids), []
    for name, own in rules if ids else ():
        if not here.issuperset(own):
            continue
        at = 0
        while at + len(own) <= len(left):
            if left[at : at + len(own)] == own:
                left[at : at + len(own)] = [None] * len(own)
                found.append(name)
                at += len(own)
            else:
                at += 1
    return list(dict.fromkeys(found)), sum(x is not None for x in left)


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    """(n_sentences, ids): how many sentences there are, and the known ones' ids in order."""

    def start():
        read = _reader(known)
        return lambda raw: dict(zip(("n_sentences", "ids"), read(raw), strict=True))

    kind = pa.struct([("n_sentences", pa.int64()), ("ids", pa.list_(pa.string()))])
    return per_value(start, "struct<n_sentences: bigint, ids: array<string>>", kind)(text)


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "license", known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """`docs` with a struct column `out`: n_sentences, ids, licenses (by rule order, distinct),
    n_unmatched (known sentences that no rule took). A column `out` of the input would be lost, so
    there must be none."""
    if out in docs.columns:
        raise ValueError(f"the input has a column {out}; name another with out=")
    rules = RULES if rules is None else rules
    known = SENTENCES if known is None else known

    def start():
        read = _reader(known)

        def one(raw: bytes | None) -> dict:
            n, ids = read(raw)
            names, rest = named_licenses(ids, rules)
            return {"n_sentences": n, "ids": ids, "licenses": names, "n_unmatched": rest}

        return one

    names = pa.list_(pa.string())
    kind = pa.struct([("n_sentences", pa.int64()), ("ids", names), ("licenses", names), ("n_unmatched", pa.int64())])
    return docs.withColumn(out, per_value(start, "struct<n_sentences: bigint, ids: array<string>, licenses: array<string>, n_unmatched: bigint>", kind)(F.col(text)))
