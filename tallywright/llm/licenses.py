"""Operator 5: license scans by conditional compression.

Lines with a word that licenses use, and their neighbours, are candidate
blocks. A block is compressed by zstandard alone and with each template as raw
dictionary, which ranks the templates. Every template whose words could be there
is confirmed by the exact wording: words of the template that the block lacks,
and words that it adds between them, are listed and must be few, and none of them
may tell kin apart: a word of a license's name, a version, or anything inside a
name ("GNU Library General"). They are looked for as far around a cue as the
template is long, and taken once. SPDX-License-Identifier lines are taken first,
as they stand.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

CUE = r"(?i)licen[cs]e|copyright|spdx|permission is hereby|warrant(?:y|ies)|redistribut|public domain|all rights reserved"
#: Lines before and after one with a cue; characters of a line without breaks on either side of a cue.
LINES, CHARS = 2, 600
RANKED, LEAST_SAVED, LEAST_SAME = 3, 0.3, 0.85

#: Wording of public licenses, or of their short notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-3.0 notice": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-NC-4.0 long notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 long notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "All rights reserved": "All rights reserved.",
}

#: Words of names by which licenses differ from their kin, and of grants for later versions.
NAMES = {
    "affero", "apache", "attribution", "boost", "bsd", "cc", "cc0", "commons", "creative", "eclipse", "eupl", "european", "general", "gnu", "isc", "later", "lesser", "mit", "mozilla",
    "nc", "nd", "noncommercial", "non-commercial", "noderivatives", "noderivs", "public", "sa", "sharealike",
}
_ELEMENTS = re.compile(r"(?:by|nc|nd|sa|attribution|non-?commercial|share-?alike|no-?deriv\w*)(?:-\w+)+|v?\d+(?:\.\d+)+|v\d+")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+\-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+\-]+\)*)*)")
#: Cost of a difference that decides: more than all others of a text can cost.
DECIDES = 1 << 32

_CUE = re.compile(CUE)
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
SCHEMA = "doc_id long, begin int, end int, license string, confirmed boolean, saved double, same double, missing array<string>, added array<string>, ranked array<struct<license:string,saved:double>>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("confirmed", pa.bool_()), ("saved", pa.float64()), ("same", pa.float64()),
    ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("ranked", pa.list_(pa.struct([("license", pa.string()), ("saved", pa.float64())]))),
])


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans around cues, overlapping ones joined. Of each line only the part
    near a cue, if it is long."""
    found: list[list[int]] = []
    for m in _CUE.finditer(text):
        begin, end = m.start(), m.end()
        for _ in range(LINES + 1):
            at = text.rfind("\n", 0, max(begin - 1, 0))
            begin = max(at + 1, m.start() - CHARS)
            if at < 0 or begin > at + 1:
                break
        for _ in range(LINES + 1):
            at = text.find("\n", end + 1)
            end = min(len(text) if at < 0 else at, m.end() + CHARS)
            if at < 0 or end < at:
                break
        if found and begin <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([begin, end])
    return [(a, b) for a, b in found]


def deciding(words: list) -> np.ndarray:
    """Which words tell a license from its kin: of NAMES, elements joined by
    hyphens, versions with a point, and numbers after "version" or "v"."""
    return np.array([w is None or w in NAMES or bool(_ELEMENTS.fullmatch(w)) or (w.isdecimal() and before in ("version", "v")) for before, w in zip([None, *words], words, strict=False)], dtype=bool)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as z

        self.alone = z.ZstdCompressor(level=3, write_content_size=False)
        self.given = {n: z.ZstdCompressor(level=3, write_content_size=False, dict_data=z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for n, t in templates.items()}
        self.own = {n: len(self.alone.compress(t.encode())) for n, t in templates.items()}
        self.words = {n: _WORD.findall(t.lower()) for n, t in templates.items()}
        self.decides = {n: deciding(w) for n, w in self.words.items()}
        self.needs = {n: {w for w, d in zip(words, self.decides[n], strict=True) if d} for n, words in self.words.items()}

    def rank(self, block: str) -> list[tuple[str, float]]:
        """Templates by the bytes that they save, per byte of their own compressed size."""
        raw = block.encode()
        alone = len(self.alone.compress(raw))
        saved = {n: (alone - len(c.compress(raw))) / self.own[n] for n, c in self.given.items()}
        return sorted(saved.items(), key=lambda x: (-x[1], x[0]))

    def possible(self, there: Counter, name: str) -> bool:
        """Whether words counted in ``there`` are enough, in whatever order, to confirm the template."""
        return self.needs[name] <= there.keys() and (Counter(self.words[name]) & there).total() >= LEAST_SAME * len(self.words[name])

    def wording(self, block: str, name: str) -> tuple[float, list[str], list[str]]:
        """Share of the template's words that the block has in order, those that
        it lacks, and those that it adds between the first and the last."""
        own, block_words = self.words[name], _WORD.findall(block.lower())
        same, missing, added = 0, [], []
        steps = difflib.SequenceMatcher(None, block_words, own, autojunk=False).get_opcodes()
        equal = [i for i, s in enumerate(steps) if s[0] == "equal"]
        for i, (kind, a, b, c, d) in enumerate(steps):
            if kind == "equal":
                same += d - c
                continue
            missing += own[c:d]
            if equal and equal[0] < i < equal[-1]:
                added += block_words[a:b]
        return same / len(own), missing, added

    def aligned(self, words: list, name: str) -> tuple[int, int, int, float, list[str], list[str]]:
        """The run of ``words`` with the fewest words of the template missing and
        other words added, those that decide before all others:
        (cost, begin, end, share present, missing, added)."""
        own, decides = self.words[name], self.decides[name]
        numbers: dict = {}
        codes = np.array([-1 if w is None else numbers.setdefault(w, len(numbers)) for w in words])
        free = np.concatenate(([0], np.cumsum(np.where(deciding(words), DECIDES, 1))))  # cost of adding the words before a place
        inside = np.arange(len(words) + 1) * DECIDES  # the same between two words of a name
        cost = np.zeros((len(own) + 1, len(words) + 1), dtype=np.int64)
        gaps = [free if i == 0 or not (decides[i - 1] and decides[i : i + 1].all()) else inside for i in range(len(own) + 1)]
        for i, w in enumerate(own):
            best = cost[i] + (DECIDES if decides[i] else 1)
            at = np.flatnonzero(codes == numbers.get(w, -2))
            best[at + 1] = np.minimum(best[at + 1], cost[i][at])
            cost[i + 1] = np.minimum.accumulate(best - gaps[i + 1]) + gaps[i + 1]
        i, j = len(own), int(cost[-1].argmin())
        least, end, missing, added = int(cost[-1][j]), j, [], []
        while i:
            if j and words[j - 1] == own[i - 1] and cost[i, j] == cost[i - 1, j - 1]:
                i, j = i - 1, j - 1
            elif cost[i, j] == cost[i - 1, j] + (DECIDES if decides[i - 1] else 1):
                i -= 1
                missing.append(own[i])
            else:
                j -= 1
                added.append(words[j])
        return least, j, end, 1 - len(missing) / len(own), missing[::-1], added[::-1]

    def confirmed(self, words: list, first: int, last: int, saved: dict[str, float]):
        """The template with most words confirmed, of equal ones that with fewest
        missing, among ``words`` around those from ``first`` to ``last``, at
        whatever distance its length allows:
        (words, name, begin, end, share present, missing, added), or None."""
        best = None
        for name in sorted(self.words, key=lambda n: (-saved[n], n)):
            n = len(self.words[name])
            most = max(1, int((1 - LEAST_SAME) * n))
            low = max(0, first - n - most)
            near = words[low : last + 1 + n + most]
            if not self.possible(Counter(near), name):
                continue
            cost, begin, end, same, missing, added = self.aligned(near, name)
            order = (n - len(missing), -len(missing))
            if cost < DECIDES and same >= LEAST_SAME and len(added) <= most and (best is None or order > best[0]):
                best = (order, name, low + begin, low + end, same, missing, added)
        return best

    def scan(self, text: str):
        """A row for each license that wording confirms near a cue; words once
        taken serve no other. An SPDX line gives its expression. A block without any has one unconfirmed row."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words: list = [text[a:b].lower() for a, b in spans]
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        for begin, end in blocks(text):
            block = text[begin:end]
            ranked = self.rank(block)
            saved, head = dict(ranked), [{"license": n, "saved": s} for n, s in ranked[:RANKED]]
            found = left = False
            for m in _SPDX.finditer(text, begin, end):
                a, b = bisect.bisect_left(starts, m.start()), bisect.bisect_left(starts, m.end())
                yield (m.start(), m.end(), m[1], True, saved.get(m[1], 0.0), 1.0, [], [], head)
                words[a:b] = [None] * (b - a)
                found = True
            for cue in _CUE.finditer(text, begin, end):
                first, last = bisect.bisect_right(ends, cue.start()), bisect.bisect_left(starts, cue.end()) - 1
                while any(w is not None for w in words[first : last + 1]):
                    best = self.confirmed(words, first, last, saved)
                    if best is None:
                        left = True
                        break
                    _, name, a, b, *rest = best
                    yield (starts[a], ends[b - 1], name, True, saved[name], *rest, head)
                    words[a:b] = [None] * (b - a)
                    found = True
            if left and not found:
                name, most = ranked[0]
                yield (begin, end, *((name, False, most, *self.wording(block, name)) if most >= LEAST_SAVED else (None, False, most, 0.0, [], [])), head)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per license that wording confirms, at the place of that wording,
    and one per candidate block that has none: place (code points), template or
    null, whether wording confirms it, bytes that it saves in the block per byte of it, share of its
    words present, words missing and added, and the block's best templates.

    Whole texts are read. Null and empty texts have no block. Repeated rows and
    null ids are reported each; ties go to the first name. An empty table gives
    an empty result; further columns are not read."""
    use = templates or TEMPLATES

    def run(batches):
        scanner = Scanner(use)
        for batch in batches:
            rows = [(own, *found) for own, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True) for found in scanner.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    cued = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).where(F.col("_text").rlike(CUE))
    return cued.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
