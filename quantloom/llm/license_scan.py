"""License scanning by patience alignment.

A template is aligned with a stretch of a text word by word: equal ends are taken off, words that
stand once in either are anchors, the longest run of anchors in the same order is kept, and the
gaps between them are aligned in the same way. The share of the template's words that found a
partner is its coverage; from ``least`` on the stretch is a finding. Of findings that overlap that
one stays whose aligned words, less ``PENALTY`` for each template word without a partner and for each
stretch of other words in between, are the most. Neighbouring licenses differ in a few words, such as
"Affero" or a version, so the words that name a license (``NAMING``) must stand together, unchanged.

Stretches are one and a half templates long and begin every eighth of a template, over the whole
text, so a license that a text holds many times is found every time. What lies between complete
ones is aligned once more as a whole for templates of ``WHOLE`` words or more, so other words may
stand in the middle of a license, however many; there only runs of ``RUN`` words or more count.
Where the template word that is rarest there occurs several times, each place is aligned by itself.
Templates of fewer than ``SHORT`` words, one-line notices, must be whole, with no other word in between;
a version they end with must end there. Every license in the expression after an SPDX tag is a finding. A text
is split into words only if it could reach the coverage at all: too many of a template's words
that don't occur anywhere in it rule the template out.

Defined cases: null and empty texts and texts without a finding give one row with a null license
and coverage 0; repeated rows are scanned each; an empty table gives no rows; other columns are
ignored. Case and everything that isn't a word character don't count.
"""

from __future__ import annotations

import pathlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import small_batches

LEAST = 0.8
SHORT, WHOLE, RUN, PENALTY = 12, 30, 3, 2
_LONG = 300  # words of a template from which looking for each in the text costs more than splitting the text
FINDINGS = "doc_id long, license string, coverage double, start long, end long, n_words long"
_WORD = re.compile(r"\w+")
_MORE_VERSION = re.compile(r"\.(?!0\b)\d")  # 2.1 where a notice ends with 2
_NAME = re.compile(r"(?<!\w)(?!(?:AND|OR|WITH)\b)[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?!\w)\+?")
_TAG = re.compile(r"(?<!\w)SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*(?!\w)\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*(?!\w)\)*)*)", re.IGNORECASE)

# Wording of public licence notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0-line": "licensed under the Mozilla Public License, version 2.0",
    "BSD-3-Clause-line": "licensed under the BSD 3-Clause License",
    "BSD-2-Clause-line": "licensed under the BSD 2-Clause License",
    "CC0-1.0": "dedicated to the public domain under CC0 1.0",
    "LGPL-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-3.0-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
}
# Identifiers of the public license list, as tags name them.
TAGS = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense Zlib BSL-1.0 WTFPL 0BSD"
# The words by which a license names itself, in lower case, of notices and texts that have near neighbours.
NAMING = {
    "Apache-2.0-header": ("apache license version 2 0",),
    "Apache-2.0-full": ("apache license version 2 0",),
    "GPL-2.0-header": ("gnu general public license", "version 2 of the license"),
    "GPL-2.0-full": ("gnu general public license version 2",),
    "GPL-3.0-header": ("gnu general public license", "version 3 of the license"),
    "GPL-3.0-full": ("gnu general public license version 3",),
    "AGPL-3.0-header": ("gnu affero general public license", "version 3 of the license"),
    "LGPL-header": ("gnu lesser general public license", "version 2 1 of the license"),
    "LGPL-2.1-header": ("gnu lesser general public license", "version 2 1 of the license"),
    "LGPL-2.1-full": ("gnu lesser general public license version 2 1",),
    "LGPL-3.0-header": ("gnu lesser general public license", "version 3 of the license"),
    "LGPL-3.0-full": ("gnu lesser general public license version 3",),
    "MPL-2.0": ("mozilla public license v 2 0",),
    "MPL-2.0-full": ("mozilla public license version 2 0",),
}
_TAGS = {t.lower(): t for t in TAGS.split()}
FOLDER = pathlib.Path(__file__).parent / "licenses"


def known_texts() -> dict[str, str]:
    """Notices, and the full texts in the folder ``licenses`` beside this file, by name."""
    return NOTICES | {f"{f.stem}-full": f.read_text() for f in sorted(FOLDER.glob("*.txt"))}


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal words, rising in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        anchors = _rising(_anchors(a, a0, a1, b, b0, b1)) if a0 < a1 and b0 < b1 else []
        pairs += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


def _anchors(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Where words stand that both stretches hold once, in the order of the first."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
    return [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second members rise."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    rarest_first: list[tuple[str, int]] = field(compare=False)
    naming: list[list[int]] = field(compare=False)  # of each naming phrase, where it begins and, last, how many words it has

    @staticmethod
    def of(name: str, text: str) -> "Template":
        words, naming = [w.lower() for w in _WORD.findall(text)], []
        for phrase in map(str.split, NAMING.get(name, ())):
            naming.append([i for i in range(len(words)) if words[i : i + len(phrase)] == phrase] + [len(phrase)])
        return Template(name, words, sorted(Counter(words).items(), key=lambda x: (-len(x[0]), x[0])), naming)

    @property
    def short(self) -> bool:
        return len(self.words) < SHORT

    def need(self, least: float) -> int:
        """How many words must be found."""
        return len(self.words) if self.short else -int(-least * len(self.words) // 1)

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether each naming phrase stands together, unchanged, in what was aligned."""
        at = dict(pairs) if self.naming else {}
        return all(any(at.get(i, -1) >= 0 and all(at.get(i + d) == at[i] + d for d in range(n)) for i in begins) for *begins, n in self.naming)


@dataclass(frozen=True)
class Finding:
    license: str
    coverage: float
    first: int  # words of the text
    last: int
    aligned: int
    value: int  # aligned words less penalties

    @staticmethod
    def of(template: Template, pairs: list[tuple[int, int]], begin: int) -> "Finding":
        gaps = sum(y - x > 1 for (_, x), (_, y) in zip(pairs, pairs[1:]))
        size, n = len(template.words), len(pairs)
        return Finding(template.name, n / size, begin + pairs[0][1], begin + pairs[-1][1], n, n - PENALTY * (size - n + gaps))


def findings(words: list[str], template: Template, least: float) -> list[Finding]:
    """Stretches of the words that cover the template."""
    size, need = len(template.words), template.need(least)
    wide, step = size if template.short else size + size // 2 + 1, max(1, size // 8)
    known, sums = set(template.words), [0]
    for w in words:
        sums.append(sums[-1] + (w in known))
    out = []
    for begin in range(0, max(1, len(words) - need + 1), 1 if template.short else step):
        end = min(len(words), begin + wide)
        if sums[end] - sums[begin] < need:
            continue
        pairs = align(template.words, words[begin:end])
        if len(pairs) >= need and template.named(pairs):
            out.append(Finding.of(template, pairs, begin))
    if size >= WHOLE:
        at = 0
        for f in [*_best([f for f in out if f.aligned == size]), None]:
            upto = f.first if f else len(words)
            if upto - at >= need and sums[upto] - sums[at] >= need:
                out += interrupted(words, at, upto, template, need)
            at = max(at, f.last + 1) if f else at
    return out


def _best(found: list[Finding]) -> list[Finding]:
    """Of findings that overlap that of the highest value, then the shortest; in the order of the text."""
    kept: list[Finding] = []
    for f in sorted(found, key=lambda f: (-f.value, -f.coverage, f.last - f.first, f.first, f.license)):
        if all(f.last < k.first or f.first > k.last for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f.first)


def interrupted(words: list[str], lo: int, hi: int, template: Template, need: int) -> list[Finding]:
    """Findings in words[lo:hi] with any number of other words between runs of the template's."""
    known, places = set(template.words), {}
    for j in range(lo, hi):
        if words[j] in known:
            places.setdefault(words[j], []).append(j)
    rarest = min(places, key=lambda w: (len(places[w]), places[w]))
    at = template.words.index(rarest)
    before, after = set(template.words[:at]) - set(template.words[at:]), set(template.words[at:]) - set(template.words[:at])
    edges = [lo, *(_cut(words, i, j, before, after) for i, j in zip(places[rarest], places[rarest][1:])), hi]
    out = []
    for a, b in zip(edges, edges[1:]):
        pairs, runs = align(template.words, words[a:b]) if b - a >= need else [], []
        for p in pairs:
            if runs and p == (runs[-1][-1][0] + 1, runs[-1][-1][1] + 1):
                runs[-1].append(p)
            else:
                runs.append([p])
        kept = [p for run in runs if len(run) >= RUN for p in run]
        if len(kept) >= need and template.named(kept):
            out.append(Finding.of(template, kept, a))
    return out


def _cut(words: list[str], i: int, j: int, before: set[str], after: set[str]) -> int:
    """Where, between two places of a template word, one copy ends and the next begins: most words that follow it lie before the cut and most that precede it behind."""
    best, at, lead = 0, i + 1, 0
    for n in range(i + 1, j):
        lead += (words[n] in after) - (words[n] in before)
        if lead > best:
            best, at = lead, n + 1
    return at


def tagged(text: str) -> list[tuple[str, int, int]]:
    """Known licenses in the expressions after SPDX tags, with the place of each; that of the first includes the tag.

    A trailing + means "or later".
    """
    out = []
    for tag in _TAG.finditer(text):
        for n, m in enumerate(_NAME.finditer(text, *tag.span(1))):
            plain, before = m[0].lower().rstrip("+"), text[tag.start(1) : m.start()].rstrip().upper()
            name = _TAGS.get(f"{plain}-or-later" if m[0].endswith("+") else plain) or _TAGS.get(plain)
            if name and not before.endswith("WITH"):
                out.append((name, m.start() if n else tag.start(), m.start() + len(plain)))
    return out


def scan_text(text: str, templates: list[Template], least: float = LEAST) -> list[tuple[str, float, int, int, int]]:
    """license, coverage, start, end (code points, end exclusive), aligned words of the findings of a text, by start."""
    low, met = text.lower(), {}
    found: list[Finding] = []
    spots: list[re.Match] = []
    words: list[str] = []
    have: set[str] = set()

    def split() -> None:
        if not spots:
            spots.extend(_WORD.finditer(text))
            words.extend(m[0].lower() for m in spots)
            have.update(words)

    for template in templates:
        need = template.need(least)
        if 2 * need - 1 > len(text):
            continue
        spare = len(template.words) - need  # words that may be missing
        if long := len(template.words) > _LONG:
            split()
        for word, n in template.rarest_first:
            if long:
                there = word in have
            else:
                if (there := met.get(word)) is None:
                    there = met[word] = word in low
            if not there and (spare := spare - n) < 0:
                break
        else:
            split()
            own = findings(words, template, least)
            found += [f for f in own if not (template.short and _MORE_VERSION.match(text, spots[f.last].end()))]
    if "spdx" in low:
        split()
        starts, ends = {m.start(): i for i, m in enumerate(spots)}, {m.end(): i for i, m in enumerate(spots)}
        found += [Finding(f"{name}-tag", 1.0, starts[a], ends[b], len(_WORD.findall(text, a, b)), len(words)) for name, a, b in tagged(text)]
    return [(f.license, f.coverage, spots[f.first].start(), spots[f.last].end(), f.aligned) for f in _best(found)]


def license_findings(docs: DataFrame, notices: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """A row for every finding of the notices (None: ``known_texts``); documents without one have a row with a null license."""
    small_batches(docs)
    templates = [t for t in (Template.of(*x) for x in (known_texts() if notices is None else notices).items()) if t.words]
    names = [f.split(" ")[0] for f in FINDINGS.split(", ")]
    types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = scan_text(text.as_py() or "", templates, least)
                rows += [(doc_id, *f) for f in found] or [(doc_id, None, 0.0, None, None, 0)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FINDINGS)
