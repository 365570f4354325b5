"""License scans: Dice coefficient over word bigrams with size bounds.

In lower case, with letters and digits as words (so that signs, comment marks and line
breaks don't matter) and one spelling for words that have two, every run of words is a
region; of a
template of fewer than WHOLE bigrams, whose words are common, only runs of whole units
(lines and their sentences). A region matches a template if the Dice coefficient of the
two bags of word bigrams, 2 |A & B| / (|A| + |B|), reaches the threshold t. A template of
b bigrams can only match regions of t b / (2 - t) to (2 - t) b / t bigrams that share
t b / (2 - t) of them; so most texts, and all but a few regions of the rest, are never
compared:

* a text is set aside unless it has a word from enough of a template's bigrams that no
  region without these could share so many (one regular expression over the batch);
* a region begins and ends with bigrams of the template, as others only lower its score;
* its beginning is tried only if the largest region from there shares enough bigrams,
  counted as the bounds slide over the text.

For each beginning the best end counts (of equal ones the later). Matches are taken from
the best down (ties: the larger template, then the earlier and longer region, then the
name), each without words that a better match holds.

Templates are the usual notices, short licenses as wholes and the openings of the long
ones. Null and empty texts have no matches. Every row of docs gives a row; equal texts
give equal results. Very long texts are scanned whole; an empty table gives no rows, and
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .kernels import slices

_MIT = "".join((
    'Permission is hereby granted, free of charge, ',
    'to any person obtaining a copy of this software ',
    'and associated documentation files (the "Software"), ',
    'to deal in the Software without restriction, including ',
    'without limitation the rights to use, copy, ',
    'modify, merge, publish, distribute, sublicense, ',
    'and/or sell copies of the Software, ',
    'and to permit persons to whom the Software is ',
    'furnished to do so, subject to the following ',
    'conditions:\n',
    'The above copyright notice and this permission notice shall ',
    'be included in all copies or substantial portions of ',
    'the Software.\n',
    'THE SOFTWARE IS PROVIDED "AS IS", ',
    'WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, ',
    'INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, ',
    'FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN ',
    'NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE ',
    'LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, ',
    'WHETHER IN AN ACTION OF CONTRACT, TORT OR ',
    'OTHERWISE, ARISING FROM, OUT OF OR IN ',
    'CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER ',
    'DEALINGS IN THE SOFTWARE.',
))
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", f"{_BSD2}\n{_BSD_END}"), ("BSD-3-Clause", f"{_BSD2}\n{_BSD3}\n{_BSD_END}"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All-Rights-Reserved", "All rights reserved."),
]



def _gnu(kind: str, version: str, thing: str, later: bool) -> str:
    which = f"as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version." if later else f"version {version} as published by the Free Software Foundation."
    return f"""This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} {which}
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""


_GPL = "General Public License"
_GNU = [("GPL-1.0", _GPL, "1"), ("GPL-2.0", _GPL, "2"), ("GPL-3.0", _GPL, "3"), ("LGPL-2.0", f"Library {_GPL}", "2"), ("LGPL-2.1", f"Lesser {_GPL}", "2.1"), ("LGPL-3.0", f"Lesser {_GPL}", "3"), ("AGPL-3.0", f"Affero {_GPL}", "3")]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
_CC_PORTS = [("4.0", " International"), ("4.0", ""), ("3.0", " Unported"), ("3.0", " International"), ("3.0", ""), ("2.5", " Generic"), ("2.5", ""), ("2.0", " Generic"), ("2.0", "")]
_MORE = [
    *[(name, _gnu(kind, v, thing, later)) for name, kind, v in _GNU for thing in ("program", "library") for later in (True, False)],
    *[(name, f"This work is licensed under the GNU {kind}, version {v}.") for name, kind, v in _GNU],
    *[(f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {long} {v}{port} License.") for k, long in _CC for v, port in _CC_PORTS],
    *[(f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k, _ in _CC for v in ("4.0", "3.0", "2.5", "2.0")],
    *[(f"EPL-{v}", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {how}{v}") for v in ("1.0", "2.0") for how in ("v", "v. ")],
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("Artistic-2.0", "Licensed under the Artistic License 2.0."), ("WTFPL", "Licensed under the Do What The Fuck You Want To Public License, Version 2."),
]
_FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_OPENINGS = [
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc.\n{_FSF}\nPreamble\nThe GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.\n{_FSF}\nPreamble\nThe licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc.\n{_FSF}\nThis version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999\nCopyright (C) 1991, 1999 Free Software Foundation, Inc.\n{_FSF}\nThis is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007\nCopyright (C) 2007 Free Software Foundation, Inc.\n{_FSF}\nPreamble\nThe GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", 'Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n1. Definitions.\n"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("MPL-2.0", 'Mozilla Public License Version 2.0\n1. Definitions\n1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
]
_MORE += _OPENINGS
_HAVE = {tuple(re.findall(r"[^\W_]+", text.lower())) for _, text in TEMPLATES}
for _name, _text in _MORE:
    if (_words := tuple(re.findall(r"[^\W_]+", _text.lower()))) not in _HAVE:
        _HAVE.add(_words)
        TEMPLATES.append((_name, _text))

WHOLE = 4
WORD = re.compile(r"[^\W_]+")
#: One of two spellings for words that license texts are written with.
SPELLING = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "licencee": "licensee", "licencor": "licensor", "sublicence": "sublicense", "relicence": "relicense",
    "https": "http", "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "behaviour": "behavior", "catalogue": "catalog", "centre": "center",
    "customisation": "customization", "endeavour": "endeavor", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "organisation": "organization", "organisations": "organizations", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}


def words_of(text: str) -> list[str]:
    return [SPELLING.get(w, w) for w in WORD.findall(text.lower())]
UNIT = re.compile(r"\n|(?<=[.!?:;])\s")


@dataclass(frozen=True)
class Template:
    name: str
    bigrams: Counter
    size: int
    key_words: frozenset = field(hash=False)


@dataclass(frozen=True)
class Match:
    license: str
    score: float
    start: int
    end: int


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8):
        self.t = threshold
        self.templates = []
        uses = Counter(w for _, text in templates for w in set(words_of(text)))
        for name, text in templates:
            grams = bigrams(words_of(text))
            size = sum(grams.values())
            if not size:
                raise ValueError(f"template {name} has no two words")
            # so many places of the template may be missing in a match: of one more, one is there
            spare = size - int(np.ceil(self.shared(size) - 1e-9)) + 1
            rare = sorted(grams.elements(), key=lambda g: (-max(map(len, g)), g))[:spare]
            self.templates.append(Template(name, grams, size, frozenset(max(g, key=lambda w: (len(w), -uses[w], w)) for g in rare)))
        keys = {w for t in self.templates for w in t.key_words}
        words = sorted(keys | {other for other, w in SPELLING.items() if w in keys}, key=len)
        least = [w for i, w in enumerate(words) if not any(v in w for v in words[:i])]  # a part stands for the whole
        self.pattern = "|".join(map(re.escape, least))

    def shared(self, size: int) -> float:
        return self.t * size / (2 - self.t)

    def scan(self, text: str | None) -> list[Match]:
        if not text:
            return []
        words, starts, ends, edges, at = [], [], [], [0], 0
        for m in [*UNIT.finditer(text), None]:
            end = m.start() if m else len(text)
            for w in WORD.finditer(text, at, end):
                word = w[0].lower()
                words.append(SPELLING.get(word, word))
                starts.append(w.start())
                ends.append(w.end())
            if len(words) > edges[-1]:
                edges.append(len(words))
            at = m.end() if m else end
        if len(words) < 2:
            return []
        have, grams = set(words), list(zip(words, words[1:]))
        found = []
        for k, t in enumerate(self.templates):
            if have.isdisjoint(t.key_words):
                continue
            hits = [i for i, g in enumerate(grams) if g in t.bigrams]
            if t.size < WHOLE:
                found += [(-score, -t.size, i, -j, t.name, k) for i, j, score in self._units(grams, edges, t)]
            elif len(hits) >= self.shared(t.size) - 1e-9:
                found += [(-score, -t.size, i, -j, t.name, k) for i, j, score in self._regions(grams, hits, t)]
        taken, out = np.zeros(len(words), bool), []
        for score, _, i, j, name, _ in sorted(found):
            if not taken[i:-j].any():
                taken[i:-j] = True
                out.append(Match(name, -score, starts[i], ends[-j - 1]))
        return sorted(out, key=lambda m: m.start)

    def _units(self, grams: list, edges: list[int], t: Template):
        """Matching runs of whole units: (first word, behind the last, score)."""
        need, most = self.shared(t.size), t.size * (2 - self.t) / self.t
        for x, i in enumerate(edges[:-1]):
            for j in edges[x + 1 :]:
                n = j - i - 1
                if n > most + 1e-9:
                    break
                if n >= need - 1e-9 and (score := 2 * sum((Counter(grams[i : j - 1]) & t.bigrams).values()) / (n + t.size)) >= self.t:
                    yield i, j, score

    def _regions(self, grams: list, hits: list[int], t: Template):
        """For each word from which a region matches its best end."""
        need, most = self.shared(t.size) - 1e-9, int(t.size * (2 - self.t) / self.t + 1e-9)
        inside: Counter = Counter()
        shared = b = 0
        for a, i in enumerate(hits):
            while b < len(hits) and hits[b] - i < most:  # the largest region from here
                g = grams[hits[b]]
                inside[g] += 1
                shared += inside[g] <= t.bigrams[g]
                b += 1
            if shared >= need:
                own: Counter = Counter()
                n, best = 0, (0.0, 0)
                for h in hits[a:b]:
                    g = grams[h]
                    own[g] += 1
                    n += own[g] <= t.bigrams[g]
                    score = 2 * n / (h - i + 1 + t.size)
                    if score >= self.t and score >= best[0]:
                        best = (score, h + 2)
                if best[1]:
                    yield i, best[1], best[0]
            g = grams[i]
            shared -= inside[g] <= t.bigrams[g]
            inside[g] -= 1

    def batch(self, arr: pa.Array) -> list[list[Match]]:
        arr = arr.fill_null("")
        maybe = pc.match_substring_regex(pc.utf8_lower(arr), self.pattern)
        out: list[list[Match]] = [[] for _ in range(len(arr))]
        for i in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.scan(arr[i].as_py())
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id and matches (license, score, start, end in code points) of each row."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = Scanner(templates, threshold)
        for b in batches:
            for i, j in slices(b.column(1), 1 << 20):
                found = scanner.batch(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([[m.__dict__ for m in f] for f in found], kind)], names=["doc_id", "matches"])

    return C.doc_columns(docs, "doc_id", "text").mapInArrow(C.lean(run), "doc_id bigint, matches array<struct<license string, score double, start bigint, end bigint>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: number of matches, their licenses and spans in order, and
    the best score (0.0 without a match)."""
    found = scan(C.table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "cast(size(matches) as bigint) n_matches", "concat_ws(',', matches.license) licenses",
        "concat_ws(',', transform(matches, m -> concat(m.start, '-', m.end))) spans", "round(coalesce(array_max(matches.score), 0D), 6) best_score",
    )
