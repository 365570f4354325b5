import random

import pyarrow as pa

from refloom.llm import licenses as L


def brute(text, scanner):
    """Every run of words, or of units, against every template."""
    at, spans, edges = 0, [], [0]
    for m in [*L.UNIT.finditer(text), None]:
        end = m.start() if m else len(text)
        spans += [w.span() for w in L.WORD.finditer(text, at, end)]
        edges += [len(spans)] * (len(spans) > edges[-1])
        at = m.end() if m else end
    words = [L.SPELLING.get(w, w) for w in (text[x:y].lower() for x, y in spans)]
    found = []
    for k, t in enumerate(scanner.templates):
        for i in range(len(words)):
            best = None
            for j in range(i + 2, len(words) + 1):
                if t.size < L.WHOLE and not {i, j} <= set(edges):
                    continue
                own = L.bigrams(words[i:j])
                score = 2 * sum((own & t.bigrams).values()) / (j - i - 1 + t.size)
                if score >= scanner.t:
                    row = (-score, -t.size, i, -j, t.name, k)
                    if t.size < L.WHOLE:
                        found.append(row)
                    elif best is None or row < best:
                        best = row
            found += [best] if best else []
    taken, out = set(), []
    for score, _, i, j, name, _ in sorted(found):
        if not taken & set(range(i, -j)):
            taken |= set(range(i, -j))
            out.append(L.Match(name, -score, spans[i][0], spans[-j - 1][1]))
    return sorted(out, key=lambda m: m.start)


def test_against_brute_force():
    rng = random.Random(2)
    short = [(n, t) for n, t in L.TEMPLATES if len(t) < 120]
    for turn in range(60):
        some = rng.sample(short, 10) + [("All-Rights-Reserved", "All rights reserved.")] + rng.sample(L.TEMPLATES, 2) * (turn % 6 == 0)
        scanner = L.Scanner(some)
        parts = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                words = rng.choice(some)[1].split(" ")[:60]
                for _ in range(rng.randint(0, 2)):
                    words[rng.randrange(len(words))] = rng.choice(["the", "License", "x", "MIT.", "Licence"])
                parts.append(" ".join(words))
            else:
                parts.append(" ".join(rng.choice(["license", "the", "under", "all", "rights", "cat", "version."]) for _ in range(rng.randint(0, 12))))
        text = rng.choice(["\n", " "]).join(parts)
        assert scanner.scan(text) == brute(text, scanner), text
        assert scanner.batch(pa.array([text, None, text])) == [brute(text, scanner), [], brute(text, scanner)]


def test_templates_find_themselves():
    scanner = L.Scanner()
    for name, text in L.TEMPLATES:
        got = scanner.scan(f"Some words before it, of no matter.\n{text}\nAnd after: more words.")
        assert [m.license for m in got] == [name] and got[0].score == 1
    assert not scanner.scan("He was licensed to drive. The rights of all were reserved for kings.")


def test_long_texts_end():
    scanner = L.Scanner()
    assert scanner.scan("license. " * 30000) == []
    assert scanner.scan("permission is granted to license " * 8000) == []
    got = scanner.scan("word " * 100000 + "\nAll rights reserved.\n" + "word. " * 50000)
    assert [m.license for m in got] == ["All-Rights-Reserved"]


def test_table(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "x\nReleased under the MIT License.", 1.0), (3, "All rights reserved.", 1.0), (3, "All rights reserved.", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    got = sorted(((r.doc_id or 0), [(m.license, m.start, m.end) for m in r.matches]) for r in L.scan(docs).collect())
    assert got == [(0, [("MIT", 2, 32)]), (1, []), (2, []), (3, [("All-Rights-Reserved", 0, 19)]), (3, [("All-Rights-Reserved", 0, 19)])]
    assert L.scan(docs.limit(0)).count() == 0


def test_look_alike_versions():
    scanner = L.Scanner()
    gnu = "This {2} is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version.\nThis {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
    gpl = "General Public License"
    for name, kind, version in [("GPL-2.0", gpl, "2"), ("GPL-3.0", gpl, "3"), ("LGPL-2.1", f"Lesser {gpl}", "2.1"), ("LGPL-3.0", f"Lesser {gpl}", "3"), ("AGPL-3.0", f"Affero {gpl}", "3")]:
        for thing in ("program", "library", "software"):
            assert [m.license for m in scanner.scan(gnu.format(kind, version, thing))] == [name]
    for long, name in [("Attribution 3.0 International", "CC-BY-3.0"), ("Attribution-NoDerivatives 4.0 International", "CC-BY-ND-4.0"), ("Attribution-NonCommercial-ShareAlike 4.0 International", "CC-BY-NC-SA-4.0"), ("Attribution-ShareAlike 3.0 Unported", "CC-BY-SA-3.0")]:
        assert [m.license for m in scanner.scan(f"This work is licensed under a Creative Commons {long} License.")] == [name]


def test_notices_inside_sentences_and_openings():
    scanner = L.Scanner()
    names = lambda t: [m.license for m in scanner.scan(t)]
    text = "Know that this code is Licensed under the MIT License and more words follow, of no end"
    (m,) = scanner.scan(text)
    assert m.license == "MIT" and text[m.start : m.end] == "Licensed under the MIT License" and m.score == 1
    assert names("it is free, all rights reserved by nobody, as they say") == []  # of so few words whole units alone
    opening = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble\n\nThe GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\nThe licenses for most software and other practical works are designed\nto take away your freedom to share and change the works."
    assert names(opening) == ["GPL-3.0"]
    assert names("# Released under\n# the MIT Licence") == ["MIT"]
    assert [len(f) for f in scanner.batch(pa.array(["Released under the MIT Licence.", "Licenced under CC BY 4.0"]))] == [1, 1]
    two = names("Licensed under CC BY 4.0. And then, in the next part: licensed under CC BY-SA 4.0")
    assert two == ["CC-BY-4.0", "CC-BY-SA-4.0"]
