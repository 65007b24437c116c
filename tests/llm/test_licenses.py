import itertools
import random
import re

from conftest_llm import doc
from scriptorium.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def written(name):
    """The sentence with a name where it leaves one open."""
    return licenses.SENTENCES[name].replace("*", "Örg 7 Inc")


def brute(text):
    """All pieces between the ends of lines and sentences that are known, read as words; of overlapping ones the longest."""
    words = {k: s.split() for k, s in licenses.SENTENCES.items()}

    def fits(piece, known):
        if "*" not in known:
            return piece == known
        i = known.index("*")
        return any(fits_rest(piece[i + n :], known[i + 1 :]) for n in range(1, licenses.WILD + 1) if piece[:i] == known[:i] and i + n <= len(piece))

    def fits_rest(piece, known):
        return fits(piece, known)

    cuts = sorted({0, len(text)} | {m.start() + 1 for m in re.finditer(r"[\n!?;]|[.:](?!\S)", text)})
    found = []
    for i, a in enumerate(cuts):
        for b in cuts[i + 1 :]:
            piece = text[a:b]
            if licenses._APART.search(piece.strip().rstrip(".:;!?")):
                break
            own = licenses.normal(piece).split()
            start = a + len(piece) - len(piece.lstrip())
            # a name that starts a sentence is on one line and holds no stop
            free = len(licenses.normal(re.split(r"[\n!?;]|[.:](?!\S)", piece.lstrip())[0]).split())
            found += [(start, -len(own), b, k) for k, w in words.items() if fits(own, w) and (w[0] != "*" or free > own.index(w[1]))]
    out, end = [], 0
    for a, _, b, k in sorted(found):
        if a >= end:
            out.append(k)
            end = b
    return out


def test_matches_brute_force():
    rng = random.Random(3)
    names = list(licenses.SENTENCES)
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            own = written(rng.choice(names)) if rng.random() < 0.7 else "some other words of no licence"
            if rng.random() < 0.3:
                own = own.replace(" ", "\n", 1) if rng.random() < 0.5 else own + " and more"
            parts.append(own + rng.choice((". ", ".\n", "\n\n", "; ")))
        text = "".join(parts)
        assert [n for _, _, n in licenses.sentences(text)] == brute(text), text


def test_whole_texts_with_names():
    bsd = "Copyright (c) 2020, Acme Corp.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    third = "3. Neither the name of Acme Corp, Inc nor the names of its\n   contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    end = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT'
    assert [(m[0], m[3]) for m in licenses.recognise(bsd + third + end)] == [("bsd-3-clause", 5)]
    assert [(m[0], m[3]) for m in licenses.recognise(bsd + end)] == [("bsd-2-clause", 4)]
    gpl = " GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  Preamble"
    assert [m[0] for m in licenses.recognise(gpl)] == ["gpl-3.0"]
    lesser = "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert [m[0] for m in licenses.recognise("/* Foo\n * " + lesser + " */")] == ["lgpl-3.0-or-later"]


def test_every_sentence_has_a_mark_and_every_rule_is_known():
    assert all(any(m in s for m in licenses.MARKS) or k == "proprietary:reserved" for k, s in licenses.SENTENCES.items() if k not in ("mit:notice",))
    assert all(name in licenses.SENTENCES for _, *rule in licenses.RULES for name in rule)
    assert all(" ".join(map(licenses.normal, s.split("*"))).split() == s.replace("*", " ").split() for s in licenses.SENTENCES.values())
    # any rule's sentences written out are recognised, whatever stands around them
    for licence, *rule in licenses.RULES:
        for before, after in itertools.product(("", "Words here\n", "One. "), ("", "\nmore words", " More.")):
            text = before + ". ".join(written(n) for n in rule) + "." + after
            assert [m[0] for m in licenses.recognise(text)] == [licence], (rule, text)


def test_every_sentence_on_lines_of_its_own_and_wrapped_anywhere():
    spdx = {f"spdx:{n.lower()}": n for n in licenses.SPDX}
    for name in licenses.SENTENCES:
        own = f"SPDX-License-Identifier: {spdx[name]}" if name in spdx else written(name)
        spaces = [i for i, c in enumerate(own) if c == " " and (licenses.SENTENCES[name][0] != "*" or i >= len("Örg 7 Inc"))]
        for lines in (own, *(own[:i] + gap + own[i + 1 :] for i in spaces for gap in ("\n", "  ", "\n# "))):
            for before, after in itertools.product(("", "int a\n", "// Copyright 2020 us\n", "One. "), ("", "\nint b() {", "\nmore; words: here", ". Two")):
                text = before + lines + after
                assert [(text[a:b].rstrip("."), n) for a, b, n in licenses.sentences(text)] == [(lines, name)], text
    for text in ("SPDX-License-Identifier: MIT OR Zlib", "not all rights reserved", "all rights\n\nreserved", "All rights. Reserved"):
        assert licenses.sentences(text) == []


def test_wrapped_header():
    found = licenses.recognise("intro line\n\n" + APACHE + "\nmore text")
    assert {m[0] for m in found} == {"apache-2.0"}


def test_scan(spark, frame):
    rows = [doc(1, "Foo bar\nReleased under the MIT License.\nbaz"), doc(2, None), doc(3, ""), doc(4, "the license is nice"), doc(5, "A.\nLicensed under CC BY-NC 4.0.\nB. All rights reserved."), doc(1, "Foo bar\nReleased under the MIT License.\nbaz"), doc(6, "This work is licensed under the GNU General Public License, version 3.")]
    got = licenses.scan(frame(rows)).collect()
    assert sorted((r.doc_id, tuple(m.licence for m in r.matches)) for r in got) == [(1, ("mit",)), (1, ("mit",)), (2, ()), (3, ()), (4, ()), (5, ("cc-by-nc-4.0", "proprietary")), (6, ("gpl-3.0",))]
    m = next(r for r in got if r.doc_id == 5).matches[0]
    assert rows[4][1][m.start : m.end] == "Licensed under CC BY-NC 4.0."
    assert licenses.scan(frame([])).count() == 0
