"""License scans by recognising sentences.

Texts are split into sentences and normalised; those that are known licence sentences become identifiers, and the sequence
of identifiers is matched against ordered licence rules: at each place the first rule that fits wins, and at most GAP other
sentences may stand between two sentences of a rule.

Defined results: a null text is an empty one and has no match. A sentence wrapped over lines is met as well as one that ends
with its line without a stop, and with any name where a licence leaves one open. Repeated rows are scanned each; an empty
table gives an empty result; only doc_id and text are read, texts whole, in memory that grows with one text. Letters are compared in lower
case, anything but letters and digits counts as a space.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import with_arrow

#: Known sentences of public licences, normalised, by identifier; "*" stands for up to WILD words, as a name. Fixed values.
SENTENCES = {
    "apache-2.0:title": "apache license version 2 0 january 2004",
    "apache-2.0:terms": "terms and conditions for use reproduction and distribution",
    "apache-2.0:under": "licensed under the apache license version 2 0",
    "apache-2.0:this-under": "* is licensed under the apache license version 2 0",
    "apache-2.0:under-the-license": "licensed under the apache license version 2 0 the license",
    "apache-2.0:not-use": "you may not use this file except in compliance with the license",
    "apache-2.0:license-then-not-use": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2.0:obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2.0:obtain-s": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache-2.0:unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0:obtain-unless": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0:see": "see the license for the specific language governing permissions and limitations under the license",
    "mit:title": "the mit license",
    "mit:title-short": "mit license",
    "mit:released": "released under the mit license",
    "mit:licensed": "licensed under the mit license",
    "mit:this-project": "this project is licensed under the mit license",
    "mit:permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit:notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit:as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit:liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd:redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd:source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd:binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd:advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd:endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd:endorse-plain": "neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd:endorse-name": "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd:as-is": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc:permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc:permission-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd:permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc:as-is": "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zlib:as-is": "this software is provided as is without any express or implied warranty",
    "zlib:permission": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib:origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "bsl-1.0:title": "boost software license version 1 0 august 17th 2003",
    "bsl-1.0:under": "distributed under the boost software license version 1 0",
    "bsl-1.0:permission": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "gpl:hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl:hope-library": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl:details": "see the gnu general public license for more details",
    "lgpl:details": "see the gnu lesser general public license for more details",
    "agpl:details": "see the gnu affero general public license for more details",
    "gpl:verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-3.0:title": "gnu general public license version 3 29 june 2007",
    "gpl-2.0:title": "gnu general public license version 2 june 1991",
    "lgpl-3.0:title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-2.1:title": "gnu lesser general public license version 2 1 february 1999",
    "agpl-3.0:title": "gnu affero general public license version 3 19 november 2007",
    "mpl-2.0:title": "mozilla public license version 2 0",
    "mpl-2.0:subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2.0:obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-2.0:obtain-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl-2.0:terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-1.0:terms": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "unlicense:public": "this is free and unencumbered software released into the public domain",
    "unlicense:anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-1.0:waived": "to the extent possible under law * has waived all copyright and related or neighboring rights to this work",
    "wtfpl:title": "do what the fuck you want to public license",
    "ofl-1.1:under": "this font software is licensed under the sil open font license version 1 1",
    "proprietary:reserved": "all rights reserved",
}
#: Families whose sentences differ by name or version. Fixed values.
GNU = {"gpl": ("gnu general public license", ("2", "3")), "lgpl": ("gnu lesser general public license", ("2 1", "3")), "agpl": ("gnu affero general public license", ("3",))}
CREATIVE = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
CREATIVE_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib")
#: Ordered: of the rules that fit at a place the first wins. Fixed values.
RULES = [
    ("apache-2.0", "apache-2.0:title", "apache-2.0:terms"),
    ("apache-2.0", "apache-2.0:license-then-not-use", "apache-2.0:obtain-unless", "apache-2.0:see"),
    ("apache-2.0", "apache-2.0:license-then-not-use", "apache-2.0:obtain", "apache-2.0:unless", "apache-2.0:see"),
    ("apache-2.0", "apache-2.0:license-then-not-use", "apache-2.0:obtain-s", "apache-2.0:unless", "apache-2.0:see"),
    ("apache-2.0", "apache-2.0:under-the-license", "apache-2.0:not-use", "apache-2.0:obtain"),
    ("mit", "mit:title", "mit:permission", "mit:notice", "mit:as-is"),
    ("mit", "mit:title-short", "mit:permission", "mit:notice", "mit:as-is"),
    ("mit", "mit:permission", "mit:notice", "mit:as-is", "mit:liable"),
    ("mit", "mit:permission", "mit:notice", "mit:as-is"),
    ("mit", "mit:permission", "mit:notice"),
    ("bsd-4-clause", "bsd:redistribution", "bsd:source", "bsd:binary", "bsd:advertising"),
    *((("bsd-3-clause", "bsd:redistribution", "bsd:source", "bsd:binary", f"bsd:endorse{e}") + rest) for rest in (("bsd:as-is",), ()) for e in ("", "-plain", "-name")),
    ("bsd-2-clause", "bsd:redistribution", "bsd:source", "bsd:binary", "bsd:as-is"),
    ("bsd-2-clause", "bsd:redistribution", "bsd:source", "bsd:binary"),
    ("isc", "isc:permission", "isc:as-is"),
    ("isc", "isc:permission-and", "isc:as-is"),
    ("0bsd", "0bsd:permission", "isc:as-is"),
    ("zlib", "zlib:as-is", "zlib:permission", "zlib:origin"),
    ("zlib", "zlib:as-is", "zlib:permission"),
    ("bsl-1.0", "bsl-1.0:title", "bsl-1.0:permission"),
    ("bsl-1.0", "bsl-1.0:permission"),
    ("bsl-1.0", "bsl-1.0:under"),
]
for _family, (_name, _versions) in GNU.items():
    for _v in _versions:
        _id = f"{_family}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"
        _terms = f"you can redistribute it and or modify it under the terms of the {_name} as published by the free software foundation"
        SENTENCES |= {
            f"{_id}:work": f"this work is licensed under the {_name} version {_v}",
            f"{_id}:under": f"licensed under the {_name} version {_v}",
            f"{_id}-or-later:free": f"* is free software {_terms} either version {_v} of the license or at your option any later version",
            f"{_id}-only:free": f"* is free software {_terms} version {_v} of the license",
        }
        _rest = (("gpl:hope", f"{_family}:details"), ("gpl:hope-library", f"{_family}:details"), ())
        RULES += [(_id, f"{_id}:title", "gpl:verbatim"), *((f"{_id}-{k}", f"{_id}-{k}:free", *rest) for rest in _rest for k in ("or-later", "only")), (_id, f"{_id}:work"), (_id, f"{_id}:under")]
RULES += [("apache-2.0", f"apache-2.0:{n}") for n in ("license-then-not-use", "under-the-license", "under", "this-under")]
RULES += [("mit", f"mit:{n}") for n in ("released", "licensed", "this-project")]
for _kind, _name in CREATIVE.items():
    for _v in CREATIVE_VERSIONS:
        _id, _number = f"cc-{_kind}-{_v}", _v.replace(".", " ")
        SENTENCES |= {f"{_id}:under": f"licensed under cc {_kind.replace('-', ' ')} {_number}", f"{_id}:work": f"this work is licensed under a creative commons {_name} {_number} international license"}
        RULES += [(_id, f"{_id}:under"), (_id, f"{_id}:work")]
RULES += [("mpl-2.0", "mpl-2.0:subject", f"mpl-2.0:{n}") for n in ("obtain", "obtain-s")]
RULES += [("mpl-2.0", "mpl-2.0:subject"), ("epl-2.0", "epl-2.0:terms"), ("epl-1.0", "epl-1.0:terms"), ("unlicense", "unlicense:public", "unlicense:anyone"), ("unlicense", "unlicense:public")]
RULES += [("cc0-1.0", "cc0-1.0:waived"), ("wtfpl", "wtfpl:title"), ("ofl-1.1", "ofl-1.1:under")]
for _name in SPDX:
    SENTENCES[f"spdx:{_name.lower()}"] = f"spdx license identifier {' '.join(re.split('[-.]', _name.lower()))}"
    RULES.append((_name.lower(), f"spdx:{_name.lower()}"))
RULES.append(("proprietary", "proprietary:reserved"))
GAP = 2
#: Words that a "*" stands for at most.
WILD = 12
#: Every known sentence has one of these; texts without them are passed over.
MARKS = ("licen", "copyright", "redistribut", "public domain", "rights reserved", "warrant", "software", "permission", "terms", "mpl")

_SENTENCE = re.compile(r"(?:[^.!?;:\n]|[.:](?=\S))+(?:[.!?;:]+|(?=\n)|\Z)?")
_STOP = re.compile(r"\n|[.!?;:]*(?:[!?;]|[.:](?!\S))[.!?;:]*")  # what stands before and after a sentence
_APART = re.compile(r"\n\s*\n|\.(?!\S)")  # what stands in no sentence
_GLUE = re.compile(r"[\W_]+")


def normal(sentence: str) -> str:
    return _GLUE.sub(" ", sentence.lower()).strip()


def _pattern(known: str) -> re.Pattern:
    """The sentence in a raw text: any marks and spaces between its words, a name of up to WILD words for a star."""
    parts = [r"[\W_]+".join(map(re.escape, part.split())) for part in known.split("*")]
    name = rf"[^\W_]+(?:(?!\.\s)[\W_]+[^\W_]+){{0,{WILD - 1}}}?"
    body = parts[0]
    for part in parts[1:]:  # a name that starts the sentence stands on its line, after the last stop
        body += r"[\W_]+" + name if body else name.replace(r"[\W_]+", r"(?:[^\w\n.:!?;]|[.:](?=\S))+")
        body += r"[\W_]+" + part if part else ""
    return re.compile(rf"(?<![^\W_]){body}(?![^\W_])", re.I)


_PATTERNS = {k: _pattern(s) for k, s in SENTENCES.items()}
#: A sentence's words without its names, which a text must hold to hold the sentence.
_PARTS = {k: tuple(f" {part.strip()} " for part in s.split("*") if part.strip()) for k, s in SENTENCES.items()}


def _borders(text: str, a: int, b: int) -> tuple[int, int] | None:
    """Start and end of the words at a to b with their stop, if the ends of lines or sentences stand on both sides."""
    before, after = a, b
    while before and not text[before - 1].isalnum():
        before -= 1
    while after < len(text) and not text[after].isalnum():
        after += 1
    stops = list(_STOP.finditer(text[before : a + 1]))
    end = _STOP.search(text[b : after + 1])
    if before and not stops or after < len(text) and not end:
        return None
    start = before + (stops[-1].end() if stops else 0)
    start += len(text[start:a]) - len(text[start:a].lstrip())
    tail = text[b:after] if end is None else text[b : b + (end.start() if end[0] == "\n" else end.end())]
    return start, b + len(tail.rstrip())


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences, in order; of overlapping ones the longest."""
    low = text.lower()
    if not any(m.split()[-1] in low for m in MARKS):  # a mark's words may stand on two lines
        return []
    flat, found = f" {normal(text)} ", {}
    for name, parts in _PARTS.items():
        if all(part in flat for part in parts):
            for m in _PATTERNS[name].finditer(text):
                if not _APART.search(m[0]) and (place := _borders(text, *m.span())):
                    found.setdefault(place, name)
    out: list[tuple[int, int, str]] = []
    for (a, b), name in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, name))
    return out


def matched(text: str, found: list[tuple[int, int, str]]) -> list[tuple[str, int, int, int]]:
    """(licence, start, end, sentences) of the rules that fit the known sentences, in text order."""
    out, i = [], 0
    while i < len(found):
        for licence, *rule in _BY_FIRST.get(found[i][2], ()):
            at, k = [i], i
            for name in rule[1:]:
                k = next((j for j in range(k + 1, len(found)) if found[j][2] == name), -1)
                if k < 0 or len(_SENTENCE.findall(text, found[at[-1]][1], found[k][0])) > GAP + 1:
                    break
                at.append(k)
            else:
                out.append((licence, found[i][0], found[at[-1]][1], len(rule)))
                i = at[-1]
                break
        i += 1
    return out


def recognise(text: str | None) -> list[tuple[str, int, int, int]]:
    text = text or ""
    return matched(text, sentences(text))


_BY_FIRST: dict[str, list[tuple[str, ...]]] = {}
for _rule in RULES:
    _BY_FIRST.setdefault(_rule[1], []).append(_rule)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones) and matches (licence, start, end, sentences) of every document."""

    def judge(texts: list) -> list:
        counts, rows = [], []
        for text in (t or "" for t in texts):
            found = sentences(text)
            counts.append(len(found))
            rows.append([dict(zip(("licence", "start", "end", "sentences"), m, strict=True)) for m in matched(text, found)])
        return [counts, rows]

    fields = "n_sentences long, matches array<struct<licence: string, start: bigint, end: bigint, sentences: bigint>>"
    return with_arrow(docs.select("doc_id", "text"), "text", fields, judge, drop=True)
