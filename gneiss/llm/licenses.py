"""Licence scans by sentence rules.

Texts are cut into sentences; each is normalised and looked up in a map from known licence
sentences to their identifiers, first as a whole, then by the known forms that it holds. The
sequence of identifiers of a document is then matched against
ordered rules: the first rule whose identifiers stand in the sequence one after the other takes
them out, and so on. Identifiers that no rule takes, and sentences that only speak of a licence,
are reported as unknown.

Defined results: a null or empty text has no licence; repeated rows are scanned each; a licence
that occurs several times is named once, in order of first occurrence; very long texts are scanned
whole, in linear time; an empty table gives an empty result; all other columns pass through, and a column that already has a result column's
name is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Licence sentences in normal form (lower case, runs of other characters than
# letters, digits and plus as one space, "licence" as "license"); * stands for up to 12 words.
SENTENCES = {
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-obtain": ["you may obtain a copy of the license at"],
    "apache-warranty": ["distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "apache-limits": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is-provided": ["the software is provided as is without warranty of any kind", "the software is provided as is and the author disclaims all warranties"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-advert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-names": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["this software is provided by the copyright holders and contributors as is", "this software is provided by * as is and any express or implied warranties"],
    "gpl-2-later": ["under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-3-later": ["under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-published": ["under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl-published": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-published": ["under the terms of the gnu affero general public license as published by the free software foundation"],
    "2-or-later": ["either version 2 of the license or at your option any later version"],
    "2.1-or-later": ["either version 2 1 of the license or at your option any later version"],
    "3-or-later": ["either version 3 of the license or at your option any later version"],
    "gpl-useful": ["distributed in the hope that it will be useful but without any warranty"],
    "gpl-copy": ["you should have received a copy of the gnu * general public license along with"],
    "gpl-details": ["see the gnu * general public license for more details"],
    "lgpl-2.1-later": ["under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl-3-later": ["under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl-3-published": ["under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"],
    "mpl-2": ["subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license version 2 0"],
    "mpl-1.1": ["subject to the mozilla public license version 1 1"],
    "cddl": ["subject to the terms of the common development and distribution license"],
    "epl-1": ["made available under the terms of the eclipse public license v1 0", "made available under the terms of the eclipse public license v 1 0"],
    "epl-2": ["made available under the terms of the eclipse public license 2 0", "made available under the terms of the eclipse public license v2 0", "made available under the terms of the eclipse public license v 2 0"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "zlib-source": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "zlib-notice": ["this notice may not be removed or altered from any source distribution"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "postgresql-grant": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"],
    "ofl": ["this font software is licensed under the sil open font license version 1 1"],
    "cc0": ["dedicated to the public domain under cc0", "creative commons cc0 1 0 universal"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "wtfpl": ["do what the fuck you want to public license"],
    "all-rights": ["all rights reserved"],
}

# What licences are called, without a leading article, and the identifier of their
# name where it isn't "named-" and the licence. Sentences with names are made from a rule.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "MIT": ["mit license"],
    "MIT-0": ["mit no attribution license", "mit 0 license"],
    "ISC": ["isc license"],
    "0BSD": ["0bsd license", "bsd zero clause license"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gplv2"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gnu gpl version 2 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gplv3"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gnu gpl version 3 or later"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lgpl version 3", "lgplv3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu agpl version 3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "OFL-1.1": ["sil open font license version 1 1"],
    "EUPL-1.2": ["eupl version 1 2", "european union public license version 1 2", "eupl 1 2"],
    "PostgreSQL": ["postgresql license"],
    "PSF-2.0": ["python software foundation license version 2"],
    "ODbL-1.0": ["open database license", "open data commons open database license"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0", "cc0 1 0", "creative commons zero"],
}
NAME_IDS = {"Apache-2.0": "apache-2", "MIT": "mit-named", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "MPL-2.0": "mpl-2", "CC0-1.0": "cc0", "BSD-2-Clause": "bsd-named-2", "BSD-3-Clause": "bsd-named-3", "Unlicense": "unlicense"}
VERBS = ["licensed under", "released under", "distributed under", "under the terms of", "available under", "provided under"]
CC_PARTS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
CC_KINDS, CC_VERSIONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"], ["2.0", "2.5", "3.0", "4.0"]


def named_sentences() -> dict[str, list[str]]:
    """Forms made of a verb and a licence's name, by identifier."""
    out: dict[str, list[str]] = {}
    for spdx, names in NAMES.items():
        out.setdefault(NAME_IDS.get(spdx, f"named-{spdx}"), []).extend(f"{v} {the}{n}" for v in VERBS for the in ("", "the ", "a ") for n in names)
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            number, parts = version.replace(".", " "), kind.split("-")
            long = "creative commons " + " ".join(CC_PARTS[p] for p in parts)
            names = [f"cc {' '.join(parts)} {number}", *(f"{long} {number} {kind_}license" for kind_ in ("international ", "unported ", "generic ", ""))]
            out[f"cc-{kind}-{version}"] = [f"{v} {the}{n}" for v in VERBS for the in ("", "the ", "a ") for n in names]
    return out


# How the grants of the GNU licences start, in one sentence or cut at a semicolon.
GNU_GRANTS = [
    ("GPL-2.0-or-later", ["gpl-2-later"]),
    ("GPL-2.0-or-later", ["gpl-published", "2-or-later"]),
    ("GPL-3.0-or-later", ["gpl-3-later"]),
    ("GPL-3.0-or-later", ["gpl-published", "3-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-later"]),
    ("LGPL-2.1-or-later", ["lgpl-published", "2.1-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later"]),
    ("LGPL-3.0-or-later", ["lgpl-published", "3-or-later"]),
    ("AGPL-3.0", ["agpl-3-published"]),
    ("AGPL-3.0", ["agpl-published", "3-or-later"]),
]
# With what follows in a whole notice, the longest first.
GNU_NOTICES = [(name, [*grant, *rest]) for rest in (["gpl-useful", "gpl-details", "gpl-copy"], ["gpl-useful", "gpl-details"], ["gpl-useful", "gpl-copy"], []) for name, grant in GNU_GRANTS]

# Rules in order, each a licence and the identifiers that must follow one another.
RULES = [
    ("Apache-2.0", ["apache-2", "apache-comply", "apache-obtain", "apache-warranty", "apache-limits"]),
    ("Apache-2.0", ["apache-2", "apache-comply", "apache-obtain", "apache-warranty"]),
    ("Apache-2.0", ["apache-2", "apache-comply", "apache-obtain"]),
    ("MIT", ["mit-named", "mit-grant", "mit-notice", "as-is-provided"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-provided"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT-0", ["mit-grant", "as-is-provided"]),
    ("ISC", ["isc-grant", "as-is-provided"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "as-is-provided"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names", "bsd-warranty"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"]),
    ("BSD-3-Clause", ["all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("BSD-2-Clause", ["all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-grant", "zlib-source", "zlib-notice"]),
    ("Zlib", ["zlib-grant", "zlib-source"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    *GNU_NOTICES,
    ("MPL-1.1", ["mpl-1.1"]),
    ("CDDL-1.0", ["cddl"]),
    ("EPL-1.0", ["epl-1"]),
    ("EPL-2.0", ["epl-2"]),
    ("OFL-1.1", ["ofl"]),
    ("WTFPL", ["wtfpl"]),
    ("Unlicense", ["unlicense", "as-is-provided"]),
    *((spdx, [NAME_IDS.get(spdx, f"named-{spdx}")]) for spdx in NAMES),
    *((f"CC-{kind.upper()}-{version}", [f"cc-{kind}-{version}"]) for kind in CC_KINDS for version in CC_VERSIONS),
    ("Proprietary", ["all-rights"]),
]
UNKNOWN = "UNKNOWN"

#: Every licence sentence has one of these in lower case, and so has one that speaks of a licence.
TRIGGERS = (
    "licen", "permission", "copyright", "redistribut", "warrant", "provided as is", "rights reserved", "endorse", "obtain a copy", "public domain",
    "creative commons", "spdx", "provided by", "notice may not be", "source versions", "advertising", "want to public", "cc0", "gpl", "in the hope",
    "either version", "should have received", "eupl", "cc by", "cc-by",
)
#: A sentence: marks end it where white space or the text's end follows, but for the point of
#: "v. 2.0". Lines may be wrapped.
SENTENCE = re.compile(r"[^.;:!?]*(?:(?:[.;:!?]+(?=\S)|(?<=\b[vV])\.(?=\s+\d))[^.;:!?]*)*(?:[.;:!?]+|\Z)", re.DOTALL)
#: Normalised sentences that speak of the terms of some licence.
SPEAKS = re.compile(r"\b(?:sub)?licensed (?:under|to|by|for|as)\b|\b(?:under|subject to|terms of|terms and conditions of|governed by|covered by|see|read|accept|accompanying|included) (?:\w+ ){0,6}?license\b|\blicense (?:agreement|terms|file|notice|text|grant)\b|\bspdx\b")
OTHER = re.compile(r"[^a-z0-9+]+")
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)")


def normal(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower().replace("licence", "license")).strip()


#: Words of a form by which it is looked up, and words that a gap holds at most.
HEAD, GAP = 3, 12


def _index() -> tuple[dict[str, str], dict[tuple[str, ...], list[tuple[list[list[str]], str]]]]:
    """The identifier of each whole sentence, and all forms by their first words, the longest first;
    a form is its runs of words between gaps."""
    whole, heads = {}, {}
    for known in (SENTENCES, named_sentences()):
        for name, forms in known.items():
            for form in forms:
                words = form.split()
                if "*" not in words:
                    whole.setdefault(form, name)
                at = min(HEAD, *(i for i, w in enumerate([*words, "*"]) if w == "*"))
                heads.setdefault(tuple(words[:at]), []).append(([run.split() for run in form.split(" * ")], name))
    for forms in heads.values():
        forms.sort(key=lambda f: -sum(map(len, f[0])))
    return whole, heads


WHOLE, HEADS = _index()


def _end(words: list[str], at: int, runs: list[list[str]]) -> int:
    """Where a form that starts at a place ends; 0 if it doesn't stand there."""
    first, rest = runs[0], runs[1:]
    if words[at : at + len(first)] != first:
        return 0
    at += len(first)
    if not rest:
        return at
    return next((end for gap in range(GAP + 1) if (end := _end(words, at + gap, rest))), 0)


def identifiers(sentence: str) -> list[str]:
    """Identifiers of the licence sentences in a normalised sentence, in order: of the whole if it
    is known, else of the known forms in it, the longest at each place; none overlap."""
    if sentence in WHOLE:
        return [WHOLE[sentence]]
    words, out, at = sentence.split(), [], 0
    while at < len(words):
        best, name = 0, ""
        for n in range(1, HEAD + 1):
            for runs, one in HEADS.get(tuple(words[at : at + n]), ()) if at + n <= len(words) else ():
                end = _end(words, at, runs)
                if end > best:
                    best, name = end, one
        if best:
            out.append(name)
        at = max(best, at + 1)
    return out


def triggered(text: str) -> bool:
    low = text.lower()
    return any(t in low for t in TRIGGERS)


def sentences(text: str):
    """(start, end) of each sentence that has a trigger."""
    for m in SENTENCE.finditer(text):
        if m.end() > m.start() and triggered(m[0]):
            yield m.start(), m.end()


def by_rules(ids: list[str]) -> list[tuple[int, str]]:
    """(place, licence) of what the ordered rules recognise, then what is left as unknown."""
    left: list[str | None] = list(ids)
    out = []
    for name, rule in RULES:
        k = 0
        while k + len(rule) <= len(left):
            if left[k : k + len(rule)] == rule:
                out.append((k, name))
                left[k : k + len(rule)] = [None] * len(rule)
                k += len(rule)
            else:
                k += 1
    for k, name in enumerate(left):
        if name is not None:
            out.append((k, name[5:] if name.startswith("spdx:") else UNKNOWN))
    return sorted(out)


def scan(text: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(licences, spans): a span is an identifier and the characters of its sentence."""
    if not triggered(text):
        return [], []
    spans = [(f"spdx:{m[1]}", m.start(), m.end()) for m in SPDX.finditer(text)]
    tagged = [(a, b) for _, a, b in spans]
    for start, end in sentences(text):
        clean = normal(text[start:end])
        names = identifiers(clean)
        if not names and SPEAKS.search(clean) and not any(start < b and a < end for a, b in tagged):
            names = [UNKNOWN.lower()]
        spans += [(name, start, end) for name in names]
    spans.sort(key=lambda s: s[1])
    licences = dict.fromkeys(name for _, name in by_rules([s[0] for s in spans]))
    return list(licences), spans


SPAN = T.StructType([T.StructField("sentence_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def with_licenses(docs: DataFrame, names: str = "licenses", spans: str = "license_spans") -> DataFrame:
    """``docs`` with the names of its licences and the spans of their sentences."""
    kept = docs.drop(names, spans)
    schema = T.StructType([*kept.schema.fields, T.StructField(names, T.ArrayType(T.StringType())), T.StructField(spans, T.ArrayType(SPAN))])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("sentence_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [scan(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            rows = [[{"sentence_id": n, "start": a, "end": b} for n, a, b in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array(rows, kind)], schema.names)

    return kept.mapInArrow(run, schema)
