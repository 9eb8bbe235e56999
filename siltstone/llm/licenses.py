"""License scans by sentence rules: sentences of known notices, then ordered rules over their identifiers.

A text is lower-cased and freed of everything but ASCII letters and digits; line ends and signs at the end of a clause stay, as
breaks. A known sentence is one that stands between two breaks, whatever breaks, comment leaders or list marks are in it, so notices
are found wrapped at any width and behind ``#``, ``//`` or ``*``. Sentences found give their identifiers, in the text's order, the longest one
where several begin; a rule is a sequence of identifiers, found where they follow each other with no other known sentence between.
One pattern, a tree of the sentences' words, reads each text once. All of it is SQL functions over the row: no shuffle, no Python.

The tables hold the notices of some fifty public licences and the one-line notes and SPDX tags that name them (of up to three in one
tag); other texts are not told. A licence that a stronger rule names with its own version is not listed (``OVERRULED``).

Defined cases: a null or empty text has no sentence and no licence; a notice that comes twice counts twice in ``n_known`` and names its
licence once; several licences are listed in the order of their names; very long texts are read whole; repeated rows and null ids are kept
as they come; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import let

# What licences are called in notes; the first name of each is followed by its SPDX identifier in tags.
NAMES = {
    "0BSD": ["zero clause bsd license", "bsd zero clause license", "0bsd license"],
    "AFL-3.0": ["academic free license version 3.0", "academic free license 3.0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3.0", "gnu agpl v3", "agpl 3.0", "agplv3"],
    "Apache-2.0": ["apache license version 2.0", "apache license version 2.0 the license", "apache license 2.0", "apache 2.0 license", "apache 2.0", "apache 2 license"],
    "Artistic-2.0": ["artistic license 2.0", "artistic license version 2.0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "two clause bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "three clause bsd license"],
    "BSD-4-Clause": ["bsd 4 clause license", "original bsd license"],
    "BSL-1.0": ["boost software license version 1.0", "boost software license 1.0"],
    "CC0-1.0": ["cc0 1.0", "cc0 1.0 universal", "creative commons zero v1.0 universal", "cc0"],
    "CDDL-1.0": ["common development and distribution license version 1.0", "common development and distribution license 1.0"],
    "ECL-2.0": ["educational community license version 2.0"],
    "EPL-1.0": ["eclipse public license version 1.0", "eclipse public license v1.0", "eclipse public license v 1.0"],
    "EPL-2.0": ["eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license v 2.0", "eclipse public license 2.0"],
    "EUPL-1.2": ["eupl version 1.2", "european union public licence v. 1.2", "eupl 1.2"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2.0", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl 2.0", "gpl version 2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3.0", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl 3.0", "gpl version 3"],
    "ISC": ["isc license", "isc licence"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "gnu lgpl version 2.1", "lgplv2.1", "lgpl 2.1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3.0", "gnu lgpl version 3", "lgplv3", "lgpl 3.0"],
    "LPPL-1.3c": ["latex project public license version 1.3c"],
    "MIT": ["mit license", "mit licence", "mit license mit", "mit x11 license", "expat license"],
    "MIT-0": ["mit no attribution license", "mit 0 license"],
    "MPL-1.1": ["mozilla public license version 1.1", "mozilla public license 1.1", "mpl 1.1"],
    "MPL-2.0": ["mozilla public license version 2.0", "mozilla public license v. 2.0", "mozilla public license 2.0", "mpl 2.0"],
    "MS-PL": ["microsoft public license", "microsoft public license ms pl"],
    "MulanPSL-2.0": ["mulan permissive software license version 2", "mulan psl v2"],
    "NCSA": ["university of illinois ncsa open source license", "ncsa open source license"],
    "ODbL-1.0": ["open data commons open database license", "open database license odbl v1.0", "open database license"],
    "OFL-1.1": ["sil open font license version 1.1", "open font license version 1.1"],
    "OSL-3.0": ["open software license version 3.0", "open software license 3.0"],
    "OpenSSL": ["openssl license"],
    "PHP-3.01": ["php license version 3.01"],
    "PostgreSQL": ["postgresql license", "postgresql licence"],
    "Python-2.0": ["python software foundation license version 2", "psf license version 2", "python software foundation license"],
    "Ruby": ["ruby license"],
    "UPL-1.0": ["universal permissive license version 1.0", "universal permissive license v1.0"],
    "Unlicense": ["unlicense"],
    "Vim": ["vim license"],
    "W3C": ["w3c software notice and license"],
    "WTFPL": ["do what the fuck you want to public license version 2", "do what the fuck you want to public license", "wtfpl"],
    "Zlib": ["zlib license", "zlib libpng license"],
}
# The Creative Commons licences' marks and what they are called.
CREATIVE_COMMONS = {"": "", "-SA": " sharealike", "-NC": " noncommercial", "-ND": " noderivatives", "-NC-SA": " noncommercial sharealike", "-NC-ND": " noncommercial noderivatives"}
for _mark, _words in CREATIVE_COMMONS.items():
    for _version, _kind in (("4.0", "international"), ("3.0", "unported")):
        _short = f"cc by{_mark.lower()} {_version}"
        NAMES[f"CC-BY{_mark}-{_version}"] = [_short, f"{_short} license", *(f"creative commons attribution{_words} {_version}{x}" for x in ("", " license", f" {_kind}", f" {_kind} license"))]
# How notes begin, and the articles that may follow.
OPENINGS = [
    *("licensed under", "released under", "distributed under", "available under", "published under", "under", "is licensed under", "license", "licence"),
    *(f"this {what} is {done} under" for what in ("work", "program", "project", "software", "file", "code", "package", "library", "document") for done in ("licensed", "released", "distributed")),
    "dual licensed under", "distributed under the terms of", "licensed under the terms of", "released under the terms of", "subject to the terms of",
]
ARTICLES = ["the", "a", "an"]

# Sentences of public licence notices and texts; a name before the dot, of the licence or family, and the sentence's own.
NOTICES = {
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.as-is": 'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement',
    "mit.liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "mit0.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "apache2.title": "Apache License Version 2.0, January 2004",
    "apache2.comply": "you may not use this file except in compliance with the License",
    "apache2.copy": "You may obtain a copy of the License at",
    "apache2.as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.as-is": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed',
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc.as-is": 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness',
    "postgresql.grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "gpl2.title": "GNU General Public License Version 2, June 1991",
    "gpl3.title": "GNU General Public License Version 3, 29 June 2007",
    "lgpl21.title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl3.title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "agpl3.title": "GNU Affero General Public License Version 3, 19 November 2007",
    "mpl2.note": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl11.note": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',
    "epl1.note": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2.note": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl.note": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
    "ofl.note": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "unlicense.note": "This is free and unencumbered software released into the public domain",
    "unlicense.anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0.waived": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "zlib.as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost.title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost.grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "wtfpl.title": "Do What The Fuck You Want To Public License Version 2, December 2004",
    "wtfpl.terms": "You just DO WHAT THE FUCK YOU WANT TO",
    "reserved.note": "All rights reserved",
}
# The family of GNU notices, whose sentences differ in the subject, the licence and the version.
GNU = {"gpl2": ("general", "2"), "gpl3": ("general", "3"), "lgpl2": ("library general", "2"), "lgpl21": ("lesser general", "2.1"), "lgpl3": ("lesser general", "3"), "agpl3": ("affero general", "3")}
SUBJECTS = ("program", "library", "software", "file")

# A licence and the sequences of identifiers that declare it, next to its notes and tags.
RULES = {
    "0BSD": ["0bsd.grant"],
    "AGPL-3.0": ["agpl3.title", "agpl3.terms gnu.no-warranty", "agpl3.terms"],
    "Apache-2.0": ["apache2.title", "apache2.comply apache2.copy", "apache2.comply"],
    "BSD-2-Clause": ["bsd.grant bsd.source bsd.binary"],
    "BSD-3-Clause": ["bsd.grant bsd.source bsd.binary bsd.endorse"],
    "BSD-4-Clause": ["bsd.grant bsd.source bsd.binary bsd.advertising"],
    "BSL-1.0": ["boost.title", "boost.grant"],
    "CC0-1.0": ["cc0.waived"],
    "CDDL-1.0": ["cddl.note"],
    "EPL-1.0": ["epl1.note"],
    "EPL-2.0": ["epl2.note"],
    "GPL-2.0": ["gpl2.title", "gpl2.terms gnu.no-warranty", "gpl2.terms"],
    "GPL-3.0": ["gpl3.title", "gpl3.terms gnu.no-warranty", "gpl3.terms"],
    "ISC": ["isc.grant"],
    "LGPL-2.0": ["lgpl2.terms"],
    "LGPL-2.1": ["lgpl21.title", "lgpl21.terms gnu.no-warranty", "lgpl21.terms"],
    "LGPL-3.0": ["lgpl3.title", "lgpl3.terms gnu.no-warranty", "lgpl3.terms"],
    "MIT": ["mit.grant mit.notice mit.as-is", "mit.grant mit.notice"],
    "MIT-0": ["mit0.grant mit.as-is", "mit0.grant"],
    "MPL-1.1": ["mpl11.note"],
    "MPL-2.0": ["mpl2.note mpl2.copy", "mpl2.note"],
    "OFL-1.1": ["ofl.note"],
    "PostgreSQL": ["postgresql.grant"],
    "Proprietary": ["reserved.note"],
    "Unlicense": ["unlicense.note", "unlicense.anyone"],
    "WTFPL": ["wtfpl.title", "wtfpl.terms"],
    "Zlib": ["zlib.as-is zlib.liability zlib.grant", "zlib.grant"],
}
#: A longer rule of the others says that the first isn't meant.
OVERRULED = {"BSD-2-Clause": ["BSD-3-Clause", "BSD-4-Clause"]}
TAG = "SPDX-License-Identifier: "


def words(sentence: str) -> str:
    """A sentence as it is after normalisation, without breaks."""
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def _known() -> dict[str, str]:
    """Each normalised sentence and its identifier."""
    found = {words(text): name for name, text in NOTICES.items()}
    for short, (kind, version) in GNU.items():
        spoken = f"the gnu {kind} public license"
        by = "as published by the free software foundation"
        for subject in SUBJECTS:
            start = f"this {subject} is free software you can redistribute it and or modify it under the terms of {spoken}"
            for end in (f"{by} either version {version} of the license or at your option any later version", f"{by} version {version} of the license", f"version {version} {by}"):
                found[words(f"{start} {end}")] = f"{short}.terms"
            found[words(f"this {subject} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose")] = "gnu.no-warranty"
    for licence, names in NAMES.items():
        for name in names[: 1 if licence.startswith("CC-") else 3]:
            if len(name.split()) > 1:  # as a title
                found.setdefault(words(name), f"{licence}.note")
                found.setdefault(words(f"the {name}"), f"{licence}.note")
    for licence in {*NAMES, *RULES} - {"Proprietary"}:
        for end in ("", "+", "-only", "-or-later"):
            found[words(TAG + licence + end)] = f"{licence}.tag"
    return found


def _named() -> dict[str, str]:
    """Each normalised name and the identifier of notes with it."""
    found: dict[str, str] = {}
    for licence, names in NAMES.items():
        for name in (*names, licence):
            found.setdefault(words(name), f"{licence}.note")
    return found


#: Whole sentences, and what may follow an opening and an article.
SENTENCES, NAMED = _known(), _named()
WAYS = {name: [*RULES.get(name, []), *([f"{name}.note"] if name in NAMES else []), *([f"{name}.tag"] if name != "Proprietary" else [])] for name in sorted({*NAMES, *RULES})}


def _tree(sentences: list[list[str]]) -> str:
    """A pattern of the sentences' words, common beginnings taken together; any break may stand between two words."""
    first: dict[str, list[list[str]]] = {}
    for s in sentences:
        if s:
            first.setdefault(s[0], []).append(s[1:])
    branches = []
    for word, rest in first.items():
        line = [word]
        while len(rest) == 1 and rest[0] or len({r[0] if r else None for r in rest}) == 1 and rest[0]:
            line.append(rest[0][0])
            rest = [r[1:] for r in rest]
        below = _tree([r for r in rest if r])
        if below:
            below = rf"(?:[ \n]{below})" + ("?" if [] in rest else "")
        branches.append(r"[ \n]".join(line) + below)
    return f"(?:{'|'.join(branches)})" if len(branches) > 1 else "".join(branches)


_NOTE = rf"{_tree([o.split() for o in OPENINGS])}[ \n](?:(?:{'|'.join(ARTICLES)})[ \n])?"
#: A list mark before a sentence may belong to its line.
PATTERN = rf"\n(?:[0-9a-z] )?({_tree([s.split() for s in SENTENCES])}|{_NOTE}{_tree([n.split() for n in NAMED])})(?=\n)"
_BREAKS = r"[.!?;:]+[ \t\r]+|[.!?;:]*[ \t\r]*\n"
_TAGS = r"(spdx-license-identifier:[ \t]*\(?[a-z0-9.+-]+)[ \t]+(?:or|and)[ \t]+"


def broken(text: Column) -> Column:
    """The normalised text: words between single blanks, breaks as single line feeds, one at either end."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    again = lambda t: F.regexp_replace(t, _TAGS, "$1\nspdx-license-identifier: ")
    lowered = let(lowered, lambda t: F.when(F.contains(t, F.lit("spdx-license-identifier")), again(again(t))).otherwise(t))
    marked = F.concat(F.lit("\n"), F.regexp_replace(lowered, _BREAKS, "\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(marked, r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*", "\n")


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences, in order."""
    known, named = (F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) for names in (SENTENCES, NAMED))
    found = F.regexp_extract_all(broken(text), F.lit(PATTERN), F.lit(1))
    name = lambda s: F.regexp_replace(s, f"^{_NOTE}", "")
    return F.transform(F.transform(found, lambda s: F.translate(s, "\n", " ")), lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(named, name(s))))


def _declared(row: Column) -> dict[str, Column]:
    found = {}
    for name, ways in WAYS.items():
        holds = F.lit(False)
        for way in ways:
            holds |= F.contains(row, F.lit(f" {way} "))
        found[name] = holds
    stronger = lambda names: F.exists(F.array(*(found[n] for n in names)), lambda x: x)
    return {name: holds & ~stronger(OVERRULED[name]) if name in OVERRULED else holds for name, holds in found.items()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (sentences), sentence_ids and licenses (both joined by commas) of every row of ``docs``."""
    rows = docs.select("doc_id", identifiers(F.col("text")).alias("ids"))
    row = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    listed = let(row, lambda r: F.array_join(F.filter(F.array(*(F.when(holds, F.lit(name)) for name, holds in _declared(r).items())), lambda x: x.isNotNull()), ","))
    names = F.when(F.size("ids") == 0, "").otherwise(listed)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), names.alias("licenses"))


def oracle(most_pieces: int = 24) -> str:
    """Plain SQL for the same: every run of pieces of a text beside every sentence."""
    whole, named = (", ".join(f"('{s}', '{i}')" for s, i in table.items()) for table in (SENTENCES, NAMED))
    openings, articles = (", ".join(f"('{x}')" for x in texts) for texts in ([f"{o} " for o in OPENINGS], ["", *(f"{x} " for x in ARTICLES)]))
    cases = []
    for name, ways in WAYS.items():
        holds = " OR ".join(f"contains(r, ' {w} ')" for w in ways)
        if name in OVERRULED:
            holds = f"({holds}) AND NOT ({' OR '.join(f"contains(r, ' {w} ')" for other in OVERRULED[name] for w in WAYS[other])})"
        cases.append(f"CASE WHEN {holds} THEN '{name}' END")
    tag = f"regexp_replace({{}}, '{_TAGS}', '\\1' || chr(10) || 'spdx-license-identifier: ', 'g')"
    return rf"""
    WITH whole(s, id) AS (VALUES {whole}), named(name, id) AS (VALUES {named}), openings(o) AS (VALUES {openings}), articles(a) AS (VALUES {articles}),
    known AS (SELECT s, id FROM whole UNION ALL SELECT DISTINCT o || a || name, id FROM openings, articles, named WHERE o || a || name NOT IN (SELECT s FROM whole)),
    plain AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace({tag.format(tag.format("lower(coalesce(text, ''))"))}, '{_BREAKS}', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), chr(10)) AS raw FROM documents),
    pieces AS (SELECT doc_id, list_filter(list_transform(raw, lambda p: trim(p, ' ')), lambda p: p <> '') AS p FROM plain),
    starts AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces),
    heads AS (SELECT DISTINCT split_part(s, ' ', 1) AS head FROM known),
    likely AS (SELECT *, regexp_replace(p[i], '^[0-9a-z] ', '') AS own FROM starts WHERE split_part(p[i], ' ', 1) IN (FROM heads) OR split_part(regexp_replace(p[i], '^[0-9a-z] ', ''), ' ', 1) IN (FROM heads)),
    runs AS (SELECT doc_id, i, j, unnest([array_to_string(p[i:j], ' '), array_to_string([own] || p[i + 1:j], ' ')]) AS s FROM (SELECT *, unnest(range(i, least(len(p), i + {most_pieces}) + 1)) AS j FROM likely)),
    found AS (SELECT doc_id, i, max(j) AS j, max_by(id, j) AS id FROM runs JOIN known USING (s) GROUP BY doc_id, i),
    apart AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.i < f.i AND g.j >= f.i)),
    ids AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM apart GROUP BY doc_id),
    joined AS (SELECT doc_id, coalesce(ids, []) AS ids, ' ' || array_to_string(coalesce(ids, []), ' ') || ' ' AS r FROM documents LEFT JOIN ids USING (doc_id))
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids,
           coalesce(array_to_string(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL), ','), '') AS licenses
    FROM joined
    """
