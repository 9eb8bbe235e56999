"""Standard notices as they stand in files: wrapped, in comments, with colons inside."""

import textwrap

from siltstone.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""


BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
LESSER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
AFFERO = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
ECLIPSE = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
NOTICES = {"MIT": MIT, "GPL-3.0": GPL.format(":", ",", 3), "GPL-2.0": GPL.format(";", ";", 2), "MPL-2.0": MPL, "ISC": ISC, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "LGPL-2.1": LESSER, "AGPL-3.0": AFFERO, "EPL-2.0": ECLIPSE, "Zlib": ZLIB}


def licences_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_wrapped_notices(spark):
    texts, want = [], []
    for name, notice in NOTICES.items():
        for width in (5_000, 76, 60):
            for leader in ("", " * ", "# ", "// ", "-- "):
                lines = [line for p in notice.split("\n\n") for line in (*textwrap.wrap(p, width), "")]
                want.append(name)
                texts.append("Some words\n" + "\n".join(leader + line for line in lines) + "\nmore words")
    assert licences_of(spark, texts) == want


def test_every_entry_is_reached(spark):
    """Every sentence is found as itself, and every licence has a way that declares it."""
    known = list(licenses.SENTENCES.items())
    halves = [(w[: len(w) // 2], w[len(w) // 2 :]) for w in (s.split() for s, _ in known)]
    rows = spark.createDataFrame([(i, f"words before.\n{' '.join(a)}\n# {' '.join(b)}.\nwords after") for i, (a, b) in enumerate(halves)], "doc_id long, text string")
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(rows).collect()}
    assert [(s, got[i]) for i, (s, _) in enumerate(known)] == known
    ids = {*licenses.SENTENCES.values(), *licenses.NAMED.values()}
    assert all(set(way.split()) <= ids for ways in licenses.WAYS.values() for way in ways)


def test_notes_and_tags(spark):
    texts = {
        "Distributed under the terms of the\nBoost Software License, Version 1.0.": "BSL-1.0",
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;": "Apache-2.0,MIT",
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "# SPDX-License-Identifier: MIT AND BSD-3-Clause OR Zlib": "BSD-3-Clause,MIT,Zlib",
        "License: MIT": "MIT",
        "This project is licensed under the MIT License - see the file for details": "",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
        "Released under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "we like the MIT License here": "",
        "All rights reserved.": "Proprietary",
        "THE SOFTWARE": "",
    }
    assert licences_of(spark, list(texts)) == list(texts.values())
