"""The standard notice of each known licence, wrapped and behind comment marks, and only that licence."""

import textwrap

import pytest

from quirefold.llm import licenses

HOPE = """

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1} for more details.

You should have received a copy of the GNU {1}
along with this {0}.  If not, see <https://www.gnu.org/licenses/>.
"""
FREE = "This {0} is free software{2} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{3}."
LATER = "; either version {} of the License, or (at your option) any later version"
BSD_HEAD = """Copyright (c) 2020, Jane Doe

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.
"""
ENDORSE = "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES.\n'
GENERAL, LESSER, AFFERO, LIBRARY = "General Public License", "Lesser General Public License", "Affero General Public License", "Library General Public License"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
CC = "This work is licensed under a Creative Commons Attribution{} International License.\n\nTo view a copy of this license, visit http://creativecommons.org/licenses/.\n"

NOTICES = [
    ("MIT", None, 1.0, MIT),
    ("Apache-2.0", None, 1.0, 'Licensed under the Apache License, Version 2.0 (the "License"); ' + APACHE),
    ("Apache-2.0", None, 1.0, 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); ' + APACHE),
    ("GPL", "3", 1.0, FREE.format("program", GENERAL, ":", LATER.format(3)) + HOPE.format("program", GENERAL)),
    ("GPL", "2", 1.0, FREE.format("program", GENERAL, ";", LATER.format(2)) + HOPE.format("program", GENERAL)),
    ("GPL", "2", 1.0, FREE.format("program", GENERAL, ";", "; version 2 of the License") + HOPE.format("program", GENERAL)),
    ("LGPL", "2.1", 1.0, FREE.format("library", LESSER, ";", LATER.format("2.1")) + HOPE.format("library", LESSER)),
    ("LGPL", "3", 1.0, FREE.format("library", LESSER, ":", LATER.format(3)) + HOPE.format("library", LESSER)),
    ("LGPL", "2", 1.0, FREE.format("library", LIBRARY, ";", LATER.format(2)) + HOPE.format("library", LIBRARY)),
    ("AGPL", "3", 1.0, FREE.format("program", AFFERO, ":", LATER.format(3)) + HOPE.format("program", AFFERO)),
    ("BSD-2-Clause", None, 1.0, BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", None, 1.0, BSD_HEAD + "3. " + ENDORSE + BSD_TAIL),
    ("BSD-4-Clause", None, 1.0, BSD_HEAD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University.\n\n4. " + ENDORSE + BSD_TAIL),
    ("ISC", None, 1.0, ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + AS_IS),
    ("0BSD", None, 1.0, ISC + ".\n\n" + AS_IS),
    ("Zlib", None, 1.0, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.\n"),
    ("BSL", None, 1.0, 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part.\n'),
    ("BSL", "1.0", 0.9, "Distributed under the Boost Software License, Version 1.0.\n"),
    ("Unlicense", None, 1.0, "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.\n"),
    ("MPL", "2.0", 1.0, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"),
    ("MPL", "1.1", 1.0, 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.\n'),
    ("CDDL", None, 1.0, 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").\n\nYou may not use this file except in compliance with the License.\n'),
    ("EPL", "2.0", 0.9, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/\n"),
    ("EPL", "1.0", 0.9, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0\n"),
    ("EUPL", "1.2", 0.9, "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL;\n"),
    ("OFL", "1.1", 0.9, "This Font Software is licensed under the SIL Open Font License, Version 1.1.\n"),
    ("Artistic", "2.0", 0.9, "Licensed under the Artistic License 2.0.\n"),
    ("Perl", None, 0.9, "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.\n"),
    ("CC-BY", "4.0", 0.9, CC.format(" 4.0")),
    ("CC-BY-SA", "4.0", 0.9, CC.format("-ShareAlike 4.0")),
    ("CC-BY-NC", "4.0", 0.9, CC.format("-NonCommercial 4.0")),
    ("CC-BY-ND", "4.0", 0.9, CC.format("-NoDerivatives 4.0")),
    ("CC-BY-NC-SA", "4.0", 0.9, CC.format("-NonCommercial-ShareAlike 4.0")),
    ("CC-BY-NC-ND", "4.0", 0.9, CC.format("-NonCommercial-NoDerivatives 4.0")),
    ("CC-BY-SA", "3.0", 0.9, "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.\n"),
    ("CC-BY-NC", "2.5", 0.9, "Licensed under CC BY-NC 2.5.\n"),
    ("CC0-1.0", None, 0.9, "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.\n"),
    ("PostgreSQL", None, 0.9, "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.\n"),
    ("NCSA", None, 1.0, MIT.split(" to deal in ")[0] + " to deal with the Software without restriction, including without limitation the rights to use, subject to the following conditions:\n\n* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.\n\n* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation.\n\n* Neither the names of Jane Doe, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.\n".replace("names of Jane", "name of Jane")),
    ("WTFPL", None, 0.9, "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n"),
    ("Beerware", None, 0.9, "As long as you retain this notice you can do whatever you want with this stuff.\n"),
    ("Apache-2.0 OR MIT", None, 1.0, "SPDX-License-Identifier: Apache-2.0 OR MIT\n"),
    ("GPL-2.0-only", None, 1.0, "SPDX-License-Identifier: GPL-2.0-only\n"),
    ("public domain", None, 0.8, "This file is in the public domain.\n"),
]
BOOK = licenses._Book(licenses.SENTENCES, licenses.RULES)


def laid(text, width, mark):
    lines = [x for part in text.split("\n\n") for x in (*textwrap.wrap(" ".join(part.split()), width), "")]
    return "".join(f"{mark}{x}\n" for x in lines)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [40, 60, 80, 10_000])
def test_notice_gives_its_licence_alone(width, mark):
    for licence, version, score, text in NOTICES:
        for whole in (laid(text, width, mark), laid("Some file.\n\n" + text + "\n\nint x = 1", width, mark)):
            if "SPDX" in text and width < 60:
                continue  # an identifier stands on one line
            got = [(m[0], m[4], m[1]) for m in BOOK.match(BOOK.locate(whole))]
            assert got == [(licence, version, score)], (licence, version, got)


def test_every_family_has_a_notice():
    missing = {x for x, *_ in licenses.RULES} - {x for x, *_ in NOTICES} - {"*"}
    assert missing == {"proprietary", "HPND", "MS-PL", "Python"}


def test_near_misses_give_nothing():
    for text in (
        "Permission is granted to anyone who asks.",
        "Redistribution of wealth and use in source.",
        "The MIT Licence hall was licensed in 1990; software was sold there.",
        "Licensed under the Apache Licence of 1874.",
        "Licensed under CC BY.",
        "You may obtain a copy.",
    ):
        assert [m for m in BOOK.match(BOOK.find(text)) if m[0] != "*"] == [], text


def test_whole_tables(spark):
    """Repeated rows, nulls, empty and long texts, a clashing column and an empty table."""
    long = "filler words, and more of them; " * 40_000 + "\n" + MIT
    rows = [(1, MIT, 5), (1, MIT, 5), (None, None, 5), (2, "", 5), (3, long, 5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, licence_scan int")
    got = licenses.scan(df)
    assert got.columns == df.columns
    found = sorted((str(r["doc_id"]), [m["licence"] for m in r["licence_scan"]["matches"]]) for r in got.collect())
    assert found == [("1", ["MIT"]), ("1", ["MIT"]), ("2", []), ("3", ["MIT"]), ("None", [])]
    assert licenses.scan(df.limit(0)).count() == 0


def test_every_known_sentence_passes_the_gate():
    assert BOOK.cued and len(licenses.SENTENCES) - len(licenses._MORE_SENTENCES) < 200
    assert all(licenses._cued(v) for v in licenses.SENTENCES.values())


ONE_LINERS = {
    "This project is licensed under the MIT License - see the LICENSE.md file for details.": ("MIT", None),
    "# MIT License": ("MIT", None),
    "License: MIT": ("MIT", None),
    "License: Apache-2.0": ("Apache-2.0", None),
    "Distributed under the MIT license.": ("MIT", None),
    "This software is licensed under the Apache License, Version 2.0.": ("Apache-2.0", None),
    "Licensed under the GNU GPL v3.": ("GPL", "3"),
    "Licensed under GPL-3.0-or-later": ("GPL", "3.0"),
    "released under the BSD 3-Clause License": ("BSD-3-Clause", None),
    "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007": ("GPL", "3"),
    "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999": ("LGPL", "2.1"),
    "GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007": ("AGPL", "3"),
    "Apache License\n  Version 2.0, January 2004": ("Apache-2.0", None),
    "Mozilla Public License Version 2.0\n====": ("MPL", "2.0"),
    "Eclipse Public License - v 2.0": ("EPL", "2.0"),
}


def test_one_line_forms_and_heads():
    for text, (licence, version) in ONE_LINERS.items():
        for whole in (text, f"Readme\n\nSome words before. And so on.\n\n{text}\n\nMore words after it."):
            got = BOOK.match(BOOK.locate(whole))
            assert [(x[0], x[4]) for x in got] == [(licence, version)], (whole, got)


def test_what_is_no_licence():
    for text in ("He had MIT luck and an Apache helicopter.", "The code is released under the terms of love.", "It is provided under the bridge.", "See the license.", "An example licence: none"):
        assert BOOK.match(BOOK.locate(text)) == []


def test_reserved_rights_count_alone():
    assert [x[0] for x in BOOK.match(BOOK.locate("All rights reserved."))] == ["proprietary"]
    assert [x[0] for x in BOOK.match(BOOK.locate("All rights reserved.\nLicensed under the MIT License."))] == ["MIT"]


def test_parts_of_a_sentence_stay_near_each_other():
    far = "To the extent possible under law, Bob likes dogs." + "\nplain line here" * 3000 + "\nhas waived all copyright and related or neighboring rights to this work"
    assert BOOK.match(BOOK.locate(far)) == []
    assert {k for k in licenses.SENTENCES} == {k for _, wanted, _ in licenses.RULES for k in wanted}


def test_a_plain_matcher_on_random_texts():
    """Sentences without variable parts, dealt among other lines: each is found where it stands, whatever is around."""
    import random

    rnd = random.Random(7)
    fixed = {k: v for k, v in licenses.SENTENCES.items() if not set("*~#") & set(v)}
    starts = {v.split()[0] for v in licenses.SENTENCES.values()}
    other = [w for w in ("river", "stone", "quiet", "lamp", "seven", "blue", "window") if w not in starts]
    for _ in range(300):
        lines, want = [], []
        for _ in range(rnd.randrange(1, 12)):
            if rnd.random() < 0.5:
                lines.append(" ".join(rnd.choices(other, k=rnd.randrange(1, 9))))
            else:
                name = rnd.choice(list(fixed))
                lines.append(fixed[name].capitalize())
                want.append(name)
        got = [name for name, *_ in BOOK.locate(".\n".join(lines) + ".")]
        assert [fixed[k] for k in want] == [licenses.SENTENCES[k] for k in got]
