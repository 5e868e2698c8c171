"""Whole licence notices, wrapped as they stand in source files."""

import pytest

from tessera.llm import license_scan

APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
BSD = """Copyright 2020 Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Copyright (c) 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
NOTICES = {
    "Apache-2.0": (APACHE, "apache-grant apache-comply apache-copy apache-as-is apache-see"), "MIT": (MIT, "mit-grant mit-notice mit-as-is"), "BSD-3-Clause": (BSD, "bsd-grant bsd-source bsd-binary bsd-endorse"),
    "GPL-3.0-or-later": (GPL, "gpl-later gpl-warranty"), "MPL-2.0": (MPL, "mpl2-ref"), "ISC": (ISC, "isc-grant"),
}


@pytest.mark.parametrize("prefix", ["", "# ", "// ", " * ", ";; ", "-- "])
def test_whole_notices(spark, prefix):
    """Each notice, as comments too, gives its licence and every sentence, and leaves none unmatched."""
    texts = [(n, "".join(f"{prefix}{line}".rstrip() + "\n" for line in text.split("\n"))) for n, (text, _) in enumerate(NOTICES.values())]
    rows = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.sentence_ids, r.n_unmatched) for r in rows] == [(name, ids, 0) for name, (_, ids) in NOTICES.items()]


def test_boundaries(spark):
    """Lines and sentences of their own stay so beside lines that don't end with a mark."""
    cases = {
        "Copyright 2020 Jane\nAll rights reserved.": "Proprietary", "Part V. Released under the MIT License.": "MIT", "Released under the MIT License; see LICENSE": "MIT",
        "terms of the Mozilla Public License, v. 2.0": "", GPL.replace("software:", "software;"): "GPL-3.0-or-later", "Released under the\n\nMIT License.": "", "Released under. The MIT License.": "",
        "Released under the MIT\nLicense\r\nReleased under the\nMIT License\n": "MIT", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    }
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == list(cases.values())


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software."""
MORE = {
    "LGPL-2.1-or-later": LGPL, "LGPL-3.0-or-later": LGPL.replace("2.1", "3"), "AGPL-3.0-or-later": GPL.replace("GNU General", "GNU Affero General"), "GPL-2.0-or-later": GPL.replace("version 3", "version 2"),
    "GPL-2.0-only": GPL.replace("License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "License version 2 as\npublished by the Free Software Foundation."),
    "Zlib": ZLIB, "Unlicense": UNLICENSE, "BSD-4-Clause": BSD.replace("3. Neither", "3. All advertising materials mentioning features or use of this software must\n   display the following acknowledgement:\n   This product includes software.\n\n4. Neither"),
    "BSD-2-Clause": BSD[: BSD.index("3. Neither")],
}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("prefix", ["", "# ", "// ", " * "])
def test_more_notices(spark, prefix, end):
    texts = [(n, end.join(f"{prefix}{line}".rstrip() for line in text.split("\n")) + end) for n, text in enumerate(MORE.values())]
    rows = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.n_unmatched) for r in rows] == [(name, 0) for name in MORE]


def test_tags_before_code(spark):
    names = ["MIT", "Apache-2.0", "GPL-3.0-or-later", *license_scan.TAGGED]
    texts = [(n, f"// SPDX-License-Identifier: {name}\n#include <x>\nint main() {{ return 0; }}\n") for n, name in enumerate(names)]
    rows = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == names


HOLDERS = ("Google Inc.", "the University of California, Berkeley", "The Regents;\n   of X v. 2. Foo")


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_holders_and_programs(spark, prefix):
    """Whoever the holder and whatever the program: the same licence, no other."""
    cases = []
    for holder in HOLDERS:
        head = f"Copyright (c) 2020 {holder}. All rights reserved.\n\n"
        cases += [("BSD-3-Clause", head + BSD.replace("the copyright holder nor", f"{holder} nor")), ("BSD-4-Clause", head + MORE["BSD-4-Clause"].replace("the copyright holder nor", f"{holder} nor")), ("BSD-2-Clause", head + MORE["BSD-2-Clause"]), ("MIT", head + MIT)]
    for program in ("Foo", "GNU Foo 2.1", "This file, like all of Foo,"):
        of = lambda text, p=program: f"This file is part of Foo.\n\n{text.replace('This program is free', p + ' is free').replace('This library is free', p + ' is free')}"
        cases += [(name, of(text)) for name, text in (("GPL-3.0-or-later", GPL), ("LGPL-2.1-or-later", LGPL), ("GPL-2.0-or-later", MORE["GPL-2.0-or-later"]), ("AGPL-3.0-or-later", MORE["AGPL-3.0-or-later"]))]
    texts = [(n, "".join(f"{prefix}{line}".rstrip() + "\n" for line in text.split("\n"))) for n, (_, text) in enumerate(cases)]
    rows = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.licenses, r.n_unmatched) for r in rows] == [(n, name, 0) for n, (name, _) in enumerate(cases)]


def test_tag_expressions(spark):
    cases = {
        "GPL-2.0-only OR MIT": "MIT GPL-2.0-only", "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "Apache-2.0 WITH LLVM-exception": "Apache-2.0", "(MIT or Apache-2.0) AND BSD-4-Clause": "Apache-2.0 MIT BSD-4-Clause",
        "MIT OR (ISC AND (0BSD OR LGPL-2.1+))": "MIT 0BSD ISC LGPL-2.1-or-later", "MIT": "MIT", "Unknown-1.0 OR MIT": "MIT",
    }
    texts = [(n, f"/* SPDX-License-Identifier: {tag} */\nint a = b or c;\n// this or that\n") for n, tag in enumerate(cases)]
    rows = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == list(cases.values())


def test_rights_of_a_copyright_line(spark):
    """A copyright line's reserved rights say nothing where a licence is given; a statement of its own does."""
    line = "Copyright (c) 2020 Jane Doe. All rights reserved."
    cases = {line: ("Proprietary", 0), "(C) Copyright Jane\n * All Rights Reserved\n": ("Proprietary", 0), f"{line}\nReleased under the MIT License.": ("MIT", 0), f"Released under the MIT License. {line}": ("MIT", 0), "All rights reserved. Licensed under CC BY-NC 4.0.": ("CC-BY-NC-4.0 Proprietary", 0)}
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.n_unmatched) for r in rows] == list(cases.values())


def test_sql_reads_names_and_tags_alike(spark):
    """The SQL gives the same rows for notices on one line, any holder and program, and tags with expressions."""
    import duckdb

    one = lambda text: " ".join(text.split())
    bodies = [one(BSD.replace("the copyright holder nor", "Google Inc. nor")).replace("3. Neither", "\nNeither").replace("2. Red", "\nRed").replace("1. Red", "\nRed"), one(GPL.replace("This program is", "GNU Foo 2.1 is")), "x\n// SPDX-License-Identifier: (GPL-2.0+ OR MIT) AND ISC\ny or z", "Copyright 2020 Jane Doe. All rights reserved.\nReleased under the MIT License.", "All rights reserved.", "", None]
    rows = list(enumerate(bodies))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.sql(license_scan.sql()).order("doc_id").fetchall()
