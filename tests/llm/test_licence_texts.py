"""Hard-wrapped licence texts and notices, and rights reserved."""

from __future__ import annotations

import textwrap

from tidegauge.llm import licences, queries

MIT = """MIT License

Copyright (c) 2020 Some One

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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD4 = BSD + """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
     This product includes software developed by the organization.
4. Neither the name of the organization nor the
   names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZERO = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
WANT = {
    MIT: "MIT", MIT.replace("\n", "\r\n"): "MIT", BSD: "BSD-2-Clause", BSD3: "BSD-3-Clause", ISC: "ISC", APACHE: "Apache-2.0", GPL: "GPL-3.0",
    " ".join(GPL.split()): "GPL-3.0", GPL.replace("software:", "software;").replace("version 3", "version 2"): "GPL-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": "GPL-3.0", "  Apache License\n  Version 2.0, January 2004\n": "Apache-2.0",
    "a line of prose\nAll rights reserved.\nmore": "proprietary", "Copyright (c) 2020 Some One. All rights reserved.": "proprietary", "Copyright 2020 Some One All Rights Reserved": "proprietary",
    "Not all rights reserved by law are named": "", "a line of prose\nReleased under the MIT License.\nmore": "MIT", "": "", None: "",
}


def test_texts(spark, tmp_path):
    rows = list(enumerate(WANT))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.licences for r in queries.op8_license_scan(spark, str(tmp_path)).collect()}
    assert {t: got[i] for i, t in rows} == WANT
    assert queries.op8_license_scan(spark, str(tmp_path)).where("licences != '' and n_sentences = 0").count() == 0


LGPL = GPL.replace("GNU General", "GNU Lesser General").replace("This program", "This library")
AGPL = GPL.replace("GNU General Public License as published by\n    the", "GNU Affero General Public License as\n    published by the")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at

   http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
EPL = """All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v2.0
which accompanies this distribution.
"""
NOTICES = {
    MIT: "MIT", BSD3.replace("Redistribution and use", "Copyright (c) 2020, Some One. All rights reserved.\n\nRedistribution and use", 1): "BSD-3-Clause", APACHE: "Apache-2.0", GPL: "GPL-3.0", LGPL: "LGPL-3.0", LGPL.replace("version 3", "version 2.1"): "LGPL-2.1", AGPL: "AGPL-3.0",
    MPL: "MPL-2.0", ASF: "Apache-2.0", UNLICENSE: "Unlicense", ZLIB: "Zlib", BSL: "BSL-1.0", EPL: "EPL-2.0", ISC: "ISC",
    "Licensed under the MIT License.": "MIT", "This project is licensed under\nthe terms of the MIT license.": "MIT", "The source code is available under the BSD 3-Clause license": "BSD-3-Clause", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "prose here\nLicensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "Released under the GPLv3.": "GPL-3.0",
    "SPDX-License-Identifier: MIT": "MIT", "x = 1  # SPDX-License-Identifier: Apache-2.0 OR MIT\nmore": "Apache-2.0,MIT", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    BSD4: "BSD-4-Clause", ZERO: "0BSD", "License: GPLv3\n": "GPL-3.0", "# License : the MIT License": "MIT", "license: \"Apache-2.0\"": "Apache-2.0", "Licensed under the Artistic License 2.0.": "Artistic-2.0", "SPDX-License-Identifier: Artistic-2.0": "Artistic-2.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0", "Licensed under CC BY 3.0": "CC-BY-3.0", "Attribution-NonCommercial 2.5 Generic\n": "CC-BY-NC-2.5", "Released under the WTFPL.": "WTFPL", "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1",
    "Microsoft Public License (Ms-PL)\n\nThis license governs": "MS-PL", "Distributed under the EUPL 1.2": "EUPL-1.2", "Licensed under the CDDL, version 1.0": "CDDL-1.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2\n--------------------------------------------\n": "PSF-2.0",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    "The project is not licensed under the MIT License": "", "We read of the MIT License, which people like.": "", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software": "",
}


def _rows(spark, texts):
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licences for r in sorted(licences.scan(given).collect(), key=lambda r: r.doc_id)]


def test_published_texts(spark):
    """As they stand, unwrapped, with other line ends, indented, and behind comment marks."""
    texts, want = list(NOTICES), list(NOTICES.values())
    assert _rows(spark, texts) == want
    assert _rows(spark, [f"A line of prose before\n{t}" for t in texts]) == want
    assert _rows(spark, [t.replace("\n", "\r\n") for t in texts]) == want
    for mark in ("# ", " * ", "// ", "    "):
        assert _rows(spark, ["\n".join(f"{mark}{line}".rstrip() for line in t.split("\n")) for t in texts]) == want, mark
    assert _rows(spark, [" ".join(t.split()) for t in (MIT, BSD3, GPL, MPL, ZLIB, UNLICENSE)]) == ["MIT", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "Zlib", "Unlicense"]
    assert _rows(spark, [textwrap.fill(" ".join(MIT.split("\n\n")[2].split()), w) + "\n\n" + MIT.split("\n\n")[-1] for w in (20, 40, 200)]) == ["MIT"] * 3


def test_notices_against_sql(spark):
    import duckdb

    rows = list(enumerate([*NOTICES, *WANT, *(t.replace("\n", "\n# ") for t in NOTICES), "a|b~c\n\n\n日本語\n日本語\n|", "mit", "spdx-license-identifier:", "x" * 50_000, None]))
    given = spark.createDataFrame([*rows, rows[0], (None, MIT)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", given.toArrow())
    want = con.execute(licences.ORACLE).fetchall()
    assert sorted(map(tuple, licences.scan(given).collect()), key=str) == sorted(want, key=str)


def test_altered_texts(spark):
    """Terms that say more, less or something else than the licence aren't the licence's."""
    research = MIT.replace("without restriction", "for non-commercial research purposes only, and not to sell")
    texts = [
        research, MIT.replace("and/or sell", "and"), MIT.replace("IMPLIED, INCLUDING", "IMPLIED INCLUDING CHARGES").replace("copies or substantial portions", "copies or most"), MIT.replace("The above copyright notice and this permission notice shall", "The above copyright notice shall").replace("NONINFRINGEMENT", "MORE"),
        "licensed under the MIT-like terms of ACME", "Licensed under the MIT License to members only.", "This is released under the Apache License 2.0-derived terms.", BSD.replace("must retain", "need not retain"),
        ISC.replace("with or without fee", "without fee"), ZLIB.replace("including commercial applications", "excluding commercial applications"), UNLICENSE.replace("public domain", "public domain of Elbonia"),
        GPL.replace("GNU General Public", "ACME General Public"), "The Mozilla Public License Version 2.0 is widely used.", "License: see the MIT file", "license: none", "Apache License\nVersion 2.0, January 2004 as amended\n", "An attribution 4.0 international effort",
    ]
    assert _rows(spark, texts) == [""] * len(texts)


def test_how_many():
    assert len(licences._LICENCES) >= 60
