"""License scans by sentence rules, in DataFrame operations only.

A sentence ends at a mark . ! ? ; : before a blank or line end, at a blank line and at the end; line ends within it are
blanks, so hard-wrapped, indented and commented texts read like others. A sentence is looked for at each line's start
too, since notices often follow a line without a mark. It is normalised (A-Z lower-cased, only a-z and digits, single
blanks) and mapped, as a whole, to the identifier of a known sentence: by its first two words to the known ones with
these, of which it must be one, word for word but for the variable parts (*). A sentence that says more or less than the
known one is another: altered terms aren't those of the licence. Headings are known as whole lines, one to three of
them. A sentence that grants something under a licence maps by the licence's name, if that is where the name ends.
SPDX lines map by the identifiers in them, `License:` lines by a name that is all they hold.

A rule is an ordered sequence of identifiers; it matches if a document has them in this order with at most GAP other
sentences between one and the next. Where a rule's identifiers are part of a longer rule's, it is tried on what the
longer ones leave. All rights reserved means `proprietary` where no rule of another licence matches.

All of it is row by row, in one pass and without a shuffle: the sentences and rules are constants of the query.

Null and empty texts have no sentences and no licence. Texts of any length are scanned whole. Rows with null or
repeated ids are scanned like others; other columns are not passed on.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other sentences between two of a rule, at most.
GAP = 3

# Known licence sentences, normalised; * stands for variable words.
_GNU = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
_ISC = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted"
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_EPL = "this program and the accompanying materials are made available under the terms of the eclipse public license {} which *"
_GNU_NAMES = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
SENTENCES = {
    "apache-use": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-asf": ["licensed to the apache software foundation asf under one or more contributor license agreements"],
    "apache-asf-grant": ["the asf licenses this file to you under the apache license version 2 0 the license"],
    "mit-permission": [f"{_MIT} subject to the following conditions"],
    "mit-0-permission": [_MIT],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement"],
    "gpl-free": ["this program is free software", "* is free software"],
    "lgpl-free": ["this library is free software"],
    **{f"{k}{v}-terms": [f"{_GNU.format(n)} {_LATER.format(x)}", f"{_GNU.format(f'{n} version {x}')}", f"{_GNU.format(n)} version {x} of the license", f"{_GNU.format(n)} version {x}"] for k, n in _GNU_NAMES.items() for v, x in (("3", "3"), ("2", "2"), ("21", "2 1")) if (k, v) in {("gpl", "3"), ("gpl", "2"), ("lgpl", "3"), ("lgpl", "21"), ("agpl", "3")}},
    **{f"{k}-part": [_GNU.format(n)] for k, n in _GNU_NAMES.items()},
    **{f"later{v}": [_LATER.format(x)] for v, x in (("3", "3"), ("2", "2"), ("21", "2 1"))},
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms with or without modification are permitted subject to the following conditions"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-advertising": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-names": [f"neither the name of * nor the names of its contributors {_ENDORSE}", f"neither the name of * nor the names of * contributors {_ENDORSE}", f"neither the name * nor the names of its contributors {_ENDORSE}", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl11-notice": ["the contents of this file are subject to the mozilla public license version 1 1 the license"],
    "cddl-notice": ["the contents of this file are subject to the terms of the common development and distribution license the license"],
    "epl2-notice": [_EPL.format("v2 0"), _EPL.format("2 0")],
    "epl1-notice": [_EPL.format("v1 0"), _EPL.format("1 0")],
    "isc-permission": [f"{_ISC.format(x)} provided that the above copyright notice and this permission notice appear in all copies" for x in ("and or", "and")],
    "0bsd-permission": [_ISC.format("and or"), _ISC.format("and")],
    "postgresql-permission": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "zlib-warranty": ["this software is provided as is without any express or implied warranty"],
    "zlib-permission": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl-permission": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "cc0-waiver": ["to the extent possible under law * has waived all copyright and related or neighboring rights to *"],
    "wtfpl-copy": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "all-rights": ["all rights reserved"],
}
# licences' headings, normalised.
_CC = {"": "attribution", "-nc": "attribution noncommercial", "-nd": "attribution noderivatives", "-sa": "attribution sharealike", "-nc-sa": "attribution noncommercial sharealike", "-nc-nd": "attribution noncommercial noderivatives"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
TITLES = {
    "Apache-2.0": ["apache license version 2 0 january 2004"],
    "GPL-3.0": ["gnu general public license version 3 29 june 2007"], "GPL-2.0": ["gnu general public license version 2 june 1991"], "AGPL-3.0": ["gnu affero general public license version 3 19 november 2007"],
    "LGPL-3.0": ["gnu lesser general public license version 3 29 june 2007"], "LGPL-2.1": ["gnu lesser general public license version 2 1 february 1999"], "GFDL-1.3": ["gnu free documentation license version 1 3 3 november 2008"],
    "MPL-2.0": ["mozilla public license version 2 0"], "MPL-1.1": ["mozilla public license version 1 1"], "EPL-2.0": ["eclipse public license v 2 0"], "EPL-1.0": ["eclipse public license v 1 0"],
    "BSL-1.0": ["boost software license version 1 0 august 17th 2003"], "CC0-1.0": ["cc0 1 0 universal"], "WTFPL": ["do what the fuck you want to public license", "do what the fuck you want to public license version 2 december 2004"],
    "Artistic-2.0": ["the artistic license 2 0"], "Artistic-1.0": ["the artistic license"], "OFL-1.1": ["sil open font license version 1 1 26 february 2007"], "MS-PL": ["microsoft public license ms pl"], "MS-RL": ["microsoft reciprocal license ms rl"],
    "CDDL-1.0": ["common development and distribution license cddl version 1 0"], "CDDL-1.1": ["common development and distribution license cddl version 1 1"], "EUPL-1.1": ["european union public licence v 1 1"], "EUPL-1.2": ["european union public licence v 1 2"],
    "PSF-2.0": ["python software foundation license version 2"], "NCSA": ["university of illinois ncsa open source license"], "UPL-1.0": ["the universal permissive license upl version 1 0"], "OSL-3.0": ["open software license v 3 0"], "AFL-3.0": ["academic free license v 3 0"],
    "CPL-1.0": ["common public license version 1 0"], "ODbL-1.0": ["odc open database license odbl"], "SSPL-1.0": ["server side public license version 1 october 16 2018"], "BUSL-1.1": ["business source license 1 1"], "CECILL-2.1": ["cecill free software license agreement version 2 1 dated 2013 06 21"],
    **{f"CC-BY{k.upper()}-{v}": [f"{n} {v.replace('.', ' ')} {'international' if v == '4.0' else 'unported' if v == '3.0' else 'generic'}", f"creative commons {n} {v.replace('.', ' ')} {'international' if v == '4.0' else 'unported' if v == '3.0' else 'generic'}"] for k, n in _CC.items() for v in _CC_VERSIONS},
}
# Ordered rules, (licence, identifiers). All that match count.
_BSD = ["bsd-redistribution", "bsd-source", "bsd-binary"]
RULES = [
    ("Apache-2.0", ["apache-use", "apache-copy"]), ("Apache-2.0", ["apache-copy", "apache-basis"]), ("Apache-2.0", ["apache-asf", "apache-asf-grant"]), ("Apache-2.0", ["apache-asf-grant"]),
    ("MIT", ["mit-permission", "mit-warranty"]), ("MIT", ["mit-permission", "mit-notice"]), ("MIT-0", ["mit-0-permission", "mit-warranty"]),
    *((n, [f, f"{k}{v}-terms"]) for n, k, v in (("GPL-3.0", "gpl", "3"), ("GPL-2.0", "gpl", "2"), ("LGPL-3.0", "lgpl", "3"), ("LGPL-2.1", "lgpl", "21"), ("AGPL-3.0", "agpl", "3")) for f in ("gpl-free", "lgpl-free")),
    *((n, [f"{k}-part", f"later{v}"]) for n, k, v in (("GPL-3.0", "gpl", "3"), ("GPL-2.0", "gpl", "2"), ("LGPL-3.0", "lgpl", "3"), ("LGPL-2.1", "lgpl", "21"), ("AGPL-3.0", "agpl", "3"))),
    ("GPL-3.0", ["gpl3-terms", "gpl-hope"]), ("GPL-2.0", ["gpl2-terms", "gpl-hope"]),
    ("BSD-2-Clause", _BSD), ("BSD-3-Clause", [*_BSD, "bsd-names"]), ("BSD-4-Clause", [*_BSD, "bsd-advertising", "bsd-names"]),
    ("MPL-2.0", ["mpl2-notice"]), ("MPL-1.1", ["mpl11-notice"]), ("CDDL-1.0", ["cddl-notice"]), ("EPL-2.0", ["epl2-notice"]), ("EPL-1.0", ["epl1-notice"]),
    ("ISC", ["isc-permission"]), ("0BSD", ["0bsd-permission"]), ("PostgreSQL", ["postgresql-permission"]), ("Unlicense", ["unlicense-free"]), ("Zlib", ["zlib-warranty", "zlib-permission"]), ("BSL-1.0", ["bsl-permission"]), ("CC0-1.0", ["cc0-waiver"]), ("WTFPL", ["wtfpl-copy"]),
]
# What licences are called in a grant, normalised, without the word license at the end.
_VERSIONED = {
    "GPL": ("gnu general public license", "gnu gpl", "gpl"), "LGPL": ("gnu lesser general public license", "gnu lgpl", "lgpl"), "AGPL": ("gnu affero general public license", "gnu agpl", "agpl"), "GFDL": ("gnu free documentation license", "gnu fdl", "gfdl"),
    "Apache": ("apache license", "apache software license", "apache"), "MPL": ("mozilla public license", "mpl"), "EPL": ("eclipse public license", "epl"), "BSL": ("boost software license", "boost license", "bsl"), "Artistic": ("artistic license", "perl artistic license", "artistic"),
    "OFL": ("sil open font license", "open font license", "sil ofl", "ofl"), "CDDL": ("common development and distribution license", "cddl"), "EUPL": ("european union public licence", "european union public license", "eupl"), "PSF": ("python software foundation license", "psf license", "psf"),
    "UPL": ("universal permissive license", "upl"), "OSL": ("open software license", "osl"), "AFL": ("academic free license", "afl"), "CPL": ("common public license", "cpl"), "ODbL": ("open database license", "odbl"), "ECL": ("educational community license", "ecl"), "SSPL": ("server side public license", "sspl"), "BUSL": ("business source license", "busl"), "CECILL": ("cecill license", "cecill"), "ZPL": ("zope public license", "zpl"), "LPPL": ("latex project public license", "lppl"),
}
_VERSIONS = ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "GFDL-1.3", "Apache-2.0", "Apache-1.1", "MPL-2.0", "MPL-1.1", "EPL-2.0", "EPL-1.0", "BSL-1.0", "Artistic-2.0", "Artistic-1.0", "OFL-1.1", "CDDL-1.0", "CDDL-1.1", "EUPL-1.1", "EUPL-1.2", "PSF-2.0", "UPL-1.0", "OSL-3.0", "AFL-3.0", "CPL-1.0", "ODbL-1.0", "ECL-2.0", "SSPL-1.0", "BUSL-1.1", "CECILL-2.1", "ZPL-2.1", "LPPL-1.3c")
NAMES = {
    "MIT": ["mit"], "MIT-0": ["mit 0", "mit no attribution"], "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"], "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"], "BSD-4-Clause": ["bsd 4 clause", "4 clause bsd", "original bsd"], "0BSD": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "ISC": ["isc"], "Unlicense": ["unlicense"], "Zlib": ["zlib"], "CC0-1.0": ["cc0", "cc0 1 0", "creative commons zero", "creative commons cc0", "creative commons cc0 1 0"], "WTFPL": ["wtfpl", "do what the fuck you want to public license"], "PostgreSQL": ["postgresql"], "NCSA": ["ncsa", "university of illinois ncsa open source"], "X11": ["x11"], "Vim": ["vim"], "W3C": ["w3c software notice and license", "w3c"],
    "MS-PL": ["microsoft public license", "ms pl"], "MS-RL": ["microsoft reciprocal license", "ms rl"],
}
for _n in _VERSIONS:
    _family, _v = _n.split("-")
    _forms = {_v.replace(".", " ").lower(), _v.removesuffix(".0").replace(".", " ").lower()}
    NAMES[_n] = sorted(f"{long}{sep}{v}" for long in _VERSIONED[_family] for v in _forms for sep in (" version ", " v", " ", *(("v",) if " " not in long else ())))
for _k, _long in _CC.items():
    for _v in _CC_VERSIONS:
        _x = _v.replace(".", " ")
        NAMES[f"CC-BY{_k.upper()}-{_v}"] = [f"cc by{_k.replace('-', ' ')} {_x}", *(f"creative commons {y} {_x}" for y in {_long, _long.replace("noncommercial", "non commercial"), _long.replace("sharealike", "share alike"), _long.replace("noderivatives", "no derivatives")}), f"creative commons by{_k.replace('-', ' ')} {_x}"]
OTHERWISE = ("proprietary", "all-rights")
#: What a granting sentence begins with, up to the licence's name.
_SUBJECTS = ("project", "software", "work", "program", "file", "library", "package", "code", "source code", "document", "documentation", "text", "content", "page", "article", "dataset", "font software")
GRANT_WORDS = ("licensed", "released", "distributed", "published", "available", "made", "dual")
GRANT_HEADS = tuple(sorted({f"{a} {x.split()[0]}" for a in ("this", "the") for x in _SUBJECTS}))
GRANT = rf"^(?:(?:this|the) (?:{'|'.join(_SUBJECTS)}) is )?(?:made |dual )?(?:licensed|released|distributed|published|available) (?:under|on) (?:the terms of )?(?:the |a |an )?(?:terms of the )?"
#: What may follow a name in a grant: nothing, or a word that doesn't change which licence it is.
AFTER = r"^ (?:licen[cs]es? )?(?:(?:international|unported|generic|or|and|with|as|the|see|which|https?) .*)?$"

_LICENCES = sorted({n for n, _ in RULES} | NAMES.keys() | TITLES.keys())
#: One character for each identifier, then one for each licence that is granted by its name, stated or in a heading.
_LETTERS = {k: chr(0x4E00 + i) for i, k in enumerate([*SENTENCES, *(f"grant {n}" for n in _LICENCES)])}
_BY_NAME = sorted(((x, _LETTERS[f"grant {n}"]) for n, some in NAMES.items() for x in some), key=lambda p: (-len(p[0]), p))
_BY_SPDX = [(f" {n.lower().replace('-', ' ').replace('.', ' ')} ", _LETTERS[f"grant {n}"]) for n in _LICENCES]
_STATED = {x: letter for x, letter in [*((k.strip(), v) for k, v in _BY_SPDX), *_BY_NAME]}
#: By the first two words: what a sentence begins with, what it ends with (both: what it is, without a variable part).
_KNOWN: dict[str, list[tuple[str, str, str, bool]]] = {}
#: Variable first words are no key: such sentences are known by their end, if that is all the rest.
_ENDS = [(_LETTERS[i], x[1:]) for i, some in SENTENCES.items() for x in some if x.startswith("*")]
for _id, _some in SENTENCES.items():
    for _line in _some:
        if not _line.startswith("*"):
            _parts = [p.strip() for p in _line.split("*")]
            _KNOWN.setdefault(" ".join(_line.split()[:2]), []).append((_LETTERS[_id], _parts[0], " " + _parts[-1] if len(_parts) > 1 and _parts[-1] else "", len(_parts) > 1))
_HEADS: dict[str, str] = {x: _LETTERS[f"grant {n}"] for n, some in TITLES.items() for x in some}
_HEAD_STARTS = sorted({" ".join(x.split()[:2]) for x in _HEADS})
_STARTS = sorted({k.split()[0] for k in _KNOWN})
#: A sentence's lines that can matter, as each has a word at least; variable parts are of 40 words, at most.
_LINES = max(len(x.split()) + 40 * x.count("*") for x in (*(y for some in SENTENCES.values() for y in some), *(n for n, _ in _BY_NAME))) + 16

_PAIRS = "array<struct<name: string, letter: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz "
#: Patterns mean the same to Java and to RE2.
_END, _BLANK, _DROP, _HARD = r"[.!?;:]+[\"'”’»\x29\x5D]*([ \t\n]|\z)", r"\n[^a-z0-9]*\n", r"[^a-z0-9|\n]+", r" ?\| ?"
#: Words that begin a sentence wherever they stand: in unwrapped texts only a copyright notice stands before them.
_GRANTS = r"[ \n]+((?:permission[ \n]+(?:is|to)|redistribution[ \n]+and)[ \n])"
_SPDX, _RIGHTS = r"spdx-license-identifier:([^\n]*)", "^(?:copyright|c) .*all rights reserved"
_FIELD = r"(?:^|\n)[^a-z0-9\n]*licen[cs]e['\"]?[ \t]*[:=][ \t]*([^\n]*)"


def _pieces(text: Column) -> Column:
    """The normalised lines of sentences; | ends the last line of a sentence."""
    t = F.regexp_replace(text, _END, "|$1")
    t = F.regexp_replace(t, _BLANK, "|")
    t = F.regexp_replace(F.regexp_replace(t, _DROP, " "), _GRANTS, "|$1")
    t = F.regexp_replace(t, _HARD, " |\n")
    return F.filter(F.transform(F.split(t, "\n"), lambda p: F.trim(p)), lambda p: p != "")


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def _constant(value, schema: str) -> Column:
    """Tables as one literal: hundreds of literals of their own make the plan slow to build."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _letter(pieces: Column, p: Column, i: Column) -> Column:
    """Of the sentence that begins with line p, the i-th from 0: the letter of its identifier, - if it isn't known, nothing
    within a sentence and for numbers of lists. Only lines that begin like a known sentence are put together to one."""
    lines = lambda n: F.replace(F.array_join(F.slice(pieces, i + 1, F.lit(n)), " "), F.lit(" |"), F.lit("|"))
    sentence = F.trim(F.substring_index(lines(_LINES), "|", 1))
    word = F.substring_index(F.replace(p, F.lit("|"), F.lit("")), " ", 1)
    head = F.rtrim(F.replace(F.substring_index(F.when(p.contains(" "), p).otherwise(F.concat_ws(" ", p, F.try_element_at(pieces, i + 2))), " ", 2), F.lit("|"), F.lit("")))
    table = _constant({k: [dict(zip(("letter", "start", "end", "open"), x)) for x in some] for k, some in _KNOWN.items()}, "map<string, array<struct<letter: string, start: string, end: string, open: boolean>>>")
    fits = lambda s: lambda k: F.when(k["open"], F.startswith(s, F.concat(k["start"], F.lit(" "))) & F.endswith(s, k["end"]) & (F.length(s) > F.length(k["start"]) + F.length(k["end"]) + 1)).otherwise(s == k["start"])
    known = F.when(word.isin(*_STARTS), F.transform(F.array(F.try_element_at(table, head)), lambda some: F.when(some.isNotNull(), _first(F.filter(some, fits(sentence)))["letter"]))[0])
    titles = _constant(_HEADS, "map<string, string>")
    heading = lambda n: F.try_element_at(titles, F.trim(F.replace(lines(n), F.lit("|"), F.lit(" "))))
    title = F.when(head.isin(*_HEAD_STARTS), F.coalesce(heading(3), heading(2), heading(1)))
    ends = reduce(lambda a, b: a | b, [F.endswith(sentence, F.lit(x)) for _, x in _ENDS])
    named = F.when(F.contains(p, F.lit("is free")) & ends, F.lit(_ENDS[0][0]))
    names = _constant([{"name": n, "letter": x} for n, x in _BY_NAME], _PAIRS)
    rest = F.regexp_replace(sentence, GRANT, "|")
    by_name = F.transform(F.array(rest), lambda r: F.when(F.startswith(r, F.lit("|")), _first(F.filter(names, lambda n: F.startswith(F.concat(F.substr(r, F.lit(2)), F.lit(" ")), F.concat(n["name"], F.lit(" "))) & F.concat(F.substr(r, F.length(n["name"]) + 2), F.lit(" ")).rlike(AFTER)))["letter"]))[0]
    granted = F.when(word.isin(*GRANT_WORDS) | head.isin(*GRANT_HEADS), by_name)
    rights = F.when(p.startswith("c") & p.rlike(_RIGHTS), F.lit(_LETTERS["all-rights"]))
    begins = (i == 0) | F.endswith(F.try_element_at(pieces, i), F.lit("|"))
    other = F.when(begins & (F.length(F.rtrim(F.replace(p, F.lit("|"), F.lit("")))) > 2), F.lit("-")).otherwise("")
    return F.coalesce(known, title, named, granted, rights, other)


def _spdx(lines: Column) -> Column:
    names = _constant([{"name": n, "letter": x} for n, x in _BY_SPDX], _PAIRS)
    normal = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, " | "), "[^a-z0-9|]+", " "), F.lit(" "))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(F.filter(names, lambda n: F.contains(normal, n["name"])), lambda n: n["letter"]), "")).otherwise("")


_PLAIN = r"^(?:the )?(.*?)(?: licen[cs]e)?$"


def _stated(lines: Column) -> Column:
    """Letters of the lines that name a licence and nothing else."""
    names = _constant(_STATED, "map<string, string>")
    plain = lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")), _PLAIN, 1)
    return F.array_join(F.transform(lines, lambda x: F.coalesce(F.try_element_at(names, plain(x)), F.lit(""))), "")


def _sequence(ids: list[str]) -> str:
    return (".{0,%d}" % GAP).join(_LETTERS[i] for i in ids)


def _patterns() -> dict[str, tuple[str, str]]:
    """For each licence what the line of letters has if it applies, and what is taken out before: longer rules that have
    the identifiers of one of its own, in order."""

    def within(x: list[str], ids: list[str]) -> bool:
        left = iter(ids)
        return len(ids) > len(x) and all(i in left for i in x)

    out = {}
    for n in _LICENCES:
        own = [ids for m, ids in RULES if m == n]
        longer = sorted({_sequence(ids) for m, ids in RULES for x in own if m != n and within(x, ids)}, key=lambda p: (-len(p), p))
        out[n] = "|".join([*map(_sequence, own), _LETTERS[f"grant {n}"]]), "|".join(longer)
    return out


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licences: sorted names joined by commas, n_sentences: known ones) for every row."""
    low = F.regexp_replace(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), _UPPER, _LOWER), r"\r\n?", "\n")
    lines = lambda p, *marks: F.regexp_extract_all(F.when(reduce(lambda a, b: a | b, [F.col("low").contains(m) for m in marks]), F.col("low")).otherwise(""), F.lit(p), F.lit(1))
    cut = docs.select(F.col(f"`{ident}`").alias("doc_id"), low.alias("low"))
    cut = cut.select("doc_id", F.concat(_spdx(lines(_SPDX, "spdx-license-identifier:")), _stated(lines(_FIELD, "license", "licence"))).alias("stated"), _pieces(F.col("low")).alias("pieces"))
    line = F.concat(F.col("stated"), F.array_join(F.transform("pieces", lambda p, i: _letter(F.col("pieces"), p, i)), ""))
    out = cut.select("doc_id", line.alias("line"), F.translate(line, "-", "").alias("letters"))
    rest = lambda longer: F.regexp_replace("line", longer, "-") if longer else F.col("line")
    found = F.concat_ws(",", *[F.when(rest(longer).rlike(p), F.lit(n)) for n, (p, longer) in _patterns().items()])
    name, last = OTHERWISE
    found = F.when(F.col("letters") == "", "").otherwise(found)
    found = F.when((found == "") & F.col("letters").contains(_LETTERS[last]), F.lit(name)).otherwise(found)
    return out.select("doc_id", found.alias("licences"), F.length("letters").cast("long").alias("n_sentences"))


def _oracle() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    entry = lambda k: f"{{l: {text(k[0])}, a: {text(k[1])}, z: {text(k[2])}, o: {str(k[3]).lower()}}}"
    pairs = lambda d: "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in d.items()) + "}"
    among = lambda some: "(" + ", ".join(map(text, some)) + ")"
    table = "MAP {" + ", ".join(f"{text(k)}: [{', '.join(map(entry, some))}]" for k, some in _KNOWN.items()) + "}"
    names = "[" + ", ".join(f"{{name: {text(n)}, letter: {text(x)}}}" for n, x in _BY_NAME) + "]"
    spdx = " || ".join(f"CASE WHEN contains(spdx, {text(n)}) THEN {text(x)} ELSE '' END" for n, x in _BY_SPDX)
    rest = lambda longer: f"regexp_replace(line, {text(longer)}, '-', 'g')" if longer else "line"
    hits = ", ".join(f"CASE WHEN regexp_matches({rest(longer)}, {text(p)}) THEN {text(n)} END" for n, (p, longer) in _patterns().items())
    lines = lambda n: f"replace(array_to_string(list_slice(pieces, i, i + {n} - 1), ' '), ' |', '|')"
    heading = lambda n: f"map_extract({pairs(_HEADS)}, trim(replace({lines(n)}, '|', ' ')))[1]"
    plain = f"regexp_extract(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), '{_PLAIN}', 1)"
    name, last = OTHERWISE
    return rf"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '\r\n?', chr(10), 'g') AS low FROM documents),
marked AS (SELECT doc_id, r, ' ' || regexp_replace(array_to_string(regexp_extract_all(low, '{_SPDX}', 1), ' | '), '[^a-z0-9|]+', ' ', 'g') || ' ' AS spdx,
  array_to_string(list_transform(regexp_extract_all(low, {text(_FIELD)}, 1), lambda x: coalesce(map_extract({pairs(_STATED)}, {plain})[1], '')), '') AS stated,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(low, {text(_END)}, '|\1', 'g'), '{_BLANK}', '|', 'g'), '{_DROP}', ' ', 'g'), '{_GRANTS}', '|\1', 'g'), '{_HARD}', ' |' || chr(10), 'g') AS t FROM low),
cut AS (SELECT doc_id, r, ({spdx}) || stated AS stated, list_filter(list_transform(string_split(t, chr(10)), lambda p: trim(p)), lambda p: p <> '') AS pieces FROM marked),
each AS (SELECT doc_id, r, stated, pieces, unnest(CASE WHEN len(pieces) > 0 THEN range(1, len(pieces) + 1) ELSE [0] END) AS i FROM cut),
sentences AS (SELECT *, coalesce(pieces[i], '') AS p, i = 1 OR ends_with(coalesce(pieces[i - 1], ''), '|') AS begins, trim(split_part({lines(_LINES)}, '|', 1)) AS s FROM each),
keyed AS (SELECT *, split_part(replace(p, '|', ''), ' ', 1) AS word, CASE WHEN contains(p, ' ') THEN p ELSE concat_ws(' ', p, pieces[i + 1]) END AS two, regexp_replace(s, '{GRANT}', '|') AS rest FROM sentences),
headed AS (SELECT *, rtrim(replace(split_part(two, ' ', 1) || CASE WHEN contains(two, ' ') THEN ' ' || split_part(two, ' ', 2) ELSE '' END, '|', '')) AS head FROM keyed),
lettered AS (SELECT *, coalesce(
    (list_filter(map_extract({table}, head)[1], lambda k: CASE WHEN k.o THEN starts_with(s, k.a || ' ') AND ends_with(s, k.z) AND length(s) > length(k.a) + length(k.z) + 1 ELSE s = k.a END)[1]).l,
    CASE WHEN head IN {among(_HEAD_STARTS)} THEN coalesce({heading(3)}, {heading(2)}, {heading(1)}) END,
    CASE WHEN contains(p, 'is free') AND ({' OR '.join(f'ends_with(s, {text(x)})' for _, x in _ENDS)}) THEN {text(_ENDS[0][0])} END,
    CASE WHEN (word IN {among(GRANT_WORDS)} OR head IN {among(GRANT_HEADS)}) AND starts_with(rest, '|') THEN (list_filter({names}, lambda n: starts_with(rest[2:] || ' ', n.name || ' ') AND regexp_matches(rest[len(n.name) + 2:] || ' ', '{AFTER}'))[1]).letter END,
    CASE WHEN regexp_matches(p, '{_RIGHTS}') THEN '{_LETTERS[last]}' END,
    CASE WHEN begins AND length(rtrim(replace(p, '|', ''))) > 2 THEN '-' ELSE '' END) AS letter FROM headed),
lines AS (SELECT doc_id, any_value(stated) || string_agg(letter, '' ORDER BY i) AS line FROM lettered GROUP BY doc_id, r),
found AS (SELECT doc_id, line, CASE WHEN replace(line, '-', '') = '' THEN '' ELSE concat_ws(',', {hits}) END AS licences FROM lines)
SELECT doc_id, CASE WHEN licences = '' AND contains(line, '{_LETTERS[last]}') THEN '{name}' ELSE licences END AS licences, length(replace(line, '-', ''))::BIGINT AS n_sentences FROM found
"""


ORACLE = _oracle()
