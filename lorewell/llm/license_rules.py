"""Licence detection by ordered signature rules.

A text is its words: lower-cased A-Z, runs of ASCII letters and digits and of
anything beyond ASCII.  Rules are regular expressions over the words joined by
blanks, written by hand: names of licences, short forms, SPDX identifiers, and
sentences of licences and of their notices.  Names and short forms are looked for
alone and in wordings of notices (each wording with each name is one rule).  Each alternative of a rule has its own keywords, read
off the expression.  A rule runs on a document only if all keywords of one
alternative are among the document's words, which numpy tells for a whole batch at once, first
by one rare word of each set, so few documents ever meet a regular expression.

A match is an interval of words.  One that lies inside another of higher
priority, or of equal priority and greater length, is suppressed: "gnu lesser
general public license" also has a general public licence in it, and a bare name
lies in the notice around it.
"""

from __future__ import annotations

import re
from functools import cache
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import kernel

# The base phrases of the contract.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_LICENSE = "licen[sc]e"
# label, name as a regular expression over words
NAMES = (
    ("mit", f"(?:mit|expat|x11) {_LICENSE}"),
    ("apache-2", f"apache (?:software )?{_LICENSE}(?: version)? 2(?: 0)?"),
    ("apache-1.1", f"apache (?:software )?{_LICENSE}(?: version)? 1 1"),
    ("apache-1.0", f"apache (?:software )?{_LICENSE}(?: version)? 1 0"),
    ("gpl-3.0", f"gnu (?:general public {_LICENSE}|gpl)(?: version| v)? ?v?3(?: 0)?"),
    ("gpl-2.0", f"gnu (?:general public {_LICENSE}|gpl)(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-1.0", f"gnu (?:general public {_LICENSE}|gpl)(?: version| v)? ?v?1(?: 0)?"),
    ("gpl", f"gnu general public {_LICENSE}"),
    ("lgpl-3.0", f"gnu (?:lesser|library) general public {_LICENSE}(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl-2.1", f"gnu (?:lesser|library) general public {_LICENSE}(?: version| v)? ?v?2 1"),
    ("lgpl-2.0", f"gnu (?:lesser|library) general public {_LICENSE}(?: version| v)? ?v?2(?: 0)?"),
    ("lgpl", f"gnu (?:lesser|library) general public {_LICENSE}"),
    ("agpl-3.0", f"gnu affero general public {_LICENSE}(?: version| v)? ?v?3(?: 0)?"),
    ("agpl", f"(?:gnu )?affero general public {_LICENSE}"),
    ("gfdl-1.3", f"gnu free documentation {_LICENSE}(?: version)? 1 3"),
    ("gfdl-1.2", f"gnu free documentation {_LICENSE}(?: version)? 1 2"),
    ("gfdl", f"gnu free documentation {_LICENSE}"),
    ("bsd-2-clause", f"(?:2|two) clause bsd(?: {_LICENSE})?|simplified bsd {_LICENSE}|freebsd {_LICENSE}"),
    ("bsd-3-clause", f"(?:3|three) clause bsd(?: {_LICENSE})?|(?:new|revised|modified) bsd {_LICENSE}"),
    ("bsd-4-clause", f"(?:4|four) clause bsd(?: {_LICENSE})?|original bsd {_LICENSE}"),
    ("bsd", f"bsd(?: style)? {_LICENSE}"),
    ("0bsd", f"(?:0|zero) clause bsd(?: {_LICENSE})?"),
    ("isc", f"isc {_LICENSE}"),
    ("mpl-2.0", f"mozilla public {_LICENSE}(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", f"mozilla public {_LICENSE}(?: version| v)? ?1 1"),
    ("mpl", f"mozilla public {_LICENSE}"),
    ("epl-2.0", f"eclipse public {_LICENSE}(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", f"eclipse public {_LICENSE}(?: version| v)? ?1(?: 0)?"),
    ("cddl-1.0", f"common development and distribution {_LICENSE}(?: version| v)? ?1(?: 0)?"),
    ("cpl-1.0", f"common public {_LICENSE}(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", f"european union public {_LICENSE}(?: version| v)? ?1 2"),
    ("eupl-1.1", f"european union public {_LICENSE}(?: version| v)? ?1 1"),
    ("artistic-2.0", f"artistic {_LICENSE}(?: version)? 2(?: 0)?"),
    ("artistic", f"artistic {_LICENSE}"),
    ("bsl-1.0", f"boost software {_LICENSE}(?: version)? ?1(?: 0)?"),
    ("zlib", f"zlib(?: libpng)? {_LICENSE}"),
    ("wtfpl", f"do what the fuck you want to public {_LICENSE}|wtfpl"),
    ("unlicense", "the unlicense"),
    ("ofl-1.1", f"(?:sil )?open font {_LICENSE}(?: version)? ?1 1"),
    ("ms-pl", f"microsoft public {_LICENSE}"),
    ("ms-rl", f"microsoft reciprocal {_LICENSE}"),
    ("postgresql", f"postgresql {_LICENSE}"),
    ("python-2.0", f"python(?: software foundation)? {_LICENSE}(?: version)? ?2"),
    ("php-3.01", f"php {_LICENSE}(?: version)? ?3 01"),
    ("ruby", f"ruby(?: s)? {_LICENSE}"),
    ("openssl", f"openssl {_LICENSE}"),
    ("odbl", f"open database {_LICENSE}|odbl"),
    ("odc-by", f"open data commons attribution {_LICENSE}"),
    ("pddl", "public domain dedication and licen[sc]e"),
    ("cc0-1.0", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: \\d \\d)?"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: \\d \\d)?"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: \\d \\d)?"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: \\d \\d)?"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)(?: \\d \\d)?"),
    ("cc-by", "(?:creative commons attribution|cc by)(?: \\d \\d)?"),
    ("public-domain", "(?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved"),
)
# label, short form that stands for the name in any wording and alone
SHORT = (
    ("apache-2", "apache v?2(?: 0)?"),
    ("gpl-3.0", "gpl ?v?3(?: 0)?"),
    ("gpl-2.0", "gpl ?v?2(?: 0)?"),
    ("lgpl-3.0", "lgpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "lgpl ?v?2 1"),
    ("agpl-3.0", "agpl ?v?3(?: 0)?"),
    ("mpl-2.0", "mpl ?v?2(?: 0)?"),
    ("bsd-2-clause", "bsd (?:2|two) clause"),
    ("bsd-3-clause", "bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd (?:4|four) clause"),
)
# label, SPDX identifier as words
SPDX = (
    ("mit", "mit|x11"),
    ("apache-2", "apache 2 0"),
    ("apache-1.1", "apache 1 1"),
    ("apache-1.0", "apache 1 0"),
    ("gpl-3.0", "gpl 3 0"),
    ("gpl-2.0", "gpl 2 0"),
    ("gpl-1.0", "gpl 1 0"),
    ("lgpl-3.0", "lgpl 3 0"),
    ("lgpl-2.1", "lgpl 2 1"),
    ("lgpl-2.0", "lgpl 2 0"),
    ("agpl-3.0", "agpl 3 0"),
    ("gfdl-1.3", "gfdl 1 3"),
    ("gfdl-1.2", "gfdl 1 2"),
    ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"),
    ("0bsd", "0bsd"),
    ("isc", "isc"),
    ("mpl-2.0", "mpl 2 0"),
    ("mpl-1.1", "mpl 1 1"),
    ("epl-2.0", "epl 2 0"),
    ("epl-1.0", "epl 1 0"),
    ("cddl-1.0", "cddl 1 0"),
    ("cpl-1.0", "cpl 1 0"),
    ("eupl-1.2", "eupl 1 2"),
    ("eupl-1.1", "eupl 1 1"),
    ("artistic-2.0", "artistic 2 0"),
    ("bsl-1.0", "bsl 1 0"),
    ("zlib", "zlib"),
    ("wtfpl", "wtfpl"),
    ("unlicense", "unlicense"),
    ("ofl-1.1", "ofl 1 1"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("postgresql", "postgresql"),
    ("python-2.0", "python 2 0"),
    ("php-3.01", "php 3 01"),
    ("ruby", "ruby"),
    ("openssl", "openssl"),
    ("odbl", "odbl 1 0"),
    ("odc-by", "odc by 1 0"),
    ("pddl", "pddl 1 0"),
    ("cc0-1.0", "cc0 1 0"),
    ("cc-by-nc-nd", "cc by nc nd \\d \\d"),
    ("cc-by-nc-sa", "cc by nc sa \\d \\d"),
    ("cc-by-nc", "cc by nc \\d \\d"),
    ("cc-by-nd", "cc by nd \\d \\d"),
    ("cc-by-sa", "cc by sa \\d \\d"),
    ("cc-by", "cc by \\d \\d"),
)
# label, sentence of the licence or of its notice
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("cc0-1.0", "creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-sa", "creativecommons org licenses by sa"),
    ("cc-by", "creativecommons org licenses by"),
    ("apache-2", "apache org licenses license 2 0"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit-0", "mit no attribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author and contributors|author) as is"),
    ("bsd-3-clause", "neither the names? of (?:the )?(?:copyright holders?|university|author|organization|company) nor the names of (?:its|their|any) contributors may be used to endorse or promote"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-patent", "bsd 2 clause plus patent license"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl-1.0", "gnu general public license version 1 february 1989"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("gpl-2.0", "general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0", "general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2.0", "general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", "general public license version 3 as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|library|package|software)"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "www gnu org licenses gpl(?: html)?"),
    ("gpl-2.0", "www gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "www gnu org licenses gpl 3 0"),
    ("gpl-exception", "as a special exception the copyright holders? of this (?:library|program) give you permission to link this (?:library|program)"),
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("lgpl-2.0", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", "lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.0", "library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|package|software)"),
    ("lgpl", "www gnu org licenses lgpl(?: html)?"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", "affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", "www gnu org licenses agpl(?: html)?"),
    ("agpl-1.0", "affero general public license version 1 march 2002"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2.0", "you can obtain one at https? (?:www )?mozilla org mpl 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file"),
    ("npl-1.1", "the contents of this file are subject to the netscape public license version 1 1"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.1", "common development and distribution license(?: cddl)? version 1 1"),
    ("eupl-1.2", "licen[sc]ed under the eupl(?: version)? 1 2"),
    ("eupl-1.1", "licen[sc]ed under the eupl(?: version)? 1 1"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "this (?:library|program|module|package) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("bsl-1.0", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer"),
    ("bsl-1.0", "www boost org license 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "the png reference library is supplied as is"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "for more information please refer to https? unlicense org"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "the fonts and derivatives however cannot be released under any other type of license"),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python-2.0", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("python-2.0", "psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("php-3.01", "this product includes php software freely available from"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", "this product includes cryptographic software written by eric young"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("json", "the software shall be used for good not evil"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ncsa", "university of illinois ncsa open source license"),
    ("w3c", "w3c software (?:notice and license|and document notice and license)"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("zpl-2.1", "zope public license zpl version 2 1"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("qpl-1.0", "the q public license version 1 0"),
    ("apsl-2.0", "apple public source license version 2 0"),
    ("lppl-1.3c", "latex project public license either version 1 3c? of this license"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("cecill-2.1", "cecill free software license agreement version 2 1"),
    ("cecill", "this software is governed by the cecill(?: b| c)? license under french law"),
    ("sspl-1.0", "server side public license version 1"),
    ("busl-1.1", "business source license 1 1"),
    ("elastic-2.0", "elastic license (?:version )?2 0"),
    ("commons-clause", "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("polyform-nc", "polyform noncommercial license 1 0 0"),
    ("parity", "the parity public license"),
    ("blueoak-1.0", "blue oak model license"),
    ("mulan-psl-2", "mulan psl v2"),
    ("vim", "vim license"),
    ("openrail", "(?:creative ml|bigscience|responsible ai) open ?rail m?"),
    ("llama", "llama (?:2|3|3 1|3 2|3 3) community license agreement"),
    ("odbl", "you are free to share to create and to adapt the database as long as you"),
    ("odbl", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org licenses by"),
    ("pddl", "opendatacommons org licenses pddl"),
    ("cdla-permissive", "community data license agreement permissive"),
    ("cdla-sharing", "community data license agreement sharing"),
    ("ogl-uk", "contains public sector information licensed under the open government licence"),
    ("ogl-uk", "open government licence v3 0"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "no copyright waived all of his or her rights to the work worldwide under copyright law"),
    ("public-domain", "creativecommons org publicdomain mark"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share ?alike \\d \\d (?:international|unported|generic) license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution non ?commercial share ?alike \\d \\d (?:international|unported|generic) license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution non ?commercial no ?derivatives \\d \\d (?:international|unported|generic) license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non ?commercial \\d \\d (?:international|unported|generic) license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution no ?derivatives \\d \\d (?:international|unported|generic) license"),
    ("cc-by", "this work is licensed under a creative commons attribution \\d \\d (?:international|unported|generic) license"),
    ("proprietary", "this (?:software|document|file) is confidential and proprietary"),
    ("proprietary", "unauthorized (?:copying|reproduction|use) of this (?:file|software|document) (?:via any medium )?is strictly prohibited"),
    ("proprietary", "no part of this (?:publication|document|work|book) may be reproduced"),
    ("proprietary", "may not be (?:reproduced|copied|redistributed|used) without (?:the )?(?:prior )?(?:written|express) permission"),
)
# wording with the place of the name, priority, score
WORDINGS = (
    ("(?:is |are )?(?:dual )?licen[sc]ed (?:to you )?under (?:the terms of )?(?:the |a |an )?{}", 30, 1.0),
    ("(?:is |are )?released under (?:the terms of )?(?:the |a |an )?{}", 30, 1.0),
    ("(?:is |are )?distributed under (?:the terms of )?(?:the |a |an )?{}", 30, 1.0),
    ("(?:is |are )?(?:made )?available under (?:the terms of )?(?:the |a |an )?{}", 30, 0.95),
    ("(?:is |are )?(?:published|covered|governed) (?:under|by) (?:the terms of )?(?:the |a |an )?{}", 25, 0.9),
    ("(?:subject to|see) (?:the terms of )?(?:the |a |an )?{}", 20, 0.7),
    ("spdx licen[sc]e identifier (?:the )?{}", 35, 1.0),
    ("{}", 10, 0.6),
)


class Rule(NamedTuple):
    name: str
    label: str
    pattern: re.Pattern
    keywords: frozenset[frozenset[str]]
    priority: int
    score: float


def _strings(parsed) -> set[str]:
    """Strings of a parsed expression: every alternative and option; what may repeat at will, as often as it must."""
    out = {""}
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            more = {chr(arg)}
        elif kind == "IN":  # the rules have sets of letters and \\d, of which a keyword can't be told
            more = {chr(x) if str(o) == "LITERAL" else "\0" for o, x in arg}
        elif kind == "BRANCH":
            more = set().union(*(_strings(x) for x in arg[1]))
        elif kind == "SUBPATTERN":
            more = _strings(arg[3])
        elif kind == "MAX_REPEAT":
            low, high, inner = arg
            more = {""} if low == 0 else _strings(inner)
            if (low, high) == (0, 1):
                more |= _strings(inner)
        else:
            raise ValueError(f"no keywords of {kind}")
        out = {a + b for a in out for b in more}
    return out


@cache
def keyword_sets(expression: str) -> frozenset[frozenset[str]]:
    """Smallest sets of words of which any match of the expression has one whole set."""
    sets = {frozenset(w for w in x.split() if "\0" not in w) for x in _strings(_parser.parse(expression))}
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(left: frozenset, right: frozenset) -> frozenset[frozenset[str]]:
    sets = {a | b for a in left for b in right}
    return frozenset(s for s in sets if not any(t < s for t in sets))


@cache
def rules() -> tuple[Rule, ...]:
    """Names and short forms in each wording, SPDX identifiers also within expressions, and signatures."""
    out = []

    def add(name: str, label: str, wording: str, form: str, priority: int, score: float) -> None:
        pattern = re.compile(rf"(?:^|(?<= )){wording.format(f'(?:{form})')}(?= |$)")
        words = _both(keyword_sets(wording.format("")), keyword_sets(form))
        out.append(Rule(name, label, pattern, words, priority, score))

    for k, forms in enumerate((NAMES, SHORT)):
        for label, form in forms:
            for w, (wording, priority, score) in enumerate(WORDINGS):
                add(f"{label}/{w}/{k}", label, wording, form, priority, score)
    ids = "|".join(f"(?:{form})" for _, form in SPDX)
    before = f"(?:(?:{ids})(?: only| or later)? (?:and|or) )*"
    for label, form in SPDX:
        add(f"{label}/spdx", label, "spdx licen[sc]e identifier " + before + "(?P<id>{})", form, 40, 1.0)
    for k, (label, form) in enumerate(SIGNATURES):
        add(f"{label}/signature/{k}", label, "{}", form, 30, 1.0)
    return tuple(out)


def _word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = kernel.utf8(pa.array(words, pa.string()))
    return kernel.RollingHash(data).ranges(offsets[:-1], offsets[1:])


def suppressed(intervals: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Which of the intervals [start, end) lie inside another that goes before them.

    Before goes the higher priority, then the greater length, then the earlier
    in the list.  A sweep by start with a running maximum of ends a priority.
    """
    n = len(intervals)
    start, end = intervals[:, 0], intervals[:, 1]
    out = np.zeros(n, bool)
    order = np.lexsort((np.arange(n), -(end - start), -priority, start))
    reach: dict[int, int] = {}  # of each priority, the furthest end so far
    for i in order:
        out[i] = any(p >= priority[i] and e >= end[i] for p, e in reach.items())
        reach[priority[i]] = max(reach.get(priority[i], -1), end[i])
    # equal start and lower priority was handled by the order; equal start, higher end and priority comes first too
    return out


def detect(text: str, active: list[Rule]) -> list[tuple[str, int, int, float]]:
    """(label, first word, end word, score) of the matches of these rules that stay, over words joined by blanks."""
    found = []
    for r in active:
        for m in r.pattern.finditer(text):
            start, end = m.span("id" if r.pattern.groups else 0)  # of an SPDX expression each identifier by itself
            found.append((r.label, start, end, r.score, r.priority))
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
    first = np.searchsorted(blanks, [f[1] for f in found]).tolist()
    last = np.searchsorted(blanks, [f[2] for f in found]).tolist()
    found = [(f[0], a, b + 1, *f[3:]) for f, a, b in zip(found, first, last)]
    gone = suppressed(np.array([f[1:3] for f in found]), np.array([f[4] for f in found]))
    return [f[:4] for f, g in zip(found, gone) if not g]


class _Scanner:
    def __init__(self):
        self.rules = rules()
        words = sorted({k for r in self.rules for s in r.keywords for k in s})
        bit = {w: i for i, w in enumerate(words)}
        hashes = _word_hashes(words)
        order = np.argsort(hashes)
        self.keys, self.bit = hashes[order], order
        sets = sorted({s for r in self.rules for s in r.keywords}, key=sorted)
        number = {s: i for i, s in enumerate(sets)}
        # most sets hold everyday words too; a text matters only if it has some set's longest word
        self.anchors = np.unique(_word_hashes(sorted({max(s, key=lambda w: (len(w), w)) for s in sets})))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.anchors >> np.uint64(44)).astype(np.int64)] = True
        self.needs = np.zeros((len(sets), len(words)), np.float32)
        for i, s in enumerate(sets):
            self.needs[i, [bit[k] for k in s]] = 1
        self.rules_of = [[] for _ in sets]
        for i, r in enumerate(self.rules):
            for s in r.keywords:
                self.rules_of[number[s]].append(i)
        self.base = [(_word_hashes(p.split()), label) for p, label in BASE]

    def batch(self, data: np.ndarray, offsets: np.ndarray):
        w = kernel.Words(data, offsets, kernel.ALNUM, lower=True)
        h, n = w.hashes(), len(offsets) - 1
        ends = w.first[1:]
        owner = w.owner()
        n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        base_labels: list[set] = [set() for _ in range(n)]
        for phrase, label in self.base:
            at = np.flatnonzero(h == phrase[0])
            at = at[at + len(phrase) <= ends[owner[at]]]
            for k in range(1, len(phrase)):
                at = at[h[at + k] == phrase[k]]
            row = owner[at]
            place = at - w.first[row]
            np.add.at(n_base, row, 1)
            for r, p in zip(row.tolist(), place.tolist()):
                base_labels[r].add(label)
                first[r] = p if first[r] < 0 else min(first[r], p)
                last[r] = max(last[r], p)
        anchored = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.anchors, h[anchored]), len(self.anchors) - 1)
        rows = np.unique(owner[anchored[self.anchors[at] == h[anchored]]])
        mine = np.flatnonzero(np.isin(owner, rows))
        at = np.minimum(np.searchsorted(self.keys, h[mine]), len(self.keys) - 1)
        real = self.keys[at] == h[mine]
        has = np.zeros((len(rows), len(self.keys)), np.float32)
        has[np.searchsorted(rows, owner[mine[real]]), self.bit[at[real]]] = 1
        full = (has @ self.needs.T) >= self.needs.sum(1)
        labels = [set(x) for x in base_labels]
        score = np.where(n_base > 0, 1.0, 0.0)
        for k in np.flatnonzero(full.any(1)):
            r = rows[k]
            a, b = w.first[r], w.first[r + 1]
            raw = w.data[offsets[r] : offsets[r + 1]].copy()
            raw[~kernel.ALNUM[raw]] = 0x20
            text = " ".join(raw.tobytes().decode("utf-8").split(" ")) if b > a else ""
            text = re.sub(" +", " ", text).strip(" ")
            ready = sorted({i for n_set in np.flatnonzero(full[k]) for i in self.rules_of[n_set]})
            for label, _, _, s in detect(text, [self.rules[i] for i in ready]):
                labels[r].add(label)
                score[r] = max(score[r], s)
        return w.count, n_base, first, last, base_labels, labels, score


def _scan(batches):
    scanner = _Scanner()
    for batch in batches:
        data, offsets = kernel.utf8(batch["_t"])
        for a, b in kernel.passes(offsets):
            n_words, n_base, first, last, base, labels, score = scanner.batch(
                data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_id"].slice(a, b - a),
                    pa.array(n_words.astype(np.int64)),
                    pa.array(n_base),
                    pa.array(first.astype(np.int64), mask=first < 0),
                    pa.array(last.astype(np.int64), mask=last < 0),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(score),
                ],
                ["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named in each text.

    Returns per row ``id_col``, n_words, n_base, first_word, last_word,
    base_labels, labels and score (that of the surest match, 1 with a base
    phrase, 0 without any match).  Null and empty texts have no words and no
    labels.  Repeated rows give equal rows; an empty table an empty result;
    other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .mapInArrow(
            _scan,
            f"_id {kind}, n_words long, n_base long, first_word long, last_word long, "
            "base_labels string, labels string, score double",
        )
        .withColumnRenamed("_id", id_col)
    )
