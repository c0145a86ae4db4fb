"""Rules of license signatures, most telling first.

A rule is written over words: lower-case words stand for themselves, ``_`` for any word, ``#`` for a year, ``( | )`` and
``?`` as in regular expressions, ``?`` behind a group or a word. Its keyword is a word that every match holds; a rule is only tried on
texts that have it.

Levels: 1 wording of a grant or an address, 2 a name with its version, 3 a name, 4 a hint.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    level: int
    label: str
    keyword: str
    words: str
    base: bool = False

    def pattern(self) -> str:
        """The rule over numbered words: each word of a text is written `` word:number ``."""
        signs = {"(": "(?:", ")": ")", "|": "|", "?": "?", "_": r"(?: [^ :]+:\d+ )", "#": r"(?: (?:19|20)\d\d:\d+ )"}
        return "".join(signs.get(t) or rf"(?: {t}:\d+ )" for t in _tokens(self.words))

    def most_words(self) -> int:
        return sum(t not in "(|?)" for t in _tokens(self.words))

    def needed(self) -> set[str]:
        """Words that every match holds: those outside of brackets without ``?``."""
        found, depth, all_ = set(), 0, _tokens(self.words)
        for t, after in zip(all_, [*all_[1:], ""], strict=True):
            depth += (t == "(") - (t == ")")
            if not depth and t not in "(|?)_#" and after != "?":
                found.add(t)
        return found


def _tokens(words: str) -> list[str]:
    return re.findall(r"[()|?_#]|[^\s()|?_#]+", words)


#: Phrases whose places are counted, whatever else is found there.
BASE = [
    Rule(3, "cc-by", "cc", "cc by", True),
    Rule(3, "gpl", "license", "general public license", True),
    Rule(4, "reserved", "reserved", "all rights reserved", True),
]

# Wording of grants, warranties and addresses. Columns: label, keyword, words.
_GRANTS = """
mit | charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit | noninfringement | fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
mit | opensource | opensource org (license | licenses) mit
mit-0 | opensource | opensource org (license | licenses) mit 0
isc | disclaims | the author disclaims all warranties with regard to this software
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | neither the name of _ ? _ ? _ ? _ ? _ ? _ ? _ ? nor the names of (its | the) ? contributors may be used to endorse or promote products
bsd-4-clause | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause | opensource | opensource org (license | licenses) bsd 2 clause
bsd-3-clause | opensource | opensource org (license | licenses) bsd 3 clause
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | apache | (https? | www) ? apache org licenses license 2 0
apache-1.1 | apache | (https? | www) ? apache org licenses license 1 1
apache-2.0 | conspicuously | conspicuously offered by you (alone | only)
apache-1.1 | apache | this product includes software developed by the apache (software foundation | group)
gpl-or-later | option | either version (2 | 3 | 2 0 | 3 0) of the license or at your option any later version
gpl | redistribute | this (program | library | software | file) is free software you can redistribute it and or modify it under the terms of the gnu (lesser | library | affero) ? general public license
gpl | warranty | this (program | library) is distributed in the hope that it will be useful but without any warranty
gpl | copy | you should have received a copy of the gnu (lesser | library | affero) ? general public license
gpl-2.0 | gnu | gnu org licenses (old licenses) ? gpl 2 0
gpl-3.0 | gnu | gnu org licenses gpl 3 0
gpl | gnu | gnu org licenses gpl
lgpl | gnu | gnu org licenses (old licenses) ? lgpl
lgpl-2.1 | gnu | gnu org licenses (old licenses) ? lgpl 2 1
lgpl-3.0 | gnu | gnu org licenses lgpl 3 0
agpl-3.0 | gnu | gnu org licenses agpl 3 0
agpl | gnu | gnu org licenses agpl
gfdl | gnu | gnu org licenses fdl
gfdl | document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v ? 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla | mozilla org mpl 2 0
epl-1.0 | eclipse | eclipse org legal epl v10
epl-2.0 | eclipse | eclipse org legal epl (v20 | 2 0)
cddl-1.0 | development | subject to the terms of the common development and distribution license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unencumbered | free and unencumbered software released into the public domain
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | misrepresented | the origin of this software must not be misrepresented
bsl-1.0 | boost | boost org license 1 0
bsl-1.0 | machine | machine executable object code generated by a source language processor
artistic | artistic | opensource org (license | licenses) artistic license
artistic-2.0 | artistic | opensource org (license | licenses) artistic license 2 0
ofl-1.1 | scripts | scripts sil org ofl
psf | python | python software foundation license version 2
ncsa | ncsa | university of illinois ncsa open source license
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
cc0-1.0 | deed | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | domain | dedicated (all copyright | the work) _ ? _ ? _ ? _ ? _ ? _ ? to the public domain
public-domain | domain | (released | placed | dedicated | put) (in | into | to) the public domain
public-domain | domain | (is | are | lies | falls) in the public domain
proprietary | confidential | proprietary and confidential
proprietary | confidential | confidential and proprietary
proprietary | unauthorized | unauthorized (copying | use | reproduction | distribution) _ ? _ ? _ ? _ ? _ ? _ ? is (strictly)? prohibited
proprietary | reproduced | no part of this (publication | book | work | document) may be reproduced
proprietary | permission | may not be (reproduced | copied | redistributed | published | broadcast | rewritten) _ ? _ ? _ ? _ ? _ ? _ ? _ ? without (the)? (prior | express)? (written)? permission
proprietary | consent | without (the)? (prior | express)? (written)? consent of the (copyright)? (owner | holder | publisher | author)
evaluation | evaluation | for evaluation purposes only
non-commercial | commercial | for non commercial (use | purposes) only
non-commercial | noncommercial | for noncommercial (use | purposes) only
non-commercial | commercial | not for commercial use
research-only | research | for research (use | purposes) only
no-derivatives | derivative | no derivative works
""".strip()

# Names with their versions: label, keyword, name, versions.
_VERSIONED = """
apache | apache | apache (software)? license | 1 0, 1 1, 2 0, 2
apache | apache | apache | 1 1, 2 0
mpl | mozilla | mozilla public license | 1 0, 1 1, 2 0
mpl | mpl | mpl | 1 0, 1 1, 2 0
epl | eclipse | eclipse public license | 1 0, 2 0
epl | epl | epl | 1 0, 2 0
cddl | cddl | cddl | 1 0, 1 1
cddl | development | common development and distribution license | 1 0, 1 1
cpl | common | common public license | 0 5, 1 0
ipl | ibm | ibm public license | 1 0
osl | open | open software license | 1 0, 1 1, 2 0, 2 1, 3 0
afl | academic | academic free license | 1 1, 1 2, 2 0, 2 1, 3 0
artistic | artistic | artistic license | 1 0, 2 0
bsl | boost | boost software license | 1 0
ofl | sil | sil open font license | 1 0, 1 1
ofl | ofl | ofl | 1 0, 1 1
eupl | eupl | eupl | 1 0, 1 1, 1 2
eupl | union | european union public (licence | license) | 1 1, 1 2
cecill | cecill | cecill | 1 0, 1 1, 2 0, 2 1
zpl | zope | zope public license | 1 1, 2 0, 2 1
lppl | lppl | lppl | 1 0, 1 2, 1 3
lppl | latex | latex project public license | 1 0, 1 2, 1 3
php | php | php license | 3 0, 3 01
ms-pl | microsoft | microsoft (public | reciprocal) license | 1 0
sspl | server | server side public license | 1
busl | business | business source license | 1 0, 1 1
elastic | elastic | elastic license | 1 0, 2 0
odbl | odbl | odbl | 1 0
odbl | database | open database license | 1 0
odc-by | attribution | open data commons attribution license | 1 0
ogl | government | open government (licence | license) | 1 0, 2 0, 3 0
openrail | openrail | openrail m ? | 1 0
""".strip()

# Names alone: level, label, keyword, words.
_NAMES = """
2 | gpl-2.0 | gplv2 | (gnu)? gplv2
2 | gpl-3.0 | gplv3 | (gnu)? gplv3
2 | lgpl-2.1 | lgplv2 | (gnu)? lgplv2 1
2 | lgpl-3.0 | lgplv3 | (gnu)? lgplv3
2 | agpl-3.0 | agplv3 | (gnu)? agplv3
3 | gpl | gpl | (gnu)? gpl
3 | lgpl | lgpl | (gnu)? lgpl
3 | agpl | agpl | (gnu)? agpl
3 | gfdl | gfdl | gfdl
3 | gfdl | documentation | (gnu)? free documentation license
3 | lgpl | lesser | lesser general public license
3 | lgpl | library | library general public license
3 | agpl | affero | affero general public license
3 | mit | license | (the)? mit license
3 | mit | licence | (the)? mit licence
3 | mit | licensed | licensed under (the)? (terms of the)? mit
3 | mit | license | x11 license
3 | mit | expat | expat license
3 | bsd | bsd | (the)? (modified | simplified | new | original | revised)? bsd (style | like)? license
3 | bsd-2-clause | bsd | bsd 2 clause (license)?
3 | bsd-2-clause | bsd | (2 | two) clause bsd (license)?
2 | bsd-2-clause | simplified | simplified bsd license
3 | bsd-3-clause | bsd | bsd 3 clause (license)?
3 | bsd-3-clause | bsd | (3 | three) clause bsd (license)?
2 | bsd-3-clause | bsd | (new | modified | revised) bsd license
3 | bsd-4-clause | bsd | bsd 4 clause (license)?
3 | bsd-4-clause | bsd | (4 | four) clause bsd (license)?
3 | 0bsd | 0bsd | 0bsd
3 | 0bsd | bsd | zero clause bsd
3 | apache | apache | apache (software)? license
3 | apache | apache | apache licensed
3 | mpl | mozilla | mozilla public license
3 | epl | eclipse | eclipse public license
3 | cddl | cddl | cddl
3 | isc | isc | isc license
3 | zlib | zlib | zlib (libpng)? license
3 | libpng | libpng | libpng license
3 | bsl-1.0 | boost | boost software license
3 | artistic | artistic | artistic license
3 | perl | perl | same terms as perl (itself)?
3 | python | python | python license
3 | psf | psf | psf license
3 | ruby | ruby | ruby license
3 | php | php | php license
3 | openssl | openssl | openssl license
3 | curl | curl | curl license
3 | ncsa | ncsa | ncsa (open source)? license
3 | unlicense | unlicense | (the)? unlicense
3 | wtfpl | wtfpl | wtfpl
3 | beerware | beerware | beerware (license)?
3 | beerware | beer | beer ware license
3 | json | json | json license
3 | postgresql | postgresql | postgresql license
3 | eupl | eupl | eupl
3 | cecill | cecill | cecill (b | c)?
3 | odbl | odbl | odbl
3 | pddl | pddl | pddl
3 | ofl | font | open font license
3 | sspl | sspl | sspl
3 | busl | business | business source license
3 | elastic | elastic | elastic license
3 | commons-clause | clause | commons clause
3 | llama | llama | llama _ ? community license
3 | openrail | openrail | (creativeml | bigscience | bigcode)? openrail (m)?
3 | cc0-1.0 | cc0 | cc0
3 | cc0-1.0 | commons | creative commons zero
3 | cc | commons | creative commons (license)?
3 | cc | commons | creative commons attribution
3 | cc | creativecommons | creativecommons org
4 | public-domain | domain | public domain
4 | reserved | reserved | (some | no) rights reserved
4 | copyright | copyright | copyright (c | ©)? #
4 | copyright | copyrighted | copyrighted (material | work | by)
4 | copyright | © | © (copyright)? #
4 | licensed | licensed | (is | are)? licensed under
4 | licensed | licensed | (is | are)? licensed (to | for | by)
4 | licensed | license | (under | see) (the)? (terms of the)? license
4 | licensed | license | (under | see) (the | this | an | a)? (open source | free software | commercial | proprietary) license
4 | terms | terms | (the)? terms (of use | of service | and conditions)
4 | freeware | freeware | freeware
4 | shareware | shareware | shareware
4 | trademark | trademark | (is | are) (a)? (registered)? trademark of
4 | trademark | trademarks | (are)? (registered)? trademarks of
4 | patent | patent | patent pending
4 | dual | dual | dual licensed
""".strip()


def _split(table: str) -> list[list[str]]:
    """Columns are parted by `` | `` with a blank at both sides outside of brackets."""
    rows = []
    for line in table.splitlines():
        cells, depth = [""], 0
        for t in re.findall(r" \| |.", line):
            depth += (t == "(") - (t == ")")
            if t == " | " and not depth:
                cells.append("")
            else:
                cells[-1] += t
        rows.append([c.strip() for c in cells])
    return rows


def _version(number: str) -> str:
    """A version's number, whatever stands before it; ``v2.1`` is the words ``v2 1``."""
    return f"((version | v | ver)? {number} | v{number})"


def _creative_commons() -> list[Rule]:
    """Names, abbreviations and addresses of the six licenses in each of their versions and without one."""
    spelled = {"by": "attribution", "nc": "(noncommercial | non commercial)", "sa": "(sharealike | share alike)", "nd": "(noderivatives | noderivs | no derivatives | no derivs)"}
    out = []
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        long = " ".join(spelled[p] for p in parts.split())
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0", ""):
            label = "cc-" + "-".join(parts.split()) + (f"-{version.replace(' ', '.')}" if version else "")
            level = 2 if version else 3
            if parts != "by" or version:  # the bare name of the first is a base phrase
                out.append(Rule(level, label, "cc", f"cc {parts} {version}"))
            out.append(Rule(level, label, "commons", f"creative commons {long} {version} (international | unported | generic)? (public)? (license)?"))
            if version:
                out.append(Rule(1, label, "creativecommons", f"creativecommons org licenses {parts} {version}"))
    return out


def _gnu() -> list[Rule]:
    out = []
    for label, kind, versions in (("gpl", "", ("1", "2", "3")), ("lgpl", "(lesser | library)", ("2", "2 1", "3")), ("agpl", "affero", ("1", "3"))):
        for v in versions:
            number = v.replace(" ", ".") if " " in v else f"{v}.0"
            end = "" if " " in v else "(0)?"
            later = "(or (at your option)? (any)? later | or newer)"
            for suffix, tail in (("", ""), ("-or-later", later), ("-only", "only")):
                out.append(Rule(2, f"{label}-{number}{suffix}", "license", f"(gnu)? {kind} general public license {_version(v)} {end} {tail}"))
                out.append(Rule(2, f"{label}-{number}{suffix}", label, f"(gnu)? {label} {_version(v)} {end} {tail}"))
    return out


def _named() -> list[Rule]:
    out = [Rule(1, label, keyword, words) for label, keyword, words in _split(_GRANTS)]
    for label, keyword, name, versions in _split(_VERSIONED):
        for v in versions.split(", "):
            out.append(Rule(2, f"{label}-{v.replace(' ', '.')}" + ("" if " " in v else ".0"), keyword, f"{name} {_version(v)}"))
    return out + [Rule(int(level), label, keyword, words) for level, label, keyword, words in _split(_NAMES)]


def _ordered(rules: list[Rule]) -> list[Rule]:
    for r in rules:
        if r.keyword not in r.needed():
            raise ValueError(f"{r}: not every match holds the keyword")
    return sorted(rules, key=lambda r: r.level)  # a stable order: inside a level as written


#: All rules, by level.
RULES = _ordered(BASE + _named() + _gnu() + _creative_commons())
