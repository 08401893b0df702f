"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

Texts are reduced to lower-case words (runs of digits, letters a-z and non-ASCII characters), joined by one space.
Each rule is a regular expression over that form with a keyword that all its alternatives hold; it runs only where its
keyword is among the words. About 180 written entries (names, identifiers, sentences, links) make some 450 rules: a name
gives one for each of its versions, after words of grant and alone, and an identifier one as a tag and one in passing.
Detections are taken in the order of priority (then the longer one, then the earlier rule): one stays unless one taken
before lies inside its interval or holds it. The three base phrases are reported at all their places and are never
suppressed.

Null or empty text: no words, no labels, score 0, null positions. Repeated rows each give a row; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_set, id_text

#: Phrase and label.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Hand-written signatures: label, keyword, priority class, expression. {v} in a label takes the expression's versions.
#: Classes: identifier, title, text, link, mention - see PRIORITY.
FAMILIES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    # label, keyword, names as they stand in running text (alternatives), versions
    ("apache", "apache", r"apache(?: software)? licen[cs]es?", ("1 0", "1 1", "2 0", "2", "")),
    ("gpl", "public", r"gnu general public licen[cs]e|general public licen[cs]e", ("1", "2", "2 0", "3", "3 0", "")),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", ("2 1", "3", "3 0", "")),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e", ("2", "2 0", "")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("1", "3", "3 0", "")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3", "")),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ("1 0", "1 1", "2 0", "")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ("1 0", "2 0", "")),
    ("eupl", "european", r"european union public licen[cs]e", ("1 1", "1 2", "")),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", ("1 0", "1 1", "")),
    ("cpl", "common", r"common public licen[cs]e", ("1 0", "")),
    ("artistic", "artistic", r"artistic licen[cs]e", ("1 0", "2 0", "")),
    ("boost", "boost", r"boost software licen[cs]e", ("1 0", "")),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", ("1 0", "1 1", "")),
    ("odbl", "database", r"open database licen[cs]e", ("1 0", "")),
    ("odc-by", "attribution", r"open data commons attribution licen[cs]e", ("1 0", "")),
    ("osl", "open", r"open software licen[cs]e", ("2 1", "3 0", "")),
    ("afl", "academic", r"academic free licen[cs]e", ("2 1", "3 0", "")),
    ("ecl", "educational", r"educational community licen[cs]e", ("1 0", "2 0", "")),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ("",)),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[cs]e", ("",)),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ("",)),
    ("isc", "isc", r"isc licen[cs]e", ("",)),
    ("mit", "mit", r"mit(?: x11| expat)? licen[cs]e", ("",)),
    ("x11", "x11", r"x11 licen[cs]e", ("",)),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised )?bsd licen[cs]e|bsd style licen[cs]e", ("",)),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?", ("",)),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?", ("",)),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?", ("",)),
    ("python", "python", r"python software foundation licen[cs]e", ("2", "")),
    ("python", "psf", r"psf licen[cs]e", ("2", "")),
    ("php", "php", r"php licen[cs]e", ("3 0", "3 01", "")),
    ("ruby", "ruby", r"ruby licen[cs]e", ("",)),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", ("",)),
    ("openssl", "openssl", r"openssl licen[cs]e", ("",)),
    ("unlicense", "unlicense", r"the unlicense", ("",)),
    ("wtfpl", "wtfpl", r"wtfpl", ("2", "")),
    ("upl", "universal", r"universal permissive licen[cs]e", ("1 0", "")),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?", ("1 1", "2 0", "2 1", "")),
    ("cc0", "cc0", r"cc0", ("1 0", "")),
    ("cc0", "zero", r"creative commons zero", ("1 0", "")),
    ("cc-by", "attribution", r"creative commons attribution(?: licen[cs]e)?", ("2 0", "2 5", "3 0", "4 0", "")),
    ("cc-by-sa", "sharealike", r"creative commons attribution sharealike(?: licen[cs]e)?", ("2 0", "2 5", "3 0", "4 0", "")),
    ("cc-by-nd", "noderivatives", r"creative commons attribution noderivatives(?: licen[cs]e)?", ("3 0", "4 0", "")),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial(?: licen[cs]e)?", ("2 0", "3 0", "4 0", "")),
    ("cc-by-nc-sa", "noncommercial", r"creative commons attribution noncommercial sharealike(?: licen[cs]e)?", ("2 0", "3 0", "4 0", "")),
    ("cc-by-nc-nd", "noncommercial", r"creative commons attribution noncommercial noderivatives(?: licen[cs]e)?", ("3 0", "4 0", "")),
    ("aal", "assurance", r"attribution assurance licen[cs]e", ("",)), ("apl", "adaptive", r"adaptive public licen[cs]e", ("",)), ("apsl", "apple", r"apple public source licen[cs]e", ("",)),
    ("beerware", "beerware", r"beerware licen[cs]e|beerware", ("",)), ("bittorrent", "bittorrent", r"bittorrent open source licen[cs]e", ("",)), ("blueoak", "oak", r"blue oak model licen[cs]e", ("",)),
    ("busl", "business", r"business source licen[cs]e", ("",)), ("catosl", "trusted", r"computer associates trusted open source licen[cs]e", ("",)),
    ("cdla", "community", r"community data licen[cs]e agreement(?: permissive| sharing)?", ("",)), ("commons-clause", "clause", r"commons clause(?: licen[cs]e)?", ("",)),
    ("cpal", "attribution", r"common public attribution licen[cs]e", ("",)), ("cua-opl", "cua", r"cua office public licen[cs]e", ("",)), ("curl", "curl", r"curl licen[cs]e", ("",)),
    ("efl", "eiffel", r"eiffel forum licen[cs]e", ("",)), ("elastic", "elastic", r"elastic licen[cs]e", ("",)), ("entessa", "entessa", r"entessa public licen[cs]e", ("",)),
    ("fair", "fair", r"fair licen[cs]e", ("",)), ("frameworx", "frameworx", r"frameworx(?: open)? licen[cs]e", ("",)), ("free-art", "art", r"free art licen[cs]e", ("",)),
    ("freetype", "freetype", r"freetype(?: project)? licen[cs]e", ("",)), ("hippocratic", "hippocratic", r"hippocratic licen[cs]e", ("",)),
    ("hpnd", "historical", r"historical permission notice and disclaimer", ("",)), ("ibm-pl", "ibm", r"ibm public licen[cs]e", ("",)), ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", ("",)),
    ("info-zip", "zip", r"info zip licen[cs]e", ("",)), ("intel", "intel", r"intel open source licen[cs]e", ("",)), ("ipa", "ipa", r"ipa font licen[cs]e", ("",)), ("json", "json", r"json licen[cs]e", ("",)),
    ("lppl", "latex", r"latex project public licen[cs]e", ("",)), ("libpng", "libpng", r"libpng licen[cs]e", ("",)), ("lucent", "lucent", r"lucent public licen[cs]e", ("",)),
    ("miros", "miros", r"miros licen[cs]e", ("",)), ("motosoto", "motosoto", r"motosoto open source licen[cs]e", ("",)), ("mulan", "mulan", r"mulan permissive software licen[cs]e", ("",)),
    ("multics", "multics", r"multics licen[cs]e", ("",)), ("nasa", "nasa", r"nasa open source agreement", ("",)), ("naumen", "naumen", r"naumen public licen[cs]e", ("",)),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", ("",)), ("netscape", "netscape", r"netscape public licen[cs]e", ("",)),
    ("ngpl", "nethack", r"nethack general public licen[cs]e", ("",)), ("nokia", "nokia", r"nokia open source licen[cs]e", ("",)), ("nposl", "profit", r"non profit open software licen[cs]e", ("",)),
    ("oclc", "oclc", r"oclc research public licen[cs]e", ("",)), ("ogl", "government", r"open government licen[cs]e", ("",)), ("oldap", "openldap", r"openldap public licen[cs]e", ("",)),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m| s| d)?(?: licen[cs]e)?", ("",)), ("pddl", "dedication", r"public domain dedication and licen[cs]e", ("",)),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|free trial|shield|strict) licen[cs]e", ("",)), ("prosperity", "prosperity", r"prosperity public licen[cs]e", ("",)),
    ("qpl", "q", r"q public licen[cs]e", ("",)), ("ricoh", "ricoh", r"ricoh source code public licen[cs]e", ("",)), ("rpl", "reciprocal", r"reciprocal public licen[cs]e", ("",)),
    ("sendmail", "sendmail", r"sendmail(?: open source)? licen[cs]e", ("",)), ("simpl", "simple", r"simple public licen[cs]e", ("",)), ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", ("",)),
    ("spl", "sun", r"sun public licen[cs]e", ("",)), ("sspl", "server", r"server side public licen[cs]e", ("",)), ("vim", "vim", r"vim licen[cs]e", ("",)),
    ("vovida", "vovida", r"vovida software licen[cs]e", ("",)), ("w3c", "w3c", r"w3c software(?: notice and| and document)? licen[cs]e", ("",)),
    ("watcom", "watcom", r"sybase open watcom public licen[cs]e", ("",)), ("wxwindows", "wxwindows", r"wxwindows library licen[cs]e", ("",)), ("xnet", "xnet", r"xnet licen[cs]e", ("",)),
    ("zpl", "zope", r"zope public licen[cs]e", ("",)),
)

#: Spellings of identifiers, as words.
IDENTIFIERS: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "apache", "apache 2 0"), ("mit", "mit", "mit"), ("isc", "isc", "isc"), ("bsd-2-clause", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3 clause"), ("gpl-2.0", "gpl", "gpl 2 0(?: only| or later)?"), ("gpl-3.0", "gpl", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", "lgpl 2 1(?: only| or later)?"), ("lgpl-3.0", "lgpl", "lgpl 3 0(?: only| or later)?"), ("agpl-3.0", "agpl", "agpl 3 0(?: only| or later)?"),
    ("mpl-2.0", "mpl", "mpl 2 0"), ("epl-2.0", "epl", "epl 2 0"), ("cc0-1.0", "cc0", "cc0 1 0"), ("unlicense", "unlicense", "unlicense"),
    ("cc-by-4.0", "cc", "cc by 4 0"), ("cc-by-3.0", "cc", "cc by 3 0"), ("cc-by-sa-4.0", "cc", "cc by sa 4 0"), ("cc-by-sa-3.0", "cc", "cc by sa 3 0"),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0"), ("cc-by-nd-4.0", "cc", "cc by nd 4 0"), ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0"), ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0"),
    ("zlib", "zlib", "zlib"), ("boost-1.0", "bsl", "bsl 1 0"), ("artistic-2.0", "artistic", "artistic 2 0"), ("ofl-1.1", "ofl", "ofl 1 1"), ("odbl-1.0", "odbl", "odbl 1 0"),
)

#: Sentences out of licence texts and notices.
TEXTS: tuple[tuple[str, str, str], ...] = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "hope", "is distributed in the hope that it will be useful but without any warranty"),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "this work is in the public domain"),
    ("reserved", "reserved", "(?:some|no) rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)"),
    ("proprietary", "permission", "may not be (?:reproduced|copied|distributed)(?: .{1,60})? without (?:prior |written |prior written |express )?permission"),
    ("non-commercial", "commercial", "for non commercial (?:use|purposes) only|not for commercial use"),
    ("research-only", "research", "for research (?:use|purposes) only"),
    ("copyright", "copyright", "copyright (?:c |© )?(?:19|20)[0-9][0-9]"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", "shall be included in all copies or substantial portions of the software"),
    ("mit", "liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("isc", "appear", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "fee", "modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "incidental", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "modification", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "derived", "to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "agreed", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("apache-2.0", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", "patent", "if you institute patent litigation against any entity including a cross claim or counterclaim"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "temple", "free software foundation inc 59 temple place"),
    ("gpl", "franklin", "free software foundation inc 51 franklin st(?:reet)?"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("gpl-2.0", "derivative", "the program or any derivative work under copyright law that is to say a work containing the program or a portion"),
    ("gpl-3.0", "convey", "you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "installation", "installation information for a user product means any methods procedures authorization keys"),
    ("lgpl", "library", "a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("lgpl-3.0", "combined", "a combined work is a work produced by combining or linking an application with the library"),
    ("agpl-3.0", "remotely", "must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", "with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "initial", "the initial developer of the original code is"),
    ("mpl-1.1", "basis", "software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind"),
    ("epl", "accompanying", "the accompanying program is provided under the terms of this eclipse public licen[cs]e"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", "cddl", "when distributing covered code include this cddl header in each file"),
    ("eupl", "eupl", "licensed under the eupl version 1 [12] or as soon they will be approved by the european commission"),
    ("boost-1.0", "machine", "are solely in the form of machine executable object code generated by a source language processor"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "successors", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("cc0", "affirmer", "to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights to"),
    ("ofl", "font", "the font software including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("ofl", "reserved", "no modified version of the font software may use the reserved font name"),
    ("artistic", "semblance", "the package s copyright holder maintains some semblance of artistic control over the development"),
    ("artistic-2.0", "package", "you are always permitted to make arbitrary changes to the package"),
    ("python", "beopen", "beopen com is making the software in source or binary form available|beopen com license agreement for python"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("lppl", "maintained", "this work has the lppl maintenance status maintained"),
    ("proprietary", "strictly", "(?:reproduction|distribution|copying)(?: of this .{1,40})? is strictly (?:prohibited|forbidden)"),
    ("proprietary", "trade", "contains (?:confidential information and )?trade secrets"),
    ("proprietary", "internal", "for internal use only"),
    ("proprietary", "consent", "without the (?:prior |express |prior written |express written )consent of"),
    ("eula", "end", "end user licen[cs]e agreement"),
    ("eula", "installing", "by installing copying or otherwise using the (?:software|product) you agree to be bound by"),
    ("no-derivatives", "derivative", "you may not create derivative works"),
    ("no-derivatives", "alter", "you may not alter transform or build upon this work"),
    ("reserved", "reserved", "all other rights(?: not expressly granted)?(?: herein)? are reserved"),
)

#: Pages on the web that hold a licence, as words.
LINKS: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "apache", "apache org licenses license 2 0"), ("mit", "mit", "opensource org licenses mit"), ("gpl", "gnu", "gnu org licenses(?: gpl)?(?: [23] 0)?"),
    ("lgpl", "lgpl", "gnu org licenses lgpl(?: [23] [01])?"), ("agpl", "agpl", "gnu org licenses agpl(?: 3 0)?"), ("mpl-2.0", "mozilla", "mozilla org mpl 2 0"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]"), ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]"), ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]"), ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"), ("unlicense", "unlicense", "unlicense org"), ("wtfpl", "wtfpl", "wtfpl net"),
    ("bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause"), ("bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause"),
    ("isc", "opensource", "opensource org licenses isc"), ("epl", "eclipse", "eclipse org legal epl(?: v[12]0)?"), ("ofl", "sil", "scripts sil org ofl"),
)

PRIORITY = {"identifier": 5, "granted": 4, "title": 3, "text": 3, "link": 2, "mention": 1}
CONFIDENCE = {"identifier": 0.99, "granted": 0.95, "title": 0.85, "text": 0.9, "link": 0.8, "mention": 0.5}
_GRANT = r"(?:licensed|released|distributed|available|published|provided|used|covered|governed)(?: .{1,30})? (?:under|by|with|in accordance with)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? "


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    kind: str
    keyword: bytes
    find: re.Pattern[bytes]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order. Grants come before titles, identifiers before both."""
    found: list[tuple[str, str, str, str]] = [(a, "identifier", k, f"(?:spdx )?licen[cs]e(?: identifier)? {e}") for a, k, e in IDENTIFIERS]
    for label, keyword, name, versions in FAMILIES:
        for v in versions:
            full = f"{label}-{'.'.join(v.split())}" if v else label
            at = f"(?:{name})" + (f"(?: licen[cs]e)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? (?:v)?{v}" if v else "")
            found += [(full, "granted", keyword, _GRANT + at), (full, "title", keyword, at)]
    found += [(a, "text", k, e) for a, k, e in TEXTS] + [(a, "link", k, e) for a, k, e in LINKS]
    found += [(a, "mention", k, f"(?:under (?:the )?|licen[cs]e )?{e}(?: licen[cs]ed?)?") for a, k, e in IDENTIFIERS if " " in e]
    return tuple(Rule(n, a, kind, k.encode(), re.compile(rb"(?<= )(?:" + e.encode() + rb")(?= )")) for n, (a, kind, k, e) in enumerate(found))


@cache
def _by_keyword() -> dict[bytes, tuple[Rule, ...]]:
    out: dict[bytes, list[Rule]] = {}
    for r in rules():
        out.setdefault(r.keyword, []).append(r)
    return {k: tuple(v) for k, v in out.items()}


_WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_PLAIN = bytes(int(LOWER[i]) if _WORD[LOWER[i]] else 0x20 for i in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def base_places(joined: bytes) -> list[tuple[int, int, str]]:
    """Start word, length in words and label of every base phrase, overlapping ones too."""
    out = []
    for phrase, label in BASE_PHRASES:
        mark, last, n = f" {phrase} ".encode(), 0, 0
        at = joined.find(mark)
        while at >= 0:
            n += joined.count(b" ", last, at)
            last = at
            out.append((n, phrase.count(" ") + 1, label))
            at = joined.find(mark, at + 1)
    return sorted(out)


def detections(present: set[bytes], joined: bytes) -> list[tuple[int, int, Rule]]:
    """Surviving (start, end, rule) in bytes of the joined words."""
    found = []
    gate = _by_keyword()
    for keyword in present & gate.keys():
        for rule in gate[keyword]:
            found += [(m.start(), m.end(), rule) for m in rule.find.finditer(joined)]
    found.sort(key=lambda d: (-PRIORITY[d[2].kind], d[0] - d[1], d[2].order, d[0]))
    # None of those taken lies inside another, so in the order of starts they are in the order of ends too.
    starts: list[int] = []
    ends: list[int] = []
    out: list[tuple[int, int, Rule]] = []
    for start, end, rule in found:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        at = bisect_left(starts, start)
        if at < len(starts) and ends[at] <= end:
            continue
        starts.insert(at, start)
        ends.insert(at, end)
        out.append((start, end, rule))
    return sorted(out, key=lambda d: (d[0], d[1], d[2].order))


_SPAN = pa.struct([("label", pa.string()), ("kind", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(_SPAN)), ("found", pa.list_(_SPAN)), ("score", pa.float64())])
SCHEMA = "doc_id long, n_words long, base array<struct<label string, kind string, start_word long, n_words long>>, found array<struct<label string, kind string, start_word long, n_words long>>, score double"


def scan_text(text: str) -> tuple[int, list[dict], list[dict], float]:
    ws = words(text)
    present = set(ws)
    if not present & (_by_keyword().keys() | {b"cc", b"general", b"reserved"}):
        return len(ws), [], [], 0.0
    joined = b" " + b" ".join(ws) + b" "
    base = [{"label": a, "kind": "base", "start_word": s, "n_words": n} for s, n, a in base_places(joined)]
    found, miss, at, n = [], 1.0, 0, 0
    for start, end, rule in detections(present, joined):
        n += joined.count(b" ", at, start)
        at = start
        found.append({"label": rule.label, "kind": rule.kind, "start_word": n - 1, "n_words": joined.count(b" ", start, end) + 1})
        miss *= 1 - CONFIDENCE[rule.kind]
    if base:
        miss *= 0.3
    return len(ws), base, found, round(1 - miss, 6)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [scan_text(t) for t in batch.column(1).to_pylist()]
        n, base, found, score = zip(*got, strict=True) if got else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_SPAN)), pa.array(score, pa.float64())], schema=_SCHEMA)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its word count, base places, the rules' detections by word interval, and a score."""
    return id_text(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)


def op4_license_scan(docs: DataFrame) -> DataFrame:
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in cols]))), ",")
    starts = F.transform("base", lambda x: x["start_word"])
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("base", "found").alias("labels"), "score", F.size("found").cast("long").alias("n_found"),
    )
