"""License scans by ordered signature rules, with DataFrame functions alone.

A rule is a regular expression over the words of a text (lower-cased in A-Z, one space between), a label, a priority and
keywords, of which every match holds one, and gates likewise. The gates of all rules are looked for in one pass, so that
few texts are left for the rules. Rules lie in groups with an expression that all their
matches hold; a rule's own is tried where its group's fits. Names in parentheses, such as (MIT), are found in the text itself,
for which a letter of Unicode's private use marks them. Of overlapping detections, one that lies inside another of the same or a better
priority is suppressed. The rules of BASE are always kept and are counted on their own.

Null and wordless texts have no detections and score 0. Texts are read whole; the work for a text grows with its length,
and ties between equal detections go to the better priority and then the first label. Rows that repeat an id and a text
get the same result each; an empty table gives an empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.base import ascii_lower, cut, normal_words, table

#: Phrase -> label, as the contract fixes them.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

LIC = "licen[cs]e"
#: label, keywords of which every match of the name holds one, name in running text, name after "under the", versions.
FAMILIES = [
    ("gpl", "gpl|general public", f"(?:gnu )?(?:general public {LIC}|gpl)", None, ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl|lesser general|library general", f"(?:gnu )?(?:(?:lesser|library) general public {LIC}|lgpl)", None, ("2.0", "2.1", "3.0")),
    ("agpl", "agpl|affero", f"(?:gnu )?(?:affero general public {LIC}|agpl)", None, ("1.0", "3.0")),
    ("gfdl", "free documentation", f"(?:gnu )?free documentation {LIC}", None, ("1.1", "1.2", "1.3")),
    ("apache", "apache", f"apache(?: software)? {LIC}", f"apache(?: software)?(?: {LIC})?", ("1.0", "1.1", "2.0")),
    ("mit", "mit|expat", f"(?:mit|expat) {LIC}", f"(?:mit|expat)(?: {LIC})?", ()),
    ("mit-0", "no attribution", f"mit no attribution(?: {LIC})?", None, ()),
    ("bsd", "bsd", f"bsd {LIC}", f"bsd(?: {LIC})?", ()),
    ("0bsd", "bsd", f"(?:0bsd|zero clause bsd)(?: {LIC})?", None, ()),
    ("bsd-1-clause", "bsd", f"(?:1|one) clause bsd(?: {LIC})?|bsd (?:1|one) clause(?: {LIC})?", None, ()),
    ("bsd-2-clause", "bsd", f"(?:2|two) clause bsd(?: {LIC})?|(?:simplified|freebsd) bsd {LIC}|bsd (?:2|two) clause(?: {LIC})?", None, ()),
    ("bsd-3-clause", "bsd", f"(?:3|three) clause bsd(?: {LIC})?|(?:new|modified|revised) bsd {LIC}|bsd (?:3|three) clause(?: {LIC})?", None, ()),
    ("bsd-4-clause", "bsd", f"(?:4|four) clause bsd(?: {LIC})?|(?:original|old) bsd {LIC}|bsd (?:4|four) clause(?: {LIC})?", None, ()),
    ("isc", "isc", f"isc {LIC}", f"isc(?: {LIC})?", ()),
    ("mpl", "mpl|mozilla", f"mozilla public {LIC}|mpl", None, ("1.0", "1.1", "2.0")),
    ("epl", "epl|eclipse", f"eclipse public {LIC}|epl", None, ("1.0", "2.0")),
    ("edl", "eclipse", f"eclipse distribution {LIC}", None, ("1.0",)),
    ("cddl", "cddl|common development", f"common development and distribution {LIC}|cddl", None, ("1.0", "1.1")),
    ("cpl", "common public", f"common public {LIC}", None, ("1.0",)),
    ("cpal", "common public", f"common public attribution {LIC}", None, ("1.0",)),
    ("eupl", "eupl|european union", f"european union public {LIC}|eupl", None, ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", f"artistic {LIC}", None, ("1.0", "2.0")),
    ("zlib", "zlib", f"zlib(?: libpng)? {LIC}", f"zlib(?: {LIC})?", ()),
    ("libpng", "libpng", f"libpng {LIC}", None, ("2.0",)),
    ("bsl", "boost", f"boost software {LIC}", None, ("1.0",)),
    ("busl", "business source", f"business source {LIC}", None, ("1.1",)),
    ("sspl", "server side", f"server side public {LIC}", None, ("1.0",)),
    ("elastic", "elastic", f"elastic {LIC}", None, ("2.0",)),
    ("unlicense", "unlicen", f"the unlicen[cs]e", "unlicen[cs]e", ()),
    ("wtfpl", "wtfpl", "wtfpl", None, ("2.0",)),
    ("cc0", "cc0|creative commons", f"cc0|creative commons zero(?: {LIC})?", None, ("1.0",)),
    ("cc-by", "cc by|creative commons", f"cc by|creative commons attribution(?: (?:unported|international))?(?: {LIC})?", None, ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc by sa|creative commons", f"cc by sa|creative commons attribution share ?alike(?: {LIC})?", None, ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc by nc|creative commons", f"cc by nc|creative commons attribution non ?commercial(?: {LIC})?", None, ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc by nd|creative commons", f"cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: {LIC})?", None, ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc by nc sa|creative commons", f"cc by nc sa|creative commons attribution non ?commercial share ?alike(?: {LIC})?", None, ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc by nc nd|creative commons", f"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: {LIC})?", None, ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("ofl", "open font", f"(?:sil )?open font {LIC}", None, ("1.0", "1.1")),
    ("odbl", "open database", f"open database {LIC}", None, ("1.0",)),
    ("odc-by", "open data", f"open data commons attribution {LIC}", None, ("1.0",)),
    ("pddl", "public domain dedication", f"public domain dedication and {LIC}", None, ("1.0",)),
    ("postgresql", "postgresql", f"postgresql {LIC}", None, ()),
    ("psf", "python|psf", f"(?:python software foundation|psf) {LIC}|python {LIC}", None, ("2.0",)),
    ("ruby", "ruby", f"ruby(?: s)? {LIC}", None, ()),
    ("php", "php", f"php {LIC}", None, ("3.0", "3.01")),
    ("openssl", "openssl", f"openssl {LIC}", None, ()),
    ("curl", "curl", f"curl {LIC}", None, ()),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LIC}", None, ()),
    ("ms-pl", "microsoft", f"microsoft public {LIC}", None, ()),
    ("ms-rl", "microsoft", f"microsoft reciprocal {LIC}", None, ()),
    ("afl", "academic free", f"academic free {LIC}", None, ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open software", f"open software {LIC}", None, ("1.0", "2.0", "2.1", "3.0")),
    ("sleepycat", "sleepycat", f"sleepycat {LIC}", None, ()),
    ("vim", "vim", f"vim {LIC}", None, ()),
    ("x11", "x11", f"x11 {LIC}", f"x11(?: {LIC})?", ()),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {LIC}", None, ()),
    ("qpl", "q public", f"q public {LIC}", None, ("1.0",)),
    ("lppl", "latex", f"latex project public {LIC}", None, ("1.0", "1.2", "1.3")),
    ("upl", "universal permissive", f"universal permissive {LIC}", None, ("1.0",)),
    ("mulan", "mulan", f"mulan (?:permissive software|psl)(?: {LIC})?", None, ("1.0", "2.0")),
    ("cecill", "cecill", f"cecill(?: free software)?(?: {LIC})", None, ("1.0", "2.0", "2.1")),
]
#: What a mention of these families holds if it need not hold "licen": short names are looked for as words.
SHORT = {
    **dict.fromkeys(("gpl", "lgpl", "agpl"), ("gpl", "lgpl", "agpl", "gnu", "general public licen", "lesser general", "library general", "affero general")), "mit-0": ("mit no attribution",), "mpl": ("mpl(?![^ ])", "licen"), "epl": ("epl(?![^ ])", "licen"),
    **dict.fromkeys(("0bsd", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause"), ("bsd", "0bsd", "zero clause bsd", "[1-4] clause bsd", "(?:one|two|three|four) clause bsd", "(?:simplified|freebsd|new|modified|revised|original|old) bsd")), "cddl": ("cddl", "licen"), "eupl": ("eupl", "licen"),
    "wtfpl": ("wtfpl",), "cc0": ("cc0", "creative commons"), "mulan": ("mulan",),
    **dict.fromkeys(("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"), ("cc by", "creative commons")),
}
#: Rules that belong to no family: label, keyword, expression, priority.
SINGLE = [
    ("public-domain", "public domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 1),
    ("public-domain", "public domain", "public domain(?: work| dedication)?", 3),
    ("proprietary", "all rights reserved", "all rights reserved", 3),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 3),
    ("copyright", "copyright", "copyright (?:c )?by", 3),
    ("licensed", "licen", "licen[cs]ed under", 3),
    ("licensed", "licen", "see (?:the )?licen[cs]e(?: file)?", 3),
]
#: The licenses' own wording, and the notices that they ask for: label, keyword, expression, priority.
WORDING = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1),
    ("mit", "the above copyright notice and this permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1),
    ("mit", "deal in the software", "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 1),
    ("mit", "authors or copyright holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 2),
    ("mit", "other dealings in the software", "out of or in connection with the software or the use or other dealings in the software", 2),
    ("mit-modern", "permission is hereby granted without written", "permission is hereby granted without written agreement and without licen[cs]e or royalty fees", 1),
    ("x11", "dealings in this software", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authori[sz]ation", 1),
    ("hpnd", "permission to use copy modify", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose(?: and without fee)? is hereby granted", 1),
    ("hpnd", "appear in supporting documentation", "both that copyright notice and this permission notice appear in supporting documentation", 2),
    ("isc", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 1),
    ("isc", "appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies", 1),
    ("isc", "the author disclaims all warranties", "the software is provided as is and the author disclaims all warranties", 2),
    ("0bsd", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided", 1),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 1),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 1),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 1),
    ("bsd-3-clause", "endorse or promote products", "neither the names? of (?:[0-9a-z]+ ){0,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software", 1),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1),
    ("bsd", "by the copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", 2),
    ("bsd", "by the regents and contributors", "this software is provided by the regents and contributors as is", 2),
    ("bsd-2-clause-views", "views and conclusions", "the views and conclusions contained in the software and documentation are those of the authors", 1),
    ("bsd-3-clause-clear", "no express or implied licen", "no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e", 1),
    ("apache-2.0", "you may not use this file except", "you may not use this file except in compliance with the licen[cs]e", 1),
    ("apache-2.0", "www apache org", "you may obtain a copy of the licen[cs]e at (?:https? )?www apache org licen[cs]es licen[cs]e 2 0", 1),
    ("apache-2.0", "without warranties or conditions", "distributed on an as is basis without warranties or conditions of any kind either express or implied", 1),
    ("apache-2.0", "terms and conditions for use", "terms and conditions for use reproduction and distribution", 2),
    ("apache-2.0", "each contributor hereby grants", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e", 1),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 1),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1),
    ("gpl", "this program is distributed in the hope", "this program is distributed in the hope that it will be useful but without any warranty", 1),
    ("gpl", "copy of the gnu general", "you should have received a copy of the gnu general public licen[cs]e along with this program", 1),
    ("gpl", "absolutely no warranty", "comes with absolutely no warranty", 3),
    ("gpl-2.0", "take away your freedom", "the licen[cs]es for most software are designed to take away your freedom to share and change it", 1),
    ("gpl-3.0", "free copyleft", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works", 1),
    ("gpl-3.0", "take away your freedom", "the licen[cs]es for most software and other practical works are designed to take away your freedom to share and change the works", 1),
    ("gpl-classpath", "special exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", 1),
    ("gpl-gcc", "gcc runtime library", "gcc runtime library exception", 1),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 1),
    ("lgpl", "copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this library", 1),
    ("lgpl-3.0", "terms and conditions of version 3", "incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e", 1),
    ("agpl-3.0", "interacting with it remotely", "offer all users interacting with it remotely through a computer network", 1),
    ("agpl", "copy of the gnu affero", "you should have received a copy of the gnu affero general public licen[cs]e", 1),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts", 1),
    ("gfdl", "permission is granted to copy", "permission is granted to copy distribute and or modify this document under the terms of", 1),
    ("mpl-2.0", "this source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e(?: v 2 0| version 2 0)?", 1),
    ("mpl-2.0", "incompatible with secondary", "incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e", 1),
    ("mpl-1.1", "contents of this file are subject", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", 1),
    ("npl", "netscape public", "netscape public licen[cs]e(?: version 1 [01])?", 2),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 1),
    ("cpl-1.0", "accompanying program", "the accompanying program is provided under the terms of this common public licen[cs]e", 1),
    ("cddl", "contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 1),
    ("eupl", "under the eupl", "licen[cs]ed under the eupl", 1),
    ("zlib", "without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented", 1),
    ("zlib", "plainly marked as such", "altered source versions must be plainly marked as such", 1),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation", 1),
    ("bsl-1.0", "person or organi", "to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation", 1),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain", 1),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", 1),
    ("wtfpl", "what the fuck you want", "do what the fuck you want to(?: public licen[cs]e)?", 1),
    ("beerware", "beer", "beer ?ware licen[cs]e|you can buy me a beer in return", 1),
    ("cc0", "dedicated the work", "has dedicated the work to the public domain by waiving all of (?:his|her|their) or? ?(?:her|his|their)? ?rights to the work worldwide under copyright law", 1),
    ("cc0", "no rights reserved", "no rights reserved", 3),
    ("cc", "creativecommons org", "creativecommons org licen[cs]es", 2),
    ("cc-by", "creativecommons org", "creativecommons org licen[cs]es by [1-4] [05]", 1),
    ("cc-by-sa", "creativecommons org", "creativecommons org licen[cs]es by sa [1-4] [05]", 1),
    ("cc-by-nc", "creativecommons org", "creativecommons org licen[cs]es by nc [1-4] [05]", 1),
    ("cc-by-nd", "creativecommons org", "creativecommons org licen[cs]es by nd [1-4] [05]", 1),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licen[cs]es by nc sa [1-4] [05]", 1),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licen[cs]es by nc nd [1-4] [05]", 1),
    ("cc0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 1),
    ("public-domain", "creativecommons org", "creativecommons org publicdomain mark 1 0", 1),
    ("cc-by", "you must give appropriate credit", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", 1),
    ("cc-by-sa", "distribute your contributions", "you must distribute your contributions under the same licen[cs]e as the original", 1),
    ("cc-by-nc", "the material for commercial purposes", "you may not use the material for commercial purposes", 1),
    ("cc-by-nd", "distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material", 1),
    ("ofl", "reserved font name", "with reserved font names?", 1),
    ("ofl", "this font software", "this font software is licen[cs]ed under the sil open font licen[cs]e", 1),
    ("artistic-2.0", "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 3),
    ("artistic-1.0", "artistic control", "semblance of artistic control over the development of the package", 1),
    ("perl", "same terms as perl", "(?:under|on) the same terms as perl(?: itself)?", 1),
    ("psf", "python software foundation", "this licen[cs]e agreement is between the python software foundation psf and the individual or organi[sz]ation", 1),
    ("php", "php software", "this product includes php software freely available from", 1),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 1),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young", 1),
    ("sspl-1.0", "as a service", "making the functionality of the program or modified version available to third parties as a service|offering the program as a service", 1),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service", 1),
    ("busl-1.1", "change date", "effective on the change date or the fourth anniversary of the first publicly available distribution", 1),
    ("commons-clause", "commons clause", "commons clause licen[cs]e condition", 1),
    ("json", "good not evil", "the software shall be used for good not evil", 1),
    ("ms-pl", "if you use the software", "if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software", 1),
    ("odbl", "open database", "made available under the open database licen[cs]e", 1),
    ("pddl", "public domain dedication and", "made available under the public domain dedication and licen[cs]e", 1),
    ("lppl", "latex project", "this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", 1),
    ("vim", "charityware", "vim is charityware", 1),
    ("postgresql", "without a written agreement", "for any purpose without fee and without a written agreement is hereby granted", 1),
    ("ncsa", "deal with the software", "to deal with the software without restriction", 1),
    ("curl", "to use copy modify and distribute this software for any purpose with or without fee", "to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 2),
    ("icu", "data files and any associated documentation", "obtaining a copy of the unicode data files and any associated documentation", 1),
    ("proprietary", "confidential and proprietary", "(?:company )?confidential and proprietary", 2),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: (?:copying|reproduction|use|or|and|distribution))*(?: of this (?:file|document|material|work))? (?:via any medium )?is strictly prohibited", 1),
    ("proprietary", "without the prior written", "may not be (?:reproduced|copied|published|distributed)(?: [0-9a-z]+){0,9} without the prior written (?:permission|consent)", 2),
    ("proprietary", "end user", "end user licen[cs]e agreement", 2),
    ("permissive", "free to use", "free to use (?:for any purpose|without restriction|and modify)", 3),
    ("royalty-free", "royalty free", "royalty free (?:licen[cs]e|use)", 3),
    ("non-commercial", "for non", "for non ?commercial (?:use|purposes?)(?: only)?", 2),
    ("research-only", "research purposes only", "for research purposes only", 2),
    ("attribution", "with attribution", "(?:may be )?(?:used|reproduced|shared|reused|republished) (?:freely )?with attribution", 3),
]
#: Words of which most wording holds one, as gates for it: few gates are quicker to look for than many.
COMMON = ("licen", "software", "copyright", "warrant", "creativecommons", "public domain")
#: How sure a detection of each priority is.
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.4}

VERBS = ("licensed", "licenced", "released", "distributed", "published", "available", "provided", "covered", "issued")
UNDER = f"(?:{'|'.join(VERBS)}) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:version [0-9]+ of (?:the )?)?"
LATER = "(?: or (?:at your option )?(?:any )?later(?: version)?)?"
#: Between "license" and an identifier: "SPDX-License-Identifier: MIT", "License: MIT", "the license is MIT".
NAMED = "(?:spdx )?licen[cs]es?(?: (?:identifier|expression|type|name|id|is))*"
#: Families whose short names carry a version, glued on or not: GPLv3, LGPLv2.1, Apache-2.0.
GLUED = ("gpl", "lgpl", "agpl", "gfdl", "apache", "mpl", "epl", "cddl", "eupl", "ofl", "odbl", "osl", "afl", "lppl", "cecill")
#: Words that are no license by themselves but are one in parentheses.
PARENTHESES = {"mit": "mit", "isc": "isc", "bsd": "bsd", "x11": "x11", "zlib": "zlib", "apache": "apache", "unlicense": "unlicense", "expat": "mit"}
MARK = "\ue000"


def _version(v: str, space: str = " ") -> str:
    major, minor = v.split(".")
    return f"{space}(?:version |v )?v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


def _whole(pattern: str) -> str:
    """A match is whole words: between spaces or ends."""
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def rules() -> list[dict]:
    """All rules in order: of each family and version a notice, a mention, identifiers and short forms, then single ones and the
    licenses' wording. A rule names its group; groups() tells what the matches of a group hold."""
    out = []

    def add(label: str, keyword: str, pattern: str, priority: int, base: bool = False, gates: Sequence[str] = (), group: str = "") -> None:
        keywords = keyword.split("|")
        out.append({"rule": len(out), "label": label, "keywords": keywords, "gates": list(gates or keywords), "priority": priority, "base": base, "group": group or f"{label} {len(out)}", "pattern": _whole(pattern)})

    for phrase, label in BASE.items():
        add(label, phrase, re.escape(phrase).replace("\\ ", " "), 2, True)
    for label, keyword, name, short, versions in FAMILIES:
        words = re.sub("[^a-z0-9]+", " ", label)
        begin = [k if len(k) > 3 else f"{k}(?![^ ])" for k in keyword.split("|")]
        for v in ("", *versions):
            full = label + (f"-{v}" if v else "")
            tail = _version(v) + LATER if v else ""
            only = "(?: only| or later)?" if "gpl" in label else ""
            own = words + (_version(v, " ?") if v else "")
            add(full, keyword, f"{UNDER}(?:{short or name}){tail}", 1, gates=SHORT.get(label, (*(begin if short else ()), "licen", "unlicen")), group=label)
            add(full, keyword, f"(?:{name}){tail}", 2, gates=SHORT.get(label, ("licen", "unlicen")), group=label)
            add(full, words, f"{NAMED} {own}{only}", 1, gates=("licen", "spdx"), group=label)
            add(full, words, f"{own} licen[cs]ed", 2, gates=("licen",), group=label)
            if v and label in GLUED:
                add(full, words, f"(?:gnu )?{own}(?:{only}|{LATER})", 2 if "gpl" in label else 3, gates=(f"{words} ?(?:version |v )?v?[0-9]",), group=label)
    add("bsd", "bsd style|bsd like|bsd type", f"bsd (?:style|like|type)(?: {LIC})?", 2, gates=("bsd",))
    add("mit", "mit style|mit like|mit type", f"mit (?:style|like|type) {LIC}", 2, gates=("licen",))
    for label, keyword, pattern, priority in (*SINGLE, *WORDING):
        certain = re.sub(r"\(\?:[^()]*\)(?:[?*]|\{0)", "", pattern)  # without what a match may lack
        common = [c for c in COMMON if re.search(f"(?:^| ){c}", certain) and "|" not in certain]
        add(label, keyword, pattern, priority, gates=common[:1])
    return out


def groups(own: list[dict]) -> dict[str, str]:
    """For each group an expression that some part of every match of its rules fits: a family's names, or the rule itself."""
    family = {label: (name, short, re.sub("[^a-z0-9]+", " ", label)) for label, _, name, short, _ in FAMILIES}
    out = {}
    for r in own:
        if r["group"] in family:
            name, short, words = family[r["group"]]
            out[r["group"]] = "(?<![^ ])(?:" + "|".join([name, *([short] if short else []), words]) + ")"
        else:
            out[r["group"]] = r["pattern"]
    return out


def _tree(words: list[str]) -> str:
    """An expression for any of the words or expressions, parted by their first letters, so that few are tried at a place. Longer
    ones come first where one begins with another."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0] if w[0].isalnum() else "", []).append(w)
    own = lambda ws: "|".join(sorted(ws, key=lambda w: (-len(w), w)))
    parts = [own(by.pop("", []))] + [f"{c}(?:{own([w[1:] for w in ws])})" for c, ws in sorted(by.items())]
    return "|".join(p for p in parts if p)


def gate(own: list[dict]) -> str:
    """The expression of the texts that any rule can match: any of the rules' gates, at the start of a word."""
    words = set()
    for g in {g for r in own for g in r["gates"]}:
        either = re.match(r"\(\?:([a-z|]+)\)(.*)", g)
        words |= {w + either[2] for w in either[1].split("|")} if either else {g}
    # a gate that starts with another adds nothing
    return "(?:^| )(?:" + _tree([w for w in words if not any(o != w and w.startswith(o) for o in words)]) + ")"


def _spaces(c):
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _gated(docs: DataFrame, doc_id: str, text: str, own: list[dict]) -> DataFrame:
    """row, k1 (id), k2 (hash), n_words, normal (the words of a text that passes the gates, else null) and named (words with marked
    names in parentheses, or null). Texts are gone through once and written only where a rule may match."""
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    rows = docs.select(docs[f"`{doc_id}`"].alias("k1"), t.alias("t"), normal_words(t).alias("words"))
    rows = rows.withColumn("open", F.rlike("words", F.lit(gate(own))))
    inside = "\\((" + "|".join(sorted(PARENTHESES)) + ")\\)"
    lower = ascii_lower(F.col("t"))
    named = F.when(F.col("open") & F.rlike(lower, F.lit(inside)), normal_words(F.regexp_replace(lower, inside, f" {MARK}$1 ")))
    n_words = F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long")
    rows = rows.select("k1", F.xxhash64("t").alias("k2"), n_words.alias("n_words"), F.when(F.col("open"), F.col("words")).alias("normal"), named.alias("named"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "gated")


def _present(normal, own: list[dict], names: list[str]):
    """Places in names of the groups of which a text has a keyword. A keyword begins where a word begins."""
    of_word: dict[str, set[int]] = {}
    for r in own:
        for k in r["keywords"]:
            of_word.setdefault(k, set()).add(names.index(r["group"]))
    # of keywords that begin alike the longest one is found, and counts for all that it begins with
    reach = {k: sorted(set().union(*(of_word[o] for o in of_word if k.startswith(o)))) for k in of_word}
    of_word = F.from_json(F.lit(json.dumps(reach)), "map<string,array<int>>")
    found = F.array_distinct(F.regexp_extract_all(normal, F.lit(f"(?<![^ ])(?=({_tree(list(reach))}))"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(found, lambda k: F.element_at(of_word, k))))


def _found(gated: DataFrame, own: list[dict]) -> DataFrame:
    """row, k1, k2, rule, label, priority, base, start and end of every match."""
    of_group = groups(own)
    names = list(of_group)
    table = [[{k: v for k, v in r.items() if k not in ("gates", "group")} for r in own if r["group"] == g] for g in names]
    table = F.from_json(F.lit(json.dumps(table)), "array<array<struct<rule:int,label:string,keywords:array<string>,priority:int,base:boolean,pattern:string>>>")
    normal, pattern = F.col("normal"), F.col("r.pattern")
    rows = gated.where("normal is not null").select("row", "k1", "k2", "normal", _present(normal, own, names).alias("gs"))
    fits = [F.when(F.array_contains("gs", i) & F.rlike(normal, F.lit(of_group[g])), F.lit(i)) for i, g in enumerate(names)]
    rows = rows.select("row", "k1", "k2", "normal", F.explode(F.filter(F.array(*fits), lambda i: i.isNotNull())).alias("g"))
    rows = rows.select("row", "k1", "k2", "normal", F.explode(F.get(table, F.col("g"))).alias("r")).where(F.exists("r.keywords", lambda k: F.contains("normal", k)) & F.rlike(normal, pattern))
    # each match's first word is marked, so that its place is found in one pass over the words, however many matches there are
    marked = F.split(F.regexp_replace(normal, pattern, F.lit("\x01$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)), lambda i: i.isNotNull())
    more = F.transform(F.regexp_extract_all(normal, pattern, F.lit(0)), _spaces)
    rows = rows.select("row", "k1", "k2", "r", F.explode(F.arrays_zip(starts.alias("start"), more.alias("more"))).alias("m"))
    worded = rows.select("row", "k1", "k2", "r.rule", "r.label", "r.priority", "r.base", "m.start", (F.col("m.start") + F.col("m.more") + 1).alias("end"))
    labels = F.create_map(*[F.lit(x) for k, v in PARENTHESES.items() for x in (MARK + k, v)])
    in_text = gated.where("named is not null").select("row", "k1", "k2", F.posexplode(F.split("named", " ")).alias("start", "w")).where(F.startswith("w", F.lit(MARK)))
    in_text = in_text.withColumn("label", F.try_element_at(labels, F.col("w"))).where("label is not null")
    return worded.unionByName(in_text.select("row", "k1", "k2", F.lit(-1).alias("rule"), "label", F.lit(2).alias("priority"), F.lit(False).alias("base"), "start", (F.col("start") + 1).alias("end")))


def detections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", own: list[dict] | None = None) -> DataFrame:
    """(k1, k2, rule, label, priority, base, start, end) of every match; words from 0, end exclusive; k1 and k2 are id and hash.

    Rule -1 is a name in parentheses. Rows that repeat an id and a text have their matches once.
    """
    own = rules() if own is None else own
    return _found(_gated(docs, doc_id, text, own), own).drop("row").distinct()


def survivors(found: DataFrame, doc: Sequence[str] = ("k1", "k2")) -> DataFrame:
    """Detections that lie inside no other of the same document with the same or a better priority."""
    order = Window.partitionBy(*doc).orderBy("start", F.desc("end"), "priority", "label", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None)
    for p in sorted(CONFIDENCE, reverse=True):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order)).otherwise(reach)
    return found.withColumn("reach", reach).where("reach is null or reach < end").drop("reach")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", own: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, for every row of docs."""
    own = rules() if own is None else own
    gated = _gated(docs, doc_id, text, own)
    found = cut(_found(gated, own), "detections")
    base = found.where("base").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.collect_set("label").alias("base_labels"),
    )
    confidence = F.lit(0.0)
    for p, c in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == p, F.lit(c)).otherwise(confidence)
    more = survivors(found, ["row"]).groupBy("row").agg(F.collect_set("label").alias("labels"), F.max(confidence).alias("score"))
    per_row = cut(more.join(base, "row", "left"), "licenses")
    out = gated.select("row", F.col("k1").alias("doc_id"), "n_words").join(per_row, "row", "left")
    none = F.array().cast("array<string>")
    basic, every = F.coalesce("base_labels", none), F.coalesce("labels", none)
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(basic), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(basic, every)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
