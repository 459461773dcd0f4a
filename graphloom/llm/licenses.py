"""License scans by ordered signature rules.

A text is normalised to lower-case words joined by one space, so that a rule
sees "CC BY-NC 4.0" as ``cc by nc 4 0`` whatever the punctuation and line
breaks.  The rules are the product of hand-written name patterns and
hand-written sentence templates, and signatures of what the licenses themselves
say, for texts that don't name theirs.  Each has a keyword and the anchor words of
its template; only rules whose keyword and anchors stand in the text are tried,
after one cheap test for any keyword at all.  A detection is an interval of
words.  One that lies inside an interval of a rule of the same or a better
priority is suppressed.

Style: DataFrame functions only; one pass, no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import constants, let, spaced_words, table
from graphloom.llm.spans import BLOCK, blocks, find_all, piece, running

#: The base: label and phrase.  The places of these phrases are counted in every text.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
BASE_FORM = r"(?<![^ ])(?:mit|apache|general public) license(?![^ ])"

_V = "(?: version)?(?: v)?"

#: label, keyword, pattern of the name in normalised words, whether the name alone says enough (None: only with the word license after it).
#: Every match has a word that starts with the keyword.
NAMES = (
    ("mit", "mit", r"mit", False),
    ("mit-0", "attribution", r"mit no attribution", True),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license)?{_V} 1 1", True),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: license)?{_V} 2(?: 0)?", True),
    ("apache-2.0", "asl", rf"asl{_V} 2(?: 0)?", False),
    ("gpl-1.0", "general", rf"(?:gnu )?general public license{_V} 1(?: 0)?", True),
    ("gpl-2.0", "general", rf"(?:gnu )?general public license{_V} 2(?: 0)?", True),
    ("gpl-3.0", "general", rf"(?:gnu )?general public license{_V} 3(?: 0)?", True),
    ("gpl", "gpl", r"(?:gnu )?gpl", True),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl(?:v2|{_V} 2(?: 0)?)", True),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl(?:v3|{_V} 3(?: 0)?)", True),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", True),
    ("lgpl", "library", r"(?:gnu )?library general public", True),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public license{_V} 2 1", True),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public license{_V} 3(?: 0)?", True),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:v[23])?", True),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public license{_V} 3(?: 0)?", True),
    ("agpl", "affero", r"(?:gnu )?affero general public", True),
    ("agpl", "agpl", r"agpl(?:v3)?", True),
    ("gfdl", "documentation", r"(?:gnu )?free documentation", False),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)", False),
    ("bsd-2-clause", "freebsd", r"freebsd", False),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", True),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)", True),
    ("bsd", "bsd", r"bsd(?: style)?", False),
    ("0bsd", "0bsd", r"0bsd", True),
    ("isc", "isc", r"isc", False),
    ("zlib", "zlib", r"zlib(?: libpng)?", False),
    ("mpl-1.1", "mozilla", rf"mozilla public(?: license)?{_V} 1 1", True),
    ("mpl-2.0", "mozilla", rf"mozilla public(?: license)?{_V} 2(?: 0)?", True),
    ("mpl", "mozilla", r"mozilla public", True),
    ("mpl-2.0", "mpl", r"mpl 2(?: 0)?", True),
    ("epl-1.0", "eclipse", rf"eclipse public(?: license)?{_V} 1(?: 0)?", True),
    ("epl-2.0", "eclipse", rf"eclipse public(?: license)?{_V} 2(?: 0)?", True),
    ("edl-1.0", "eclipse", r"eclipse distribution", False),
    ("cddl", "cddl", r"cddl(?: 1 [01])?", True),
    ("cddl", "development", r"common development and distribution", True),
    ("cpl-1.0", "common", r"common public license(?: 1 0)?", True),
    ("artistic-1.0", "artistic", rf"artistic(?: license)?{_V} 1(?: 0)?", True),
    ("artistic-2.0", "artistic", rf"artistic(?: license)?{_V} 2(?: 0)?", True),
    ("artistic", "artistic", r"artistic", None),
    ("bsl-1.0", "boost", rf"boost software(?: license)?{_V}(?: 1 0)?", True),
    ("busl-1.1", "business", r"business source license(?: 1 1)?", True),
    ("sspl-1.0", "server", r"server side public", True),
    ("elastic-2.0", "elastic", r"elastic license(?: v2| 2 0)?", True),
    ("unlicense", "unlicense", r"(?:the )?unlicense", True),
    ("wtfpl", "wtfpl", r"wtfpl", True),
    ("python-2.0", "python", r"python(?: software foundation)?", False),
    ("php-3.0", "php", r"php", False),
    ("ruby", "ruby", r"ruby", None),
    ("postgresql", "postgresql", r"postgresql", False),
    ("openssl", "openssl", r"openssl", False),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", False),
    ("x11", "x11", r"x11", False),
    ("ms-pl", "microsoft", r"microsoft public", False),
    ("ms-rl", "microsoft", r"microsoft reciprocal", False),
    ("eupl-1.2", "european", r"european union public", True),
    ("ofl-1.1", "sil", r"sil open font", True),
    ("odbl-1.0", "database", r"open (?:data commons open )?database", False),
    ("odc-by-1.0", "commons", r"open data commons attribution", True),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?", True),
    ("cc-by", "cc", r"cc by", True),
    ("cc-by-4.0", "cc", r"cc by 4 0", True),
    ("cc-by-sa", "cc", r"cc by sa", True),
    ("cc-by-nc", "cc", r"cc by nc", True),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0", True),
    ("cc-by-nd", "cc", r"cc by nd", True),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", True),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", True),
    ("cc-by", "commons", r"creative commons attribution", True),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike", True),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial", True),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s", True),
    ("public-domain", "domain", r"public domain", False),
    ("llama", "llama", r"llama(?: [23])?(?: [0-9])? community", True),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?", True),
    ("openrail", "rail", r"(?:creativeml )?open rail(?: m)?", True),
    ("proprietary", "proprietary", r"proprietary", None),
)

_GRANT = r"(?:(?:licensed|licenced|released|distributed|available|published|provided|redistributed)(?: to you)? under|(?:covered|governed) (?:under|by))"
_TERMS = r"(?: either)?(?: the)?(?: terms(?: and conditions)? of)?(?: an?| the)?"
_LICENSE = r"(?: public| software| general| community)? licen[cs]es?"

#: Words, of which a text must hold one for the templates that name the group to match anywhere.
ANCHORS = {"none": (), "spdx": (" spdx ",), "grant": (" under ", " by "), "license": (" licen",), "either": (" licen", " spdx ")}

#: priority (1 is best), score, anchors, template; the last is used for names that say enough alone.
TEMPLATES = (
    (1, 1.0, "spdx", r"spdx license identifier {name}"),
    (2, 0.95, "grant", _GRANT + _TERMS + r" {name}{license}(?: version [0-9](?: [0-9])?)?"),
    (3, 0.9, "license", r"(?:see|read|accompanying|subject to|terms of|copy of|accept)(?: the)? {name}" + _LICENSE),
    (4, 0.8, "license", r"{name}" + _LICENSE + r"(?: version [0-9](?: [0-9])?)?"),
    (4, 0.75, "either", r"(?:licen[cs]es?|licen[cs]ed|spdx) (?:is )?(?:the )?{name}"),
    (5, 0.6, "none", r"{name}"),
)

_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal {} the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
_FSF = "general public license as published by the free software foundation (?:either )?version "

#: label, keyword and pattern of what a license's own text or header says, whether it is named or not.
SIGNATURES = (
    ("mit", "hereby", _MIT_GRANT.format("in") + "subject to"),
    ("mit-0", "hereby", _MIT_GRANT.format("in") + "the software is provided"),
    ("ncsa", "hereby", _MIT_GRANT.format("with") + "subject to"),
    ("isc", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("postgresql", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsl-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "materials", r"materials provided with the distribution this software is provided"),
    ("bsd-3-clause", "materials", r"materials provided with the distribution (?:3 )?(?:neither the name|the names? of)"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "hereby", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl-2.0", "foundation", rf"gnu {_FSF}2"),
    ("gpl-3.0", "foundation", rf"gnu {_FSF}3"),
    ("lgpl-2.1", "foundation", rf"gnu lesser {_FSF}2 1"),
    ("lgpl-3.0", "foundation", rf"gnu lesser {_FSF}3"),
    ("agpl-3.0", "foundation", rf"gnu affero {_FSF}3"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("cc0-1.0", "neighboring", r"waived all copyright and related or neighboring rights"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "tort", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("hpnd", "hereby", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("ntp", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("tcl", "hereby", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("w3c", "royalty", r"permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "contributors", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "png", r"the png reference library is supplied as is"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("php-3.0", "php", r"this product includes php software freely available from"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "hereby", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0", "trademarks", r"this license does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("ecl-2.0", "educational", r"licensed under the educational community license version 2 0"),
    ("gpl-1.0", "foundation", rf"gnu {_FSF}1"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2.0", "guarantee", r"the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("gpl-3.0", "guarantee", r"the gnu general public license is intended to guarantee your freedom to share and change all versions of a program"),
    ("lgpl", "merchantability", r"this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.0", "library", rf"gnu library {_FSF}2"),
    ("lgpl-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", "affero", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "interacting", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("perl", "perl", r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic-1.0", "artistic", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2.0", "establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("mpl-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1.0", "eclipse", r"the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl-1.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?|version )?2 0"),
    ("cpl-1.0", "accompanying", r"the accompanying program is provided under the terms of this common public license agreement"),
    ("ipl-1.0", "ibm", r"the accompanying program is provided under the terms of this ibm public license agreement"),
    ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version)?(?: v)? ?1 2"),
    ("afl-3.0", "academic", r"licensed under the academic free license version 3 0"),
    ("osl-3.0", "osl", r"open software license osl v ?3 0"),
    ("upl-1.0", "universal", r"the universal permissive license upl version 1 0"),
    ("ms-pl", "governs", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("busl-1.1", "production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "clause", r"commons clause license condition"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use) license"),
    ("unlicense", "compiled", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("cc0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-4.0", "commons", r"creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "commons", r"creative commons attribution share ?alike 4 0 international"),
    ("cc-by-nc-4.0", "commons", r"creative commons attribution non ?commercial 4 0 international"),
    ("cc-by-nd-4.0", "commons", r"creative commons attribution no ?derivatives 4 0 international"),
    ("cc-by-nc-sa-4.0", "commons", r"creative commons attribution non ?commercial share ?alike 4 0 international"),
    ("cc-by-nc-nd-4.0", "commons", r"creative commons attribution non ?commercial no ?derivatives 4 0 international"),
    ("cc-by-3.0", "commons", r"creative commons attribution 3 0 unported"),
    ("cc-by-sa-3.0", "commons", r"creative commons attribution share ?alike 3 0 unported"),
    ("cc-by-nc-3.0", "commons", r"creative commons attribution non ?commercial 3 0 unported"),
    ("cc-by-nc-sa-3.0", "commons", r"creative commons attribution non ?commercial share ?alike 3 0 unported"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "collaborative", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("odbl-1.0", "database", r"this (?:[^ ]+ ){0,6}is made available under the open database license"),
    ("pddl-1.0", "dedication", r"open data commons public domain dedication and license"),
    ("llama", "monthly", r"the monthly active users of the products or services made available by or for licensee"),
    ("openrail", "attachment", r"the restrictions set forth in attachment a are considered use based restrictions"),
    ("bigcode-openrail-m", "bigcode", r"bigcode open ?rail m"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("proprietary", "confidential", r"this software is the confidential and proprietary information of"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
)

#: What reserves all rights and grants none; it ranks last.
RESERVED = ("all-rights-reserved", "reserved", r"all rights reserved")

#: Of all signatures: priority, score and anchors.
SIGNED = (2, 0.95, "none")

#: Score of a text in which only the base finds anything.
BASE_SCORE = 0.7


class Rule(NamedTuple):
    rule: int
    priority: int
    score: float
    label: str
    keyword: str
    anchor: int
    pattern: str


def rules() -> list[Rule]:
    """All rules in order: by priority, then as the names and templates are listed.

    A name that states a version ranks with sentences, so that it stands against the name in them without.
    """
    whole = lambda pattern: rf"(?<![^ ]){pattern}(?![^ ])"
    made = [
        (min(priority, 4) if label[-1].isdigit() else priority, score, label, keyword, list(ANCHORS).index(anchor), whole(template.replace("{name}", f"(?:{name})").replace("{license}", _LICENSE if alone is None else f"(?:{_LICENSE})?")))
        for priority, score, anchor, template in TEMPLATES
        for label, keyword, name, alone in NAMES
        if alone or priority < 5
    ]
    none = list(ANCHORS).index("none")
    priority, score, _ = SIGNED
    made += [(priority, score, label, keyword, none, whole(pattern)) for label, keyword, pattern in SIGNATURES]
    label, keyword, pattern = RESERVED
    made.append((max(t[0] for t in TEMPLATES), 0.5, label, keyword, none, whole(pattern)))
    return [Rule(k, *x) for k, x in enumerate(sorted(made, key=lambda x: x[0]))]


_ROW = "struct<start:int,end:int,priority:int,rule:int,label:string,score:double>"
_FOUND = f"array<{_ROW}>"
_BASE = "array<struct<word:bigint,label:string>>"
_PLACED = "array<struct<start:bigint,end:bigint,priority:int,rule:int,label:string,score:double>>"


def _detections(spaced: Column) -> Column:
    """All rules' matches in ``spaced``, by start, longest first, then by priority and rule."""
    padded = F.concat(F.lit(" "), spaced, F.lit(" "))
    keywords = constants(sorted({r.keyword for r in rules()}))

    def some(words: tuple[str, ...]) -> Column:
        out = F.lit(not words)
        for w in words:
            out = out | F.contains(padded, F.lit(w))
        return out

    gates = F.struct(F.filter(keywords, lambda k: F.contains(padded, F.concat(F.lit(" "), k))).alias("keywords"), F.array(*map(some, ANCHORS.values())).alias("anchors"))
    tried = let(gates, lambda g: F.filter(constants(rules()), lambda r: F.get(g["anchors"], r["anchor"]) & F.array_contains(g["keywords"], r["keyword"])))
    found = F.transform(
        tried,
        lambda r: F.transform(
            find_all(spaced, r["pattern"]),
            lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["score"].alias("score")),
        ),
    )
    return F.transform(
        F.array_sort(F.flatten(found)),
        lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["score"].alias("score")),
    )


def _unsuppressed(found: Column) -> Column:
    """Drops each detection that an earlier one of the same or a better priority contains.

    In the order of ``_detections`` whatever contains a detection stands before
    it, so the furthest end for each priority so far is all there is to know.
    """
    levels = sorted({r.priority for r in rules()})

    def step(state: Column, d: Column) -> tuple[Column, Column]:
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((d["priority"] >= p) & (state[f"e{p}"] >= d["end"]))
        ends = F.struct(*[F.when(d["priority"] == p, F.greatest(state[f"e{p}"], d["end"])).otherwise(state[f"e{p}"]).alias(f"e{p}") for p in levels])
        return ends, F.when(~inside, d)

    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in levels])
    return F.filter(running(found, start, _ROW, step), lambda d: d.isNotNull())


def _any_keyword(spaced: Column) -> Column:
    """One regex for all keywords, by first letter, so that most words are passed over after one."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted({r.keyword for r in rules()}):
        by_letter.setdefault(word[0], []).append(word[1:])
    words = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return spaced.rlike(rf"(?:^| )(?=[{''.join(by_letter)}])(?:{words})")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, base places and the detections that stand.

    ``doc_id, n_words, base`` (first words of the base phrases' places, in
    order, with labels) and ``found`` (array of start, end, priority, rule,
    label, score; words, ends exclusive).  Null, empty and wordless texts have
    none; of detections at one place the better priority, then the earlier rule
    stands.  Long texts are read whole, repeated rows each give their row, null
    ids stay null, an empty table gives no rows, and other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), spaced_words(F.col(text_col).cast("string")).alias("s"))

    def spaces(x: Column) -> Column:
        return (F.length(x) - F.length(F.translate(x, " ", ""))).cast("long")

    def words_before(held: Column, at: Column) -> Column:
        block = F.floor(at / BLOCK).cast("int")
        return F.get(held["before"], block) + spaces(F.substring(F.get(held["blocks"], block), F.lit(1), at - block * BLOCK))

    def places(s: Column, held: Column) -> Column:
        base = F.when(
            F.contains(s, F.lit(" license")),
            F.transform(
                find_all(s, BASE_FORM),
                lambda m: F.struct(words_before(held, m["start"]).alias("word"), F.when(F.startswith(m["value"], F.lit("mit")), "mit").when(F.startswith(m["value"], F.lit("apache")), "apache").otherwise("gpl").alias("label")),
            ),
        ).otherwise(F.array().cast(_BASE))
        found = F.when(_any_keyword(s), _unsuppressed(_detections(s))).otherwise(F.array().cast(_FOUND))
        placed = F.transform(
            found,
            lambda d: let(
                words_before(held, d["start"]),
                lambda w: F.struct(w.alias("start"), (w + spaces(piece(held["blocks"], d["start"], d["end"] - d["start"])) + 1).alias("end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["score"].alias("score")),
            ),
        )
        return F.struct(base.alias("base"), placed.alias("found"))

    def of(s: Column) -> Column:
        n_words = F.when(s == "", F.lit(0)).otherwise(spaces(s) + 1).cast("long")
        held = let(blocks(s), lambda b: F.struct(b.alias("blocks"), running(b, F.lit(0).cast("long"), "bigint", lambda n, x: (n + spaces(x), n)).alias("before")))
        some = F.contains(s, F.lit(" license")) | _any_keyword(s)
        none = F.struct(F.array().cast(_BASE).alias("base"), F.array().cast(_PLACED).alias("found"))
        return let(F.when(some, let(held, lambda h: places(s, h))).otherwise(none), lambda x: F.struct(n_words.alias("n_words"), x["base"].alias("base"), x["found"].alias("found")))

    return texts.select("doc_id", let(F.col("s"), of).alias("x")).select("doc_id", "x.n_words", "x.base", "x.found")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """``scan_licenses`` over all of ``documents``, as counts, labels and a score."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base, more = F.transform("base", lambda b: b["label"]), F.transform("found", lambda d: d["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda d: d["score"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["word"])).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, more)).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
    )


def _op2_sql() -> str:
    """The same rules for an engine without look-around: each word is padded by its own spaces."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    bare = lambda r: r.pattern.removeprefix(r"(?<![^ ])").removesuffix(r"(?![^ ])")
    # an optional word keeps its space inside its group, so doubling spaces in the pattern is safe
    listed = ",\n  ".join(f"({r.rule}, {r.priority}, {r.score}, {quoted(r.label)}, {quoted(' ' + r.keyword)}, {quoted(' ' + bare(r).replace(' ', '  ') + ' ')})" for r in rules())
    return rf"""
WITH rules(rule, priority, score, label, keyword, pattern) AS (VALUES
  {listed}),
d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
padded AS (SELECT uid, doc_id, w, CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS s FROM d),
pairs AS (SELECT uid, s, rules.* FROM padded JOIN rules ON contains(s, keyword)),
parts AS (SELECT uid, rule, priority, score, label, regexp_extract_all(s, pattern) AS m, string_split_regex(s, pattern) AS g FROM pairs WHERE regexp_matches(s, pattern)),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM parts),
spans AS (
  SELECT uid, rule, priority, score, label, m[k] AS t,
         coalesce(list_sum(list_transform(g[1:k], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0) AS a,
         coalesce(list_sum(list_transform(g[1:k], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:k], lambda x: len(x))), 0) AS b
  FROM each
),
kept AS (
  SELECT * FROM spans AS x WHERE NOT EXISTS (
    SELECT 1 FROM spans AS y
    WHERE y.uid = x.uid AND y.priority <= x.priority AND y.a <= x.a AND y.b >= x.b
      AND (y.a < x.a OR y.b > x.b OR y.priority < x.priority OR y.rule < x.rule))
),
base AS (
  SELECT uid, p - 1 AS p, CASE w[p] WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' ELSE 'gpl' END AS label
  FROM (SELECT uid, w, unnest(range(1, len(w) + 1)) AS p FROM d)
  WHERE (w[p] IN ('mit', 'apache') AND w[p + 1] = 'license') OR (w[p] = 'general' AND w[p + 1] = 'public' AND w[p + 2] = 'license')
),
b AS (SELECT uid, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY uid),
l AS (SELECT uid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT uid, label FROM base UNION ALL SELECT uid, label FROM kept) GROUP BY uid),
s AS (SELECT uid, max(score) AS score FROM (SELECT uid, CAST(score AS DOUBLE) AS score FROM kept UNION ALL SELECT uid, CAST({BASE_SCORE} AS DOUBLE) FROM base) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first AS BIGINT) AS first_word, CAST(b.last AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(s.score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN b USING (uid) LEFT JOIN l USING (uid) LEFT JOIN s USING (uid)
"""


OP2_SQL = _op2_sql()
